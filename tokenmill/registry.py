"""Named extension points: mask builders, packers, position ids, stores, tokenizers, schedules, checks."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any


class Registry:
    """Factory by name. A second registration of a name is a ValueError, a wrong kind a TypeError."""

    def __init__(self, base: type | None = None):
        self.base, self._made = base, {}

    def register(self, name: str) -> Callable:
        def keep(thing):
            if name in self._made:
                raise ValueError(f"{name!r} is registered already")
            if self.base is not None and not (inspect.isclass(thing) and issubclass(thing, self.base)):
                raise TypeError(f"{thing!r} is no {self.base.__name__}")
            self._made[name] = thing
            return thing

        return keep

    def get(self, name: str):
        if name not in self._made:
            raise ValueError(f"unknown name {name!r}; known: {', '.join(self.list_registered())}")
        return self._made[name]

    def create(self, name: str, **kwargs: Any):
        """Call the registered thing with those arguments that it takes."""
        made = self.get(name)
        takes = inspect.signature(made).parameters
        if not any(p.kind is p.VAR_KEYWORD for p in takes.values()):
            kwargs = {k: v for k, v in kwargs.items() if k in takes}
        return made(**kwargs)

    def list_registered(self) -> list[str]:
        return sorted(self._made)

    def is_registered(self, name: str) -> bool:
        return name in self._made
