"""Configuration of a corpus build: one table of settings, read from and written to nested JSON."""

from __future__ import annotations

import json
from copy import deepcopy
from pathlib import Path
from typing import Any

# Keys of configuration files, where they stand in the file (empty: at the top), kinds and defaults.
SETTINGS = """
input          sections              list    null
input          sources               dict    null
               mask                  dict    {}
               mask_default          text    "mask"
preprocessing  max_seq_len           whole   2048
preprocessing  min_chars             whole   50
preprocessing  max_chars             whole   2000000
preprocessing  max_items             whole   null
preprocessing  batch_size            whole   256
preprocessing  packing_strategy      text    "simple"
preprocessing  max_packed_len        whole   8192
preprocessing  truncation_mode       text    "keep_start"
output         domain_key            text    null
output         storage_format        text    "bin"
output         max_tokens_per_shard  whole   100000000
output         dtype                 dict    {}
output         position_ids_mode     text    "doc_reset"
"""


def _table() -> dict[str, tuple[str, str, Any]]:
    rows = {}
    for line in SETTINGS.strip("\n").splitlines():
        place, rest = line[:15].strip(), line[15:].split(None, 2)
        rows[rest[0]] = (place, rest[1], json.loads(rest[2]))
    return rows


TABLE = _table()


class BuildConfig:
    """Settings by their own names (``config.max_seq_len``); a change makes a new configuration."""

    def __init__(self, **settings: Any):
        if unknown := settings.keys() - TABLE.keys():
            raise TypeError(f"unknown settings {sorted(unknown)}")
        self._values = {name: self._fitting(kind, settings[name]) if name in settings else deepcopy(default) for name, (_, kind, default) in TABLE.items()}

    @staticmethod
    def _fitting(kind: str, value: Any) -> Any:
        return int(value) if kind == "whole" and isinstance(value, float) and value.is_integer() else value

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __eq__(self, other: object) -> bool:
        return isinstance(other, BuildConfig) and self._values == other._values

    def changed(self, **settings: Any) -> BuildConfig:
        return BuildConfig(**(deepcopy(self._values) | settings))

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> BuildConfig:
        """Unknown keys are dropped, numbers like 64.0 become whole."""
        found = {}
        for name, (place, _, _) in TABLE.items():
            group = values.get(place) or {} if place else values
            if name in group:
                found[name] = group[name]
        return cls(**found)

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for name, (place, _, _) in TABLE.items():
            (out.setdefault(place, {}) if place else out)[name] = deepcopy(self._values[name])
        return out

    @classmethod
    def from_file(cls, path: str) -> BuildConfig:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

    def to_file(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2, ensure_ascii=False), encoding="utf-8")
