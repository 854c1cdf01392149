"""Stateful decoding: text deltas from token bytes, stops, tool-call deltas, the task queue and refreshes.

The transitions are plain functions of (state, event); ``run_keyed`` makes a stateful
stream of one, and tests drive them token by token.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tokenmill.functions.toolcalls import content_before, find_calls

STATE = StructType([StructField("json", StringType())])


def decode_step(state: dict, data: bytes, last: bool = False) -> str:
    """Text that has become certain: bytes of an unfinished character wait; at the end they are flushed."""
    held = bytes.fromhex(state.get("held", "")) + data
    text = held.decode("utf-8", "replace")
    if not last and text.endswith("�"):
        cut = next((k for k in (1, 2, 3) if len(held) >= k and not held[:-k].decode("utf-8", "replace").endswith("�")), 0)
        if cut:
            state["held"] = held[-cut:].hex()
            return held[:-cut].decode("utf-8", "replace")
        state["held"] = held.hex()
        return ""
    state["held"] = ""
    return text


def stop_step(state: dict, delta: str, stops: list[str]) -> tuple[str, str | None]:
    """What may be shown of the body so far and the stop that ended it (the first in the list's order).

    The end of the body that could still become a stop waits.
    """
    if state.get("stop"):
        return "", state["stop"]
    body = state.get("body", "") + delta
    shown = state.get("shown", 0)
    hit = next((s for s in stops if s and s in body), None)
    if hit:
        end = body.index(hit)
        state |= {"stop": hit, "body": body, "shown": end}
        return body[shown:end] if end > shown else "", hit
    wait = max((k for s in stops for k in range(1, len(s)) if body.endswith(s[:k])), default=0)
    end = max(shown, len(body) - wait)
    state |= {"body": body, "shown": end}
    return body[shown:end], None


def tool_step(state: dict, delta: str) -> list[dict]:
    """Events of a growing text: content before the first call, each name once, new ends of arguments.

    What an object shows before its name is there counts as content, since it may turn out to be none.
    """
    text = state["text"] = state.get("text", "") + delta
    calls, out = find_calls(text), []
    body = content_before(text, calls)
    sent = state.setdefault("content", 0)
    if len(body) > sent:
        out.append({"type": "content", "text": body[sent:]})
        state["content"] = len(body)
    known = state.setdefault("calls", [])
    for i, call in enumerate(calls):
        if i == len(known):
            known.append("")
            out.append({"type": "name", "index": i, "text": call["name"]})
        if len(call["arguments"]) > len(known[i]):
            out.append({"type": "arguments", "index": i, "text": call["arguments"][len(known[i]) :]})
            known[i] = call["arguments"]
    return out


def admit(prompt: list[int], max_tokens: int, max_prompt: int, max_seq: int) -> tuple[list[int], int] | None:
    """The last ``max_prompt`` ids and the tokens that fit behind them; None if nothing fits."""
    kept = prompt[-max_prompt:]
    return None if len(kept) >= max_seq else (kept, min(max_tokens, max_seq - len(kept)))


def finished(output: list[int], max_tokens: int, stop_ids: list[int]) -> bool:
    return len(output) >= max_tokens or bool(output and output[-1] in stop_ids)


@dataclass
class TaskQueue:
    """First come, first served: waiting, active (at most ``slots``), done. What can't be placed goes back to the front."""

    slots: int
    waiting: list[str] = field(default_factory=list)
    active: list[str] = field(default_factory=list)
    done: dict[str, str] = field(default_factory=dict)

    def add(self, task: str) -> None:
        self.waiting.append(task)

    def refill(self, place: Callable[[str], bool] = lambda _: True) -> list[str]:
        started = []
        while self.waiting and len(self.active) < self.slots:
            task = self.waiting.pop(0)
            if not place(task):
                self.waiting.insert(0, task)
                break
            self.active.append(task)
            started.append(task)
        return started

    def end(self, task: str, how: str = "finished") -> None:
        for pool in (self.active, self.waiting):
            if task in pool:
                pool.remove(task)
                self.done[task] = how

    def stats(self) -> dict[str, int]:
        return {"waiting": len(self.waiting), "active": len(self.active), "finished": sum(v == "finished" for v in self.done.values()), "aborted": sum(v == "aborted" for v in self.done.values())}


def prefill_groups(tasks: list[tuple[str, int, int]]) -> dict[tuple[int, int], list[str]]:
    """Tasks (id, prompt length, cached length) that can be started together."""
    out: dict[tuple[int, int], list[str]] = {}
    for task, size, cached in tasks:
        out.setdefault((size, cached), []).append(task)
    return out


def refresh_due(state: dict, key: str, step: int, interval: int) -> bool:
    """Whether kept rollouts are made anew: none yet, another key, or ``interval`` steps old."""
    due = state.get("key") != key or step - state.get("step", -(10**18)) >= interval
    if due:
        state |= {"key": key, "step": step}
    return due


class _Keyed(StatefulProcessor):
    def __init__(self, step: Callable[[dict, dict], list[dict]], order: str):
        self.step, self.order = step, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.state.get()[0]) if self.state.exists() else {}
        events = pd.concat(list(rows)).sort_values(self.order)  # order inside a micro-batch isn't given
        out = []
        for event in events.to_dict("records"):
            out += [{"key": key[0], self.order: event[self.order], **x} for x in self.step(kept, event)]
        self.state.update((json.dumps(kept),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def run_keyed(stream: DataFrame, key: str, order: str, step: Callable[[dict, dict], list[dict]], schema: str) -> DataFrame:
    """A stateful stream: ``step`` gets the key's state (kept as JSON) and one event, and returns output rows.

    Needs the RocksDB state store. Output columns: ``key``, the order column and those of ``schema``.
    """
    return stream.groupBy(key).transformWithStateInPandas(_Keyed(step, order), outputStructType=schema, outputMode="Append", timeMode="None")


def sse_chunk(task: str, model: str, delta: str | None, reason: str | None = None) -> str:
    """One event of a chat-completion stream."""
    body = {"id": task, "object": "chat.completion.chunk", "model": model, "choices": [{"index": 0, "delta": {} if delta is None else {"content": delta}, "finish_reason": reason}]}
    return f"data: {json.dumps(body, ensure_ascii=False)}\n\n"


def sse_event(kind: str, body: dict) -> str:
    """One typed event of a message stream."""
    return f"event: {kind}\ndata: {json.dumps({'type': kind, **body}, ensure_ascii=False)}\n\n"
