"""Tool calls in generated text: complete and partial JSON objects with a name and arguments."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.registry import Registry

PARSERS = Registry()
CALLS = "array<struct<start:int,end:int,name:string,arguments:string,complete:boolean>>"


_MARKS = re.compile(r'\\.|["{}]', re.S)
_NAME = re.compile(r'"name"\s*:\s*"([^"]*)"')
_ARGUMENTS = re.compile(r'"arguments"\s*:\s*(.*)', re.S)


def object_end(text: str, start: int) -> int | None:
    """Place behind the object that opens at ``start``; null while it is open. Braces in strings and what a backslash stands before don't count."""
    depth, quoted = 0, False
    for m in _MARKS.finditer(text, start):
        mark = m.group()
        if mark == '"':
            quoted = not quoted
        elif len(mark) == 1 and not quoted:
            depth += 1 if mark == "{" else -1
            if depth == 0:
                return m.end()
    return None


def argument_text(value) -> str:
    """Arguments as they are sent: the inside of an object, a list as JSON, a string as it is, nothing for what is empty."""
    if isinstance(value, str):
        return value
    if isinstance(value, (dict, list)):
        whole = json.dumps(value, ensure_ascii=False) if value else ""
        return whole[1:-1].rstrip() if isinstance(value, dict) else whole
    return "" if value is None else str(value)


def as_call(text: str) -> tuple[str, str] | None:
    """Name and arguments of a whole object; null if it isn't JSON or names nothing."""
    try:
        value = json.loads(text)
    except ValueError:
        return None
    name = value.get("name")
    return (name, argument_text(value.get("arguments"))) if isinstance(name, str) and name else None


def whole_calls(text: str) -> list[dict]:
    """All complete calls in order. An object that is no call is passed over with all that it holds; an open one ends the search."""
    out, at = [], 0
    while (at := text.find("{", at)) >= 0 and (end := object_end(text, at)) is not None:
        if call := as_call(text[at:end]):
            out.append({"start": at, "end": end, "name": call[0], "arguments": call[1], "complete": True})
        at = end
    return out


@PARSERS.register("simple_json")
def find_calls(text: str | None) -> list[dict]:
    """All complete calls, then the one that is still open behind them once its name is there (complete = false)."""
    if not text:
        return []
    out = whole_calls(text)
    at = text.find("{", out[-1]["end"] if out else 0)
    if at >= 0 and (call := partial_call(text[at:])):
        out.append({"start": at, "end": len(text), "name": call[0], "arguments": call[1], "complete": False})
    return out


def partial_call(text: str) -> tuple[str, str] | None:
    """Name and the beginning of the arguments, without the braces around them, of an open object."""
    if not (name := _NAME.search(text)):
        return None
    found = _ARGUMENTS.search(text)
    raw = found.group(1).rstrip() if found else ""
    if raw.startswith("{"):
        raw = raw[1:].rstrip()
        raw = raw.removesuffix("}").rstrip() if raw.endswith("}") else raw
    return name.group(1), raw


def content_before(text: str, calls: list[dict]) -> str:
    return text[: calls[0]["start"]] if calls else text


def parse_complete(text: str | None) -> dict | None:
    """Content before the first call (null if blank) and the complete calls; null if there is none."""
    calls = whole_calls(text or "")
    return {"content": text[: calls[0]["start"]].strip() or None, "tool_calls": [(c["name"], c["arguments"]) for c in calls]} if calls else None


def parse_tool_calls(df: DataFrame, text_col: str, parser: str = "simple_json", out: str = "tool_calls") -> DataFrame:
    find = PARSERS.get(parser)
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("arguments", pa.string()), ("complete", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([find(t) for t in b.column(1).to_pylist()], kind)], names=["row", out])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {out} {CALLS}").select("row.*", out)
