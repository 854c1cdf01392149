"""Splitting oversized texts at natural boundaries (problem 6)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LINE = re.compile(r"\n[^\S\n]*|\r")
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*")
WORD = re.compile(r"\s+|(?<=[぀-ヿ一-鿿，、；：])(?=[぀-ヿ一-鿿])")
#: Strongest first; a cut lies behind the match.
LEVELS = (PARAGRAPH, LINE, SENTENCE, WORD)
#: Marks that can't begin a piece: they belong to the character before them.
JOINED = re.compile(r"[̀-ͯ‍︎️\U0001f3fb-\U0001f3ff\udc00-\udfff]")


def boundaries(text: str) -> list[list[int]]:
    """Places of cuts by level, each sorted; a word end is a cut behind the white space."""
    n = len(text)
    return [[p for m in level.finditer(text) if 0 < (p := m.end()) < n] for level in LEVELS]


def cut_points(text: str, size: int) -> list[int]:
    """Ends of parts, each at most ``size``, by recursive bisection.

    A part over the size is cut at the strongest boundary near its middle: the
    level is the first with a boundary in the middle half of the part, the place
    the one nearest the middle; without any, the nearest of any level inside the
    part; without a boundary at all, the middle itself, moved past joined marks (unless
    they fill the quarter behind it).
    """
    levels = boundaries(text)
    ends: list[int] = []
    stack = [(0, len(text))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= size:
            ends.append(hi)
            continue
        mid, reach = (lo + hi) // 2, (hi - lo) // 4
        cut = None
        for slack in (reach, mid - lo):
            for places in levels:
                i = bisect_left(places, mid)
                near = [p for p in places[max(0, i - 1) : i + 1] if lo < p < hi and abs(p - mid) <= slack]
                if near:
                    cut = min(near, key=lambda p: (abs(p - mid), p))
                    break
            if cut is not None:
                break
        if cut is None:
            cut, stop = mid, min(hi, mid + reach)
            while cut < stop and (JOINED.match(text[cut]) or text[cut - 1] == "‍"):
                cut += 1
            cut = mid if cut == stop else cut
        stack.append((cut, hi))
        stack.append((lo, cut))
    return ends


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of every piece: own parts join to the text; start - own start is the overlap."""
    ends = cut_points(text, limit - overlap)
    out, lo = [], 0
    for hi in ends:
        out.append((max(0, lo - overlap) if lo else 0, lo, hi))
        lo = hi
    return out


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Numbered pieces of every text of over ``limit`` code points.

    Columns: id, ``piece`` (from 0), ``n_pieces``, ``start_char``, ``overlap`` and ``text``.
    A piece has at most ``limit`` code points; its first ``overlap`` ones are the
    last of the piece before, and behind them it goes on where that one ended, so
    the pieces without overlaps join to the text. Null, empty and shorter texts
    have no piece. Repeated ids are split row by row. One narrow stage after a
    filter on the length, each text on its own.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > limit)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, n_pieces int, start_char int, overlap int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                who, cols = [], ([], [], [], [], [])
                for i, text in enumerate(part.column(1).to_pylist()):
                    cut = pieces(text, limit, overlap)
                    for k, (start, own, end) in enumerate(cut):
                        who.append(i)
                        for c, v in zip(cols, (k, len(cut), start, own - start, text[start:end])):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who, pa.int32())), *(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.string())],
                    names=["id", "piece", "n_pieces", "start_char", "overlap", "text"],
                )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
