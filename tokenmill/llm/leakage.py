"""Evaluation texts leaking into training text, by an FM-index per shard (problem 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ideographs one by one, other letters and digits (categories L and N) in longest runs.
TOKEN = re.compile(r"[^\W_一-鿿]+|[一-鿿]")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class FMIndex:
    """Index of a sequence of codes; 0 separates runs, and no phrase holds it.

    Suffixes are sorted by doubling, comparing no further than the next
    separator. The Burrows-Wheeler transform is held as a wavelet tree of levels
    by bit (a wavelet matrix); a rank in it answers one step of the backward
    search. Suffix positions are kept at the start of each run and at every
    ``sample``-th place; the others are found by walking back to one of these.
    """

    def __init__(self, codes: np.ndarray, sigma: int, sample: int = 8):
        seq = np.concatenate([codes, [0]]).astype(np.int64)
        self.n, self.sample = len(seq), sample
        sa = self._suffixes(seq)
        bwt = seq[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma + 1))])
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for shift in range(self.bits - 1, -1, -1):
            bit = (level >> shift) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        kept = (sa % sample == 0) | (bwt == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)  # how many sampled rows stand before each
        self.sampled = sa[kept].astype(np.int32)

    @staticmethod
    def _suffixes(seq: np.ndarray) -> np.ndarray:
        n = len(seq)
        separators = np.flatnonzero(seq == 0)
        rank = seq + len(separators)
        rank[separators] = np.arange(len(separators))
        sa = np.argsort(rank, kind="stable")
        step = 1
        r = np.empty(n, np.int64)
        ordered = rank[sa]
        r[sa] = np.searchsorted(ordered, ordered, "left")  # rank = first place of the equal ones
        while True:
            place = r[sa]
            tied = np.zeros(n, bool)
            same = place[1:] == place[:-1]
            tied[1:] |= same
            tied[:-1] |= same
            where = np.flatnonzero(tied)
            if not len(where):
                return sa
            who = sa[where]
            nxt = np.where(who + step < n, r[np.minimum(who + step, n - 1)], -1)
            order = np.lexsort((nxt, place[where]))
            who, nxt, base = who[order], nxt[order], place[where]
            sa[where] = who
            new = np.ones(len(where), bool)
            new[1:] = (base[1:] != base[:-1]) | (nxt[1:] != nxt[:-1])
            r[who] = np.maximum.accumulate(np.where(new, where, 0))
            step *= 2

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Number of ``code`` among the first ``at`` characters of the transform."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.bits):
            bit = (code >> (self.bits - 1 - k)) & 1
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows of the suffixes that begin with each phrase (a row of codes)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows, by sampled positions."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        live, row = np.arange(len(rows)), rows.astype(np.int64)
        while len(live):
            before = self.kept[row]
            hit = self.kept[row + 1] > before
            out[live[hit]] = self.sampled[before[hit]] + steps[live[hit]]
            live, row = live[~hit], row[~hit]
            steps[live] += 1
            row = self._before(row)
        return out

    def _before(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one place to the left: its code is read from the wavelet tree on the way to its rank."""
        at, code, lo = row, np.zeros_like(row), np.zeros_like(row)
        for k in range(self.bits):
            ones = self.ones[k]
            bit = ones[at + 1] - ones[at]
            code = code << 1 | bit
            at, lo = np.where(bit, self.zeros[k] + ones[at], at - ones[at]), np.where(bit, self.zeros[k] + ones[lo], lo - ones[lo])
        return self.first[code] + at - lo


def phrase_table(items: list[tuple[int, str | None]], run: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Codes of the items' tokens, all distinct (phrase, item), phrases of ``run`` tokens."""
    codes: dict[str, int] = {}
    rows, who = [], []
    for item, text in items:
        seq = [codes.setdefault(t, len(codes) + 1) for t in tokens(text or "")]
        for phrase in {tuple(seq[i : i + run]) for i in range(len(seq) - run + 1)}:
            rows.append(phrase)
            who.append(item)
    return codes, np.array(rows, np.int64).reshape(-1, run), np.array(who, np.int64)


def find_leaks(
    corpus: DataFrame,
    id_col: str,
    text_col: str,
    items: DataFrame,
    item_col: str = "item_id",
    question_col: str = "question",
    run: int = 12,
    shard_tokens: int = 400_000,
    block_items: int = 20_000,
) -> DataFrame:
    """Passages of ``run`` or more consecutive tokens of an item in a text.

    Columns: id, ``item_id``, ``start_char``, ``end_char`` (code points of the text
    itself) and ``n_tokens``; touching and overlapping occurrences of one item in
    one row are merged. Null and empty texts and items of under ``run`` tokens
    have none; copies and rows delivered twice are searched row by row.

    The items are the stated query set, of any number: they come to the driver in blocks of
    ``block_items``, and every text is searched for each block.
    Each task indexes its shard in blocks of about ``shard_tokens`` tokens. Tokens
    that no item holds end a run of text, and runs too short for a phrase are
    left out of the index; both can't be part of any occurrence. One narrow stage.
    """
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, item_id bigint, start_char int, end_char int, n_tokens int"
    out = None
    asked = items.select(item_col, question_col).filter(F.col(item_col).isNotNull()).distinct().toLocalIterator()
    while (block := [(r[0], r[1]) for r in islice(asked, block_items)]) or out is None:
        table = corpus.sparkSession.sparkContext.broadcast(phrase_table(block, run))
        found = rows.mapInArrow(_searcher(table, run, shard_tokens), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def _searcher(table, run: int, shard_tokens: int):
    names = ["id", "item_id", "start_char", "end_char", "n_tokens"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, phrases, items = table.value
        get = codes.get
        held_codes, held_where, held = [], [], 0

        def flush() -> pa.RecordBatch | None:
            text = np.concatenate(list(chain.from_iterable((c, [0]) for c in held_codes)))
            index = FMIndex(text, len(codes))
            lo, hi = index.search(phrases)
            hits = np.flatnonzero(hi > lo)
            size = hi[hits] - lo[hits]
            if not len(hits):
                return None
            at_row = np.repeat(lo[hits] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            where, item = index.locate(at_row), np.repeat(items[hits], size)
            order = np.lexsort((where, item))
            where, item = where[order], item[order]
            new = np.ones(len(where), bool)
            # runs are held apart by one 0, so starts of different runs never come together
            new[1:] = (item[1:] != item[:-1]) | (where[1:] > where[:-1] + run)
            begin, last = where[new], where[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(where) - 1]])]
            starts = np.cumsum([0, *(len(c) + 1 for c in held_codes)])
            piece = np.searchsorted(starts, begin, "right") - 1
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, b, e, p in zip(item[new].tolist(), begin.tolist(), (last + run).tolist(), piece.tolist()):
                row_id, spans, first = held_where[p]
                b, e = b - int(starts[p]) + first, e - int(starts[p]) + first
                for c, v in zip(cols, (row_id, i, spans[b][0], spans[e - 1][1], e - b)):
                    c.append(v)
            return cols

        def emit(cols, id_type) -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            if not len(phrases):
                continue
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1000):
                part = texts.slice(at, 1000).to_pylist()
                split = [tokens(t) for t in part]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                flat = np.fromiter(map(get, chain.from_iterable(split), repeat(0)), np.int64, int(sizes.sum()))
                ends = np.cumsum(sizes)
                edge = np.ones(len(flat) + 1, bool)
                edge[1:-1] = (flat[1:] == 0) != (flat[:-1] == 0)
                edge[ends] = True
                edge[0] = True
                cut = np.flatnonzero(edge)
                lo, hi = cut[:-1], cut[1:]
                good = (hi - lo >= run) & (flat[np.minimum(lo, max(len(flat) - 1, 0))] > 0) if len(flat) else np.zeros(0, bool)
                spans_of: dict[int, list] = {}
                for a, b in zip(lo[good].tolist(), hi[good].tolist()):
                    doc = int(np.searchsorted(ends, a, "right"))
                    if doc not in spans_of:
                        spans_of[doc] = _spans(part[doc])
                    held_codes.append(flat[a:b])
                    held_where.append((ids[at + doc].as_py(), spans_of[doc], a - int(ends[doc] - sizes[doc])))
                    held += b - a
                if held >= shard_tokens:
                    if (cols := flush()) is not None:
                        yield emit(cols, id_type)
                    held_codes, held_where, held = [], [], 0
        if held:
            if (cols := flush()) is not None:
                yield emit(cols, id_type)

    return search


def _spans(text: str) -> list[tuple[int, int]]:
    """Code points of each token in the text as it was before lower-casing."""
    low = text.lower()
    found = [m.span() for m in TOKEN.finditer(low)]
    if len(low) == len(text):
        return found
    origin = list(chain.from_iterable(repeat(i, len(c.lower())) for i, c in enumerate(text)))
    origin.append(len(text))
    return [(origin[a], origin[b - 1] + 1) for a, b in found]


def leaked_pairs(found: DataFrame, id_col: str) -> DataFrame:
    """Each (row, item) once."""
    return found.select(id_col, "item_id").distinct()


def removal_spans(found: DataFrame, *id_cols: str) -> DataFrame:
    """Spans to remove from each text, which ``id_cols`` name: those of all its items, merged where they meet."""
    spans = F.array_sort(F.collect_set(F.struct("start_char", "end_char")))
    start = F.expr("array(struct(int(-1) as start_char, int(-1) as end_char))")
    merged = F.aggregate(
        "spans",
        F.slice(start, 1, 0),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end_char"] >= x["start_char"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start_char"].alias("start_char"), F.greatest(F.try_element_at(acc, F.lit(-1))["end_char"], x["end_char"]).alias("end_char"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start_char"].alias("start_char"), x["end_char"].alias("end_char"))))),
    )
    return found.groupBy(*id_cols).agg(spans.alias("spans")).select(*id_cols, F.explode(merged).alias("span")).select(*id_cols, "span.start_char", "span.end_char")
