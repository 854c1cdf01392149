"""Near-duplicate records by ProbMinHash, banding and exact verification (problem 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import written
from tokenmill.llm.leakage import tokens

U = np.uint64
STEP, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # fixed values: SplitMix64
#: Bits of agreement, of 64, below which a pair that shares a band isn't verified. At
#: similarity 0.6 a true pair agrees in 51 on average, with a deviation of 3.2.
SKETCH_BITS = 64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = h = xxhash.xxh3_64_intdigest(token)
        return h


_HASHES = _Hashes()


def shingle_sets(texts: list[str | None], k: int, counts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct hashes of runs of ``k`` tokens of all texts in a row, their number per text, and their counts."""
    split = [tokens(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(split)), U, int(sizes.sum()))
    n = max(0, len(flat) - k + 1)
    h = np.zeros(n, U)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h + flat[j : j + n]) * MIX1
            h ^= h >> U(29)
        h = mix(h)
    sets, times, ends = [], [], np.cumsum(sizes)
    for lo, hi in zip((ends - sizes).tolist(), (ends - k + 1).tolist()):
        if counts:
            u, c = np.unique(h[lo : max(lo, hi)], return_counts=True)
            times.append(c)
        else:
            u = np.sort(h[lo : max(lo, hi)])
            if len(u):
                keep = np.empty(len(u), bool)
                keep[0] = True
                np.not_equal(u[1:], u[:-1], out=keep[1:])
                u = u[keep]
        sets.append(u)
    n_of = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), n_of, (np.concatenate(times).astype(float) if counts and times else None)


def prob_minhash(elements: np.ndarray, sizes: np.ndarray, m: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """One byte per register, ``m`` registers per set: two sets agree in a register
    with their probability Jaccard similarity (and 1 in 256 otherwise).

    Each element sends a Poisson process of arrivals at the rate of its weight; every
    arrival goes to a random register, which keeps the earliest. All elements run
    side by side, several arrivals at a time; an element ends as soon as it is past
    the latest time that any register of its set still holds, since nothing of it
    could be kept any more. With equal weights this is the Jaccard similarity.
    ``m`` is a power of two; empty sets have only zeros.
    """
    if m & (m - 1):
        raise ValueError("m must be a power of two")
    out = np.zeros((len(sizes), m), np.uint8)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    at = 0
    while at < len(order):
        size = int(sizes[order[at]])
        end = at + 1
        total = size
        while end < len(order) and total < 60_000 and sizes[order[end]] <= 1.5 * size + 4 and end - at < 1024:
            total += int(sizes[order[end]])
            end += 1
        docs = order[at:end]
        doc = np.repeat(np.arange(len(docs)), sizes[docs])
        where = np.arange(total) - np.repeat(np.cumsum(sizes[docs]) - sizes[docs], sizes[docs]) + starts[docs][doc]
        out[docs] = _arrivals(elements[where], doc, len(docs), m, None if weights is None else weights[where], max(1, math.ceil(1.5 * m / size)), seed)
        at = end
    return out


def _arrivals(elem: np.ndarray, doc: np.ndarray, n: int, m: int, w: np.ndarray | None, burst: int, seed: int) -> np.ndarray:
    times, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint8)
    limit = np.full(n, np.inf)
    with np.errstate(over="ignore"):
        x = mix(elem ^ U(seed))
        byte = (mix(elem + STEP) >> U(56)).astype(np.uint8)
        t = np.zeros(len(elem))
        while len(x):
            for _ in range(min(burst, 64)):
                x = x + STEP
                z = mix(x)
                wait = -np.log1p((z >> U(11)).astype(np.float64) * -(2.0**-53))
                t = t + (wait if w is None else wait / w)
                place = doc * m + (z & U(m - 1)).astype(np.int64)
                np.minimum.at(times, place, t)
                won = times[place] == t
                kept[place[won]] = byte[won]
            limit = times.reshape(n, m).max(1)
            live = t < limit[doc]
            x, byte, t, doc = x[live], byte[live], t[live], doc[live]
            if w is not None:
                w = w[live]
    return kept.reshape(n, m)


def band_registers(bands: int, rows: int, m: int) -> np.ndarray:
    """Registers of each band: seeded permutations of all, one after another."""
    rng = np.random.default_rng(5)
    need = -(-bands * rows // m)
    return np.concatenate([rng.permutation(m) for _ in range(need)])[: bands * rows].reshape(bands, rows)


def signed(df: DataFrame, id_col: str, text_col: str, k: int, m: int, weights: str = "set") -> DataFrame:
    """id, ``n`` (distinct runs), ``set_hash`` and ``sig`` of every row that has a run of ``k`` tokens."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, n, times = shingle_sets(part.column(1).to_pylist(), k, weights == "count")
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                sig = prob_minhash(sets, n, m, times)[some]
                cut = np.cumsum(n) - n
                with np.errstate(over="ignore"):
                    total = np.add.reduceat(mix(sets + STEP), cut[some]) if times is None else np.add.reduceat(mix(sets + STEP) * times.astype(U), cut[some])
                sigs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(m), len(some), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some)), pa.array(n[some], pa.int32()), pa.array(total.view(np.int64)), sigs],
                    names=["id", "n", "set_hash", "sig"],
                )

    return rows.mapInArrow(run, f"id {id_type}, n int, set_hash bigint, sig binary")


def _bands(sigs: DataFrame, bands: int, rows: int, m: int) -> DataFrame:
    """A row per set and band: ``key``, id, ``n`` and a sketch of one bit of 64 registers."""
    of = band_registers(bands, rows, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(n, m)
                bits = np.packbits(sig[:, np.linspace(0, m - 1, SKETCH_BITS).astype(int)] & 1, axis=1)
                sketch = np.ascontiguousarray(bits).view(np.int64)[:, 0]
                key = np.zeros((n, bands), U)
                for j in range(rows):
                    key = key << U(8) | sig[:, of[:, j]]
                if rows > 5:
                    key = mix(key) >> U(24)
                key = key | (np.arange(bands, dtype=U) << U(40))
                who = np.repeat(np.arange(n), bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1).view(np.int64)), part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(np.repeat(sketch, bands))],
                    names=["key", "id", "n", "sketch"],
                )

    id_type = sigs.schema["id"].dataType.simpleString()
    return sigs.select("id", "n", "sig").mapInArrow(run, f"key bigint, id {id_type}, n int, sketch bigint")


def _likely(a: np.ndarray, b: np.ndarray, ids, n, sketch, threshold: float, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs fit by size and sketch, and the bits in which those sketches differ."""
    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
    good = (ids[a] != ids[b]) & (small >= threshold * large - 1e-9)
    a, b = a[good], b[good]
    apart = np.bitwise_count((sketch[a] ^ sketch[b]).view(U))
    near = apart <= SKETCH_BITS - agree
    good[good] = near
    return good, apart[near].astype(np.int32)


def _pairs_in_buckets(threshold: float, agree: int, hot: int):
    """Sorted band rows to likely pairs; a bucket of over ``hot`` rows is handed on instead (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        passing = None  # key of the bucket that is being handed on
        id_type = None

        def emit(a, b, key=None, n=None, sketch=None):
            k = len(a)
            nothing = lambda t: pa.nulls(k, t)
            return pa.RecordBatch.from_arrays(
                [pa.array(a, id_type), nothing(id_type) if b is None else pa.array(b, id_type),
                 nothing(pa.int64()) if key is None else pa.array(key), nothing(pa.int32()) if n is None else pa.array(n), nothing(pa.int64()) if sketch is None else pa.array(sketch)],
                names=["a", "b", "key", "n", "sketch"],
            )

        def work(key, ids, n, sketch):
            # every pair (i, i + d) of one bucket, d by d
            i = np.arange(len(key))
            d = 1
            while len(i):
                i = i[i + d < len(key)]
                i = i[key[i] == key[i + d]]
                if len(i):
                    for at in range(0, len(i), 1 << 20):
                        x = i[at : at + (1 << 20)]
                        good, apart = _likely(x, x + d, ids, n, sketch, threshold, agree)
                        x = x[good]
                        if len(x):
                            yield emit(np.minimum(ids[x], ids[x + d]), np.maximum(ids[x], ids[x + d]), n=apart)
                d += 1

        def groups(cols, last):
            nonlocal carry, passing
            key = cols[0]
            if not len(key):
                return
            end = len(key) if last else int(np.searchsorted(key, key[-1], "left"))
            tail = tuple(c[end:] for c in cols)
            if passing is not None or len(tail[0]) > hot:
                # the open bucket is hot: hand its rows on as they come
                if passing is not None:
                    stop = int(np.searchsorted(key, passing, "right"))
                    if stop:
                        yield emit(cols[1][:stop], None, key[:stop], cols[2][:stop], cols[3][:stop])
                    cols = tuple(c[stop:] for c in cols)
                    if not len(cols[0]):
                        carry = None
                        return
                    passing, carry = None, None
                    yield from groups(cols, last)
                    return
                yield emit(tail[1], None, tail[0], tail[2], tail[3])
                passing, tail = int(tail[0][0]), None
            body = tuple(c[:end] for c in cols)
            if len(body[0]):
                size = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(body[0])) + 1, [len(body[0])]]))
                big = np.repeat(size > hot, size)
                if big.any():
                    yield emit(body[1][big], None, body[0][big], body[2][big], body[3][big])
                    body = tuple(c[~big] for c in body)
                yield from work(*body)
            carry = tail

        for batch in batches:
            id_type = batch.schema.field(1).type
            cols = tuple(batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            if carry is not None:
                cols = tuple(np.concatenate([c, x]) for c, x in zip(carry, cols))
            yield from groups(cols, False)
        if carry is not None:
            yield from groups(carry, True)

    return run


def _pairs_of_hot(found: DataFrame, threshold: float, agree: int, block: int) -> DataFrame:
    """All likely pairs of hot buckets: rows are cut into blocks, a task takes a pair of blocks."""
    rows = found.filter("b is null").select(F.col("a").alias("id"), "key", "n", "sketch").distinct()
    size = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block)).cast("int").alias("blocks"))
    cut = rows.join(size, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", "id", "n", "sketch", "i", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    id_type = rows.schema["id"].dataType.simpleString()

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n, sketch = pdf["id"].to_numpy(), pdf["n"].to_numpy(), pdf["sketch"].to_numpy()
        left = np.flatnonzero(pdf["i"].to_numpy() == pdf["lo"].to_numpy())
        right = np.flatnonzero(pdf["i"].to_numpy() == pdf["hi"].to_numpy())
        out = []
        for a in left:
            x = np.full(len(right), a)
            good, apart = _likely(x, right, ids, n, sketch, threshold, agree)
            out.append(np.stack([np.minimum(ids[x[good]], ids[right[good]]), np.maximum(ids[x[good]], ids[right[good]]), apart], 1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3), ids.dtype), columns=["a", "b", "n"]).drop_duplicates()

    return cells.groupBy("key", "lo", "hi").applyInPandas(pairs, f"a {id_type}, b {id_type}, n int")


def _verify(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, k: int, threshold: float, weights: str, broadcast_rows: int) -> DataFrame:
    """Exact similarity of candidate pairs from the whole sets: a, b, ``similarity``.

    Only texts of ids in some pair are cut into runs and shuffled; the ids are
    broadcast up to ``broadcast_rows`` of them (8 bytes each) and joined by a
    shuffle beyond. Runs travel as 40-bit hashes.
    """
    needed = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "neardup-needed")
    id_type = needed.schema["id"].dataType.simpleString()
    if needed.count() <= broadcast_rows:
        needed = F.broadcast(needed)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    mine = texts.join(needed, "id", "left_semi")

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets, n, times = shingle_sets(part.column(1).to_pylist(), k, weights == "count")
                ends = np.cumsum(n)
                cells = (sets >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5]
                if times is not None:
                    cells = np.concatenate([cells, times.astype(np.uint32).view(np.uint8).reshape(-1, 4)], 1)
                out = [cells[e - c : e].tobytes() for e, c in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["id", "runs"])

    runs = mine.mapInArrow(blobs, f"id {id_type}, runs binary")
    both = pairs.join(runs.withColumnsRenamed({"id": "b", "runs": "runs_b"}), "b").join(runs.withColumnsRenamed({"id": "a", "runs": "runs_a"}), "a")
    width = 9 if weights == "count" else 5

    def cut(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        cells = np.frombuffer(blob, np.uint8).reshape(-1, width)
        keys = np.zeros((len(cells), 8), np.uint8)
        keys[:, :5] = cells[:, :5]
        return keys.view(U)[:, 0], np.ascontiguousarray(cells[:, 5:]).view(np.uint32)[:, 0] if width == 9 else keys

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                (x, m), (y, n) = cut(x), cut(y)
                if weights == "count":
                    out[i] = _weighted(np.stack([x, m.astype(U)], 1), np.stack([y, n.astype(U)], 1))
                else:
                    s = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((s[1:] == s[:-1]).sum())
                    out[i] = shared / (len(s) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    checked = both.select("a", "b", "runs_a", "runs_b").mapInArrow(compare, f"a {id_type}, b {id_type}, similarity double")
    return checked.filter(F.col("similarity") >= threshold).dropDuplicates(["a", "b"])


def _weighted(x: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets, by definition."""
    keys = np.union1d(x[:, 0], y[:, 0])
    p, q = np.zeros(len(keys)), np.zeros(len(keys))
    p[np.searchsorted(keys, x[:, 0])], q[np.searchsorted(keys, y[:, 0])] = x[:, 1], y[:, 1]
    both = np.flatnonzero((p > 0) & (q > 0))
    return float(sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in both))


def near_duplicates(
    df: DataFrame,
    id_col: str,
    text_col: str,
    k: int = 5,
    threshold: float = 0.8,
    m: int = 256,
    bands: int = 64,
    rows: int = 5,
    weights: str = "set",
    hot: int = 4096,
    broadcast_rows: int = 1_000_000,
    sketched: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the membership of exact copies.

    links: ``a``, ``b``, ``similarity`` of every found pair of class representatives
    (a < b, the least id of each group of equal sets of runs) of at least
    ``threshold``. members: ``id``, ``rep`` of every row that has a run of ``k`` tokens.
    Null, empty and short texts are in neither; ids delivered twice count once.
    Ids are numbers.

    Every row gets a ProbMinHash signature of ``m`` bytes in one narrow stage. Copies
    fold into their representative before anything is paired. A representative's
    bands (``rows`` registers each) are shuffled once and sorted; in each bucket only
    pairs that fit by size and by a 64-bit sketch become candidates, and buckets
    of over ``hot`` rows are paired block by block in further tasks. A pair that
    shares one band only must agree in more of its sketch (1.6 instead of 3.5
    deviations below the mean at the threshold). Candidates are verified on whole
    sets, so no pair is wrong; a pair of similarity s is missed with about
    (1 - s^rows)^bands, and with one in 400 more for the sketch at the threshold:
    0.8 % at 0.6, 0.1 % at 0.65 and less beyond. ``sketched=False`` verifies every pair
    that shares a band and fits by size.
    """
    sigs = written(signed(df, id_col, text_col, k, m, weights), "neardup-signatures")
    groups = sigs.groupBy("set_hash", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.count(F.lit(1)).alias("c"))
    copied = groups.filter("last <> rep").select("set_hash", "n", "rep")
    n_copied = copied.count()
    small = n_copied <= broadcast_rows
    copied = F.broadcast(copied) if small else copied
    members = sigs.select("id", "set_hash", "n").join(copied, ["set_hash", "n"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    reps = sigs.join(copied, ["set_hash", "n"], "left").filter("rep is null or rep = id").select("id", "n", "sig")
    mean, deviation = SKETCH_BITS * (1 + threshold) / 2, math.sqrt(SKETCH_BITS * (1 - threshold**2) / 4)
    agree, agree_once = (int(mean - 3.5 * deviation), int(mean - 1.6 * deviation)) if weights == "set" and sketched else (0, 0)
    keyed = _bands(reps, bands, rows, m).repartition("key").sortWithinPartitions("key", "id")
    id_type = sigs.schema["id"].dataType.simpleString()
    bound = threshold if weights == "set" else 0.0
    found = keyed.mapInArrow(_pairs_in_buckets(bound, agree, hot), f"a {id_type}, b {id_type}, key bigint, n int, sketch bigint")
    found = written(found, "neardup-found")
    pairs = found.filter("b is not null").select("a", "b", "n")
    if not found.filter("b is null").isEmpty():
        pairs = pairs.unionByName(_pairs_of_hot(found, bound, agree, hot))
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min("n").alias("apart"))
    pairs = written(met.filter((F.col("times") > 1) | (F.col("apart") <= SKETCH_BITS - agree_once)).select("a", "b"), "neardup-pairs")
    return _verify(pairs, df, id_col, text_col, k, threshold, weights, broadcast_rows), members.distinct()


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair of ids: links of representatives expanded to members, and copies among each other."""
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    linked = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    copies = members.select(F.col("rep").alias("a"), F.col("id").alias("y")).join(a, "a").filter("x < y").select("x", "y")
    return linked.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def duplicate_classes(links: DataFrame, members: DataFrame, rounds: int = 60) -> DataFrame:
    """One row per id: ``class_id`` (least id of its component) and ``n_links`` (of its representative).

    Components by alternating large-star and small-star; each round is two
    shuffles of the edges and is written to the shared folder. Ends when a round
    changes nothing; an error after ``rounds`` rounds.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "classes-edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "classes-edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = links.select(F.col("a").alias("rep")).union(links.select("b"))
    degree = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    top = edges.select(F.col("u").alias("rep"), F.col("v").alias("class_id"))
    out = members.join(top, "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
