"""Prefix sums over a long order, windows over a token stream, records and samplers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.registry import Registry


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """A small table in fewer files than there are cores, dealt to all of them; larger ones as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if len(df.inputFiles()) >= cores or not 1 << 17 < size < small else df.repartition(cores)


def bucketed(df: DataFrame, order: str, out: str = "_bucket", rows: int = 100_000, most: int = 8192) -> DataFrame:
    """``out``: number of a range of ``order`` that holds about ``rows`` rows, whatever the values are (dense numbers, hashes).

    Bounds are approximate quantiles, ``most`` at most; a row without order is in the first range.
    """
    n = min(most, -(-df.count() // rows))
    if n <= 1:
        return df.withColumn(out, F.lit(0))
    at = F.col(order).cast("double")
    bounds = sorted(set(df.select(at.alias("o")).approxQuantile("o", [i / n for i in range(1, n)], 0.25 / n)))
    kept = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_o", outputCol=out, handleInvalid="keep")
    return kept.transform(df.withColumn("_o", F.coalesce(at, F.lit(-math.inf)))).drop("_o").withColumn(out, F.col(out).cast("int"))


def prefix_sum(df: DataFrame, order: str, value: str, out: str = "offset", bucket: int = 100_000) -> DataFrame:
    """Sum of ``value`` of all rows before, in the order of the number ``order``.

    Two levels: sums of ranges of about ``bucket`` rows are scanned in one small window (8,192 rows at most), rows
    only inside their range, so that no task holds the table.
    """
    keyed = bucketed(df, order, rows=bucket)
    sums = keyed.groupBy("_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return keyed.join(F.broadcast(base), "_bucket").withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_base")


def window_count(length: int, window: int, stride: int) -> int:
    """Windows over a stream of which one token is kept for the shifted target."""
    return (length - 1 - window) // stride + 1 if length > window else 0


def stream_windows(segments: DataFrame, order: str, ids: str, window: int, stride: int) -> DataFrame:
    """``window_id``, ``input`` [b, e) and ``target`` [b + 1, e + 1) of every window over the stream of all segments.

    Each segment emits its slice to the windows that it meets, which are known from
    its offset alone: a range join without a join. One shuffle by window.
    The tail behind the last full window is dropped; null and empty segments take no room.
    """
    if window < 1 or stride < 1:
        raise ValueError("window and stride must be at least 1")
    rows = segments.select(order, ids).withColumn("_n", F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0)))
    placed = prefix_sum(rows.filter("_n > 0"), order, "_n", "_start")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    count = window_count(total, window, stride)
    first = F.greatest(F.floor((F.col("_start") - (window + 1)) / stride) + 1, F.lit(0))
    last = F.least(F.floor((F.col("_start") + F.col("_n") - 1) / stride), F.lit(count - 1))
    met = placed.filter(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("window_id") * stride - F.col("_start"), F.lit(0))
    hi = F.least(F.col("window_id") * stride + window + 1 - F.col("_start"), F.col("_n"))
    part = F.struct("_start", F.slice(ids, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = met.filter(hi > lo).groupBy("window_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    river = F.flatten(F.transform("parts", lambda x: x["part"]))
    return whole.select("window_id", F.slice(river, 1, window).alias("input"), F.slice(river, 2, window).alias("target"))


def _jumps(sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For a range with running sums ``sums``: of every row, the last cut if there is a cut behind it, and how many follow it.

    Rows point at the next cut; pointers are doubled until all have reached the last one.
    """
    n = len(sums)
    to = np.append(np.searchsorted(sums, sums + most), n)
    last, count = np.where(to[:n] < n, to[:n], np.arange(n)), (to[:n] < n).astype(np.int64)
    while True:
        again = last[last]
        if (again == last).all():
            return last, count
        last, count = again, count + count[last]


def shard_epochs(df: DataFrame, order: str, value: str, most: int, mode: str = "reset", bucket: int = 200_000, kept: int = 1_000_000) -> DataFrame:
    """``epoch`` of every row: the shard flush that it belongs to.

    ``reset``: a running total that goes back to 0 when it reaches ``most``, so what a row adds beyond is lost.
    Ranges of the order (512 at most) are worked out side by side: where the first cut of a range falls decides all
    that follow, so every range gives a table from the total that comes in to the cuts in it and the total that goes
    out. The driver follows these tables, one look-up a range: on the driver if they have up to ``kept`` rows, else by
    a small query each. ``floor``: total / most by prefix sums. Null values add nothing; equal ``order`` by value.
    """
    if most < 1:
        raise ValueError("most must be at least 1")
    if mode == "floor":
        return prefix_sum(df, order, value, "_at").withColumn("epoch", F.floor(F.col("_at") / most)).drop("_at")
    keyed = bucketed(df.withColumn("_v", F.coalesce(F.col(value).cast("bigint"), F.lit(0))), order, rows=bucket, most=512)
    sums = {r["_bucket"]: r["s"] for r in keyed.groupBy("_bucket").agg(F.sum("_v").alias("s")).collect()}

    def tables(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["o", "n"], kind="stable")
        run = frame["n"].to_numpy().cumsum()
        first = run - frame["n"].to_numpy() < most  # rows that can hold the first cut
        last, count = _jumps(run, most)
        out = pd.DataFrame({"b": frame["b"].to_numpy(), "at": run, "cuts": count + 1, "left": run[-1] - run[last]})[first]
        return out.drop_duplicates("at")

    pairs = keyed.select(F.col("_bucket").alias("b"), F.col(order).cast("double").alias("o"), F.col("_v").alias("n"))
    found = pairs.groupBy("b").applyInPandas(tables, "b int, at bigint, cuts bigint, left bigint").persist()
    local = {b: g.sort_values("at") for b, g in found.toPandas().groupby("b")} if found.count() <= kept else None
    carry, epoch, begins = 0, 0, []
    for b in sorted(sums):
        begins.append((b, carry, epoch))
        if carry + sums[b] < most:
            carry += sums[b]
        else:
            if local is not None:
                row = local[b].iloc[local[b]["at"].searchsorted(most - carry)]
            else:
                row = found.filter((F.col("b") == b) & (F.col("at") >= most - carry)).orderBy("at").first()
            carry, epoch = int(row["left"]), epoch + int(row["cuts"])
    found.unpersist()
    start = {b: (c, e) for b, c, e in begins}  # of 512 ranges at most
    columns = [c for c in df.columns]

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_o", "_v"], kind="stable")
        total, at = start[int(frame["_bucket"].iloc[0])]
        run = frame["_v"].to_numpy().cumsum()
        out, done, base = np.empty(len(run), np.int64), 0, -total
        while done < len(run):
            end = int(np.searchsorted(run, base + most))
            out[done : end + 1] = at
            if end < len(run):
                base, at = run[end], at + 1
            done = end + 1
        return frame[["_k"]].assign(epoch=out)

    kind = df.schema[order].dataType.simpleString()
    epochs = keyed.select("_bucket", F.col(order).alias("_k"), F.col(order).cast("double").alias("_o"), "_v").groupBy("_bucket").applyInPandas(cut, f"_k {kind}, epoch bigint")
    return df.join(epochs.dropDuplicates(["_k"]), df[order] == epochs["_k"]).select(*[df[c] for c in columns], "epoch")


def shard_index(epochs: DataFrame, domain: str = "domain") -> DataFrame:
    """``shard_idx``: number of a domain's epoch among its own, from a table of distinct epochs."""
    seen = epochs.select(domain, "epoch").distinct()
    numbered = seen.withColumn("shard_idx", F.dense_rank().over(Window.partitionBy(domain).orderBy("epoch")) - 1)
    return epochs.join(numbered, [domain, "epoch"])


POSITION_IDS = Registry()


@POSITION_IDS.register("none")
def _no_positions(ids: Column, offset: Column | None = None) -> None:
    return None


@POSITION_IDS.register("doc_reset")
def _positions_of_document(ids: Column, offset: Column | None = None) -> Column:
    return F.transform(ids, lambda _, i: i)


@POSITION_IDS.register("continuous")
def _positions_of_shard(ids: Column, offset: Column | None = None) -> Column:
    return F.transform(ids, lambda _, i: (offset + i).cast("int"))


def position_ids(ids: Column, mode: str, offset: Column | None = None) -> Column | None:
    """``doc_reset``: 0.. per document; ``continuous``: over the shard, from ``offset``; ``none``: no column; or a registered kind."""
    return POSITION_IDS.get(mode)(ids, offset)


def document_ids(positions: Column) -> Column:
    """Number of the document of each token: a new one where a position isn't above the one before."""
    start = F.transform(positions, lambda p, i: F.when((i == 0) | (p <= F.get(positions, i - 1)), i))
    starts = F.filter(start, lambda i: i.isNotNull())
    size = lambda i, k: F.coalesce(F.get(starts, k + 1), F.size(positions)) - i
    return F.flatten(F.transform(starts, lambda i, k: F.array_repeat(k, size(i, k))))


def seeded_hash(*parts: Column | int, digits: int = 15) -> Column:
    """A whole number of 4 x ``digits`` bits from any values: the beginning of an MD5, so that other engines say the same."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("bigint")


def seeded_order(df: DataFrame, key: str, seed: int, out: str = "position", buckets: int = 4096) -> DataFrame:
    """A reproducible permutation: ``position`` 0.. in the order of a seeded hash (ties by key)."""
    h = seeded_hash(F.col(key), seed)
    hashed = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / ((1 << 60) // buckets)))
    sums = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return hashed.join(F.broadcast(base), "_b").withColumn(out, F.col("_base") + rank).drop("_h", "_b", "_base")


def subsample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows drawn by a seeded hash of the key, or all if there are no more."""
    return df.orderBy(seeded_hash(F.col(key), seed), key).limit(n)


def sampler_length(n: int, replicas: int = 1, resume: int = 0, drop_last: bool = False) -> int:
    """Records that one replica still has to give in its epoch, of which it has given ``resume``."""
    each = n // replicas if drop_last else -(-n // replicas)
    return each - resume % each if each else 0


def sampler_next(n: int, epoch: int, given: int, replicas: int = 1, drop_last: bool = False) -> tuple[int, int]:
    """Epoch and records given in it, once a replica has given all that ``sampler_length`` said."""
    each = n // replicas if drop_last else -(-n // replicas)
    return epoch + 1, (given % each + sampler_length(n, replicas, given, drop_last)) % each if each else 0


def sampler(df: DataFrame, key: str, seed: int, epoch: int = 0, replicas: int = 1, rank: int = 0, resume: int = 0, drop_last: bool = False, shuffle: bool = True) -> DataFrame:
    """The rows of one replica in a resumable epoch, with ``position`` and ``step``.

    The epoch's order depends on ``seed + epoch`` (or is that of the key). It is padded once with its own beginning to
    a multiple of ``replicas`` (or cut, with ``drop_last``) and dealt in turn; then the replica skips the first
    ``resume`` records of its share.
    """
    if shuffle:
        placed = seeded_order(df, key, seed + epoch)
    else:
        placed = prefix_sum(df.withColumn("_one", F.lit(1)), key, "_one", "position").drop("_one")
    n = df.count()
    each = n // replicas if drop_last else -(-n // replicas)
    if each == 0:
        return placed.filter("false").withColumn("step", F.lit(0).cast("bigint"))
    copies = F.when(F.col("position") < each * replicas - n, F.array(F.col("position"), F.col("position") + n)).otherwise(F.array("position"))
    rows = placed.withColumn("_at", F.explode(copies)).filter((F.col("_at") < each * replicas) & (F.col("_at") % replicas == rank))
    return rows.withColumn("step", F.floor(F.col("_at") / replicas)).filter(F.col("step") >= resume % each).drop("_at")


def split_validation(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """``is_validation``: exactly round(ratio * n) rows, at least one, by the seeded order."""
    n = df.count()
    held = max(1, int(n * ratio)) if n else 0
    return seeded_order(df, key, seed).withColumn("is_validation", F.col("position") < held).drop("position")
