"""Packing of sequences: simple, best-fit decreasing, and splitting best-fit decreasing."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.build import truncate
from tokenmill.registry import Registry


def plan_best_fit(lengths: list[int], most: int) -> list[int]:
    """Bin of each item: longest first (stable), into the fullest bin that takes it, the earliest of equal ones.

    Open bins are kept sorted by (free, bin), so a placement is a binary search.
    """
    bins: list[tuple[int, int]] = []
    out, opened = [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -min(lengths[i], most)):
        n = min(lengths[i], most)
        at = bisect_left(bins, (n, -1))
        if at < len(bins):
            free, b = bins.pop(at)
        else:
            free, b, opened = most, opened, opened + 1
        out[i] = b
        insort(bins, (free - n, b))
    return out


def bin_plan(df: DataFrame, key: str, ids: str, most: int, groups: list[str]) -> DataFrame:
    """groups, key, ``bin``, ``place``: only keys and lengths go to Python, a shard (bounded by its tokens) to a task."""
    rows = df.select(*groups, key, F.least(F.size(ids), F.lit(most)).alias("n"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*groups, key])

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        lengths = pdf["n"].tolist()
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        place = [0] * len(lengths)
        for p, i in enumerate(order):
            place[i] = p
        return pdf[[*groups, key]].assign(bin=plan_best_fit(lengths, most), place=place)

    return rows.groupBy(*groups).applyInPandas(plan, f"{kinds}, bin int, place int")


PACKERS = Registry()


@PACKERS.register("simple")
def _simple(df: DataFrame, key: str, arrays: list[str], most: int, groups: list[str], mode: str) -> DataFrame:
    return df.select(*groups, key, *[truncate(F.col(a), most, mode).alias(a) for a in arrays])


@PACKERS.register("bfd")
def _best_fit(df: DataFrame, key: str, arrays: list[str], most: int, groups: list[str], mode: str) -> DataFrame:
    capped = df.select(*groups, key, *[truncate(F.col(a), most, mode).alias(a) for a in arrays])
    placed = capped.join(bin_plan(df, key, arrays[0], most, groups), [*groups, key])
    whole = placed.groupBy(*groups, "bin").agg(F.array_sort(F.collect_list(F.struct("place", *arrays))).alias("_all"), F.count(F.lit(1)).alias("members"))

    def members(name: str):
        return F.flatten(F.transform("_all", lambda x: F.coalesce(x[name], F.array().cast("array<int>"))))

    return whole.select(*groups, "bin", "members", *[truncate(members(a), most).alias(a) for a in arrays])


@PACKERS.register("bfd_split")
def _split_best_fit(df: DataFrame, key: str, arrays: list[str], most: int, groups: list[str], mode: str) -> DataFrame:
    if most > 0:
        at = F.sequence(F.lit(0), F.floor((F.greatest(F.size(arrays[0]), F.lit(1)) - 1) / most))
        cut = df.select(*groups, key, *arrays, F.explode(at).alias("_chunk"))
        name = F.concat_ws("/", F.lpad(F.col(key).cast("string"), 20, "0"), F.lpad(F.col("_chunk").cast("string"), 10, "0"))
        df = cut.select(*groups, name.alias(key), *[F.slice(a, (F.col("_chunk") * most + 1).cast("int"), F.lit(most)).alias(a) for a in arrays])
    return _best_fit(df, key, arrays, most, groups, mode)


def pack(df: DataFrame, key: str, arrays: list[str], most: int, groups: list[str], strategy: str = "simple", mode: str = "keep_start") -> DataFrame:
    """Packed rows. ``arrays[0]`` drives the plan; all arrays are cut and joined alike.

    ``simple`` truncates each record. ``bfd`` joins the members of a bin in the order of placement and
    truncates. ``bfd_split`` first cuts longer records into chunks, so that no token is lost.
    Null arrays stay absent (null) under simple and are empty in bins. Further strategies can be registered.
    """
    return PACKERS.get(strategy)(df, key, arrays, most, groups, mode)
