"""Filling fixed-capacity containers (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import written


class OpenBins:
    """Bounded-space best-fit: at most ``open_bins`` open bins, keyed by free space.

    ``mask`` is one integer used as a bitset with bit f set where a bin with f
    free units is open, so the best fit for a size s is the lowest set bit at or
    above s, and the fullest bin is the lowest set bit of all. A new bin that
    would be one too many closes the fullest first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.mask, self.by_free, self.n_open, self.next_bin = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop(0)
        if not bins:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def _put(self, bin_id: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(bin_id)
            self.mask |= 1 << free
            self.n_open += 1

    def add(self, size: int) -> int:
        """The bin of an item of at most ``capacity``."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            if self.n_open == self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
            bin_id, free = self.next_bin, self.capacity
            self.next_bin += 1
        self._put(bin_id, free - size)
        return bin_id

    def whole(self) -> int:
        """A bin of its own that is never open."""
        self.next_bin += 1
        return self.next_bin - 1


def pack(
    sized: DataFrame, id_col: str, size_col: str, capacity: int = 2048, open_bins: int = 64, block_rows: int = 20_000
) -> DataFrame:
    """Assign every item to containers: id, ``container``, ``part``, ``used``, ``fill``.

    Items are spread over blocks by a hash of the id, ``block_rows`` to a block on
    average, and each block is packed online in the order of (hash, id), so the
    result doesn't depend on partitions. Only (id, size) crosses the shuffle; a
    block's items stream through ``open_bins`` open bins. An item over the
    capacity is cut into full containers (part 0, 1, ...) and a rest that is
    packed like any item; all others stay whole (part 0). Items of size null or
    0 take no space: their container is null. Repeated ids are separate items.
    ``used`` is what the part takes. At most one open list per block is left
    part-filled, so the loss is bounded by ``open_bins`` bins per ``block_rows`` items.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    rows = sized.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("size"))
    rows = written(rows, "pack-sizes")  # sizes are counted once
    id_type = rows.schema["id"].dataType.simpleString()
    n_blocks = max(1, -(-rows.count() // block_rows))
    mixed = F.xxhash64("id", F.lit(17))
    empty = F.coalesce(F.col("size"), F.lit(0)) <= 0
    keyed = rows.filter(~empty).select("id", "size", mixed.alias("h"), F.pmod(mixed, F.lit(n_blocks)).alias("block"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins: OpenBins | None = None
        now = None
        for frame in frames:
            out = []
            for block, item, size in zip(frame["block"].tolist(), frame["id"].tolist(), frame["size"].tolist()):
                if block != now:
                    now, bins = block, OpenBins(capacity, open_bins)
                part = 0
                while size > capacity:
                    out.append((item, block, bins.whole(), part, capacity))
                    size -= capacity
                    part += 1
                out.append((item, block, bins.add(size), part, size))
            yield pd.DataFrame(out, columns=["id", "block", "bin", "part", "used"])

    packed = (
        keyed.repartition("block")
        .sortWithinPartitions("block", "h", "id", "size")
        .mapInPandas(run, f"id {id_type}, block bigint, bin bigint, part int, used bigint")
        .select("id", (F.col("block") * F.lit(1 << 32) + F.col("bin")).alias("container"), "part", "used")
    )
    nothing = rows.filter(empty).select(
        "id", F.lit(None).cast("bigint").alias("container"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("used")
    )
    return packed.unionByName(nothing).withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, parts, used units and the share of unused space."""
    full = packed.filter("container is not null").groupBy("container").agg(
        F.sum("used").alias("used"), F.count(F.lit(1)).alias("parts")
    )
    return full.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        (F.lit(1.0) - F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity))).alias("unused_share"),
    )
