"""Batches of equal length: padding and masks, batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pad_right(ids: Column, size: Column, value=0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))))


def pad_left(ids: Column, size: Column, value=0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), F.greatest(size - F.size(ids), F.lit(0))), ids)


def valid_mask(ids: Column, size: Column, left: bool = False) -> Column:
    """True at real tokens of a padded sequence."""
    real, pad = F.transform(ids, lambda _: F.lit(True)), F.array_repeat(F.lit(False), F.greatest(size - F.size(ids), F.lit(0)))
    return F.concat(pad, real) if left else F.concat(real, pad)


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(position) / size))


def collate_dpo(df: DataFrame, batch: str = "batch") -> DataFrame:
    """chosen, rejected and their masks padded right to the longest of both in the batch."""
    longest = F.max(F.greatest(F.size("chosen"), F.size("rejected"))).over(Window.partitionBy(batch))
    rows = df.withColumn("_size", longest)
    return rows.withColumns({c: pad_right(F.col(c), F.col("_size")) for c in ("chosen", "chosen_mask", "rejected", "rejected_mask")}).drop("_size")


def _rows_to(lists: Column, size: Column) -> Column:
    """The first ``size`` lists, filled up with empty ones."""
    return F.concat(F.slice(lists, F.lit(1), size), F.array_repeat(F.array(), F.greatest(size - F.size(lists), F.lit(0))))


def collate_grpo(df: DataFrame, batch: str = "batch") -> DataFrame:
    """Prompts padded left with a mask; responses and masks to [G, R], rewards to [G], with zeros.

    G is the number of responses of the batch's first row (by ``record_id``): surplus ones of other rows are ignored,
    but R is the longest of all responses, as in the reference.
    """
    w = Window.partitionBy(batch)
    rows = df.withColumn("_p", F.max(F.size("prompts")).over(w))
    rows = rows.withColumn("_g", F.min_by(F.size("responses"), "record_id").over(w))
    longest = F.greatest(F.array_max(F.transform("responses", F.size)), F.lit(1))
    rows = rows.withColumn("_r", F.max(longest).over(w))
    padded = lambda c: F.transform(_rows_to(F.col(c), F.col("_g")), lambda x: pad_right(x, F.col("_r")))
    return rows.select(
        batch, "record_id",
        pad_left(F.col("prompts"), F.col("_p")).alias("prompts"), valid_mask(F.col("prompts"), F.col("_p"), left=True).alias("prompt_mask"),
        padded("responses").alias("responses"), padded("masks").alias("masks"),
        pad_right(F.slice(F.col("rewards").cast("array<float>"), F.lit(1), F.col("_g")), F.col("_g"), 0.0).cast("array<float>").alias("rewards"),
    )


def collate_ids(df: DataFrame, ids: str, pad_id: int, batch: str = "batch") -> DataFrame:
    """ids padded right with ``pad_id`` and ``attention_mask``."""
    size = F.max(F.size(ids)).over(Window.partitionBy(batch))
    rows = df.withColumn("_size", size)
    return rows.withColumn("attention_mask", valid_mask(F.col(ids), F.col("_size"))).withColumn(ids, pad_right(F.col(ids), F.col("_size"), pad_id)).drop("_size")
