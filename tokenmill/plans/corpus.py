"""The corpus build from records to shards, and the views that training reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.config import BuildConfig
from tokenmill.operators.build import build
from tokenmill.operators.pack import pack
from tokenmill.operators.scans import position_ids, shard_epochs, shard_index
from tokenmill.sources.store import cast_keys, require_keys

TEXT_CONFIG = BuildConfig.from_dict({"input": {"sections": [{"field": "text", "action": "train"}]}, "output": {"domain_key": "source"}})
CHAT_CONFIG = BuildConfig.from_dict(
    {"input": {"sections": [{"field": "messages", "action": "$role", "template": True}]}, "mask": {"system": "mask", "user": "mask", "assistant": "train"}, "output": {"domain_key": "source"}}
)


def prepare(records: DataFrame, key: str, config: BuildConfig, tokenizer="codepoint") -> DataFrame:
    """Filtered, tokenized, masked, sharded and packed rows with position ids.

    A mask that a record lacks is all ones. Filters stand before the tokenizer in the
    plan; the shuffles are those of shard cuts and of packing.
    """
    built = build(records, config, tokenizer, keep=(key,))
    ones = F.transform("sequence", lambda _: F.lit(1))
    built = built.withColumn("loss_mask", F.coalesce("loss_mask", ones)).withColumn("n_tokens", F.size("sequence"))
    cut = shard_index(shard_epochs(built, key, "n_tokens", config.max_tokens_per_shard))
    arrays = ["sequence", "loss_mask"]
    if config.position_ids_mode == "doc_reset":
        cut = cut.withColumn("position_ids", position_ids(F.col("sequence"), "doc_reset"))
        arrays.append("position_ids")
    packed = pack(cut, key, arrays, config.max_packed_len, ["domain", "shard_idx"], config.packing_strategy, config.truncation_mode)
    return cast_keys(packed, config.dtype)


def dataset_view(df: DataFrame, kind: str) -> DataFrame:
    """Columns of a training view (``seq``, ``sft``, ``dpo``, ``grpo``); a missing key is a KeyError."""
    require_keys(df, kind)
    if kind == "seq":
        return df.select(F.expr("slice(sequence, 1, greatest(size(sequence) - 1, 0))").cast("array<bigint>").alias("input"), F.expr("slice(sequence, 2, size(sequence))").cast("array<bigint>").alias("target"))
    if kind == "sft":
        n = "greatest(size(sequence) - 1, 0)"
        return df.select(
            F.expr(f"slice(sequence, 1, {n})").cast("array<bigint>").alias("input"), F.expr("slice(sequence, 2, size(sequence))").cast("array<bigint>").alias("target"),
            F.expr(f"slice(position_ids, 1, {n})").cast("array<bigint>").alias("position_ids"), F.expr("slice(loss_mask, 2, size(loss_mask))").cast("array<boolean>").alias("loss_mask"),
        )
    if kind == "dpo":
        return df.select(*[F.col(c).cast("array<boolean>" if "mask" in c else "array<bigint>").alias(c) for c in ("chosen", "rejected", "chosen_mask", "rejected_mask")])
    return df.select(
        F.col("prompts").cast("array<bigint>"), F.col("responses").cast("array<array<bigint>>"), F.col("masks").cast("array<array<boolean>>"), F.col("rewards").cast("array<float>")
    )
