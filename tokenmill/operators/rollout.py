"""Groups of responses: expansion of prompts, scoring by a reward model, padding to batches, scores of turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.operators.collate import pad_left, pad_right, valid_mask
from tokenmill.operators.pack import bin_plan
from tokenmill.registry import Registry


class RewardModel:
    """Scores a batch: prompts and a list of responses each, to a list of numbers each."""

    def score(self, prompts: list[str], responses: list[list[str]]) -> list[list[float]]:
        raise NotImplementedError


REWARDS = Registry(RewardModel)


def expand_groups(prompts: DataFrame, size: int, out: str = "member") -> DataFrame:
    """Every prompt ``size`` times, numbered from 0; narrow."""
    if size < 1:
        raise ValueError("a group has at least one member")
    return prompts.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))


def score_responses(df: DataFrame, model: str | RewardModel, prompt: str, responses: str, out: str = "rewards") -> DataFrame:
    """``df`` and the rewards of its responses, an Arrow batch at a time; null lists have null."""
    judge = REWARDS.create(model) if isinstance(model, str) else model
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(prompt).alias("p"), F.col(responses).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts, answers = (b.column(i).to_pylist() for i in (1, 2))
            at = [i for i, a in enumerate(answers) if a is not None]
            scores: list = [None] * len(answers)
            for i, got in zip(at, judge.score([prompts[i] or "" for i in at], [[x or "" for x in answers[i]] for i in at])):
                if len(got) != len(answers[i]):
                    raise ValueError(f"{len(got)} rewards for {len(answers[i])} responses")
                scores[i] = [float(x) for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.list_(pa.float64()))], names=["row", out])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {out} array<double>").select("row.*", out)


def collate_rollouts(df: DataFrame, batch: str, key: str, prompts: str = "prompts", responses: str = "responses", logprobs: str = "logprobs") -> DataFrame:
    """Prompts padded left with a mask; responses, their masks and old log-probabilities to the batch's longest response, at least 1.

    Ids and log-probabilities of unequal number are an error of the run, as is a batch of unequal groups.
    """
    w = Window.partitionBy(batch)
    sizes = lambda c: F.transform(c, F.size)
    lps = F.when(sizes(responses) == sizes(logprobs), F.col(logprobs)).otherwise(F.raise_error(F.lit("ids and log-probabilities differ in number")).cast(df.schema[logprobs].dataType))
    rows = df.withColumn(logprobs, lps).withColumn("_p", F.max(F.size(prompts)).over(w)).withColumn("_least", F.min(F.size(responses)).over(w)).withColumn("_most", F.max(F.size(responses)).over(w))
    same = F.when(F.col("_least") == F.col("_most"), F.col(responses)).otherwise(F.raise_error(F.lit("groups of one batch differ in size")).cast(df.schema[responses].dataType))
    longest = F.greatest(F.coalesce(F.array_max(sizes(responses)), F.lit(1)), F.lit(1))
    rows = rows.withColumn("_r", F.max(longest).over(w))
    return rows.select(
        batch, key, pad_left(F.col(prompts), F.col("_p")).alias("prompts"), valid_mask(F.col(prompts), F.col("_p"), left=True).alias("prompt_mask"),
        F.transform(same, lambda x: pad_right(x, F.col("_r"))).alias("responses"), F.transform(responses, lambda x: valid_mask(x, F.col("_r"))).alias("response_mask"),
        F.transform(logprobs, lambda x: pad_right(x, F.col("_r"), 0.0)).alias("logprobs_old"),
    )


def pair_bins(pairs: DataFrame, key: str, context: str, response: str, most: int, groups: list[str]) -> DataFrame:
    """``bin`` and ``place`` of every pair, packed best-fit decreasing by the length of both together, a group to a task."""
    return bin_plan(pairs.withColumn("_both", F.concat(context, response)), key, "_both", most, groups)


def conversation_difficulty(turns: DataFrame, conversation: str, score: str = "ifd") -> DataFrame:
    """Mean difficulty over a conversation's valid turns (null if none is), and how many turns it has and are valid."""
    return turns.groupBy(conversation).agg(F.round(F.avg(score), 6).alias(score), F.count(F.lit(1)).alias("turns"), F.count(score).alias("valid"))


def recent_counts(prompt: Column, output: Column, window: int) -> Column:
    """Map from id to its number among the last ``window`` ids of the prompt and all of the output."""
    if window <= 0:
        raise ValueError("rep_window must be above 0")
    ids = F.concat(F.slice(prompt, F.greatest(F.size(prompt) - window + 1, F.lit(1)), F.lit(window)), output)
    return F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i, F.size(F.filter(ids, lambda x: x == i)))))


def token_cross_entropy(logprobs: Column, mean_logprobs: Column, mask: Column | None = None, smoothing: float = 0.0) -> Column:
    """Smoothed loss of a sequence: mean over the tokens whose mask isn't 0 (all without a mask); null if none is left."""
    kept = F.arrays_zip(logprobs.alias("x"), mean_logprobs.alias("m"), (F.coalesce(mask, F.transform(logprobs, lambda _: F.lit(1))) if mask is not None else F.transform(logprobs, lambda _: F.lit(1))).alias("k"))
    loss = F.transform(F.filter(kept, lambda z: z["k"] != 0), lambda z: -(1 - smoothing) * z["x"] - smoothing * z["m"])
    return F.when(F.size(loss) > 0, F.aggregate(loss, F.lit(0.0), lambda a, x: a + x) / F.size(loss))
