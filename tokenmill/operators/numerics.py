"""Row-wise numerics over logits, log-probabilities, rewards and steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tokenmill.operators.scans import seeded_hash

def row() -> WindowSpec:
    """The tokens of one row."""
    return Window.partitionBy("row_id")


def validate_sampling(top_k: int = 0, top_p: float = 1.0, temperature: float = 1.0, frequency_penalty: float = 0.0, rep_window: int = 64) -> None:
    bad = []
    if not isinstance(top_k, int) or top_k < 0:
        bad.append("top_k must be a whole number of at least 0")
    if not 0 <= top_p <= 1:
        bad.append("top_p must be between 0 and 1")
    if temperature < 0:
        bad.append("temperature must be at least 0")
    if not -2 <= frequency_penalty <= 2:
        bad.append("frequency_penalty must be between -2 and 2")
    if rep_window <= 0:
        bad.append("rep_window must be above 0")
    if bad:
        raise ValueError("; ".join(bad))


def with_temperature(logits: DataFrame, t: float) -> DataFrame:
    return logits.withColumn("logit", F.col("logit") / max(t, 1e-8))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Keeps the k greatest of each row and all that equal the last of them; 0 keeps all."""
    if k == 0:
        return logits
    return logits.withColumn("_r", F.rank().over(row().orderBy(F.desc("logit")))).filter(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, out: str = "prob") -> DataFrame:
    shifted = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(row())))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(row())).drop("_e")


def top_p(logits: DataFrame, p: float) -> DataFrame:
    """Drops what comes after the running probability is above p; the first always stays."""
    if p >= 1:
        return logits
    order = row().orderBy(F.desc("logit"), "token_id").rowsBetween(Window.unboundedPreceding, -1)
    run = softmax(logits).withColumn("_before", F.coalesce(F.sum("prob").over(order), F.lit(0.0)))
    first = F.row_number().over(row().orderBy(F.desc("logit"), "token_id")) == 1
    return run.withColumn("_first", first).filter((F.col("_before") <= p) | F.col("_first")).drop("_before", "_first", "prob")


def occurrence_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("row_id", "token_id").agg(F.count(F.lit(1)).alias("n"))


def frequency_penalty(logits: DataFrame, counts: DataFrame, penalty: float) -> DataFrame:
    joined = logits.join(counts.select("row_id", "token_id", "n"), ["row_id", "token_id"], "left")
    return joined.withColumn("logit", F.col("logit") - penalty * F.coalesce("n", F.lit(0))).drop("n")


def filtered(logits: DataFrame, counts: DataFrame | None = None, temperature: float = 1.0, k: int = 0, p: float = 1.0, penalty: float = 0.0) -> DataFrame:
    """Temperature, top-k, top-p, then the penalty; probabilities of what is left."""
    validate_sampling(k, p, temperature, penalty)
    out = top_p(top_k(with_temperature(logits, temperature), k), p)
    if penalty and counts is not None:
        out = frequency_penalty(out, counts, penalty)
    return softmax(out)


def sample_tokens(logits: DataFrame, seed: int, **options) -> DataFrame:
    """One token per row: greedy at temperature 0, else by seeded Gumbel noise; with its log-probability."""
    if options.get("temperature", 1.0) == 0:
        rows, score = softmax(logits), F.col("logit")
    else:
        rows = filtered(logits, **options)
        u = (seeded_hash(F.col("row_id"), F.col("token_id"), seed, digits=13) + 0.5) / float(1 << 52)
        score = F.ln("prob") - F.ln(-F.ln(u))
    best = F.max_by(F.struct("token_id", F.ln("prob").alias("logprob")), F.struct(score, (-F.col("token_id"))))
    return rows.groupBy("row_id").agg(best.alias("b")).select("row_id", "b.token_id", "b.logprob")


def log_softmax_gather(logits: DataFrame, targets: DataFrame) -> DataFrame:
    """Log-probability of the target token of each row."""
    m = logits.groupBy("row_id").agg(F.max("logit").alias("m"))
    z = logits.join(m, "row_id").groupBy("row_id").agg(F.first("m").alias("m"), F.sum(F.exp(F.col("logit") - F.col("m"))).alias("z"))
    got = logits.join(targets, ["row_id", "token_id"])
    return got.join(z, "row_id").select("row_id", "token_id", (F.col("logit") - F.col("m") - F.ln("z")).alias("logprob"))


def masked_reduce(logprobs: Column, mask: Column, how: str = "mean") -> Column:
    """Sum or mean of the log-probabilities where the mask is 1; the mean divides by at least 1."""
    total = F.aggregate(F.zip_with(logprobs, mask, lambda x, m: x * m), F.lit(0.0), lambda a, x: a + x)
    if how == "sum":
        return total
    return total / F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1.0))


def smoothed_cross_entropy(logprob: Column, mean_logprob: Column, smoothing: float = 0.0) -> Column:
    """Loss of one token from its log-probability and the mean of those of the vocabulary."""
    return -(1 - smoothing) * logprob - smoothing * mean_logprob


def dpo_loss(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    z = beta * ((policy_chosen - policy_rejected) - (ref_chosen - ref_rejected))
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))


def group_advantage(rewards: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """(reward - mean) / (population deviation + 1e-8) within the group; equal rewards have 0."""
    w = Window.partitionBy(group)
    return rewards.withColumn("advantage", (F.col(reward) - F.avg(reward).over(w)) / (F.stddev_pop(reward).over(w) + 1e-8))


def grpo_token_loss(logprob: Column, old_logprob: Column, ref_logprob: Column, advantage: Column, clip: float = 0.2, kl: float = 0.01, eps: float = 1e-8) -> Column:
    """Clipped surrogate and the penalty r - ln(r + eps) - 1 with r = reference over policy, of one token."""
    ratio = F.exp(logprob - old_logprob)
    surrogate = F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)
    r = F.exp(ref_logprob - logprob)
    return -surrogate + kl * (r - F.ln(r + eps) - 1)


def token_mean(loss: Column, mask: Column) -> Column:
    """Aggregate: mean of ``loss`` over the tokens whose mask is 1, divided by at least 1."""
    kept = F.coalesce(mask.cast("double"), F.lit(0.0))
    return F.coalesce(F.sum(F.when(kept != 0, loss * kept)), F.lit(0.0)) / F.greatest(F.sum(kept), F.lit(1.0))


def best_and_worst(rewards: DataFrame, group: str, index: str, reward: str = "reward") -> DataFrame:
    """Index of the best and the worst response, the first of equal ones."""
    return rewards.groupBy(group).agg(
        F.max_by(index, F.struct(F.col(reward), -F.col(index))).alias("best"), F.min_by(index, F.struct(F.col(reward), F.col(index))).alias("worst")
    )


def route_experts(gates: DataFrame, k: int) -> DataFrame:
    """The k greatest weights of each row, renormalised."""
    top = gates.withColumn("_r", F.row_number().over(row().orderBy(F.desc("weight"), "expert"))).filter(F.col("_r") <= k)
    return top.withColumn("weight", F.col("weight") / F.sum("weight").over(row())).drop("_r")


def cosine_rate(step: Column, warmup: int, total: int, least: float = 0.1) -> Column:
    """Linear warm-up, then half a cosine down to ``least``."""
    done = F.least((step - warmup) / max(1, total - warmup), F.lit(1.0))
    return F.when(step < warmup, F.greatest(step / max(1, warmup), F.lit(least))).otherwise(F.greatest(0.5 * (1 + F.cos(math.pi * done)), F.lit(least)))


def restart_rate(step: Column, warmup: int, cycle: int, growth: int = 2, least: float = 0.1) -> Column:
    """Cosine with restarts; each cycle is ``growth`` times as long as the one before."""
    at = F.greatest(step - warmup, F.lit(0)).cast("double")
    if growth == 1:
        inside, length = at % cycle, F.lit(float(cycle))
    else:
        n = F.floor(F.ln(at / cycle * (growth - 1) + 1) / math.log(growth) + 1e-12)
        length = cycle * F.pow(F.lit(float(growth)), n)
        inside = at - cycle * (F.pow(F.lit(float(growth)), n) - 1) / (growth - 1)
    wave = least + (1 - least) * 0.5 * (1 + F.cos(math.pi * inside / length))
    return F.when(step < warmup, F.greatest(step / max(1, warmup), F.lit(least))).otherwise(wave)


def stable_decay_rate(step: Column, warmup: int, stable: int, decay: int, least: float = 0.1) -> Column:
    """Warm-up, a flat stretch, then least + (1 - least) (1 - r)^2."""
    r = F.least((step - warmup - stable) / max(1, decay), F.lit(1.0))
    fall = least + (1 - least) * (1 - r) * (1 - r)
    return F.when(step < warmup, F.greatest(step / max(1, warmup), F.lit(least))).when(step < warmup + stable, F.lit(1.0)).otherwise(fall)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def pool(states: Column, mask: Column, how: str = "mean") -> Column:
    """One vector from token vectors: the first, the last real one, or the mean of the real ones."""
    real = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["s"])
    if how == "cls":
        return states[0]
    if how == "last":
        return F.try_element_at(real, F.lit(-1))
    if how != "mean":
        raise ValueError(f"unknown pooling {how!r}")
    total = F.aggregate(real, F.transform(states[0], lambda x: x * 0.0).cast("array<double>"), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(real), F.lit(1)))
