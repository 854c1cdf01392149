"""Scores: ROUGE, perplexity, instruction difficulty, multiple choice, pass@k, weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tokenmill.functions.text import WS, f1, quoted, strip, words
from tokenmill.operators.build import render_chat


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    return F.aggregate(
        F.array_distinct(a), F.lit(0),
        lambda n, g: n + F.least(F.size(F.filter(a, lambda x: x == g)), F.size(F.filter(b, lambda x: x == g))),
    )


def rouge_n(df: DataFrame, key: str, reference: str, candidate: str, n: int) -> DataFrame:
    """precision, recall and F1 per row (``key`` is unique) from counted n-grams.

    Both texts explode to 64-bit hashes of their n-grams and are counted by (key, n-gram),
    linear in the texts; rows that are partitioned by ``key`` already aren't shuffled again.
    """
    def side(col: str, name: str) -> Column:
        def grams(t: Column) -> Column:
            at = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
            runs = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(t, i, F.lit(n))).alias("g"), F.lit(name).alias("side")))
            return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<struct<g:bigint,side:string>>"))

        # through a lambda variable, so that the text is split once and not per n-gram
        return F.transform(F.array(words(F.col(col))), grams)[0]

    each = df.select(key, F.explode_outer(F.concat(*[F.coalesce(side(c, s), F.array().cast("array<struct<g:bigint,side:string>>")) for c, s in ((reference, "r"), (candidate, "c"))])).alias("x"))
    counts = each.groupBy(key, F.col("x.g").alias("g")).agg(F.count_if(F.col("x.side") == "r").alias("r"), F.count_if(F.col("x.side") == "c").alias("c"))
    rows = counts.groupBy(key).agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum(F.least("r", "c")).alias("shared"))
    p = F.when(F.col("c") > 0, F.col("shared") / F.col("c")).otherwise(F.lit(0.0))
    r = F.when(F.col("r") > 0, F.col("shared") / F.col("r")).otherwise(F.lit(0.0))
    return rows.select(key, p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step per token of ``b``."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(df: DataFrame, key: str, reference: str, candidate: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, words(F.coalesce(reference, F.lit(""))).alias("r"), words(F.coalesce(candidate, F.lit(""))).alias("c"))

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "n_r": f["r"].map(len), "n_c": f["c"].map(len), "lcs": [lcs_length(list(a), list(b)) for a, b in zip(f["r"], f["c"])]})

    got = rows.mapInPandas(run, f"{key} {kind}, n_r int, n_c int, lcs int")
    p = F.when(F.col("n_c") > 0, F.col("lcs") / F.col("n_c")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_r") > 0, F.col("lcs") / F.col("n_r")).otherwise(F.lit(0.0))
    return got.select(key, "lcs", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    """Mean of each score over rows; null for no rows."""
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def token_type(token: Column, special: Column | None = None) -> Column:
    out = F.when(special, F.lit("special")) if special is not None else F.when(F.lit(False), F.lit(""))
    return out.when(token.rlike(r"[\x{4e00}-\x{9fff}]"), F.lit("cjk")).when(token.rlike(r"[^\x00-\x7f]"), F.lit("non_ascii")).otherwise(F.lit("ascii"))


def perplexity_stats(losses: DataFrame, loss: str = "loss", by: list[str] | None = None) -> DataFrame:
    """Mean, exp(mean), median and linear percentiles of token losses; null and NaN losses don't count."""
    good = losses.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    q = F.percentile(loss, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = good.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("tokens"), F.avg(loss).alias("mean_loss"), q.alias("_q"))
    return out.select(*(by or []), "tokens", "mean_loss", F.exp("mean_loss").alias("perplexity"), *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


def loss_histogram(losses: DataFrame, loss: str = "loss", bins: int = 1000, top: float = 20.0) -> DataFrame:
    """Count per bin of [0, top], values clamped; mergeable, so it works on streams too."""
    good = losses.filter(F.col(loss).isNotNull() & ~F.isnan(loss))
    at = (F.least(F.greatest(F.col(loss), F.lit(0.0)), F.lit(top)) / top * (bins - 1)).cast("int")
    return good.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_percentiles(hist: DataFrame, qs: list[float], bins: int = 1000, top: float = 20.0) -> DataFrame:
    """Middle of the first bin at which the running count reaches each share."""
    w = Window.orderBy("bin")  # at most ``bins`` rows
    run = hist.withColumn("run", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    one = run.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs]))).filter(F.col("run") >= F.col("q") * F.col("total"))
    return one.groupBy("q").agg(((F.min("bin") + 0.5) * (top / bins)).alias("value"))


def difficulty(losses: DataFrame, key: str, conditional: str, unconditional: str) -> DataFrame:
    """Instruction-following difficulty: mean conditional over mean unconditional token loss; rows keep a reason when skipped."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    reason = F.when(F.col(conditional).isNull() | (F.size(conditional) == 0), "empty response").when(F.size(conditional) != F.size(unconditional), "lengths differ")
    rows = losses.withColumn("skip_reason", reason)
    ratio = F.when(F.col("skip_reason").isNull(), F.try_divide(mean(conditional), mean(unconditional)))
    each = F.when(F.col("skip_reason").isNull(), F.transform(F.arrays_zip(F.col(conditional).alias("x"), F.col(unconditional).alias("y")), lambda z: F.round(F.try_divide(z["x"], z["y"]), 6)))
    return rows.select(key, F.round(ratio, 6).alias("ifd"), each.alias("token_ratio"), "skip_reason")


def difficulty_summary(rows: DataFrame) -> DataFrame:
    v = F.col("ifd")
    return rows.agg(
        F.count(F.lit(1)).alias("count"), F.count(v).alias("valid"), F.count_if(v.isNull()).alias("skipped"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def turn_contexts(conversations: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """A row per assistant turn: all contents before it joined by blank lines, and its own."""
    each = conversations.select(key, messages, F.posexplode(messages).alias("turn", "m")).filter("m.role = 'assistant'")
    text = lambda m: F.coalesce(m["content"], F.lit(""))
    before = F.array_join(F.transform(F.slice(messages, F.lit(1), F.col("turn")), text), "\n\n")
    return each.select(key, "turn", before.alias("context"), text(F.col("m")).alias("response"))


def trim_pair(context: Column, response: Column, most: int) -> tuple[Column, Column]:
    """Response to at most half of ``most`` ids; the context keeps its end."""
    r = F.slice(response, 1, most // 2)
    room = F.lit(most) - F.size(r)
    return F.slice(context, F.greatest(F.size(context) - room + 1, F.lit(1)), F.greatest(room, F.lit(0))), r


def choice_prompt(question: Column, choices: list[Column], subject: Column) -> Column:
    """One question as the scorer asks it; null parts are empty."""
    lines = [F.concat(F.lit(f"{'ABCD'[i]}. "), F.coalesce(c, F.lit(""))) for i, c in enumerate(choices)]
    about = F.concat(F.lit("The following are multiple choice questions (with answers) about "), F.coalesce(subject, F.lit("")), F.lit(".\n"))
    return F.concat_ws("\n", about, F.concat(F.lit("Question: "), F.coalesce(question, F.lit(""))), *lines, F.lit("Answer:"))


def few_shot_chat(questions: DataFrame, examples: DataFrame, key: str, subject: str, prompt: str, answer: str, shots: int) -> DataFrame:
    """``questions`` with ``chat``: up to ``shots`` solved examples of the subject as turns, the question, and the opening of an answer.

    Examples are the first of their subject by ``key``; one small row per subject is joined.
    """
    order = Window.partitionBy(subject).orderBy(key)
    some = examples.filter(F.col(subject).isNotNull()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= shots)
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    pair = F.array(turn("user", F.col(prompt)), turn("assistant", F.col(answer)))
    solved = some.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct("_n", pair.alias("turns")))).alias("_solved"))
    joined = questions.join(solved, subject, "left") if shots > 0 else questions.withColumn("_solved", F.lit(None).cast(solved.schema["_solved"].dataType))
    before = F.coalesce(F.flatten(F.transform("_solved", lambda x: x["turns"])), F.array().cast("array<struct<role:string,content:string>>"))
    return joined.withColumn("chat", render_chat(F.concat(before, F.array(turn("user", F.col(prompt)))), add_generation_prompt=True)).drop("_solved")


def permuted_choices(key: Column, choices: list[Column], answer: Column, seed: int) -> tuple[list[Column], Column]:
    """Choices in a seeded order of their own for every question, and the letter that the right one has then."""
    letters = "ABCD"[: len(choices)]
    marks = F.array(*[F.struct(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(x)).cast("binary")).alias("h"), F.lit(x).alias("was"), c.alias("text")) for x, c in zip(letters, choices)])
    order = F.array_sort(marks)
    place = F.array_position(F.transform(order, lambda x: x["was"]), answer)
    return [order[i]["text"] for i in range(len(letters))], F.get(F.array(*map(F.lit, letters)), place - 1)


def function_body(code: Column, entry: Column) -> Column:
    """Body of a function in generated code: the indented and blank lines behind its head, from the first that isn't blank.

    Code without such a head is returned whole; a head without a body gives null.
    """
    head = F.concat(F.lit(r"def\s+"), quoted(entry), F.lit(r"(?![\p{L}\p{N}_])[^:]*:"))
    at = F.regexp_instr(code, head)
    rest = F.substr(code, at + F.length(F.regexp_substr(code, head)))
    lines = F.transform(F.split(rest, "\n"), lambda x: F.regexp_replace(x, WS + r"+\z", ""))
    first = F.coalesce(F.array_position(F.transform(lines, lambda x: x != ""), F.lit(True)), F.lit(0))
    kept = F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    ends = F.array_position(F.transform(kept, lambda x: (x != "") & ~x.rlike("^" + WS)), F.lit(True))
    body = F.array_join(F.when(ends > 0, F.slice(kept, 1, (ends - 1).cast("int"))).otherwise(kept), "\n")
    return F.when(at == 0, code).when(strip(body) != "", body)


def left_overflow(context: Column, choice: Column, most: int) -> tuple[Column, Column]:
    """Ids to score a choice with, cut at the left to ``most``, and how many of them are context."""
    ids = F.concat(context, choice)
    over = F.greatest(F.size(ids) - most, F.lit(0))
    return F.slice(ids, over + 1, F.lit(most)), F.size(context) - over


def choice_score(logprobs: Column, n_context: Column, n_choice: Column) -> Column:
    """Sum of the log-probabilities of a choice's ids; ``logprobs[i]`` is that of id i + 1. Places outside count nothing."""
    return F.aggregate(F.sequence(F.lit(0), n_choice - 1), F.lit(0.0), lambda a, i: a + F.coalesce(F.get(logprobs, n_context - 1 + i), F.lit(0.0)))


def pick_choice(scores: Column) -> Column:
    """0-based index of the greatest score, the first of equal ones."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def accuracy(rows: DataFrame, subject: str, right: Column) -> DataFrame:
    """Per subject, and overall (null subject) over all rows."""
    return rows.withColumn("_ok", right.cast("int")).groupingSets([[subject], []], subject).agg(
        F.grouping(subject).alias("overall"), F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("correct"), F.avg("_ok").alias("accuracy")
    )


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Chance that one of k of n samples passes, c of which do; null where k > n."""
    product = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i))
    return F.when(k > n, F.lit(None)).when(n - c < k, F.lit(1.0)).when(c > 0, 1 - product).otherwise(F.lit(0.0))


def trim_stop(text: Column, stops: list[str]) -> Column:
    """The text up to the first of any stop."""
    for s in stops:
        text = F.substring_index(text, s, 1)
    return text


def weight_stats(weights: DataFrame, name: str = "name", matrix: str = "matrix") -> DataFrame:
    """Per matrix: mean, unbiased deviation, min, max; energy and entropic ranks, top share and condition of its singular values."""

    def one(frames):
        for f in frames:
            out = []
            for key, rows in zip(f[name], f[matrix]):
                m = np.array([np.asarray(r, float) for r in rows])
                s = np.linalg.svd(m, compute_uv=False)
                e = s**2 / max((s**2).sum(), 1e-300)
                run = np.cumsum(e)
                p = e[e > 0]
                out.append((key, m.mean(), m.std(ddof=1) if m.size > 1 else 0.0, m.min(), m.max(), *(int(np.searchsorted(run, q - 1e-12) + 1) for q in (0.9, 0.95, 0.99)), float(np.exp(-(p * np.log(p)).sum())), float(e[0]), float(s[0] / max(s[-1], 1e-12))))
            yield pd.DataFrame(out, columns=[name, "mean", "std", "min", "max", "er_90", "er_95", "er_99", "entropic_rank", "top_share", "condition"])

    return weights.select(name, matrix).mapInPandas(one, f"{name} string, mean double, std double, min double, max double, er_90 int, er_95 int, er_99 int, entropic_rank double, top_share double, condition double")


def gradient_norms(grads: DataFrame, name: str = "name", value: str = "grad") -> DataFrame:
    """Norm per parameter, and of all (null name)."""
    return grads.rollup(name).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"), F.grouping(name).alias("overall"))
