"""Queries of the training-data problems; production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm import budget, chunks, containers, encode, leakage, mixing, neardup, pairs, pii
from tokenmill.llm.common import prompt_of, table

CAPACITY = 2048


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """rollout_id and the contents of the messages in order, joined by line feeds, null as empty."""
    contents = F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("")))
    return table(spark, d, "rollout").select("rollout_id", F.array_join(contents, "\n").alias("text"))


def _near(spark: SparkSession, d: str):
    """The two corpora side by side; the last bit of an id tells the corpus (ids within 62 bits and a sign)."""
    a = table(spark, d, "pretrain").select((F.col("record_id") * 2).alias("id"), "text")
    b = conversations(spark, d).select((F.col("rollout_id") * 2 + 1).alias("id"), "text")
    both = a.unionByName(b)
    return neardup.near_duplicates(both, "id", "text", k=3, threshold=0.6)


def _own_id(column):
    return F.shiftright(column, 1)


def _of_rollout(column):
    return column.bitwiseAND(F.lit(1)) == 1


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = _near(spark, d)
    found = neardup.all_pairs(links, members).filter(_of_rollout(F.col("id_a")) == _of_rollout(F.col("id_b")))
    x, y = _own_id(F.col("id_a")), _own_id(F.col("id_b"))
    corpus = F.when(_of_rollout(F.col("id_a")), "rollout").otherwise("pretrain").alias("corpus")
    return found.select(corpus, F.least(x, y).alias("id_a"), F.greatest(x, y).alias("id_b")).distinct()


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes over both corpora. class_corpus and class_id name a class's first record: the least id of pretrain, else of rollout."""
    classes = neardup.duplicate_classes(*_near(spark, d))
    first = classes.groupBy("class_id").agg(F.min(F.struct(_of_rollout(F.col("id")).alias("col1"), _own_id(F.col("id")).alias("id"))).alias("first"))
    corpus = lambda rollout: F.when(rollout, "rollout").otherwise("pretrain")
    return classes.join(first, "class_id").select(
        corpus(_of_rollout(F.col("id"))).alias("corpus"), _own_id(F.col("id")).alias("record_id"), corpus(F.col("first.col1")).alias("class_corpus"), F.col("first.id").alias("class_id"), "n_links"
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.single_defect(pairs.defective_pairs(table(spark, d, "dpo_tokenize")))


def p3_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "single_output_mask_builder"), table(spark, d, "mix_targets"))[0]


def _mix(total: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        targets = table(spark, d, "mix_targets")
        taken, plan = mixing.mix(table(spark, d, "single_output_mask_builder"), targets, total_tokens=total)
        return mixing.mix_report(taken, plan, targets)

    return query


def _budget_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "pretrain").select("record_id", "text", "source", F.lower(F.trim("lang")).alias("lang"), "ingested_at")
    return rows, budget.domains(rows, table(spark, d, "single_output_mask_builder"), "record_id")


def _budget() -> budget.TokenBudget:
    return budget.TokenBudget("record_id", "text", ["source", "lang", "domain"], order_col="ingested_at")


def p4_cube(spark: SparkSession, d: str) -> DataFrame:
    return _budget().update(*_budget_rows(spark, d))


def p4_update(spark: SparkSession, d: str) -> DataFrame:
    """The same cube in two steps, the second by a budget that opens what the first has left: what had come by the middle of the deliveries, then everything."""
    (rows, domain), kept = _budget_rows(spark, d), _budget()
    came = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    middle = rows.agg(F.percentile_approx(came, 0.5)).first()[0]
    kept.update(rows.filter(came <= F.lit(middle)), domain)
    later = _budget()
    later.path = kept.path
    return later.update(rows, domain)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    dpo = table(spark, d, "dpo_tokenize")
    prompts = dpo.select("record_id", prompt_of(dpo).alias("text"))
    one = leakage.find_leaks(table(spark, d, "pretrain"), "record_id", "text", items).withColumn("corpus", F.lit("pretrain"))
    return one.unionByName(leakage.find_leaks(prompts, "record_id", "text", items).withColumn("corpus", F.lit("dpo_tokenize")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("corpus", "record_id", "item_id").distinct()


def p5_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.removal_spans(_leaks(spark, d), "corpus", "record_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_oversized(table(spark, d, "pretrain"), "record_id", "text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.token_counts(table(spark, d, "documents").select("doc_id", "text"), "text")
    return containers.pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill_report(p8_containers(spark, d), CAPACITY)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_mentions(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "kind", "start_char")


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.mask(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found,
        "p3_selection": p3_selection, "p3_mix": _mix("reachable"), "p3_mix_corpus": _mix("corpus"),
        "p4_cube": p4_cube, "p4_update": p4_update, "p5_found": p5_found, "p5_spans": p5_spans,
        "p6_pieces": p6_pieces, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill,
        "p9_found": p9_found, "p9_masked": p9_masked,
    }


TOKENS = "regexp_extract_all(regexp_replace(lower({}), '([\\x{{4e00}}-\\x{{9fff}}])', ' \\1 ', 'g'), '[\\pL\\pN]+')"
P1_SQL = f"""
with texts as (select 'pretrain' as corpus, record_id as id, any_value(text) as t from pretrain group by 2
 union all select 'rollout', rollout_id, any_value(array_to_string([coalesce(m.content, '') for m in messages], chr(10))) from rollout group by 2),
w as (select corpus, id, {TOKENS.format("t")} as w from texts where t is not null),
g as (select distinct corpus, id, hash(w[i], w[i + 1], w[i + 2]) as g from w, unnest(range(1, len(w) - 1)) as u(i)),
n as (select corpus, id, count(*) as n from g group by 1, 2),
p as (select a.corpus, a.id as id_a, b.id as id_b, count(*) as shared from g a join g b on a.corpus = b.corpus and a.g = b.g and a.id < b.id group by 1, 2, 3)
select p.corpus, id_a, id_b from p join n x on x.corpus = p.corpus and x.id = id_a join n y on y.corpus = p.corpus and y.id = id_b where shared >= 0.6 * (x.n + y.n - shared)"""
P5_RUN = "array_to_string(w[i : i + 11], ' ')"
P5_SQL = f"""
with texts as (select 'pretrain' as corpus, record_id, text as t from pretrain union all select 'dpo_tokenize', record_id, coalesce(prompt, legacy_input) from dpo_tokenize),
w as (select corpus, record_id, {TOKENS.format("t")} as w from (select distinct * from texts) where t is not null),
q as (select item_id, {TOKENS.format("question")} as w from eval_items),
i as (select distinct item_id, {P5_RUN} as g from q, unnest(range(1, len(w) - 10)) as u(i))
select distinct corpus, record_id, item_id from (select corpus, record_id, {P5_RUN} as g from w, unnest(range(1, len(w) - 10)) as u(i)) join i using (g)"""


def oracle_sql() -> dict[str, str]:
    """All pairs and all runs of twelve, for small tables; the other operators can't be said in SQL (tests/llm compares them exactly)."""
    return {"p1_found": P1_SQL, "p5_found": P5_SQL}
