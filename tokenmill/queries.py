"""Queries of the core operators, and the SQL that says the same over the same tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.config import BuildConfig
from tokenmill.functions import checks, text, toolcalls
from tokenmill.operators import build, collate, metrics, numerics, pack, rollout, scans
from tokenmill.operators.tokenize import Codepoints
from tokenmill.plans import corpus
from tokenmill.sources import json_files, records, store
from tokenmill.streaming import metrics as metric_stream
from tokenmill.streaming import pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CP = Codepoints()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scans.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one of the cluster (a machine's own only where the session names none)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        import tempfile

        base = tempfile.mkdtemp(prefix="tokenmill-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def total(ids: str) -> F.Column:
    return F.sum(F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- corpus preparation ------------------------------------------------------------------------
WHOLE = {"max_seq_len": 10_000_000}  # above max_chars: a token is one code point here, and no text is cut


@query("""
with d as (select coalesce(source, '__default__') as domain, [unicode(c) for c in string_split(text, '')] as ids from documents
  where length(text) between 50 and 2000000 and regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\pZ]'))
select domain, count(*) as docs, sum(len(ids))::bigint as tokens, sum(list_sum(ids))::bigint as checksum from d group by 1""")
def corpus_build_counts(spark, d):
    conf = corpus.TEXT_CONFIG.changed(**WHOLE)
    built = build.build(table(spark, d, "documents"), conf, CP)
    return built.groupBy("domain").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("sequence")).cast("bigint").alias("tokens"), total("sequence").alias("checksum"))


@query("""select lang, count(*) as n, count(*) filter (where length(text) between 50 and 2000) as kept,
  count(*) filter (where regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\pZ]')) as filled from documents group by 1""")
def length_and_blank_filters(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(text.length_between(t, 50, 2000)).alias("kept"), F.count_if(text.not_blank(t)).alias("filled")
    )


RENDER = "case when m.role in ('system','user','assistant','tool') then '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>' || chr(10) else '' end"


@query(f"select rollout_id, md5(array_to_string([{RENDER} for m in messages], '')) as digest from rollout where messages is not null")
def chat_render(spark, d):
    rows = table(spark, d, "rollout").filter("messages is not null")
    return rows.select("rollout_id", F.md5(build.render_chat(F.col("messages")).cast("binary")).alias("digest"))


@query(f"""
with e as (select coalesce(source, '__default__') as domain, rollout_id, unnest(range(len(messages))) as i, messages from rollout where len(messages) > 0),
r as (select domain, rollout_id, i, {RENDER.replace('m.', 'messages[i + 1].')} as t, messages[i + 1].role = 'assistant' as trained, row_number() over () as n from e),
p as (select domain, rollout_id, unnest([{{'id': unicode(c), 'keep': trained::int}} for c in string_split(t, '')]) as x from r where t <> '')
select domain, count(*) as tokens, sum(x.keep)::bigint as trained, sum(x.id)::bigint as checksum from p group by 1""")
def chat_build(spark, d):
    conf = corpus.CHAT_CONFIG.changed(max_seq_len=10_000_000)
    built = build.build(table(spark, d, "rollout"), conf, CP)
    mask = F.coalesce("loss_mask", F.transform("sequence", lambda _: F.lit(1)))
    kept = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
    return built.groupBy("domain").agg(F.sum(F.size("sequence")).cast("bigint").alias("tokens"), F.sum(kept).alias("trained"), total("sequence").alias("checksum"))


@query("""
with p as (select rollout_id, m.content as c from rollout, unnest(messages) as u(m) where m.role = 'assistant' and m.content <> '')
select count(distinct rollout_id) as records, sum(n)::bigint as responses, sum(ids)::bigint as tokens from
(select rollout_id, count(*) as n, sum(least(length(c), 512)) as ids from p group by 1)""")
def grpo_list_field(spark, d):
    rows = table(spark, d, "rollout")
    answers = F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"])
    rows = rows.select("rollout_id", F.filter(answers, lambda c: c.isNotNull()).alias("responses"))
    make = build.Sections(BuildConfig.from_dict({"preprocessing": {"max_seq_len": 512}}), CP)
    nested = rows.select("rollout_id", make.list_field({"field": "responses"}).alias("ids")).filter(F.size("ids") > 0)
    sizes = F.aggregate("ids", F.lit(0), lambda a, x: a + F.size(x))
    return nested.agg(F.countDistinct("rollout_id").alias("records"), F.sum(F.size("ids")).cast("bigint").alias("responses"), F.sum(sizes).cast("bigint").alias("tokens"))


DPO = """x as (select record_id, any_value('<|im_start|>user' || chr(10) || coalesce(nullif(prompt, ''), legacy_input) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) as p, any_value(chosen || '<|im_end|>' || chr(10)) as c, any_value(rejected || '<|im_end|>' || chr(10)) as r from dpo_tokenize group by 1),
ok as (select *, p is not null and c is not null and r is not null as well_formed from x)"""
SUM = "list_sum([unicode(u) for u in string_split({}, '')])::bigint"


@query(f"""
with {DPO} select record_id, well_formed, case when well_formed then {SUM.format("left(p || c, 1024)")} end as chosen_sum, case when well_formed then {SUM.format("left(p || r, 1024)")} end as rejected_sum,
 case when well_formed then greatest(least(length(p || c), 1024) - length(p), 0)::bigint end as trained_chosen, case when well_formed then greatest(least(length(p || r), 1024) - length(p), 0)::bigint end as trained_rejected from ok""")
def dpo_records(spark, d):
    """Rendered conversations, cut to 1,024 ids."""
    rows = build.dpo_ids(table(spark, d, "dpo_tokenize").dropDuplicates(["record_id"]), CP, 1024)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("record_id", "well_formed", add("chosen").alias("chosen_sum"), add("rejected").alias("rejected_sum"), add("chosen_mask").alias("trained_chosen"), add("rejected_mask").alias("trained_rejected"))


@query(f"""
with {DPO}, y as (select record_id // 64 as batch, p || c as c, p || r as r, length(c) + length(r) as t from ok where well_formed)
select batch, count(*) as rows, max(greatest(length(c), length(r))) as width, sum({SUM.format("c")} + {SUM.format("r")})::bigint as checksum, sum(t)::bigint as trained from y group by 1""")
def dpo_collate(spark, d):
    rows = build.dpo_ids(table(spark, d, "dpo_tokenize").dropDuplicates(["record_id"]), CP, 1_000_000).filter("well_formed")
    padded = collate.collate_dpo(collate.batches(rows, "record_id", 64))
    widths = F.array(*[F.size(c) for c in ("chosen", "rejected", "chosen_mask", "rejected_mask")])
    same = F.when(F.min(F.array_min(widths)) == F.max(F.array_max(widths)), F.max(F.array_max(widths)))
    add = lambda *c: F.sum(F.aggregate(F.concat(*c), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return padded.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), same.cast("bigint").alias("width"), add("chosen", "rejected").alias("checksum"), add("chosen_mask", "rejected_mask").alias("trained"))


@query(f"""
with r as (select rollout_id, any_value(messages) as m from rollout where len(messages) > 0 group by 1),
a as (select rollout_id, m[:len(m) - 1] as before, coalesce(m[len(m)].content, '') as last from r where len(m) > 1), t as (select rollout_id, array_to_string([{RENDER} for m in before], '') as t, last from a)
select rollout_id, length(t || '<|im_start|>assistant' || chr(10) || last || '<|im_end|>' || chr(10)) as n, (length(last) + 11)::bigint as trained, {SUM.format("t || '<|im_start|>assistant' || chr(10) || last || '<|im_end|>' || chr(10)")} as checksum from t""")
def dpo_conversations(spark, d):
    """Conversations as prompts, their last message as both answers, one of them as a conversation."""
    rows = table(spark, d, "rollout").dropDuplicates(["rollout_id"]).filter(F.size("messages") > 1)
    last = F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], F.lit(""))
    rows = rows.select("rollout_id", F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"), last.alias("chosen"), F.array(F.struct(F.lit("assistant").alias("role"), last.alias("content"))).alias("rejected"))
    out = build.dpo_ids(rows, CP, 10_000_000, key="rollout_id", malformed="raise")
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    same = F.when((F.col("chosen") == F.col("rejected")) & (F.col("chosen_mask") == F.col("rejected_mask")), F.size("chosen"))
    return out.select("rollout_id", same.cast("bigint").alias("n"), add("chosen_mask").alias("trained"), add("chosen").alias("checksum"))


@query("""
with x as (select rollout_id, any_value(messages) as messages from rollout where len(messages) > 0 group by 1),
y as (select rollout_id // 32 as batch, rollout_id, length(coalesce(messages[1].content, '')) as p, [coalesce(m.content, '') for m in messages if m.role = 'assistant'] as r from x),
b as (select batch, count(*) as rows, max(p) as width, arg_min(len(r), rollout_id) as g, greatest(coalesce(max(list_max([length(c) for c in r])), 1), 1) as longest from y group by 1),
z as (select *, r[1:g] as taken from y join b using (batch))
select batch, any_value(rows) as rows, any_value(width) as width, any_value(g)::bigint as group_size, any_value(case when g = 0 then 0 else longest end)::bigint as longest, sum(len(taken))::bigint as filled,
 sum(coalesce(list_sum([length(c) for c in taken]), 0))::bigint as trained, sum(coalesce(list_sum([list_sum([unicode(u) for u in string_split(c, '')]) for c in taken if c <> '']), 0))::bigint as checksum from z group by 1""")
def grpo_collate(spark, d):
    """All rollouts that hold a message, with all their answers; an answer's number, from 1, stands in for its reward."""
    rows = table(spark, d, "rollout").filter(F.size("messages") > 0).dropDuplicates(["rollout_id"])
    ids = lambda m: CP.ids(F.coalesce(m["content"], F.lit("")))
    answers = F.filter("messages", lambda m: m["role"] == "assistant")
    rows = rows.select(F.col("rollout_id").alias("record_id"), F.floor(F.col("rollout_id") / 32).alias("batch"), ids(F.col("messages")[0]).alias("prompts"), F.transform(answers, ids).alias("responses"))
    rows = rows.withColumn("masks", F.transform("responses", lambda x: F.transform(x, lambda _: F.lit(1)))).withColumn("rewards", F.transform("responses", lambda _, i: i + F.lit(1.0)))
    add = lambda c: F.sum(F.aggregate(F.flatten(c), F.lit(0).cast("bigint"), lambda a, x: a + x))
    same = lambda c: F.when(F.min(c) == F.max(c), F.max(c).cast("bigint"))
    sizes = F.transform("responses", F.size)
    wide = F.when((F.size(sizes) == 0) | (F.array_min(sizes) == F.array_max(sizes)), F.coalesce(F.array_max(sizes), F.lit(0)))
    return collate.collate_grpo(rows).groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), same(F.size("prompt_mask")).alias("width"), same(F.size("responses")).alias("group_size"), same(wide).alias("longest"),
        F.sum(F.size(F.filter("rewards", lambda x: x > 0))).cast("bigint").alias("filled"), add("masks").alias("trained"), add("responses").alias("checksum"),
    )


@query("""
with r as (select record_id, any_value(sequence) as s from single_output_mask_builder where len(sequence) > 0 group by 1),
t as (select record_id, unnest(s) as id, unnest(range(len(s))) as i from r),
p as (select id, row_number() over (order by record_id, i) - 1 as pos from t), l as (select count(*) as n from p),
w as (select unnest(range(case when n > 512 then (n - 1 - 512) // 384 + 1 else 0 end)) as window_id from l)
select window_id, sum(id) filter (where pos < window_id * 384 + 512)::bigint as input_sum, sum(id) filter (where pos > window_id * 384)::bigint as target_sum,
 max(case when pos = window_id * 384 then id end) as first_id, max(case when pos = window_id * 384 + 512 then id end) as last_target
from w join p on pos >= window_id * 384 and pos <= window_id * 384 + 512 group by 1""")
def stream_windows(spark, d):
    rows = table(spark, d, "single_output_mask_builder").select("record_id", "sequence").dropDuplicates(["record_id"])
    w = scans.stream_windows(rows, "record_id", "sequence", 512, 384)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("window_id", add("input").alias("input_sum"), add("target").alias("target_sum"), F.col("input")[0].alias("first_id"), F.try_element_at("target", F.lit(-1)).alias("last_target"))


@query("select doc_id, n_chars, (sum(coalesce(n_chars, 0)) over (order by doc_id) - coalesce(n_chars, 0))::bigint as start_char from documents")
def segment_offsets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").withColumn("_n", F.coalesce("n_chars", F.lit(0)))
    return scans.prefix_sum(rows, "doc_id", "_n", "start_char").drop("_n")


@query("""
with recursive o as (select row_number() over (order by doc_id) as i, coalesce(n_chars, 0) as n, coalesce(source, '__default__') as domain from documents),
f as (select 1::bigint as i, case when n >= 200000 then 0 else n end as total, 0 as ep, case when n >= 200000 then 1 else 0 end as nxt from o where i = 1
 union all select o.i, case when f.total + o.n >= 200000 then 0 else f.total + o.n end, f.nxt, case when f.total + o.n >= 200000 then f.nxt + 1 else f.nxt end from f join o on o.i = f.i + 1)
select domain, ep::bigint as epoch, count(*) as docs, sum(n)::bigint as chars, dense_rank() over (partition by domain order by ep) - 1 as shard_idx from f join o using (i) group by domain, ep""")
def shard_cuts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"), text.domain_of(F.col("source")).alias("domain"))
    cut = scans.shard_index(scans.shard_epochs(rows, "doc_id", "n", 200_000))
    return cut.groupBy("domain", "epoch", "shard_idx").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("chars")).withColumn("shard_idx", F.col("shard_idx").cast("bigint"))


@query("""
with x as (select record_id, any_value(sequence) as s from single_output_mask_builder group by 1)
select record_id, least(len(s), 256) as n_start, list_sum(s[1:256])::bigint as start_sum, list_sum(s[greatest(len(s) - 255, 1):])::bigint as end_sum from x""")
def packing_simple(spark, d):
    rows = table(spark, d, "single_output_mask_builder").select("record_id", "sequence").dropDuplicates(["record_id"]).withColumn("g", F.lit(0))
    one = lambda mode: pack.pack(rows, "record_id", ["sequence"], 256, ["g"], "simple", mode)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    a = one("keep_start").select("record_id", F.size("sequence").cast("bigint").alias("n_start"), add("sequence").alias("start_sum"))
    return a.join(one("keep_end").select("record_id", add("sequence").alias("end_sum")), "record_id")


def _packed(spark, d, strategy):
    rows = table(spark, d, "single_output_mask_builder").dropDuplicates(["record_id"]).filter(F.size("sequence") > 0)
    rows = rows.select("record_id", "sequence", F.coalesce("loss_mask", F.transform("sequence", lambda _: F.lit(1))).alias("loss_mask"))
    cut = scans.shard_epochs(rows.withColumn("n", F.size("sequence")), "record_id", "n", 100_000)
    return pack.pack(cut, "record_id", ["sequence", "loss_mask"], 2048 if strategy == "bfd" else 512, ["epoch"], strategy)


def _epochs(p: DataFrame, most: int) -> DataFrame:
    """Per epoch: tokens and their sum, whether no bin is too full, and whether no two bins would fit into one (a best fit leaves none)."""
    size = F.size("sequence")
    least = F.slice(F.array_sort(F.collect_list(size)), 1, 2)
    return p.groupBy("epoch").agg(
        F.sum(size).cast("bigint").alias("tokens"), total("sequence").alias("checksum"), F.max(size).alias("_most"), least.alias("_least"), total("loss_mask").alias("trained"), F.sum("members").alias("members"),
    ).select("epoch", "tokens", "checksum", "trained", "members", (F.col("_most") <= most).alias("within"), ((F.size("_least") < 2) | (F.col("_least")[0] + F.get("_least", F.lit(1)) > most)).alias("tight"))


EPOCHS = """recursive r as (select record_id, any_value(sequence) as s, any_value(loss_mask) as m from single_output_mask_builder where len(sequence) > 0 group by 1),
o as (select row_number() over (order by record_id) as i, len(s) as n, s, m from r),
f as (select 1::bigint as i, case when n >= 100000 then 0 else n end as total, 0 as ep, case when n >= 100000 then 1 else 0 end as nxt from o where i = 1
 union all select o.i, case when f.total + o.n >= 100000 then 0 else f.total + o.n end, f.nxt, case when f.total + o.n >= 100000 then f.nxt + 1 else f.nxt end from f join o on o.i = f.i + 1)"""


@query(f"""
with {EPOCHS} select ep::bigint as epoch, sum(n)::bigint as tokens, sum(list_sum(s))::bigint as checksum, sum(case when m is null then n else list_sum(m) end)::bigint as trained, sum((n + 511) // 512)::bigint as members, true as within, true as tight
from f join o using (i) group by 1""")
def packing_bfd_split(spark, d):
    return _epochs(_packed(spark, d, "bfd_split"), 512)


@query(f"""
with {EPOCHS} select ep::bigint as epoch, sum(least(n, 2048))::bigint as tokens, sum(list_sum(s[1:2048]))::bigint as checksum, sum(case when m is null then least(n, 2048) else list_sum(m[1:2048]) end)::bigint as trained, count(*) as members, true as within, true as tight
from f join o using (i) group by 1""")
def packing_bfd(spark, d):
    return _epochs(_packed(spark, d, "bfd"), 2048)


@query("""
with recursive o as (select row_number() over (order by doc_id) as i, length(text) as n, coalesce(source, '__default__') as domain from documents where length(text) between 50 and 2000000 and regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\pZ]')),
f as (select 1::bigint as i, case when n >= 200000 then 0 else n end as total, 0 as ep, case when n >= 200000 then 1 else 0 end as nxt from o where i = 1
 union all select o.i, case when f.total + o.n >= 200000 then 0 else f.total + o.n end, f.nxt, case when f.total + o.n >= 200000 then f.nxt + 1 else f.nxt end from f join o on o.i = f.i + 1)
select domain, dense_rank() over (partition by domain order by ep) - 1 as shard_idx, sum(n)::bigint as tokens, count(*) as documents, true as within from f join o using (i) group by domain, ep""")
def corpus_prepare(spark, d):
    """Whole texts: none is cut before sharding, and those above a bin's size are split over bins."""
    conf = corpus.TEXT_CONFIG.changed(**WHOLE, packing_strategy="bfd_split", max_tokens_per_shard=200_000)
    bins = corpus.prepare(table(spark, d, "documents"), "doc_id", conf)
    most = conf.max_packed_len or conf.max_seq_len
    starts = F.size(F.filter(F.col("position_ids"), lambda p: p == 0)) if "position_ids" in bins.columns else F.lit(0)
    return bins.groupBy("domain", F.col("shard_idx").cast("bigint").alias("shard_idx")).agg(F.sum(F.size("sequence")).cast("bigint").alias("tokens"), F.sum(starts).alias("documents"), F.bool_and(F.size("sequence") <= most).alias("within"))


@query("""
with r as (select record_id, len(any_value(sequence)) as n from single_output_mask_builder group by 1)
select record_id // 8 as row_id, sum(n)::bigint as n, sum(n * (n - 1) // 2)::bigint as position_sum, count(*) filter (where n > 0) as documents,
 sum(n * (row_number - 1))::bigint as document_sum from (select *, sum((n > 0)::int) over (partition by record_id // 8 order by record_id) as row_number from r) where n > 0 group by 1""")
def position_ids(spark, d):
    """Rows of up to eight records: positions begin anew with each, and document ids are told from the positions."""
    rows = table(spark, d, "single_output_mask_builder").dropDuplicates(["record_id"]).filter(F.size("sequence") > 0)
    rows = rows.select("record_id", scans.position_ids(F.col("sequence"), "doc_reset").alias("p")).groupBy(F.floor(F.col("record_id") / 8).alias("row_id"))
    one = rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("record_id", "p"))), lambda x: x["p"])).alias("p")).withColumn("doc", scans.document_ids(F.col("p")))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return one.select("row_id", F.size("p").cast("bigint").alias("n"), add("p").alias("position_sum"), (F.array_max("doc") + 1).cast("bigint").alias("documents"), add("doc").alias("document_sum"))


@query(f"""with {EPOCHS} select ep::bigint as epoch, count(*) as documents, true as same from f join o using (i) group by 1""")
def packed_documents(spark, d):
    """Documents in each bin, told from the position ids of its packed row, beside the members that were put there."""
    rows = table(spark, d, "single_output_mask_builder").select("record_id", F.size("sequence").alias("n")).filter("n > 0").dropDuplicates(["record_id"])
    cut = scans.shard_epochs(rows, "record_id", "n", 100_000)
    cut = cut.withColumn("position_ids", scans.position_ids(F.array_repeat(F.lit(0), F.col("n")), "doc_reset"))
    packed = pack.pack(cut, "record_id", ["position_ids"], 2048, ["epoch"], "bfd")
    told = (F.try_element_at(scans.document_ids(F.col("position_ids")), F.lit(-1)) + 1).cast("bigint")
    return packed.select("epoch", "members", told.alias("told")).groupBy("epoch").agg(F.sum("told").alias("documents"), F.bool_and(F.col("told") == F.col("members")).alias("same"))


@query("select doc_id from documents where length(text) between 50 and 2000000 order by doc_id limit 100")
def accepted_limit(spark, d):
    conf = corpus.TEXT_CONFIG.changed(max_items=100)
    return build.build(table(spark, d, "documents"), conf, CP, keep=("doc_id",)).select("doc_id")


# --- sampling of records ---------------------------------------------------------------------------
ORDER = "row_number() over (order by ('0x' || substr(md5(concat_ws('|', doc_id, {seed})), 1, 15))::bigint, doc_id) - 1"


@query(f"""
with p as (select doc_id, {ORDER.format(seed=9)} as position, count(*) over () as total from documents), e as (select *, (total + 2) // 3 as per from p),
c as (select * , position as place from e union all select *, position + total from e where position < per * 3 - total)
select place % 3 as rank, place // 3 as step, doc_id from c where place // 3 >= 5 % per""")
def sampler_partition(spark, d):
    """Three replicas that go on after five records each, in epoch 2 of seed 7."""
    docs, placed = table(spark, d, "documents").select("doc_id"), None
    for rank in range(3):
        one = scans.sampler(docs, "doc_id", seed=7, epoch=2, replicas=3, rank=rank, resume=5).select(F.lit(rank).cast("bigint").alias("rank"), "step", "doc_id")
        placed = one if placed is None else placed.unionByName(one)
    return placed


@query(f"select doc_id, {ORDER.format(seed=3)} < greatest(1, floor(count(*) over () * 0.05)) as is_validation from documents")
def validation_split(spark, d):
    return scans.split_validation(table(spark, d, "documents").select("doc_id"), "doc_id", 0.05, seed=3).select("doc_id", "is_validation")


@query("select doc_id from documents order by ('0x' || substr(md5(concat_ws('|', doc_id, 5)), 1, 15))::bigint, doc_id limit 200")
def random_subsample(spark, d):
    return scans.subsample(table(spark, d, "documents").select("doc_id"), "doc_id", 200, seed=5)


@query("select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text")
def exact_copies(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.md5("text").alias("m"))
    return docs.groupBy("h", "m").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


# --- scores -----------------------------------------------------------------------------------------
def _rouge_sql(n: int) -> str:
    gram = " || chr(1) || ".join(f"w[i + {j}]" for j in range(n))
    return f"""
with x as (select record_id, any_value(chosen) as a, any_value(rejected) as b from dpo_tokenize where chosen is not null and rejected is not null group by 1),
s as (select record_id, [q for q in string_split_regex(a, '[\\s\\x0B\\x1C-\\x1F\\x85\\pZ]+') if q <> ''] as w, 'r' as side from x union all select record_id, [q for q in string_split_regex(b, '[\\s\\x0B\\x1C-\\x1F\\x85\\pZ]+') if q <> ''], 'c' from x),
g as (select record_id, side, {gram} as gram from s, unnest(range(1, len(w) - {n} + 2)) as u(i)),
c as (select record_id, gram, count(*) filter (where side = 'r') as r, count(*) filter (where side = 'c') as c from g group by 1, 2),
t as (select record_id, sum(r) as r, sum(c) as c, sum(least(r, c)) as shared from c group by 1),
f as (select x.record_id, coalesce(r, 0) as r, coalesce(c, 0) as c, coalesce(shared, 0) as shared from x left join t using (record_id)),
p as (select case when c > 0 then shared / c else 0 end as p, case when r > 0 then shared / r else 0 end as q from f)
select round(avg(p), 6) as precision, round(avg(q), 6) as recall, round(avg(case when p + q > 0 then 2 * p * q / (p + q) else 0 end), 6) as f1 from p"""


def _answers(spark, d):
    return table(spark, d, "dpo_tokenize").filter("chosen is not null and rejected is not null").dropDuplicates(["record_id"])


def _macro(scores):
    return metrics.macro(scores).select(*[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query(_rouge_sql(1))
def rouge_1(spark, d):
    return _macro(metrics.rouge_n(_answers(spark, d), "record_id", "chosen", "rejected", 1))


@query(_rouge_sql(2))
def rouge_2(spark, d):
    return _macro(metrics.rouge_n(_answers(spark, d), "record_id", "chosen", "rejected", 2))


@query()
def rouge_l(spark, d):
    return metrics.rouge_l(_answers(spark, d), "record_id", "chosen", "rejected")


LOSSES = "(select any_value(token_type) as token_type, any_value(token_loss) as loss from token_losses group by loss_id)"
PPL = "count(*) as tokens, round(avg(loss), 6) as mean_loss, round(exp(avg(loss)), 6) as perplexity, " + ", ".join(f"round(quantile_cont(loss, {q}), 6) as {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))


def _losses(spark, d):
    return table(spark, d, "token_losses").dropDuplicates(["loss_id"]).withColumnRenamed("token_loss", "loss")


def _ppl(df):
    return df.select(*[r6(F.col(c), c) if c not in ("token_type", "tokens") else F.col(c) for c in df.columns])


@query(f"select {PPL} from {LOSSES} where loss is not null and not isnan(loss)")
def perplexity_overall(spark, d):
    return _ppl(metrics.perplexity_stats(_losses(spark, d)))


@query(f"select token_type, {PPL} from {LOSSES} where loss is not null and not isnan(loss) group by 1")
def perplexity_by_type(spark, d):
    return _ppl(metrics.perplexity_stats(_losses(spark, d), by=["token_type"]))


HIST = f"select trunc(least(greatest(loss, 0), 20) / 20.0 * 999)::int as bin, count(*) as n from {LOSSES} where loss is not null and not isnan(loss) group by 1"


@query(HIST)
def loss_histogram(spark, d):
    return metrics.loss_histogram(_losses(spark, d))


@query(f"""
with h as ({HIST}), r as (select bin, sum(n) over (order by bin) as run, sum(n) over () as total from h), q as (select unnest([0.5, 0.9, 0.99]::double[]) as q)
select q, round(((min(bin) + 0.5) * 0.02)::double, 6) as value from r, q where run >= q * total group by 1""")
def histogram_percentiles(spark, d):
    out = metrics.histogram_percentiles(metrics.loss_histogram(_losses(spark, d)), [0.5, 0.9, 0.99])
    return out.select("q", r6(F.col("value"), "value"))


@query("""
with w as (select unnest([q for q in string_split_regex(text, '[\\s\\x0B\\x1C-\\x1F\\x85\\pZ]+') if q <> '']) as t from documents)
select case when t = '```' then 'special' when regexp_matches(t, '[\\x{4e00}-\\x{9fff}]') then 'cjk' when regexp_matches(t, '[^\\x00-\\x7f]') then 'non_ascii' else 'ascii' end as token_type, count(*) as n from w group by 1""")
def token_types(spark, d):
    t = table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("t"))
    return t.groupBy(metrics.token_type(F.col("t"), F.col("t") == "```").alias("token_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""
with x as (select sample_id, avg(loss) / avg(loss + 0.5) as v from (select any_value(sample_id) as sample_id, any_value(token_loss) as loss from token_losses group by loss_id) where loss is not null and not isnan(loss) group by 1)
select count(*) as count, count(v) as valid, 0::bigint as skipped, round(avg(round(v, 6)), 5) as mean, round(median(round(v, 6)), 5) as median, round(stddev_samp(round(v, 6)), 5) as stdev, round(min(v), 5) as min, round(max(v), 5) as max from x""")
def instruction_difficulty(spark, d):
    rows = _losses(spark, d).filter(F.col("loss").isNotNull() & ~F.isnan("loss")).groupBy("sample_id").agg(F.collect_list("loss").alias("c"))
    rows = rows.withColumn("u", F.transform("c", lambda x: x + 0.5))
    s = metrics.difficulty_summary(metrics.difficulty(rows, "sample_id", "c", "u"))
    return s.select("count", "valid", "skipped", *[F.round(c, 5).alias(c) for c in ("mean", "median", "stdev", "min", "max")])


@query("""
with x as (select sample_id, any_value(run_id) as run_id, avg(loss) filter (where pos % 2 = 0) as c, avg(loss) filter (where pos % 2 = 1) as u from (select any_value(sample_id) as sample_id, any_value(run_id) as run_id, any_value(pos) as pos, any_value(token_loss) as loss from token_losses group by loss_id) where loss is not null and not isnan(loss) group by sample_id, run_id),
y as (select run_id, round(case when u <> 0 then c / u end, 6) as v from x)
select run_id, round(avg(v), 4) as ifd, count(*) as turns, count(v) as valid from y group by 1""")
def difficulty_by_conversation(spark, d):
    """Runs stand for conversations and samples for their turns; losses at even and odd places for those with and without context."""
    rows = _losses(spark, d).filter(F.col("loss").isNotNull() & ~F.isnan("loss"))
    means = rows.groupBy("sample_id", "run_id").agg(F.avg(F.when(F.col("pos") % 2 == 0, F.col("loss"))).alias("c"), F.avg(F.when(F.col("pos") % 2 == 1, F.col("loss"))).alias("u"))
    pairs = means.select("run_id", F.concat_ws("/", "sample_id", F.col("run_id").cast("string")).alias("turn"), F.array("c").alias("c"), F.array("u").alias("u"))
    scored = metrics.difficulty(pairs, "turn", "c", "u").join(pairs.select("turn", "run_id"), "turn")
    return rollout.conversation_difficulty(scored, "run_id").select("run_id", F.round("ifd", 4).alias("ifd"), "turns", "valid")


@query("""
with r as (select distinct rollout_id, messages from rollout), e as (select rollout_id, messages, unnest(range(len(messages))) as turn from r)
select rollout_id, turn::int as turn, md5(array_to_string([coalesce(m.content, '') for m in messages[1:turn]], chr(10) || chr(10))) as context, length(coalesce(messages[turn + 1].content, ''))::int as n_response
from e where messages[turn + 1].role = 'assistant'""")
def turn_contexts(spark, d):
    rows = metrics.turn_contexts(table(spark, d, "rollout").dropDuplicates(["rollout_id"]), "rollout_id")
    return rows.select("rollout_id", "turn", F.md5("context").alias("context"), F.length("response").alias("n_response"))


@query("""
with m as (select subject, [length(coalesce(choice_a, '')), length(coalesce(choice_b, '')), length(coalesce(choice_c, '')), length(coalesce(choice_d, ''))] as s, answer from eval_items where benchmark = 'mcq'),
p as (select subject, answer = ['A', 'B', 'C', 'D'][list_position(s, list_max(s))] as ok from m)
select subject, grouping(subject)::int as overall, count(*) as n, sum(ok::int)::bigint as correct, round(avg(ok::int), 6) as accuracy from p group by grouping sets ((subject), ())""")
def choice_accuracy(spark, d):
    rows = table(spark, d, "eval_items").filter("benchmark = 'mcq'")
    scores = F.array(*[F.length(F.coalesce(f"choice_{c}", F.lit(""))) for c in "abcd"])
    rows = rows.withColumn("pick", F.array(*[F.lit(c) for c in "ABCD"])[metrics.pick_choice(scores)])
    out = metrics.accuracy(rows, "subject", F.col("answer") == F.col("pick"))
    return out.select("subject", F.col("overall").cast("int").alias("overall"), "n", "correct", r6(F.col("accuracy"), "accuracy"))


PROMPT = """'The following are multiple choice questions (with answers) about ' || coalesce(subject, '') || '.' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10)
 || 'A. ' || coalesce({a}, '') || chr(10) || 'B. ' || coalesce({b}, '') || chr(10) || 'C. ' || coalesce({c}, '') || chr(10) || 'D. ' || coalesce({d}, '') || chr(10) || 'Answer:'"""


@query(f"""
with q as (select item_id, subject, answer, '<|im_start|>user' || chr(10) || {PROMPT.format(**{c: f"choice_{c}" for c in "abcd"})} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as p from eval_items where benchmark = 'mcq'),
s as (select subject, p || answer || '<|im_end|>' || chr(10) as solved, row_number() over (partition by subject order by item_id) as k from q where subject is not null),
x as (select subject, string_agg(solved, '' order by k) as prefix from s where k <= 2 group by 1)
select item_id, md5(coalesce(prefix, '') || p) as digest from q left join x using (subject)""")
def few_shot_prompts(spark, d):
    rows = table(spark, d, "eval_items").filter("benchmark = 'mcq'")
    rows = rows.select("item_id", "subject", "answer", metrics.choice_prompt(F.col("question"), [F.col(f"choice_{c}") for c in "abcd"], F.col("subject")).alias("p"))
    return metrics.few_shot_chat(rows, rows, "item_id", "subject", "p", "answer", 2).select("item_id", F.md5(F.col("chat").cast("binary")).alias("digest"))


@query(f"""
with m as (select *, unnest(['A', 'B', 'C', 'D']) as was, unnest([choice_a, choice_b, choice_c, choice_d]) as t from eval_items where benchmark = 'mcq'),
o as (select *, row_number() over (partition by item_id order by md5(concat_ws('|', item_id, 9, was)), was) as k from m),
g as (select item_id, any_value(subject) as subject, any_value(question) as question, max(case when k = 1 then t end) as a, max(case when k = 2 then t end) as b, max(case when k = 3 then t end) as c, max(case when k = 4 then t end) as d,
 max(case when was = answer then ['A', 'B', 'C', 'D'][k] end) as answer from o group by 1)
select item_id, answer, md5({PROMPT.format(a="a", b="b", c="c", d="d")}) as digest from g""")
def permuted_prompts(spark, d):
    rows = table(spark, d, "eval_items").filter("benchmark = 'mcq'")
    texts, letter = metrics.permuted_choices(F.col("item_id"), [F.col(f"choice_{c}") for c in "abcd"], F.col("answer"), 9)
    return rows.select("item_id", letter.alias("answer"), F.md5(metrics.choice_prompt(F.col("question"), texts, F.col("subject")).cast("binary")).alias("digest"))


@query("""select doc_id, '    \"\"\"' || coalesce(lang, 'none') || '\"\"\"' || chr(10) || chr(10) || '    return ' || coalesce(n_chars, 0) as body from documents""")
def function_bodies(spark, d):
    head = F.concat(F.lit("import os\n\ndef run"), F.col("doc_id").cast("string"), F.lit("x(a):\n    pass\n\ndef run"), F.col("doc_id").cast("string"), F.lit("(a, b=1):\n\n    "))
    code = F.concat(head, F.lit('\"\"\"'), F.coalesce("lang", F.lit("none")), F.lit('\"\"\"  \n\n    return '), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit("\nprint(1)\n    x"))
    return table(spark, d, "documents").select("doc_id", metrics.function_body(code, F.concat(F.lit("run"), F.col("doc_id").cast("string"))).alias("body"))


@query("""
with g as (select n, c, k from range(1, 21) a(n), range(0, 21) b(c), unnest([1, 5, 10]) u(k) where c <= n)
select n::int as n, c::int as c, k::int as k, case when k > n then null when n - c < k then 1.0 when c = 0 then 0.0 else round(1 - list_product([1 - k / i::double for i in range(n - c + 1, n + 1)]), 9) end as pass from g""")
def pass_at_k(spark, d):
    r = lambda name, lo, hi: spark.range(lo, hi).select(F.col("id").cast("int").alias(name))
    g = r("n", 1, 21).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("k", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    return g.select("n", "c", "k", F.round(metrics.pass_at_k(F.col("n"), F.col("c"), F.col("k")), 9).alias("pass"))


@query()
def weight_statistics(spark, d):
    e = table(spark, d, "embeddings").filter("vec_id is not null")
    m = e.groupBy(F.concat(F.lit("block_"), F.floor(F.col("vec_id") / 50).cast("string")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("r"))
    return metrics.weight_stats(m.select("name", F.transform("r", lambda x: x["embedding"]).alias("matrix")))


@query("select l_returnflag as name, grouping(l_returnflag)::int as overall, round(sqrt(sum(l_discount * l_discount)), 6) as norm from lineitem group by rollup (l_returnflag)")
def gradient_norms(spark, d):
    g = metrics.gradient_norms(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("name"), F.col("l_discount").alias("grad")))
    return g.select("name", F.col("overall").cast("int").alias("overall"), r6(F.col("norm"), "norm"))


# Written from the definitions in the survey: what a Python program would say of each answer.
_S = r"[\s\x0B\x1C-\x1F\x85\pZ]"
_STRIP = rf"regexp_replace(r, '^{_S}+|{_S}+$', '', 'g')"
_FILLED = rf"len([x for x in string_split_regex(r, '{{}}') if regexp_matches(x, '[^\s\x0B\x1C-\x1F\x85\pZ]')])"
_PARTS = r"[x for x in string_split_regex(r, '\n\n+') if regexp_matches(x, '[^\s\x0B\x1C-\x1F\x85\pZ]')]"
CHECKED = [
    ("keywords:existence", {"keywords": ["the", "MASK"]}, "contains(lower(r), 'the') and contains(lower(r), 'mask')"),
    ("keywords:frequency", {"keyword": "the", "frequency": 5, "relation": "less than"}, "(length(lower(r)) - length(replace(lower(r), 'the', ''))) // 3 < 5"),
    ("keywords:frequency", {"keyword": "Batch"}, "contains(lower(r), 'batch')"),
    ("keywords:forbidden_words", {"forbidden_words": ["page", "warm-up"]}, r"not regexp_matches(' ' || lower(r) || ' ', '[^\pL\pN_](page|warm-up)[^\pL\pN_]')"),
    ("keywords:letter_frequency", {"letter": "E", "let_frequency": 40}, "length(lower(r)) - length(replace(lower(r), 'e', '')) >= 40"),
    ("keywords:letter_frequency", {"letter": "z", "let_relation": "less than"}, "not contains(lower(r), 'z')"),
    ("detectable_content:number_placeholders", {}, r"regexp_matches(r, '\[[^\n]*\]')"),
    ("detectable_content:postscript", {}, r"regexp_matches(lower(r), 'p\.[\s\x0B\x1C-\x1F\x85\pZ]?s\.')"),
    ("detectable_content:postscript", {"postscript_marker": "Note"}, "contains(lower(r), 'note')"),
    ("detectable_format:number_bullet_lists", {"num_bullets": 3}, r"len(regexp_extract_all(r, '(?m)^[\s\x0B\x1C-\x1F\x85\pZ]*\*[^*].*$')) + len(regexp_extract_all(r, '(?m)^[\s\x0B\x1C-\x1F\x85\pZ]*-.*$')) = 3"),
    ("detectable_format:number_highlighted_sections", {}, r"len([x for x in regexp_extract_all(r, '\*([^\n*]+)\*', 1) if regexp_matches(x, '[^\s\x0B\x1C-\x1F\x85\pZ]')]) >= 1"),
    ("detectable_format:multiple_sections", {"section_spliter": "1.", "num_sections": 1}, r"regexp_matches(r, '1\.[\s\x0B\x1C-\x1F\x85\pZ]?\p{Nd}+')"),
    ("detectable_format:title", {}, r"regexp_matches(r, '<<[^>\n]+>>')"),
    ("detectable_format:json_format", {}, rf"json_valid({_STRIP}) and {_STRIP} <> ''"),
    ("detectable_format:general_punctuation", {"punctuation_blacklist": [";", "!"]}, "not contains(r, ';') and not contains(r, '!')"),
    ("detectable_format:general_punctuation", {}, "true"),
    ("detectable_format:number_highlighted_words", {}, r"regexp_matches(r, '\*[^*\s\x0B\x1C-\x1F\x85\pZ][^*]*[^*\s\x0B\x1C-\x1F\x85\pZ]\*')"),
    ("startend:end_checker", {"end_phrase": " safer option."}, rf"ends_with(lower(regexp_replace(r, '{_S}*\"*{_S}*$', '')), 'safer option.')"),
    ("startend:quotation", {}, f"starts_with({_STRIP}, '\"') and ends_with({_STRIP}, '\"')"),
    ("startend:start_checker", {"starter": "If"}, r"regexp_matches(r, '(?m)^[\s\x0B\x1C-\x1F\x85\pZ]*If')"),
    ("change_case:english_capital", {}, "r = upper(r) and r <> lower(r)"),
    ("change_case:english_lowercase", {}, "r = lower(r) and r <> upper(r)"),
    ("change_case:capital_word_frequency", {"capital_frequency": 2}, r"len(regexp_extract_all(regexp_replace(r, '[^\pL\pN_]', '  ', 'g'), '(?:^|[ ])[A-Z]{2,}(?:$|[ ])')) >= 2"),
    ("punctuation:no_comma", {}, "not contains(r, ',')"),
    ("length_constraints:number_words", {}, r"len(regexp_extract_all(r, '[\pL\pN_]+')) >= 100"),
    ("length_constraints:number_words", {"num_words": 60, "relation": "less than"}, r"len(regexp_extract_all(r, '[\pL\pN_]+')) < 60"),
    ("length_constraints:number_sentences", {"num_sentences": 4}, rf"len([x for x in string_split_regex(regexp_replace({_STRIP}, '([.!?]){_S}+', '\1' || chr(1), 'g'), chr(1)) if x <> '']) >= 4"),
    ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, r"(case when contains(r, '***') then " + _FILLED.format(r"\*\*\*") + " else " + _FILLED.format(r"\n\n+") + " end) = 2"),
    ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "The"}, rf"len({_PARTS}) = 2 and regexp_matches(lower({_PARTS}[2]), '^{_S}*[''\"]*the[.,!?:;\"'']*({_S}|$)')"),
    ("length_constraints:nth_word_checker", {"nth_word": 2, "target_word": "shared"}, r"lower(regexp_extract_all(r, '[\pL\pN_]+')[2]) = 'shared'"),
    ("combination:repeat_prompt", {"prompt_to_repeat": " In practice"}, f"starts_with(lower({_STRIP}), 'in practice')"),
    ("combination:two_responses", {}, "contains(r, '******') and " + _FILLED.format(r"\*{6}") + " = 2"),
]


@query(
    "with a as (select any_value(chosen) as r from dpo_tokenize where chosen is not null group by record_id) "
    + " union all ".join(f"select '{k}' as check_id, '{json.dumps(kw)}' as kwargs, count(*) as n, count(*) filter (where {sql}) as passed from a" for k, kw, sql in CHECKED)
)
def instruction_checks(spark, d):
    a = table(spark, d, "dpo_tokenize").filter("chosen is not null").dropDuplicates(["record_id"])
    return checks.pass_counts(a, "chosen", [(k, kw) for k, kw, _ in CHECKED])


@query("""
with a as (select record_id, any_value(chosen) as c, any_value(rejected) as r from dpo_tokenize where chosen is not null and rejected is not null group by record_id),
t as (select record_id, not contains(c, ',') or not contains(r, ',') as x, len(regexp_extract_all(c, '[\\pL\\pN_]+')) >= 100 or len(regexp_extract_all(r, '[\\pL\\pN_]+')) >= 100 as y from a)
select record_id as key, 3::bigint as constraints, 2::bigint as verified, (x::int + y::int)::bigint as passed, round((x::int + y::int) / 2.0, 4)::double as accuracy from t""")
def instruction_problems(spark, d):
    """Two samples a problem (both answers of a record), three instructions of which one is unknown."""
    a = _answers(spark, d)
    asked = [F.array(*[F.lit(x) for x in ("punctuation:no_comma", "length_constraints:number_words", "other:one")]).alias("instruction_id_list"), F.array(F.lit("{}")).alias("kwargs")]
    rows = a.select(F.col("record_id").alias("key"), *asked, F.posexplode(F.array("chosen", "rejected")).alias("sample", "response"))
    return checks.instruction_report(rows)["by_problem"]


# --- numerics -----------------------------------------------------------------------------------------
LOGITS = "(select vec_id as row_id, unnest(range(len(embedding)))::int as token_id, unnest(embedding)::double * 10 as logit from embeddings)"


def _logits(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("token_id", "v"))
    return e.select("row_id", "token_id", (F.col("v").cast("double") * 10).alias("logit"))


@query(f"""
with k as (select *, rank() over (partition by row_id order by logit desc) as r from {LOGITS} qualify r <= 20),
e as (select *, exp(logit - max(logit) over (partition by row_id)) as e from k), s as (select *, e / sum(e) over (partition by row_id) as p from e),
c as (select *, coalesce(sum(p) over (partition by row_id order by logit desc, token_id rows between unbounded preceding and 1 preceding), 0) as before from s),
q as (select * from c where before <= 0.8), z as (select row_id, token_id, e / sum(e) over (partition by row_id) as prob from q)
select row_id, count(*) as kept, round(max(prob), 6) as top, sum(token_id)::bigint as token_sum from z group by 1""")
def sampling_filters(spark, d):
    z = numerics.filtered(_logits(spark, d), k=20, p=0.8)
    return z.groupBy("row_id").agg(F.count(F.lit(1)).alias("kept"), r6(F.max("prob"), "top"), F.sum("token_id").alias("token_sum"))


@query(f"""
with c as (select vec_id as row_id, (vec_id % 8)::int as token_id, 3 as n from embeddings), l as (select row_id, token_id, logit / 0.7 - 0.5 * coalesce(n, 0) as logit from {LOGITS} left join c using (row_id, token_id))
select row_id, arg_max(token_id, logit)::int as token_id, round(max(logit), 5) as logit from l group by 1""")
def frequency_penalty(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 8).cast("int").alias("token_id"))
    counts = numerics.occurrence_counts(e.withColumn("x", F.explode(F.array_repeat(F.lit(1), 3))))
    out = numerics.frequency_penalty(numerics.with_temperature(_logits(spark, d), 0.7), counts, 0.5)
    best = out.groupBy("row_id").agg(F.max(F.struct("logit", -F.col("token_id"))).alias("b"))
    return best.select("row_id", (-F.col("b.col2")).cast("int").alias("token_id"), F.round("b.logit", 5).alias("logit"))


@query("""
with r as (select record_id, any_value(sequence) as s from single_output_mask_builder where len(sequence) > 0 group by 1),
t as (select record_id, unnest(s[greatest(len(s) - 63, 1):]) as token_id from r), c as (select record_id, token_id, count(*) as n from t group by 1, 2)
select record_id, count(*) as ids, max(n)::int as most, sum(n * token_id)::bigint as weighted from c group by 1""")
def recent_counts(spark, d):
    """What the frequency penalty counts: ids among the last 64."""
    rows = table(spark, d, "single_output_mask_builder").filter(F.size("sequence") > 0).dropDuplicates(["record_id"])
    rows = rows.select("record_id", rollout.recent_counts(F.col("sequence"), F.array().cast("array<int>"), 64).alias("c"))
    weighted = F.aggregate(F.map_entries("c"), F.lit(0).cast("bigint"), lambda a, e: a + e["key"].cast("bigint") * e["value"])
    return rows.select("record_id", F.size("c").cast("bigint").alias("ids"), F.array_max(F.map_values("c")).alias("most"), weighted.alias("weighted"))


@query("""
with x as (select rollout_id, any_value(messages) as m from rollout where len(messages) > 0 group by 1), p as (select rollout_id, rollout_id // 16 as batch, coalesce(m[1].content, '') as p, [length(coalesce(m[len(m)].content, '')), len(m)] as n from x)
select batch, count(*) as rows, max(length(p)) as width, max(greatest(list_max(n), 1)) as longest, sum(list_sum(n))::bigint as tokens, round(sum(-list_sum(n) / 2.0), 3)::double as logprob from p group by 1""")
def rollout_collate(spark, d):
    """Groups of two responses a prompt: as many sevens as the last message has letters, and as there are messages; each with log-probability -1/2."""
    rows = table(spark, d, "rollout").filter(F.size("messages") > 0).dropDuplicates(["rollout_id"])
    n = F.array(F.length(F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], F.lit(""))), F.size("messages"))
    rows = rollout.expand_groups(rows.select("rollout_id", F.floor(F.col("rollout_id") / 16).alias("batch"), CP.ids(F.coalesce(F.col("messages")[0]["content"], F.lit(""))).alias("prompts"), n.alias("n")), 2)
    each = rows.groupBy("rollout_id", "batch").agg(F.any_value("prompts").alias("prompts"), F.array_sort(F.collect_list(F.struct("member", F.array_repeat(F.lit(7), F.col("n")[F.col("member")]).alias("ids")))).alias("g"))
    each = each.select("rollout_id", "batch", "prompts", F.transform("g", lambda x: x["ids"]).alias("responses")).withColumn("logprobs", F.transform("responses", lambda x: F.transform(x, lambda _: F.lit(-0.5))))
    out = rollout.collate_rollouts(each, "batch", "rollout_id")
    return out.groupBy("batch").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size("prompt_mask")).cast("bigint").alias("width"), F.max(F.size(F.col("response_mask")[1])).cast("bigint").alias("longest"),
        F.sum(F.size(F.filter(F.flatten("response_mask"), lambda x: x))).cast("bigint").alias("tokens"), F.round(F.sum(F.aggregate(F.flatten("logprobs_old"), F.lit(0.0), lambda a, x: a + x)), 3).alias("logprob"),
    )


@query(f"""
with z as (select row_id, max(logit) as m, ln(sum(exp(logit))) as s from {LOGITS} group by 1)
select l.row_id, l.token_id, round(l.logit - z.s, 6) as logprob from {LOGITS} l join z using (row_id) where l.token_id = l.row_id % 16""")
def log_softmax_gather(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("vec_id") % 16).cast("int").alias("token_id"))
    return numerics.log_softmax_gather(_logits(spark, d), t).select("row_id", "token_id", r6(F.col("logprob"), "logprob"))


@query(f"""
with t as (select row_id, token_id, logit / 0.8 as logit from {LOGITS}), k as (select *, rank() over (partition by row_id order by logit desc) as r from t qualify r <= 40),
e as (select *, exp(logit - max(logit) over (partition by row_id)) as e from k), s as (select *, e / sum(e) over (partition by row_id) as p from e),
c as (select *, coalesce(sum(p) over (partition by row_id order by logit desc, token_id rows between unbounded preceding and 1 preceding), 0) as before from s),
z as (select row_id, token_id, e / sum(e) over (partition by row_id) as prob, (('0x' || substr(md5(concat_ws('|', row_id, token_id, 11)), 1, 13))::bigint + 0.5::double) / 4503599627370496 as u from c where before <= 0.95)
select row_id, arg_max(token_id, ln(prob) - ln(-ln(u))) as token_id, round(arg_max(ln(prob), ln(prob) - ln(-ln(u))), 6) as logprob from z group by 1""")
def sampled_tokens(spark, d):
    out = numerics.sample_tokens(_logits(spark, d), seed=11, temperature=0.8, k=40, p=0.95)
    return out.select("row_id", "token_id", r6(F.col("logprob"), "logprob"))


@query(f"""
with g as (select row_id, token_id, exp(logit) as w from {LOGITS} where token_id < 8), t as (select *, row_number() over (partition by row_id order by w desc, token_id) as r from g qualify r <= 2)
select row_id, token_id as expert, round(w / sum(w) over (partition by row_id), 6) as weight from t""")
def expert_routing(spark, d):
    g = _logits(spark, d).filter("token_id < 8").select("row_id", F.col("token_id").alias("expert"), F.exp("logit").alias("weight"))
    return numerics.route_experts(g, 2).select("row_id", "expert", r6(F.col("weight"), "weight"))


@query("""
with r as (select any_value(sequence) as s, any_value(loss_mask) as m, record_id from single_output_mask_builder where loss_mask is not null group by record_id)
select record_id, round(sum_ / greatest(list_sum(m), 1), 6) as mean, sum_::double as total from (select *, list_sum([s[i] * m[i] for i in range(1, len(s) + 1)]) as sum_ from r)""")
def masked_reduction(spark, d):
    rows = table(spark, d, "single_output_mask_builder").filter("loss_mask is not null").dropDuplicates(["record_id"])
    s, m = F.col("sequence").cast("array<double>"), F.col("loss_mask").cast("array<double>")
    return rows.select("record_id", r6(numerics.masked_reduce(s, m), "mean"), numerics.masked_reduce(s, m, "sum").alias("total"))


@query("""
with x as (select l_orderkey, l_linenumber, 0.5 * ((l_discount * 10 - l_tax * 10) - (l_quantity / 50 - 0.5)) as z from lineitem)
select round(avg(ln(1 + exp(-z))), 6) as loss, count(*) as n from x""")
def dpo_loss(spark, d):
    x = table(spark, d, "lineitem")
    loss = numerics.dpo_loss(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, F.lit(0.5), beta=0.5)
    return x.select(loss.alias("l")).agg(r6(F.avg("l"), "loss"), F.count(F.lit(1)).alias("n"))


@query("""
with x as (select l_returnflag, l_discount as p, l_tax as o, 0.04 as f, l_quantity / 25 - 1 as a, (l_linenumber <> 2)::int as m from lineitem),
y as (select *, exp(p - o) as ratio, exp(f - p) as k from x)
select l_returnflag as batch, round(sum(m * -least(ratio * a, least(greatest(ratio, 0.98), 1.02) * a)) / greatest(sum(m), 1) + 0.5 * sum(m * (k - ln(k + 1e-8) - 1)) / greatest(sum(m), 1), 6) as loss from y group by 1""")
def grpo_loss(spark, d):
    """Mean over unmasked tokens; k is reference over policy."""
    loss = numerics.grpo_token_loss(F.col("l_discount"), F.col("l_tax"), F.lit(0.04), F.col("l_quantity") / 25 - 1, clip=0.02, kl=0.5)
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("batch")).agg(r6(numerics.token_mean(loss, F.col("l_linenumber") != 2), "loss"))


@query("""
with x as (select event_id, user_id, (value - avg(value) over (partition by user_id)) / (stddev_pop(value) over (partition by user_id) + 1e-8) as a from events)
select user_id, count(*) as n, round(sum(a * a), 3) as squares, round(max(a), 5) as most from x group by 1""")
def group_advantages(spark, d):
    x = numerics.group_advantage(table(spark, d, "events"), "user_id", "value")
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("advantage") * F.col("advantage")), 3).alias("squares"), F.round(F.max("advantage"), 5).alias("most"))


@query("""
with x as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as b, row_number() over (partition by user_id order by value, event_id) as w from events)
select user_id, max(case when b = 1 then event_id end) as best, max(case when w = 1 then event_id end) as worst from x group by 1""")
def best_and_worst(spark, d):
    return numerics.best_and_worst(table(spark, d, "events"), "user_id", "event_id", "value")


@query("""
with s as (select range as step from range(0, 1000))
select step, round(case when step < 100 then greatest(step / 100, 0.1) else greatest(0.5 * (1 + cos(pi() * least((step - 100) / 900, 1))), 0.1) end, 9) as cosine,
 round(case when step < 100 then greatest(step / 100, 0.1) when step < 600 then 1.0 else 0.1 + 0.9 * (1 - least((step - 600) / 300, 1)) * (1 - least((step - 600) / 300, 1)) end, 9) as stable,
 round(case when step < 100 then greatest(step / 100, 0.1) else 0.1 + 0.9 * 0.5 * (1 + cos(pi() * case when step < 200 then (step - 100) / 100 when step < 400 then (step - 200) / 200 when step < 800 then (step - 400) / 400 else (step - 800) / 800 end)) end, 9) as restarts from s""")
def learning_rates(spark, d):
    s = F.col("step")
    out = spark.range(0, 1000).withColumnRenamed("id", "step")
    return out.select("step", F.round(numerics.cosine_rate(s, 100, 1000), 9).alias("cosine"), F.round(numerics.stable_decay_rate(s, 100, 500, 300), 9).alias("stable"), F.round(numerics.restart_rate(s, 100, 100), 9).alias("restarts"))


@query("""
with x as (select vec_id, [v::double * 3 for v in embedding] as e from embeddings)
select vec_id, round(list_sum([v * v for v in e]) / list_sum([v * v for v in e]), 6) as norm, round(e[1] / sqrt(list_sum([v * v for v in e])), 5) as first, round((e[2] + e[4]) / 2, 5) as mean_second from x""")
def pooled_embeddings(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 3).alias("e"))
    unit = numerics.l2_normalise(F.col("e"))
    states = F.array(F.slice("e", 1, 2), F.slice("e", 3, 2), F.slice("e", 5, 2))
    mean = numerics.pool(states, F.array(F.lit(1), F.lit(1), F.lit(0)), "mean")
    rows = e.select("vec_id", unit.alias("u"), mean.alias("m"))
    return rows.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm"), F.round(F.col("u")[0], 5).alias("first"), F.round(F.col("m")[1], 5).alias("mean_second"))


# --- serving ------------------------------------------------------------------------------------------
@query("""
with r as (select record_id, any_value(sequence) as s from single_output_mask_builder group by 1),
p as (select record_id, i as page, s[i * 16 + 1 : i * 16 + 16] as ids from r, unnest(range(len(s) // 16)) as u(i))
select record_id, page, list_reduce([0::hugeint] || [x::hugeint for x in ids], lambda h, x: (h * 31 + x) % 18446744073709551616)::varchar as hash from p""")
def page_hashes(spark, d):
    rows = table(spark, d, "single_output_mask_builder").dropDuplicates(["record_id"])
    return pages.pages(rows, "record_id", "sequence", 16).select("record_id", "page", F.col("hash").cast("string").alias("hash"))


@query("""
with r as (select record_id, any_value(sequence) as s, min(built_at) as t from single_output_mask_builder group by 1),
p as (select record_id, t, i as page, s[i * 16 + 1 : i * 16 + 16] as ids from r, unnest(range(len(s) // 16)) as u(i)),
c as (select ids, min(t) as first from p group by 1), h as (select record_id, page, (first < t)::int as hit from p join c using (ids)),
m as (select record_id, min(hit) over (partition by record_id order by page) as ok from h)
select r.record_id, coalesce(sum(ok), 0)::bigint as cached_pages from r left join m using (record_id) group by 1""")
def prefix_cache(spark, d):
    """Each record asks for its pages when it was built; the pages of all records built earlier are cached."""
    built = table(spark, d, "single_output_mask_builder").select("record_id", "sequence", "built_at")
    rows = built.groupBy("record_id").agg(F.any_value("sequence").alias("sequence"), F.min("built_at").alias("built_at"))
    return pages.cached_before(rows, built, "record_id", "sequence", "built_at", 16)


@query("""
with a as (select record_id, any_value(chosen) as r from dpo_tokenize where chosen is not null group by 1),
s as (select record_id, r, case when contains(r, '```') then '```' when contains(r, 'because') then 'because' when contains(r, '. ') then '. ' end as stop from a)
select record_id, stop, length(case when stop is null then r else left(r, length(r) - strpos(reverse(r), reverse(stop)) + 1 - length(stop)) end)::int as kept from s""")
def stop_sequences(spark, d):
    a = table(spark, d, "dpo_tokenize").filter("chosen is not null").dropDuplicates(["record_id"])
    s = a.select("record_id", "chosen", text.first_stop(F.col("chosen"), ["```", "because", ". "]).alias("stop"))
    return s.select("record_id", "stop", F.length(F.coalesce(text.cut_at_last(F.col("chosen"), F.col("stop")), "chosen")).alias("kept"))


@query("""
with a as (select record_id, length(any_value(chosen)) as n from dpo_tokenize group by 1)
select record_id, 0 as place, 'look' as name, '"id": ' || record_id || ', "n": ' || coalesce(n, 0) as arguments, true as complete from a
union all select record_id, 1, 'list', '[' || record_id || ']', true from a union all select record_id, 2, 'none', '', true from a
union all select record_id, 3, 'open', ' "id": ' || record_id, false from a""")
def tool_calls(spark, d):
    """Answers without braces, then an object that is no call but holds one, three calls and one that is still open."""
    a = table(spark, d, "dpo_tokenize").dropDuplicates(["record_id"])
    i, n = F.col("record_id").cast("string"), F.coalesce(F.length("chosen"), F.lit(0)).cast("string")
    parts = [F.translate(F.coalesce("chosen", F.lit("")), "{}", "()"), F.lit('{"x": {"name": "inner"}} {"name": "look", "arguments": {"id":'), i, F.lit(', "n":'), n, F.lit('}} {"name": "list", "arguments": ['), i, F.lit(']} {"name": "none", "parameters": {}} {"name": "open", "arguments": { "id": '), i]
    calls = toolcalls.parse_tool_calls(a.select("record_id", F.concat(*parts).alias("t")), "t")
    return calls.select("record_id", F.posexplode("tool_calls").alias("place", "c")).select("record_id", "place", "c.name", "c.arguments", "c.complete")


@query("""
with m as (select any_value(loss) as loss, kind, run_id, step, logged_at from metric_log group by kind, run_id, step, logged_at)
select kind, date_trunc('month', logged_at) as month, count(loss) as n, round(avg(loss), 6) as loss from m group by 1, 2""")
def metric_summary(spark, d):
    m = table(spark, d, "metric_log").dropDuplicates(["kind", "run_id", "step", "logged_at"])
    return m.groupBy("kind", F.date_trunc("month", "logged_at").alias("month")).agg(F.count("loss").alias("n"), r6(F.avg("loss"), "loss"))


@query("""
with m as (select any_value(loss) as loss, run_id from metric_log where kind = 'validation' group by kind, run_id, step, logged_at)
select round(sum(loss) / count(loss), 6) as loss, count(loss) as n from m""")
def validation_loss(spark, d):
    m = table(spark, d, "metric_log").filter("kind = 'validation'").dropDuplicates(["kind", "run_id", "step", "logged_at"])
    parts = m.groupBy("run_id").agg(F.sum("loss").alias("loss_sum"), F.count("loss").alias("loss_count"))
    out = metric_stream.validation_loss(parts)
    return out.select(r6(F.col("loss"), "loss"), "n")


# --- sources and sinks --------------------------------------------------------------------------------
@query("select doc_id, md5(text) as digest, source from documents")
def json_round_trip(spark, d):
    path = scratch(spark, "json")
    json_files.write_records(table(spark, d, "documents").select("doc_id", "text", "source"), path)
    back = json_files.read_records(spark, path, "doc_id bigint, text string, source string")
    return back.select("doc_id", F.md5("text").alias("digest"), "source")


@query("select md5(coalesce(text, '')) as digest, row_number() over (order by doc_id) - 1 as record_idx from documents")
def jsonl_store(spark, d):
    """Documents written as JSON lines in the order of their ids and read back as numbered records."""
    path = scratch(spark, "jsonl")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.select(F.to_json(F.struct("doc_id", "text")).alias("value"), "doc_id").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    rows, _ = records.read_lines(spark, records.renamed(spark, path), "doc_id bigint, text string")
    return rows.select(F.md5("text").alias("digest"), "record_idx")


@query("select record_id, len(any_value(sequence)) as n, list_sum(any_value(sequence))::bigint as checksum, coalesce(any_value(domain), '__default__') as domain from single_output_mask_builder group by 1")
def shard_round_trip(spark, d):
    rows = table(spark, d, "single_output_mask_builder").dropDuplicates(["record_id"]).withColumn("domain", text.domain_of(F.col("domain")))
    rows = rows.select("record_id", "sequence", F.col("domain").alias("name"), F.regexp_replace(F.trim(F.lower("domain")), " ", "_").alias("domain"), F.floor(F.col("record_id") / 5000).cast("int").alias("shard_idx"))
    path = scratch(spark, "shards")
    store.write_shards(rows, path, {"sequence": "int32"})
    back = store.read_shards(spark, path)
    return back.select("record_id", F.size("sequence").cast("bigint").alias("n"), F.aggregate("sequence", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"), F.col("name").alias("domain"))


@query("with r as (select any_value(sequence) as s from single_output_mask_builder group by record_id) select count(*) as records, sum(len(s))::bigint as tokens, sum(list_sum(s))::bigint as checksum from r")
def bin_round_trip(spark, d):
    rows = table(spark, d, "single_output_mask_builder").dropDuplicates(["record_id"]).select("record_id", "sequence")
    path = scratch(spark, "bin")
    store.write_bin(rows, path, ["sequence"], "record_id")
    spark.dataSource.register(store.BinSource)
    back = spark.read.format("tokenbin").option("key", "sequence").load(path)
    return back.agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("values")).alias("tokens"), total("values").alias("checksum"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
