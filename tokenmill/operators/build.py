"""Chat rendering and mask building: a configuration becomes expressions over a record.

Every result is ``(ids, mask)`` of one length; all is narrow, so a build is a
projection and a filter that Catalyst fuses with the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.config import BuildConfig
from tokenmill.functions.text import domain_of, flatten_content, length_between, not_blank
from tokenmill.operators.tokenize import TOKENIZERS

ROLES = ("system", "user", "assistant", "tool")
INTS, NONE = "array<int>", "cast(array() as array<int>)"


def render_message(m: Column) -> Column:
    """ChatML of one message; an unknown role renders to nothing, null content is empty."""
    text = F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))
    return F.when(m["role"].isin(*ROLES), text).otherwise(F.lit(""))


def render_chat(messages: Column, add_generation_prompt: bool = False, system_prompt: str | None = None) -> Column:
    if system_prompt is not None:
        first = F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))
        messages = F.concat(F.array(first), messages)
    out = F.array_join(F.transform(messages, render_message), "")
    return F.concat(out, F.lit("<|im_start|>assistant\n")) if add_generation_prompt else out


def instruction_messages(instruction: Column, input_: Column, output: Column | None = None) -> Column:
    """system, user and assistant turns of an instruction record; empty and null ones left out."""
    pairs = [("system", instruction), ("user", input_), *([("assistant", output)] if output is not None else [])]
    turns = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in pairs])
    return F.filter(turns, lambda m: F.coalesce(m["content"], F.lit("")) != "")


def truncate(ids: Column, most: int, mode: str = "keep_start") -> Column:
    if mode == "keep_start":
        return F.slice(ids, 1, most)
    if mode != "keep_end":
        raise ValueError(f"unknown truncation mode {mode!r}")
    return F.slice(ids, F.greatest(F.size(ids) - most + 1, F.lit(1)), F.lit(most))


def constant_mask(ids: Column, value) -> Column:
    return F.transform(ids, lambda _: F.lit(value) if isinstance(value, int) else value)


def nested_mask(ids: Column, value: int) -> Column:
    return F.transform(ids, lambda x: constant_mask(x, value))


@dataclass
class Sections:
    """Compiles sections to one sequence.

    A section is ``field``, ``action`` (``train``, ``mask``, ``$role``, ``value``), ``template`` and
    ``add_special_tokens`` (only the first plain section by default). Text bounds hold only
    where no section is templated and all are trained.
    """

    config: BuildConfig
    tokenizer: object

    def _role_mask(self, role: Column) -> Column:
        acts = F.when(F.lit(False), F.lit(""))
        for name, action in self.config.mask.items():
            acts = acts.when(role == name, F.lit(action))
        return (acts.otherwise(F.lit(self.config.mask_default)) == "train").cast("int")

    def _part(self, s: dict, special: bool, bounds: bool) -> tuple[Column, Column]:
        col, action, bos = F.col(s["field"]), s.get("action", "train"), self.tokenizer.bos_id
        empty = F.expr(NONE)
        if s.get("template"):
            each = F.transform(
                F.coalesce(col, F.array().cast("array<struct<role:string,content:string>>")),
                lambda m: F.struct(self.tokenizer.ids(render_message(m)).alias("ids"), (self._role_mask(m["role"]) if action == "$role" else F.lit(int(action == "train"))).alias("keep")),
            )
            ids = F.flatten(F.transform(each, lambda x: x["ids"]))
            mask = F.flatten(F.transform(each, lambda x: constant_mask(x["ids"], x["keep"])))
            return F.coalesce(ids, empty), F.coalesce(mask, empty)
        ids = self.tokenizer.ids(col.cast("string"))
        if special and bos is not None:
            ids = F.concat(F.array(F.lit(bos)), ids)
        good = not_blank(col.cast("string"))
        if bounds:
            p = self.config
            good = good & length_between(col, p.min_chars if p.min_chars > 0 else 0, p.max_chars)
        ids = F.when(good, ids).otherwise(empty)
        return ids, constant_mask(ids, int(action == "train"))

    def columns(self, sections: list[dict], top: bool = True) -> tuple[Column, Column, Column]:
        """ids, mask and whether the record is kept."""
        templated = any(s.get("template") for s in sections)
        bounds = not templated and all(s.get("action", "train") == "train" for s in sections)
        parts, plain = [], True
        for s in sections:
            special = s.get("add_special_tokens", plain and not s.get("template"))
            plain = plain and bool(s.get("template"))
            parts.append(self._part(s, special, bounds))
        ids, mask = (F.concat(*[p[k] for p in parts]) for k in (0, 1))
        bos = self.tokenizer.bos_id
        if top and templated and bos is not None:
            some = F.size(ids) > 0
            ids = F.when(some, F.concat(F.array(F.lit(bos)), ids)).otherwise(ids)
            mask = F.when(some, F.concat(F.array(F.lit(0)), mask)).otherwise(mask)
        p = self.config
        ids, mask = truncate(ids, p.max_seq_len), truncate(mask, p.max_seq_len)
        return ids, mask, F.size(ids) > (1 if templated else 0)

    def list_field(self, s: dict) -> Column:
        """Each element its own sequence; empty ones dropped, each truncated."""
        most = self.config.max_seq_len
        each = F.transform(F.col(s["field"]), lambda t: truncate(self.tokenizer.ids(t), most))
        return F.filter(each, lambda x: F.size(x) > 0)


def raw_values(column: str, is_list: bool) -> Column:
    """Numbers as they are: a list as floats, a scalar as a list of one, null absent."""
    c = F.col(column)
    return c.cast("array<float>") if is_list else F.when(c.isNotNull(), F.array(c.cast("float")))


def build(df: DataFrame, config: BuildConfig, tokenizer: str | object = "codepoint", keep: tuple[str, ...] = ()) -> DataFrame:
    """``domain`` and the built keys of every accepted record, besides the columns ``keep``.

    Single output (``sections``): ``sequence`` and ``loss_mask`` (null if all is trained).
    Many outputs (``sources``, which take priority): a column per source and ``<key>_mask``
    (or ``mask_key``). A key that a record lacks is null; records without any
    non-empty flat ids are left out. ``max_items`` counts accepted records in the order of ``keep[0]``.
    """
    tok = TOKENIZERS.create(tokenizer) if isinstance(tokenizer, str) else tokenizer
    make, out = Sections(config, tok), [F.col(c) for c in keep]
    domain = domain_of(F.col(config.domain_key)) if config.domain_key in df.columns else domain_of(F.lit(None).cast("string"))
    out.append(domain.alias("domain"))
    if config.sources:
        primary = []
        for key, source in config.sources.items():
            sections = source["sections"]
            if sections[0].get("action") == "value":
                field = sections[0]["field"]
                out.append(raw_values(field, df.schema[field].dataType.typeName() == "array").alias(key))
                continue
            if source.get("list_field"):
                ids = make.list_field(sections[0])
                out.append(ids.alias(key))
                value = int(sections[0].get("action", "train") == "train")
                out.append(nested_mask(ids, value).alias(source.get("mask_key", f"{key}_mask")))
                continue
            ids, mask, good = make.columns(sections)
            primary.append(F.when(good, F.size(ids)).otherwise(F.lit(0)))
            out.append(F.when(good, ids).alias(key))
            explicit = "mask_key" in source
            out.append(F.when(good & (F.lit(explicit) | F.exists(mask, lambda m: m == 0)), mask).alias(source.get("mask_key", f"{key}_mask")))
        accepted = F.greatest(*primary, F.lit(0)) > 0
    else:
        ids, mask, accepted = make.columns(config.sections)
        out += [ids.alias("sequence"), F.when(F.exists(mask, lambda m: m == 0), mask).alias("loss_mask")]
    built = df.select(*out, accepted.alias("_accepted")).filter("_accepted").drop("_accepted")
    most = config.max_items
    return built.orderBy(keep[0]).limit(most) if most and keep else built


def as_messages(df: DataFrame, column: str) -> Column:
    """A conversation as it is, a text as one user turn; null stays null."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "array":
        return F.transform(c, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when(c.isNotNull(), F.array(F.struct(F.lit("user").alias("role"), c.cast("string").alias("content"))))


def as_answer(df: DataFrame, column: str) -> Column:
    """A text as it is, the contents of a conversation joined; null stays null."""
    c = F.col(column)
    return flatten_content(c) if df.schema[column].dataType.typeName() == "array" else c


def dpo_ids(df: DataFrame, tokenizer: str | object = "codepoint", most: int = 2048, key: str = "record_id", legacy: str = "legacy_input", malformed: str = "null") -> DataFrame:
    """Preference records to ids and masks of the rendered conversation, the prompt masked.

    ``prompt``, ``chosen`` and ``rejected`` may be texts or conversations; the prompt is ``legacy`` where it is null or
    empty. The prompt is rendered with the opening of an answer, each side as the whole conversation with one closing
    assistant turn; both are cut to ``most``. A record without a prompt or an answer is malformed: its four columns are
    null, or the run ends with ``malformed="raise"``.
    """
    tok = TOKENIZERS.create(tokenizer) if isinstance(tokenizer, str) else tokenizer
    start = F.array(F.lit(tok.bos_id)) if tok.bos_id is not None else None
    ids = lambda text: F.concat(start, tok.ids(text)) if start is not None else tok.ids(text)
    asked = as_messages(df, "prompt")
    filled = F.size("prompt") > 0 if df.schema["prompt"].dataType.typeName() == "array" else F.col("prompt") != ""
    asked = F.when(F.coalesce(filled, F.lit(False)), asked)
    if legacy in df.columns:
        asked = F.coalesce(asked, as_messages(df, legacy))
    answers = {side: as_answer(df, side) for side in ("chosen", "rejected")}
    whole = asked.isNotNull() & answers["chosen"].isNotNull() & answers["rejected"].isNotNull()
    rows = df.select(key, whole.alias("well_formed"), asked.alias("_asked"), *[a.alias(side) for side, a in answers.items()])
    rows = rows.withColumn("_prompt", F.least(F.size(ids(render_chat(F.col("_asked"), add_generation_prompt=True))), F.lit(most)))
    out = []
    for side in answers:
        turn = F.array(F.struct(F.lit("assistant").alias("role"), F.col(side).alias("content")))
        full = truncate(ids(render_chat(F.concat("_asked", turn))), most)
        out += [full.alias(side), F.transform(full, lambda _, i: (i >= F.col("_prompt")).cast("int")).alias(f"{side}_mask")]
    rows = rows.select(key, "well_formed", *out)
    refuse = F.raise_error(F.lit("malformed preference record")) if malformed == "raise" else None
    keep = lambda k: F.when(F.col("well_formed"), F.col(k)) if refuse is None else F.when(F.col("well_formed"), F.col(k)).otherwise(refuse.cast("array<int>"))
    return rows.select(key, "well_formed", *[keep(k).alias(k) for k in ("chosen", "chosen_mask", "rejected", "rejected_mask")])


def first_ids(names: list[str]) -> Column:
    """The first of these columns of ids that holds any, in the order in which they were declared; null if none does."""
    return F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names])


def filled_up(df: DataFrame, primary: str, others: list[str]) -> DataFrame:
    """Columns that a record lacks as zeros of the length of its primary ids."""
    return df.withColumns({c: F.coalesce(F.col(c), F.array_repeat(F.lit(0), F.size(primary))) for c in others})
