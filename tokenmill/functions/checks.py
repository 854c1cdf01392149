"""Instruction-following checks: a registry of predicates over (response, arguments).

Arguments are JSON texts of a column, or a dict known on the driver (then they are literals of the plan). A check
whose argument is missing or of another type is false; an unknown check is null. White space is what Unicode calls so.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import WORD, WS, quoted, strip
from tokenmill.registry import Registry

CHECKS = Registry()
check = CHECKS.register
LINES = "(?md)"  # only a line feed ends a line


class Args:
    """Arguments by name; a default stands in where the name is absent, not where its value is null."""

    def __init__(self, source: Column | dict):
        self.source = source

    def get(self, name: str, kind: str = "string", default=None) -> Column:
        spark_type = "array<string>" if kind == "array" else kind
        empty = F.lit(default).cast(spark_type) if not isinstance(default, list) else F.array(*map(F.lit, default)).cast(spark_type)
        if isinstance(self.source, dict):
            if name not in self.source:
                return empty
            value = self.source[name]
            return F.array(*map(F.lit, value)).cast(spark_type) if isinstance(value, list) else F.lit(value).cast(spark_type)
        raw = F.get_json_object(self.source, f"$.{name}")
        value = F.from_json(raw, spark_type) if kind == "array" else raw.try_cast(spark_type)
        return value if default is None else F.when(F.array_contains(F.json_object_keys(self.source), name), value).otherwise(empty)


def found(text: Column, pattern: str | Column) -> Column:
    return F.regexp_count(text, F.lit(pattern) if isinstance(pattern, str) else pattern)


def filled(parts: Column) -> Column:
    return F.filter(parts, lambda p: strip(p) != "")


def at_python_index(items: Column, nth: Column) -> Column:
    """Item number ``nth`` from 1; 0 and less count from the end, as an index below zero would."""
    return F.try_element_at(items, F.when(nth >= 1, nth).otherwise(nth - 1))


def at_least(number: Column, k: Args, name: str, default: int, relation: str) -> Column:
    bound = k.get(name, "int", default)
    return F.when(k.get(relation, default="at least").eqNullSafe("less than"), number < bound).otherwise(number >= bound)


@check("keywords:existence")
def _(r, k):
    return F.forall(k.get("keywords", "array"), lambda w: F.regexp_like(r, F.concat(F.lit("(?iu)"), quoted(w))))


@check("keywords:frequency")
def _(r, k):
    return at_least(found(r, F.concat(F.lit("(?iu)"), quoted(k.get("keyword")))), k, "frequency", 1, "relation")


@check("keywords:forbidden_words")
def _(r, k):
    edge = lambda w, behind: F.when(w.rlike(rf"{WORD}\z" if behind else f"^{WORD}"), f"(?{'' if behind else '<'}!{WORD})").otherwise(f"(?{'' if behind else '<'}={WORD})")
    return ~F.exists(k.get("forbidden_words", "array"), lambda w: F.regexp_like(r, F.concat(F.lit("(?iu)"), edge(w, False), quoted(w), edge(w, True))))


@check("keywords:letter_frequency")
def _(r, k):
    text, letter = F.lower(r), F.lower(k.get("letter"))
    times = F.when(letter == "", F.length(text) + 1).otherwise((F.length(text) - F.length(F.replace(text, letter, F.lit("")))) / F.length(letter))
    return at_least(times, k, "let_frequency", 1, "let_relation")


@check("detectable_content:number_placeholders")
def _(r, k):
    return found(r, r"\[[^\n]*?\]") >= k.get("num_placeholders", "int", 1)


@check("detectable_content:postscript")
def _(r, k):
    marker, low = k.get("postscript_marker", default="P.S."), F.lower(r)
    return F.when(marker == "P.P.S", low.rlike(rf"p\.{WS}?p\.{WS}?s")).when(marker == "P.S.", low.rlike(rf"p\.{WS}?s\.")).otherwise(F.contains(low, F.lower(marker)))


@check("detectable_format:number_bullet_lists")
def _(r, k):
    return found(r, rf"{LINES}^{WS}*\*[^*].*$") + found(r, rf"{LINES}^{WS}*-.*$") == k.get("num_bullets", "int", 1)


@check("detectable_format:number_highlighted_sections")
def _(r, k):
    return F.size(filled(F.regexp_extract_all(r, F.lit(r"\*([^\n*]+)\*"), F.lit(1)))) >= k.get("num_highlights", "int", 1)


@check("detectable_format:multiple_sections")
def _(r, k):
    return found(r, F.concat(F.lit(f"{WS}?"), quoted(k.get("section_spliter", default="Section")), F.lit(rf"{WS}?\p{{Nd}}+{WS}?"))) >= k.get("num_sections", "int", 1)


@check("detectable_format:title")
def _(r, k):
    return F.exists(F.regexp_extract_all(r, F.lit(r"<<([^>\n]+)>>"), F.lit(1)), lambda t: strip(strip(t, "<")) != "")


@check("detectable_format:json_format")
def _(r, k):
    bare = F.regexp_replace(strip(r), rf"(?i)^(?:```json{WS}*){{0,3}}(?:```{WS}*)?", "")
    return F.try_parse_json(strip(F.regexp_replace(bare, r"```\z", ""))).isNotNull()


@check("detectable_format:general_punctuation")
def _(r, k):
    return ~F.exists(k.get("punctuation_blacklist", "array", []), lambda p: F.contains(r, p))


@check("detectable_format:number_highlighted_words")
def _(r, k):
    edge = WS.replace("[", "[^*", 1)
    return found(r, rf"\*{edge}[^*]*{edge}\*") >= k.get("num_highlights", "int", 1)


@check("startend:end_checker")
def _(r, k):
    closed = F.regexp_replace(strip(r), rf'"+{WS}*\z', "")
    return F.endswith(F.lower(F.regexp_replace(closed, rf"{WS}+\z", "")), F.lower(strip(k.get("end_phrase"))))


@check("startend:quotation")
def _(r, k):
    t = strip(r)
    return F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))


@check("startend:start_checker")
def _(r, k):
    return F.regexp_like(r, F.concat(F.lit(f"{LINES}^{WS}*"), quoted(k.get("starter"))))


@check("change_case:english_capital")
def _(r, k):
    return r.rlike(r"\p{IsUppercase}") & ~r.rlike(r"[\p{IsLowercase}\p{Lt}]")


@check("change_case:english_lowercase")
def _(r, k):
    return r.rlike(r"\p{IsLowercase}") & ~r.rlike(r"[\p{IsUppercase}\p{Lt}]")


@check("change_case:capital_word_frequency")
def _(r, k):
    return at_least(found(r, rf"(?<!{WORD})[A-Z]{{2,}}(?!{WORD})"), k, "capital_frequency", 1, "capital_relation")


@check("punctuation:no_comma")
def _(r, k):
    return ~F.contains(r, F.lit(","))


@check("length_constraints:number_words")
def _(r, k):
    return at_least(found(r, f"{WORD}+"), k, "num_words", 100, "relation")


@check("length_constraints:number_sentences")
def _(r, k):
    return at_least(F.size(filled(F.split(strip(r), rf"(?<=[.!?]){WS}+"))), k, "num_sentences", 5, "relation")


@check("length_constraints:number_paragraphs")
def _(r, k):
    parts = F.when(F.contains(r, F.lit("***")), F.split(r, rf"{WS}?\*\*\*{WS}?")).otherwise(F.split(r, r"\n\n+"))
    return F.size(filled(parts)) == k.get("num_paragraphs", "int", 1)


@check("length_constraints:nth_paragraph_first_word")
def _(r, k):
    parts = filled(F.split(r, r"\n\n+"))
    word = F.regexp_extract(at_python_index(parts, k.get("nth_paragraph", "int", 1)), rf"(?d)^{WS}*([^\s\x1c-\x1f\x85\p{{Z}}]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(word, r"^['\"]+", ""), r"[.,!?:;\"']+\z", "")
    return (F.size(parts) == k.get("num_paragraphs", "int", 1)) & (F.lower(bare) == F.lower(k.get("first_word", default="")))


@check("length_constraints:nth_word_checker")
def _(r, k):
    words = F.regexp_extract_all(r, F.lit(f"({WORD}+)"), F.lit(1))
    return F.lower(at_python_index(words, k.get("nth_word", "int", 1))) == F.lower(k.get("target_word", default=""))


@check("combination:repeat_prompt")
def _(r, k):
    return F.startswith(F.lower(strip(r)), F.lower(strip(k.get("prompt_to_repeat"))))


@check("combination:two_responses")
def _(r, k):
    parts = filled(F.split(r, r"\*{6}"))
    return (F.size(parts) == 2) & (strip(F.try_element_at(parts, F.lit(1))) != strip(F.try_element_at(parts, F.lit(2))))


def holds(check_id: str, response: Column, kwargs: Column | dict) -> Column:
    """Whether one check holds; false for a null response or a missing argument."""
    return F.coalesce(CHECKS.get(check_id)(response, Args(kwargs)), F.lit(False))


def verdict(check_id: Column, response: Column, kwargs: Column) -> Column:
    """One expression over all registered checks: null for an unknown id."""
    out = None
    for name in CHECKS.list_registered():
        one = holds(name, response, kwargs)
        out = F.when(check_id == name, one) if out is None else out.when(check_id == name, one)
    return out


def pass_counts(df: DataFrame, response: str, asked: list[tuple[str, dict]]) -> DataFrame:
    """``check_id``, ``kwargs``, ``n``, ``passed`` of the same checks on every response: one pass, no copies of rows."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(holds(name, F.col(response), kwargs)).alias(f"c{i}") for i, (name, kwargs) in enumerate(asked)])
    rows = F.array(*[F.struct(F.lit(name).alias("check_id"), F.lit(json.dumps(kwargs)).alias("kwargs"), F.col("n"), F.col(f"c{i}").alias("passed")) for i, (name, kwargs) in enumerate(asked)])
    return counts.select(F.inline(rows))


def instruction_report(df: DataFrame, response: str = "response") -> dict[str, DataFrame]:
    """df: key, sample, response, instruction_id_list, kwargs (JSON texts; those missing at the end are empty).

    An instruction is passed if any sample passes it (best of n). ``by_problem``: constraints, verified (supported)
    ones, passed ones, and accuracy, the passed share of the verified ones, null where none is; ``by_type``: total,
    passed, accuracy of each supported instruction; ``summary``: totals over all. Accuracies to 4 places.
    """
    at = F.posexplode("instruction_id_list").alias("place", "instruction")
    each = df.select("key", "sample", response, "kwargs", at).withColumn("k", F.coalesce(F.get("kwargs", F.col("place")), F.lit("{}")))
    each = each.select("key", "place", "instruction", verdict(F.col("instruction"), F.col(response), F.col("k")).alias("ok"))
    best = each.groupBy("key", "place", "instruction").agg(F.bool_or("ok").alias("ok"), F.lit(1).alias("one"))
    share = F.round(F.count_if("ok") / F.nullif(F.count("ok"), F.lit(0)), 4)
    by_problem = best.groupBy("key").agg(F.count(F.lit(1)).alias("constraints"), F.count("ok").alias("verified"), F.count_if("ok").alias("passed"), share.alias("accuracy"))
    by_type = best.filter("ok is not null").groupBy("instruction").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("passed"), share.alias("accuracy"))
    summary = best.agg(
        F.countDistinct("key").alias("problems"), F.count("ok").alias("verified"), F.count_if("ok").alias("passed"), F.coalesce(share, F.lit(0.0)).alias("accuracy"),
        F.count_if(F.col("ok").isNull()).alias("unsupported"),
    )
    return {"by_problem": by_problem, "by_type": by_type, "summary": summary}
