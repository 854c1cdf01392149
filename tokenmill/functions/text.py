"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DOMAIN = "__default__"
# One sign of white space, one of a word.
WS, WORD = r"[\s\x1c-\x1f\x85\p{Z}]", r"[\p{L}\p{N}_]"


def strip(text: Column, signs: str = "") -> Column:
    """Without white space (or the given signs) at both ends."""
    of = f"[{signs}]" if signs else WS
    return F.regexp_replace(text, f"(?d)^{of}+|{of}+\\z", "")


def quoted(part: Column) -> Column:
    """A text as a pattern of itself."""
    return F.regexp_replace(part, r"([^\p{L}\p{N}_\s])", r"\\$1")


def length_between(text: Column, least: int = 50, most: int = 2_000_000) -> Column:
    """Code points within both bounds; null is outside."""
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def domain_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(DEFAULT_DOMAIN))


def words(text: Column) -> Column:
    """Tokens between runs of Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens as strings, in order; none if there are fewer. ``tokens`` is computed once."""

    def runs(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1)))
        joined = F.transform(at, lambda i: F.array_join(F.slice(t, i, F.lit(n)), "\x01"))
        return F.when(F.size(t) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(tokens), runs)[0]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def sentence_count(text: Column) -> Column:
    """Non-blank parts behind . ! ? and white space."""
    return F.size(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""))


def flatten_content(messages: Column, sep: str = "") -> Column:
    """Contents of a conversation joined, null as empty."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), sep)


def block_text(content: Column) -> Column:
    """Text of a message's content, a string or a JSON list of blocks: the string, or its first block of type text; else empty."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    first = F.try_element_at(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(1))["text"]
    return F.when(content.rlike(r"^\s*\[") & blocks.isNotNull(), F.coalesce(first, F.lit(""))).otherwise(F.coalesce(content, F.lit("")))


def first_stop(body: Column, stops: list[str]) -> Column:
    """The first of the stops, in the order of the list, that the body holds; null if none."""
    found = F.filter(F.array(*[F.lit(s) for s in stops]), lambda s: F.contains(body, s)) if stops else F.array().cast("array<string>")
    return F.try_element_at(found, F.lit(1))


def cut_at_last(body: Column, stop: Column) -> Column:
    """The body up to the last occurrence of ``stop``; the body itself if it holds none."""
    tail = F.call_function("substring_index", body, stop, F.lit(-1))
    keep = F.length(body) - F.length(tail) - F.length(stop)
    return F.when(F.contains(body, stop), F.substring(body, F.lit(1), keep)).otherwise(body)


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))
