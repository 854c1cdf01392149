"""Tokenizer back ends: code points and words as expressions, vocabulary files as an Arrow stage."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.registry import Registry

logger = logging.getLogger(__name__)

TOKENIZERS = Registry()


@dataclass
class Special:
    """Special tokens by name; ``id_of("bos")`` and ``stop_ids`` as ids."""

    tokens: dict[str, str] = field(default_factory=dict)
    ids: dict[str, int] = field(default_factory=dict)
    stop: tuple[str, ...] = ("eos",)

    def id_of(self, name: str) -> int | None:
        return self.ids.get(self.tokens.get(name, name))

    @property
    def stop_ids(self) -> list[int]:
        return [i for i in map(self.id_of, self.stop) if i is not None]


@TOKENIZERS.register("codepoint")
@dataclass
class Codepoints:
    """The id of a token is its code point; pure expressions."""

    bos_id: int | None = None

    def ids(self, text: Column) -> Column:
        return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def text(self, ids: Column) -> Column:
        unit = lambda x: F.lpad(F.hex(x), 4, "0")
        above = lambda i: i - 0x10000
        pair = lambda i: F.concat(unit(F.shiftright(above(i), 10) + 0xD800), unit(above(i).bitwiseAND(0x3FF) + 0xDC00))
        return F.array_join(F.transform(ids, lambda i: F.decode(F.unhex(F.when(i < 0x10000, unit(i)).otherwise(pair(i))), "UTF-16BE")), "")


@TOKENIZERS.register("whitespace")
@dataclass
class Words:
    """Ids by hash of the word, in 31 bits; pure expressions."""

    bos_id: int | None = None

    def ids(self, text: Column) -> Column:
        from tokenmill.functions.text import words

        return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << 31)).cast("int"))


def each_apart(run: Callable[[list], list], items: list) -> list:
    """``run`` over all items at once; if that fails, one by one, and None for those that fail alone."""
    try:
        return run(items)
    except Exception:
        out = []
        for item in items:
            try:
                out += run([item])
            except Exception:
                logger.warning("failed to process a record, left out", exc_info=True)
                out.append(None)
        return out


def sentinel_ids(encode: Callable[[str], list[int]], text: str | None, special: Special) -> list[int]:
    """Ids that stand before a pass without context: those of ``text``, else the first of bos, pad and eos that there is, else 0."""
    ids = encode(text) if text else []
    return ids or [next((i for i in map(special.id_of, ("bos", "pad", "eos")) if i is not None), 0)]


@TOKENIZERS.register("file")
@dataclass
class VocabularyFile:
    """A tokenizer file of the ``tokenizers`` library: encode and decode as narrow Arrow stages."""

    path: str
    bos_id: int | None = None

    def save(self, folder: str) -> None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        Path(folder, "tokenizer.json").write_text(Path(self.path).read_text(encoding="utf-8"), encoding="utf-8")
        Path(folder, "tokenizer_config.json").write_text(json.dumps({"bos_id": self.bos_id}), encoding="utf-8")

    @classmethod
    def load(cls, folder: str) -> VocabularyFile:
        conf = json.loads(Path(folder, "tokenizer_config.json").read_text(encoding="utf-8"))
        return cls(str(Path(folder, "tokenizer.json")), conf.get("bos_id"))

    def encode(self, df: DataFrame, text_col: str, out: str = "ids", special: bool = False, as_tokens: bool = False) -> DataFrame:
        """``df`` and the ids (or token strings) of ``text_col``; null text, and one that the tokenizer fails on, has null."""
        path, kind = self.path, pa.string() if as_tokens else pa.int32()
        rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(text_col).alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                done = iter(each_apart(lambda some: [e.tokens if as_tokens else e.ids for e in tok.encode_batch(some, add_special_tokens=special)], [t for t in texts if t is not None]))
                got = [None if t is None else next(done) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(kind))], names=["row", out])

        schema = f"row {rows.schema['row'].dataType.simpleString()}, {out} array<{'string' if as_tokens else 'int'}>"
        return rows.mapInArrow(run, schema).select("row.*", out)

    def decode(self, df: DataFrame, ids_col: str, out: str = "text") -> DataFrame:
        path = self.path
        rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(ids_col).alias("ids"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            for batch in batches:
                got = [None if i is None else tok.decode(i, skip_special_tokens=True) for i in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=["row", out])

        return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {out} string").select("row.*", out)
