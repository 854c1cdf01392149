"""Encoding a corpus with a public tokenizer (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.bpe import encoder
from tokenmill.llm.common import TOKENIZER_DIR

BYTE_BPE = f"{TOKENIZER_DIR}/byte_bpe_50k.json"


def encode_corpus(df: DataFrame, id_col: str, text_col: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    """``id_col`` and ``ids`` of every row, without special tokens.

    Null and empty texts have the empty list; strings of special tokens in a
    text are ordinary text. Only the two columns are read, so others may have
    any name. One narrow stage: no shuffle, memory bounded by an Arrow batch
    and a cache of at most ``KEEP_PIECES`` pieces per Python worker. The path of
    the vocabulary must exist on every executor.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in _slices(batch):
                ids, counts = enc.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "ids"])

    out = rows.mapInArrow(run, f"id {id_type}, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def token_counts(df: DataFrame, text_col: str, tokenizer: str = BYTE_BPE, out: str = "n_tokens") -> DataFrame:
    """``df`` without ``text_col`` and with the number of ids of it (0 for null and empty)."""
    kept = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*[df[c] for c in kept]).alias("row"), F.col(text_col).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {out} bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for part in _slices(batch):
                _, counts = enc.encode(part.column(1).to_pylist(), count_only=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["row", out])

    return rows.mapInArrow(run, schema).select("row.*", out)


def _slices(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
