"""Keyed segment stores: Parquet by domain and shard, and flat binary files with a description."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {"bool": "boolean", "uint8": "smallint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float16": "float", "float32": "float", "float64": "double"}
REQUIRED = {
    "seq": ("sequence",), "sft": ("sequence", "loss_mask", "position_ids"),
    "dpo": ("chosen", "rejected", "chosen_mask", "rejected_mask"), "grpo": ("prompts", "responses", "masks", "rewards"),
}


def detect_format(path: str) -> str:
    """``h5``, ``bin`` or ``jsonl`` from a file's ending, or the first of these that a folder holds."""
    p = Path(path)
    if p.is_file():
        kind = {".h5": "h5", ".hdf5": "h5", ".bin": "bin", ".jsonl": "jsonl", ".json": "jsonl"}.get(p.suffix)
        if not kind:
            raise ValueError(f"no store format for {p.suffix!r}")
        return kind
    if not p.exists():
        raise FileNotFoundError(path)
    for kind, pattern in (("h5", "*.h5"), ("bin", "meta.json"), ("jsonl", "*.jsonl")):
        if next(p.rglob(pattern), None):
            return kind
    raise FileNotFoundError(f"no store in {path}")


def require_keys(df: DataFrame, kind: str) -> None:
    missing = [k for k in REQUIRED[kind] if k not in df.columns]
    if missing:
        raise KeyError(f"missing {missing}; there are {df.columns}")


def cast_keys(df: DataFrame, dtype: dict[str, str] | None = None) -> DataFrame:
    """Arrays to named element types; floats stay floats unless one is named."""
    out = {}
    for name, kind in (dtype or {}).items():
        if kind not in KINDS:
            raise ValueError(f"unknown dtype {kind!r}")
        if name in df.columns:
            nested = df.schema[name].dataType.simpleString().startswith("array<array")
            out[name] = F.col(name).cast(f"array<array<{KINDS[kind]}>>" if nested else f"array<{KINDS[kind]}>")
    return df.withColumns(out) if out else df


def widen(df: DataFrame) -> DataFrame:
    """Reading types: ids as bigint, masks as boolean, rewards as float."""
    out = {}
    for c in df.columns:
        kind = df.schema[c].dataType.simpleString()
        if kind.startswith("array"):
            leaf = "boolean" if "mask" in c else "float" if c == "rewards" else "bigint" if "int" in kind else None
            if leaf:
                out[c] = F.col(c).cast(f"array<array<{leaf}>>" if kind.startswith("array<array") else f"array<{leaf}>")
    return df.withColumns(out) if out else df


def write_shards(df: DataFrame, path: str, dtype: dict[str, str] | None = None) -> None:
    """``<path>/domain=.../shard_idx=...``; the commit protocol leaves nothing behind a failure."""
    cast_keys(df, dtype).repartition("domain", "shard_idx").write.mode("overwrite").partitionBy("domain", "shard_idx").parquet(path)


def read_shards(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("domain") == domain) if domain is not None else df


def _files(path: str):
    """The file system of a path or URI (local, HDFS, object stores) and the path in it, on whatever machine this runs."""
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{Path(path).absolute()}" if not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def _read(fs, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def _metas(path: str) -> list[str]:
    fs, root = _files(path)
    found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(i.path for i in found if i.base_name == "meta.json")


def write_bin(df: DataFrame, path: str, keys: list[str], order: str, dtype: dict[str, str] | None = None) -> int:
    """Flat files: a folder per partition with ``<key>.bin``, offsets of records and ``meta.json``.

    ``path`` is one that all executors share, any that Arrow can open. Each task streams its batches to its own
    shard, a shard counts once its description is there, and a task that is run again writes it anew. Nested arrays are
    a ValueError; null lists are empty. Returns the number of shards.
    """
    for k in keys:
        if df.schema[k].dataType.simpleString().startswith("array<array"):
            raise ValueError(f"{k} is nested; flatten it first")
    kinds = {k: (dtype or {}).get(k, "float32" if "float" in df.schema[k].dataType.simpleString() or "double" in df.schema[k].dataType.simpleString() else "int32") for k in keys}

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs, root = _files(path)
        folder = f"{root}/shard_{part:05d}"
        streams, sizes, total = {}, {k: [np.zeros(1, np.int64)] for k in keys}, dict.fromkeys(keys, 0)
        for b in batches:
            if not streams:
                fs.create_dir(folder)
                streams = {k: fs.open_output_stream(f"{folder}/{k}.bin") for k in keys}
            for k, column in zip(keys, b.columns):
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(kinds[k])
                streams[k].write(flat.tobytes())
                sizes[k].append(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                total[k] += len(flat)
        for k, stream in streams.items():
            stream.close()
            with fs.open_output_stream(f"{folder}/{k}.offsets") as f:
                f.write(np.cumsum(np.concatenate(sizes[k])).astype(np.int64).tobytes())
        if streams:
            with fs.open_output_stream(f"{folder}/meta.json.tmp") as f:
                f.write(json.dumps({k: {"shape": [total[k]], "dtype": kinds[k]} for k in keys}).encode())
            fs.move(f"{folder}/meta.json.tmp", f"{folder}/meta.json")
            yield pa.RecordBatch.from_arrays([pa.array([part])], names=["shard"])

    done = df.repartitionByRange(order).sortWithinPartitions(order).select(*keys).mapInArrow(run, "shard bigint")
    return len(done.collect())


class BinSource(DataSource):
    """``spark.read.format("tokenbin").option("key", "sequence").load(path)``: shard, record_idx, values.

    A partition per shard, read from the shared path and cut at the record offsets.
    """

    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        key, metas = self.options["key"], _metas(self.options["path"])
        if not metas:
            raise FileNotFoundError(self.options["path"])
        meta = json.loads(_read(_files(self.options["path"])[0], metas[0]))
        if key not in meta:
            raise KeyError(f"missing {key!r}; there are {sorted(meta)}")
        return f"shard int, record_idx bigint, `values` array<{KINDS[meta[key]['dtype']]}>"

    def reader(self, schema):
        return _BinReader(self.options["path"], self.options["key"], [m.rsplit("/", 1)[0] for m in _metas(self.options["path"])])


class _Shard(InputPartition):
    def __init__(self, number: int, folder: str):
        self.number, self.folder = number, folder


class _BinReader(DataSourceReader):
    def __init__(self, path: str, key: str, folders: list[str]):
        self.path, self.key, self.folders = path, key, folders

    def partitions(self):
        return [_Shard(i, f) for i, f in enumerate(self.folders)]

    def read(self, partition):
        fs, _ = _files(self.path)
        at = f"{partition.folder}/{self.key}"
        kind = np.dtype(json.loads(_read(fs, f"{partition.folder}/meta.json"))[self.key]["dtype"])
        size = fs.get_file_info(f"{at}.bin").size
        known = fs.get_file_info(f"{at}.offsets").type != pa.fs.FileType.NotFound
        offsets = np.frombuffer(_read(fs, f"{at}.offsets"), "int64") if known else np.array([0, size // kind.itemsize])
        out = pa.list_(pa.from_numpy_dtype(kind))
        with fs.open_input_stream(f"{at}.bin") as f:
            for i in range(0, len(offsets) - 1, 1024):
                some = offsets[i : i + 1025]
                flat = np.frombuffer(f.read(int(some[-1] - some[0]) * kind.itemsize), kind)
                lists = pa.ListArray.from_arrays(pa.array(some - some[0], pa.int32()), pa.array(flat)).cast(out)
                n = len(lists)
                yield pa.RecordBatch.from_arrays([pa.array([partition.number] * n, pa.int32()), pa.array(range(i, i + n), pa.int64()), lists], names=["shard", "record_idx", "values"])
