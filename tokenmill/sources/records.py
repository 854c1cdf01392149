"""Record stores: JSON lines in a fixed order, eager or lazy, and access by record or by stream position."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tokenmill.config import BuildConfig
from tokenmill.operators.build import build
from tokenmill.operators.scans import position_ids, prefix_sum
from tokenmill.plans.corpus import CHAT_CONFIG
from tokenmill.registry import Registry

STORES = Registry()
CONFIG_NAME = "dataset_config.json"  # fixed value


def renamed(spark: SparkSession, path: str) -> str:
    """The folder, after the part files of a text sink in it have got the ending of JSON lines."""
    files, fs = _files(spark, path, "part-*")
    for f in files:
        if not f.endswith(".jsonl"):
            fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f), spark._jvm.org.apache.hadoop.fs.Path(f"{f.rsplit('.', 1)[0]}.jsonl"))
    return path


def _files(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> tuple[list[str], object]:
    """The file, or the matching files right in the folder, by name; and the file system that holds them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.isFile(at):
        return [str(at)], fs
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, pattern)) if fs.exists(at) else None
    return sorted(str(s.getPath()) for s in found or []), fs


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """``record_idx`` and fields of the JSON lines of a file or a folder's ``*.jsonl``, and the malformed lines beside them.

    The order is that of file names and lines. Blank lines vanish. A malformed line is left out and stands in the
    second table (file, line). Splits are numbered from their counts, so no task sees more than its split.
    """
    files, _ = _files(spark, path)
    if not files:
        raise FileNotFoundError(f"no *.jsonl in {path}")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(files).filter(F.col("value").rlike(r"\S"))
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.withColumn("r", F.from_json("value", StructType([*kind.fields]).add("_corrupt_record", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = parsed.filter(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()).select("file", F.col("value").alias("line"))
    good = parsed.filter(F.col("r._corrupt_record").isNull() & F.col("r").isNotNull())
    splits = good.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))  # a row per split of the input
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = good.withColumn("_i", inside).join(F.broadcast(base), ["file", "block"])
    return numbered.select((F.col("base") + F.col("_i")).alias("record_idx"), *[F.col(f"r.`{f.name}`").alias(f.name) for f in kind.fields]), bad


def tokenize_records(records: DataFrame, config: BuildConfig, tokenizer, keep: tuple[str, ...] = ("record_idx",)) -> DataFrame:
    """Records to keyed ids as they are read (no packing, no shards), with position ids where the config names a kind."""
    out = build(records, config, tokenizer, keep=keep)
    main = "sequence" if "sequence" in out.columns else None
    mode = config.position_ids_mode
    if main and mode == "continuous":
        out = prefix_sum(out.withColumn("_n", F.size(main)), keep[0], "_n", "_at")
        return out.withColumn("position_ids", position_ids(F.col(main), mode, F.col("_at"))).drop("_n", "_at")
    return out.withColumn("position_ids", position_ids(F.col(main), mode)) if main and mode != "none" else out


class RecordStore:
    """Columns of lists, by record or as one stream per key.

    ``record_idx`` numbers the records from 0. A lazy store (``processor``) has raw records: it gives records only.
    """

    def __init__(self, rows: DataFrame | None = None, processor: Callable[[DataFrame], DataFrame] | None = None):
        self.rows, self.processor, self._length = rows, processor, {}

    def _loaded(self) -> DataFrame:
        if self.rows is None:
            raise RuntimeError("no store is loaded")
        return self.rows

    @property
    def keys(self) -> list[str]:
        rows = self._loaded()
        shown = self.processor(rows.limit(0)) if self.processor else rows
        return [f.name for f in shown.schema.fields if f.dataType.typeName() == "array"]

    @property
    def num_records(self) -> int:
        return self._loaded().count()

    def _key(self, key: str) -> str:
        if key not in self.keys:
            raise KeyError(f"missing {key!r}; there are {self.keys}")
        return key

    def length(self, key: str) -> int:
        """Ids of a key in the whole stream."""
        if self.processor:
            raise RuntimeError("a lazy store has no stream")
        if key not in self._length:
            self._length[key] = self._loaded().agg(F.sum(F.greatest(F.size(F.col(self._key(key))), F.lit(0)))).first()[0] or 0
        return self._length[key]

    def fetch_record(self, index: int, key: str | None = None):
        """One record; an index below 0 counts from the end, one outside is an IndexError."""
        n = self.num_records
        if not -n <= index < n:
            raise IndexError(f"record {index} of {n}")
        row = self._loaded().filter(F.col("record_idx") == index % n)
        row = (self.processor(row) if self.processor else row).first().asDict()
        return row if key is None else row[self._key(key)]

    def fetch(self, begin: int, end: int, key: str) -> list:
        """Stream positions [begin, end) of a key: only the records that they meet are read."""
        n = self.length(key)
        if not (0 <= begin < n and 0 <= end <= n):
            raise ValueError(f"[{begin}, {end}) is outside of [0, {n})")
        if end <= begin:
            return []
        rows = self._loaded().select("record_idx", F.col(key).alias("v")).withColumn("n", F.greatest(F.size("v"), F.lit(0)))
        placed = prefix_sum(rows, "record_idx", "n", "at").filter((F.col("at") < end) & (F.col("at") + F.col("n") > begin))
        lo = F.greatest(F.lit(begin) - F.col("at"), F.lit(0))
        hi = F.least(F.lit(end) - F.col("at"), F.col("n"))
        parts = placed.select("record_idx", F.slice("v", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("v")).orderBy("record_idx")
        return [x for r in parts.collect() for x in r["v"]]


@STORES.register("jsonl")
def jsonl_store(spark: SparkSession, path: str, schema: StructType | str, transform: BuildConfig | None = None, tokenizer=None, processor: Callable[[DataFrame], DataFrame] | None = None) -> RecordStore:
    """A store over JSON lines.

    Lazy with a ``processor``. Else eager, by the first of: ``transform``; the folder's ``dataset_config.json``; the
    config for conversations, if a tokenizer is given. None of them is a ValueError.
    """
    records, _ = read_lines(spark, path, schema)
    if processor is not None:
        return RecordStore(records, processor)
    if transform is None:
        files, fs = _files(spark, path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        config = spark._jvm.org.apache.hadoop.fs.Path(folder, CONFIG_NAME)
        if fs.exists(config):
            text = "\n".join(r.value for r in spark.read.text(str(config), wholetext=True).collect())
            transform = BuildConfig.from_dict(json.loads(text))
        elif tokenizer is not None:
            transform = CHAT_CONFIG.changed(position_ids_mode="doc_reset", domain_key=None)
        else:
            raise ValueError(f"{path} has no {CONFIG_NAME}; give a transform, a tokenizer or a processor")
    built = tokenize_records(records, transform, tokenizer or "codepoint")
    start = prefix_sum(built.withColumn("_one", F.lit(1)), "record_idx", "_one", "_i").drop("_one")
    return RecordStore(start.withColumn("record_idx", F.col("_i")).drop("_i"))


@STORES.register("parquet")
def parquet_store(spark: SparkSession, path: str, order: str = "record_idx") -> RecordStore:
    """A store over a table whose column ``order`` numbers the records in any way."""
    rows = prefix_sum(spark.read.parquet(path).withColumn("_one", F.lit(1)), order, "_one", "_i").drop("_one")
    return RecordStore(rows.withColumn("record_idx", F.col("_i")).drop("_i"))
