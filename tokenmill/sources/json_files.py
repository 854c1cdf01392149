"""JSON scans and sinks, multiple-choice CSV, and input resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokenmill.functions.text import strip


def read_records(spark: SparkSession, path: str, schema: StructType | str, mode: str = "fail", recursive: bool = True) -> DataFrame:
    """Records of JSON files: lines of ``*.jsonl`` (and of files that a JSON sink wrote), whole ``*.json`` files with an array or an object.

    ``fail``: a malformed line ends the run; ``skip``: it is left out. Blank lines vanish. A folder is searched
    downwards unless ``recursive`` is off. ``*.json`` files whose text doesn't begin as an array are read as lines.
    """
    if mode not in ("fail", "skip"):
        raise ValueError(f"unknown mode {mode!r}")
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = lambda: spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json*")
    texts = reader().text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("sign"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    heads = texts.filter("sign <> ''").groupBy("file").agg(F.min_by("sign", "at").alias("sign"))
    arrays = [r.file for r in heads.filter("sign = '['").select("file").collect()]  # names of files, not records
    marked = StructType([*kind.fields]).add("_corrupt_record", "string")
    options = {"mode": "FAILFAST"} if mode == "fail" else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = reader().options(**options).schema(kind if mode == "fail" else marked).json(path)
    if arrays:
        lines = lines.filter(~F.col("_metadata.file_path").isin(arrays)) if mode == "skip" else _lines_but(spark, reader, path, arrays, kind)
        whole = spark.read.option("multiLine", True).options(**options).schema(kind if mode == "fail" else marked).json(arrays)
        lines = lines.unionByName(whole)
    return lines if mode == "fail" else lines.filter("_corrupt_record is null").drop("_corrupt_record")


def _lines_but(spark: SparkSession, reader, path: str, arrays: list[str], kind: StructType) -> DataFrame:
    """JSON lines of all files but ``arrays``, which a reader that fails on a malformed line must not open."""
    files = [r.f for r in reader().text(path).select(F.col("_metadata.file_path").alias("f")).distinct().collect() if r.f not in arrays]
    return spark.read.option("mode", "FAILFAST").schema(kind).json(files) if files else spark.createDataFrame([], kind)


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Whole JSON files: an object is a record, an array is many."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schema).json(path)


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice CSV without header: question, four choices, answer.

    Rows of fewer than six columns and header rows (first column ``question``) are left out; each choice loses its own
    prefix (``A)`` and so on); all are stripped.
    """
    names = ["question", "a", "b", "c", "d", "answer"]
    rows = spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_short").schema(", ".join(f"{n} string" for n in [*names, "_short"])).csv(path)
    rows = rows.filter(F.col("_short").isNull() | F.col("answer").isNotNull()).select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])
    rows = rows.filter(F.lower(strip(F.col("question"))) != "question")
    own = {n: F.when(F.startswith(strip(F.col(n)), F.lit(f"{n.upper()})")), strip(F.substring(strip(F.col(n)), 3, 1 << 30))).otherwise(strip(F.col(n))) for n in names[1:5]}
    return rows.withColumns(own | {n: strip(F.col(n)) for n in ("question", "answer")})


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A small result as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def generate(df: DataFrame, provider, prompt_col: str, response_col: str = "response") -> DataFrame:
    """``df`` with the answers of ``provider`` (a list of prompts to a list of answers), a batch at a time."""
    import pyarrow as pa

    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(prompt_col).alias("prompt"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(provider(b.column(1).to_pylist()), pa.string())], names=["row", "answer"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, answer string")
    return out.select("row.*", F.col("answer").alias(response_col))
