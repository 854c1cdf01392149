"""Shared helpers: table access, the shared folder, spreading of skewed input."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = os.environ.get("TOKENMILL_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, small: int = 256 << 20) -> DataFrame:
    """A small table in fewer files than there are cores, dealt to all of them; larger ones as they are.

    A file with one row group is one task however many cores wait; from some hundred
    megabytes on there are splits enough, and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= small:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where the session names none (tests, one machine) a temporary folder
    of this machine is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        folder = current or tempfile.mkdtemp(prefix="tokenmill-")
        if not current:
            spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The lineage ends at files that outlive the executors which wrote them. They
    are removed when the driver's session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    remove_at_end(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """The path as Hadoop has it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_end(spark: SparkSession, path: str) -> None:
    at, fs = hadoop(spark, path)
    fs.mkdirs(at.getParent())
    _ENDS.setdefault(id(spark._jvm), _Ends(spark)).paths.append((at, fs))


class _Ends:
    """Folders to remove when this process ends or stops its session, while the JVM still answers."""

    def __init__(self, spark: SparkSession):
        self.paths: list = []
        atexit.register(self.clear)

    def clear(self) -> None:
        while self.paths:
            at, fs = self.paths.pop()
            with contextlib.suppress(Exception):
                fs.delete(at, True)


_ENDS: dict[int, _Ends] = {}


def first_delivery(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key; a row delivered twice has the same content, so any will do."""
    return df.select(key, *columns).dropDuplicates([key])


def prompt_of(df: DataFrame):
    return F.coalesce(df["prompt"], df["legacy_input"])
