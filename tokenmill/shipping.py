"""Makes the package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once per context.

    The archive goes to the shared folder of the cluster by Hadoop's file system, or,
    where the session names none, to a file of this machine that the driver serves.
    """
    context = spark.sparkContext
    if getattr(context, "_tokenmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".json"):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
    name = f"tokenmill-{context.applicationId}.zip"
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(held.getvalue()))
        out.close()
        context.addPyFile(path.toString())
    else:
        local = Path(tempfile.mkdtemp(prefix="tokenmill-"), name)
        local.write_bytes(held.getvalue())
        context.addPyFile(str(local))
    context._tokenmill_shipped = True
