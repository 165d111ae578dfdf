"""Working folders shared by the driver and all executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; below a temporary folder only where that is unset, as in local tests.
    It is removed when the driver's Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    path = f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass

    atexit.register(remove)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again, for rows that are scanned many times."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what :func:`saved` wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df._saved_at)


#: Rows up to which a table of results is sent to every executor.
MOST_BROADCAST = 50_000
