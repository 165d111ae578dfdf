"""Shared pieces of the training-data operators: reading, folds, words, scratch tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal id, modulo ``n`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def words(text: Column) -> Column:
    """Array of words of a text; null or blank text: empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, WORD_SPLIT)
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where it is unset, as in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_dir
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _local_dir


_local_dir: str | None = None


class Scratch:
    """Intermediate Parquet tables in the shared folder: they cut lineage and survive the loss of executors.

    Tables not dropped earlier go when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop_all)

    def save(self, df: DataFrame, **options) -> DataFrame:
        """``df`` written with the writer's ``options`` and read again."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._scratch_path)

    def drop_all(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the JVM may be gone when the interpreter ends
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Marks ``df`` for broadcast if its counted rows are within the bound, else leaves the join to a shuffle."""
    return F.broadcast(df) if df.count() <= max_rows else df


MOST_HOT = 40_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table`` (unique, not null ``key``; ``rows_of_key``: how many of the ``total`` rows have it).

    Keys with more than total / MOST_HOT rows, MOST_HOT of them at most, are joined by broadcast, so a key with a large
    share of all rows does not meet in one task; the others are joined by a shuffle. ``how``: inner or left.
    """
    most = max(500, total // MOST_HOT)
    hot = F.broadcast(table.where(F.col("rows_of_key") > most))
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("rows_of_key") <= most), key, how)
    return rows.join(hot, key).unionByName(rest).drop("rows_of_key")


def bounded_sample(df: DataFrame, key: Column, bound: int, seed: str) -> DataFrame:
    """About ``bound`` rows at most in expectation, chosen by a hash of ``key``; all rows when there are no more than that."""
    total = df.count()
    if total <= bound:
        return df
    slots = 1 << 40
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(slots)) < int(slots * (bound / total)))


ROWS_AT_ONCE = 256
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of about ``BATCH_BYTES`` at most, so that long texts do not pile up to 10,000 rows in
    the memory of the JVM and of Python. A smaller bound that the session has set stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(conf.get(key)).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, keep: tuple[str, ...], inputs: tuple[str, ...], make, out: str) -> DataFrame:
    """``keep`` columns unchanged and the columns ``out`` (DDL), computed from ``inputs`` in Arrow batches.

    ``make()`` runs once per task and returns a function of lists (one per input) to lists (one per output).
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = df.select(*keep).schema.fields
    schema = T.StructType([*kept, *T.StructType.fromDDL(out).fields])
    names, n = [f.name for f in schema.fields], len(kept)
    arrow = to_arrow_schema(schema)
    sent = [*keep, *(c for c in inputs if c not in keep)]  # a column that is both goes once
    source = df.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(sent)))
    taken = [sent.index(c) for c in inputs]

    def run(batches):
        f = make()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                made = f(*(part.column(i).to_pylist() for i in taken))
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                columns += [pa.array(x, arrow.field(n + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(source, run, schema)
