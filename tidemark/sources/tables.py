"""Sources: declared schemas, file readers, and adapters from the event and order tables to transactions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TX_COLUMNS = ("TransactionID", "TransactionDT", "TransactionAmt", "cents", "card_id", "isFraud", "label_available_at")
# Base feature columns of a transaction table.
NUMERIC = ("TransactionAmt", "dist1", "dist2", "card1", "card2", "card3", "card5", "addr1", "addr2", *(f"C{i}" for i in range(1, 15)), *(f"D{i}" for i in range(1, 16)))
CATEGORICAL = ("ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", *(f"M{i}" for i in range(1, 10)))
DAY = 86_400

TRANSACTION_CSV = "TransactionID bigint, isFraud int, TransactionDT bigint, " + ", ".join(f"{c} double" for c in NUMERIC) + ", " + ", ".join(f"{c} string" for c in CATEGORICAL if c != "DeviceType")
IDENTITY_CSV = "TransactionID bigint, DeviceType string"
EVENT_SCHEMA = "kind string, t double, card_id string, txid bigint, amt double, is_fraud int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, columns matched by name to a declared schema; columns that the file lacks are null."""
    names = spark.read.option("header", True).csv(path).columns
    from pyspark.sql import types as T

    declared = {f.name: f.dataType for f in T.StructType.fromDDL(schema).fields}
    there = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in names])
    df = spark.read.option("header", True).option("enforceSchema", False).schema(there).csv(path)
    for c, kind in declared.items():
        if isinstance(kind, T.DoubleType) and c in names:
            df = df.withColumn(c, F.nanvl(F.col(c), F.lit(None).cast("double")))
    return df.select(*(F.col(c) if c in names else F.lit(None).cast(k).alias(c) for c, k in declared.items()), *(c for c in names if c not in declared))


def read_periods(spark: SparkSession, path: str, periods: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Rows of the given periods in time order; the columns are pushed to the scan, and so is the period, which is a
    choice of folders where the table was written by it."""
    return spark.read.parquet(path).where(F.col("period").isin(*periods)).select(*columns).orderBy("TransactionDT", "TransactionID")


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    """A report of JSON records, one a line, or None if there is no such file."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.json(path)


def write_ordered(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet files that hold rows in time order: ranges of time over files, sorted within; a folder for each value of
    the columns ``by``, such as the period, so that a reader of one opens no file of another."""
    order = (*by, "TransactionDT", "TransactionID")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON records, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """One nested report as a line of JSON, see :func:`read_report`."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Transactions from the event table: errors are fraud, labels arrive 1 to 7 days later, others after 8."""
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    days = F.when(F.col("event_type") == "error", 1 + (F.col("event_id") * 7919) % 7).otherwise(8)
    return events.select(
        F.col("event_id").alias("TransactionID"),
        t.alias("TransactionDT"),
        F.col("value").alias("TransactionAmt"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.col("user_id").cast("string").alias("card_id"),
        (F.col("event_type") == "error").cast("int").alias("isFraud"),
        (t + days * DAY).cast("double").alias("label_available_at"),
    )


def transactions_from_orders(orders: DataFrame, *more: Column) -> DataFrame:
    """Transactions from the order table, with the columns ``more``: pending ones are fraud, with delays of 1 to 89 days, others 30."""
    t = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate)")
    days = F.when(F.col("o_orderstatus") == "P", 1 + (F.col("o_orderkey") * 7919) % 89).otherwise(30)
    return orders.select(
        F.col("o_orderkey").alias("TransactionID"),
        t.alias("TransactionDT"),
        F.col("o_totalprice").alias("TransactionAmt"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.col("o_custkey").cast("string").alias("card_id"),
        (F.col("o_orderstatus") == "P").cast("int").alias("isFraud"),
        (t + days * DAY).cast("double").alias("label_available_at"),
        *more,
    )


def card_id(parts: tuple[Column, ...], t: Column, days_since_first: Column) -> Column:
    """Account key: the parts and the day the card was first seen, joined by |, nulls as empty strings."""
    first_day = F.floor(t / F.lit(float(DAY)) - days_since_first).cast("int")
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in (*parts, first_day)))
