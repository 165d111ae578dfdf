"""Shards that all hold the sources in the table's own mixture: proportional stratified interleaving.

Rows are ranked in seeded shuffled order within their source. A row's fractional rank is its place in its source over
the source's total, so sorting by it interleaves all sources in proportion, and equal cuts of that order give shards
that match the mixture. Neither the ranks nor the order pass through one task: both are running totals over ranges of
the shuffle key and of the fractional rank, after totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, small

SHARDS = 40
SEED = "shard-1"
ROW_OVERHEAD = 16  # bytes of a row besides its text
LAWS = ("rows", "bytes")
ROWS_PER_RANGE = 10_000
MOST_RANGES = 65_536  # rows of the tables of range totals, which one task adds up
_COPIES_AT_ONCE = 65_536


def _identity(docs: DataFrame, keep: tuple[str, ...] = ()) -> list[Column]:
    """size, text_crc32 and row_hash: rows that agree in these, in doc_id and in source are copies of one row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [
        (F.octet_length(text) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.col("text").isNull(), *keep).alias("row_hash"),
    ]


def _unit(key: Column) -> Column:
    """The first 32 bits of a hexadecimal hash as a number from 0 to below 1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _range_of(share: Column, ranges: int) -> Column:
    return F.least(F.floor(share * ranges), F.lit(ranges - 1)).cast("int")


def _ranges(rows: int, least: int) -> int:
    return min(MOST_RANGES, max(least, -(-rows // ROWS_PER_RANGE)))


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, row_hash, copies, law, shard, slot), one row per row of ``docs`` (doc_id, text, source).

    ``law``: ``rows`` cuts the interleaved order into shards whose counts differ by one at most, ``bytes`` into shards
    of near equal size. Slots count from 0 in a shard's order. Up to any fraction, each source has its share within a row
    (within a document, for bytes), so a shard's mixture is off by no more than the roundings of all sources.

    Null texts have no bytes of their own; a null source is a source. Rows equal in doc_id, text, source and ``keep``
    are copies, each with a place of its own; they are counted before anything is ranked, so however many there are they
    meet in no task. Other columns play no part. With fewer rows than shards some shards stay empty; an empty table
    gives no rows. The order is a hash of id and text with ``seed``, so reruns agree.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {', '.join(LAWS)}, not {law}")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    scratch = Scratch(docs.sparkSession)
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    base = docs.select("doc_id", name.alias("name"), *_identity(docs, keep))
    content = ["doc_id", "name", "size", "text_crc32", "row_hash"]
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.md5(F.concat(F.lit(seed + ":"), id_text, F.lit(":"), F.col("text_crc32").cast("string")).cast("binary"))
    contents = scratch.save(base.groupBy(*content).agg(F.count("*").alias("copies")).withColumn("shuffle_key", key))
    kinds, rows, all_bytes = contents.agg(F.count("*"), F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()

    # Places within each source.
    step = F.lit(1) if law == "rows" else F.col("size")
    weight = F.col("copies") * step
    placed = contents.withColumn("range", _range_of(_unit(F.col("shuffle_key")), _ranges(kinds, 256)))
    totals = placed.groupBy("name", "range").agg(F.sum(weight).alias("weight"))
    earlier = W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "name", "range", F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("offset"), F.sum("weight").over(W.partitionBy("name")).alias("of_source")
    )
    order = ("shuffle_key", "doc_id", "size", "text_crc32", "row_hash")
    within = W.partitionBy("name", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.withColumn("before", F.coalesce(F.sum(weight).over(within), F.lit(0))).join(small(scratch.save(totals)), ["name", "range"])

    # One row per copy, with its fractional rank. Sources start at different fractions of a step, so that sources of a
    # single row do not all stand in the middle.
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(_COPIES_AT_ONCE).cast("bigint")))
    ranked = ranked.withColumn("first", first)
    until = F.least(F.col("first") + (_COPIES_AT_ONCE - 1), F.col("copies") - 1)
    ranked = ranked.withColumn("copy", F.explode(F.sequence("first", until)))
    start = F.col("before") + F.col("offset") + F.col("copy") * step
    fraction = (start.cast("double") + _unit(F.md5(F.concat(F.lit(seed + ":"), "name").cast("binary"))) * step) / F.col("of_source").cast("double")
    cells = _ranges(rows or 0, 1_024)
    spread = ranked.select("doc_id", "size", "text_crc32", "row_hash", "copies", "copy", "name", "shuffle_key", fraction.alias("fraction"))
    spread = scratch.save(spread.withColumn("cell", _range_of(F.col("fraction"), cells)))

    # Places in the order of all rows.
    cell_totals = spread.groupBy("cell").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    lower = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # MOST_RANGES rows at most
    offsets = cell_totals.select("cell", *(F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"{c}_before") for c in ("rows", "bytes")))
    inside = W.partitionBy("cell").orderBy("fraction", "name", *order, "copy")
    local_bytes = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumns({"place": F.row_number().over(inside) - 1, "bytes_here": local_bytes}).join(F.broadcast(offsets), "cell")
    placed = placed.withColumns({"place": F.col("place") + F.col("rows_before"), "at_byte": F.col("bytes_here") + F.col("bytes_before")})
    wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731  places times shards stay exact
    if law == "rows":
        middle, whole = wide(2 * F.col("place") + 1), rows or 1
    else:
        middle, whole = wide(2 * F.col("at_byte") + F.col("size")), all_bytes or 1
    placed = placed.withColumn("shard", _quotient(middle * shards, 2 * whole).cast("int"))
    if law == "rows":  # the first place of each shard, by the same law
        slot = F.col("place") - _quotient(wide(F.col("shard").cast("bigint")) * (2 * whole) + (shards - 1), 2 * shards)
    else:
        placed = scratch.save(placed)
        starts = placed.groupBy("shard").agg(F.min("place").alias("starts"))  # one row per shard
        placed, slot = placed.join(F.broadcast(starts), "shard"), F.col("place") - F.col("starts")
    return placed.select("doc_id", "size", "text_crc32", "row_hash", "copies", F.lit(law).alias("law"), "shard", slot.cast("bigint").alias("slot"))


def _quotient(a: Column, b: int) -> Column:
    """``a`` (a whole decimal) divided by ``b``, rounded down."""
    return F.call_function("div", a, F.lit(b).cast("decimal(38,0)"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "rows", seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Writes doc_id, text, source and ``keep`` as Parquet below ``path``, one folder a shard, rows in slot order; the
    manifest (shard, rows, bytes). ``keep`` may not be named shard or slot."""
    placed = Scratch(docs.sparkSession).save(shard_documents(docs, shards, law, seed, keep))
    out = ["doc_id", "text", "source", *keep]
    key = ["row_hash", "text_crc32", "size"]
    texts = docs.select(*out, *_identity(docs, keep))
    slots = placed.select(*key, "shard", "slot", F.col("copies") > 1)
    slots = slots.toDF(*key, "shard", "slot", "repeated")
    found = texts.join(slots.where(~F.col("repeated")), key)
    if not slots.where("repeated").isEmpty():  # one text of each row that repeats serves all its places
        again = slots.where("repeated")
        one = texts.join(again.select(*key).distinct(), key, "left_semi").dropDuplicates(key)
        found = found.unionByName(one.join(again, key))
    found.select(*out, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 is spelled out with its table, made by the rule of its polynomial.
OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS name, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc),
keyed AS (SELECT *, md5('shard-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || crc) AS k FROM base),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY k, doc_id NULLS FIRST, size, crc) - 1 AS r, count(*) OVER (PARTITION BY name) AS n FROM keyed),
spread AS (
  SELECT *, (CAST(r AS DOUBLE) + CAST('0x' || substr(md5('shard-1:' || name), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) / CAST(n AS DOUBLE) AS f FROM ranked),
placed AS (
  SELECT *, row_number() OVER (ORDER BY f, name, k, doc_id NULLS FIRST, size, crc) - 1 AS p, count(*) OVER () AS total FROM spread),
cut AS (SELECT *, CAST((2 * p + 1) * 40 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, shard, p - min(p) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
