"""The corpus pipeline: its stages, in order, each over the whole of what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import language_id, mixing, ngram_join, sentencepiece_bpe, toxicity
from tidemark.llm.common import SPACES, Scratch, read, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A predicted language with a lower score counts as unknown.
LEAST_CONFIDENCE = 0.5
#: Rows (of a few numbers) up to which a table of decisions is sent to every executor; beyond, joins shuffle.
MOST_BROADCAST = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of the training part, does not reject.

    Null texts count as empty, long ones are scored whole; repeated rows share a score and stay or go together; rows
    without an id are scored too. An empty table, or no toxic label, rejects nothing.
    """
    model = toxicity.train_toxicity_model(toxicity.training_part(docs), toxicity.training_part(read(spark, sf_dir, "labels")))
    return toxicity.score_toxicity(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows and is sure of; null texts and those without letters go.

    Long texts are judged whole, repeated rows stay or go together. Without a learned language nothing is rejected.
    """
    model = language_id.train_language_model(language_id.training_part(docs))
    if not model.languages:
        return docs.select(*COLUMNS)
    judged = language_id.identify_language(docs, model, COLUMNS)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CONFIDENCE)).select(*COLUMNS)


def _one_row(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One of the rows that agree in ``key``: the least by its other columns."""
    order = W.partitionBy(*key).orderBy("lang", "source", "n_chars", "doc_id")
    return rows.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that of the smallest id, of rows with that id the one of least
    hash of its text, and one row of it where it is repeated.

    Documents without an id or without words are in no group and stay, repeated or not. An empty table stays empty.
    """
    scratch = Scratch(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    groups = scratch.save(ngram_join.ngram_components(rows, carry=("_hash",)).where("component is not null"))
    first = groups.groupBy("component").agg(F.min(F.struct("doc_id", "_hash")).alias("first")).select("component", "first.*")
    copies = groups.groupBy("component", "doc_id", "_hash").agg(F.count("*").alias("_rows"))
    kept = scratch.save(first.join(copies, ["component", "doc_id", "_hash"]).select("doc_id", "_hash", "_rows"))
    alone = rows.where(_in_no_group())
    named = rows.join(small(kept, MOST_BROADCAST), ["doc_id", "_hash"])
    out = named.where("_rows = 1").select(*COLUMNS).unionByName(alone.select(*COLUMNS))
    if kept.where("_rows > 1").count():  # only repeated rows are dealt out
        out = out.unionByName(_one_row(named.where("_rows > 1"), ("doc_id", "_hash")).select(*COLUMNS))
    return out


def _in_no_group() -> Column:
    return F.col("doc_id").isNull() | (F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))) == 0)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as many times as it takes them.

    Null and blank texts are not taken. Rows equal in id, text and source are taken as often together as the mix takes
    each of them, as copies of one of them. An empty table stays empty.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_hash"))
    taken = mixing.mix_sources(rows, carry=("_hash", "source")).where("repeats > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_id"), F.col("_hash").alias("_of"), F.col("source").alias("_from")).agg(F.sum("repeats").cast("int").alias("_repeats"), F.count("*").alias("_rows"))
    taken = Scratch(spark).save(taken)
    same = rows["doc_id"].eqNullSafe(taken["_id"]) & (F.col("_hash") == F.col("_of")) & rows["source"].eqNullSafe(taken["_from"])
    found = rows.join(small(taken, MOST_BROADCAST), same).drop("_id", "_of", "_from")
    times = lambda df: df.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_repeats")).alias("_pass")).select(*COLUMNS)
    out = times(found.where("_rows = 1"))
    if taken.where("_rows > 1").count():  # only repeated rows are dealt out
        out = out.unionByName(times(_one_row(found.where("_rows > 1"), ("doc_id", "_hash", "source"))))
    return out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row kept, with the digest of the text that they decode to; null texts encode as empty ones."""
    import public_tokenizers

    keep = ("doc_id", "lang", "source")
    encoded = sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep)
    return encoded.select(
        *keep, "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_join", one_of_each_group),
    ("mixing", mix_to_weights),
    ("sentencepiece", encode),
]

#: SQL can express neither the trained stages nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
    return docs
