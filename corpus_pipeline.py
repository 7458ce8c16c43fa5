"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longwatch.llm.common import read, shared_dir
from longwatch.llm.mixing import mix, word_count
from longwatch.llm.neartext import keep_one
from longwatch.llm.pieces import encode_documents
from longwatch.llm.quality import THRESHOLD, quality_scores
from longwatch.llm.suffix import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored = quality_scores(docs.select(COLUMNS), read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.where(F.col("score") >= THRESHOLD).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id."""
    return keep_one(docs.select(COLUMNS)).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document of a lesser doc_id has; characters cut in two go whole."""
    left = remove_repeats(docs.select(COLUMNS), characters=True).withColumn("text", F.col("kept").cast("string"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = docs.select(COLUMNS).withColumn("_size", word_count(F.col("text")))
    taken = mix(docs.select(F.col("doc_id").alias("id"), "source", F.col("_size").alias("size"))).where("repeats > 0")
    taken = taken.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_words"), "repeats")
    same = docs.doc_id.eqNullSafe(taken._id) & docs.source.eqNullSafe(taken._source) & (docs._size == taken._words)
    rows = docs.join(taken.hint("shuffle_hash"), same)
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document under seeded merge-dropout, and whether they decode to its text."""
    return encode_documents(docs.select("doc_id", "lang", "source", "text"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL can express neither the classifier nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again.

    Null texts are empty, null ids come first, repeated rows are documents of
    their own until one of a group of near copies stays, extra columns are
    dropped; without documents there are no rows. Stage folders stay, as the
    last one's rows are read from its own.
    """
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
