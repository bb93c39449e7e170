"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.llm import bpe, minhash, mixing, quality, repeats
from quadrel.llm.common import table, written
from quadrel.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity of 0.8 or more)."""
    ship(spark)
    return minhash.without_copies(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 200-byte string that also starts elsewhere go; n_chars follows the text."""
    ship(spark)
    cut = repeats.remove_repeats(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"])
    return cut.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    ship(spark)
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of every text that the earlier stages left."""
    ship(spark)
    return bpe.encode(docs, ["doc_id"]).select("doc_id", "n_tokens", "ids")


STAGES = [("quality", good), ("near_dedup", distinct), ("repeats", without_repeats), ("mixing", mixed), ("bpe", tokens)]

#: No stage but the last could be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
