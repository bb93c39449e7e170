"""Frequency profiles: counters, shares, running coverage, top rows per key, keyword groups, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frequencies(df: DataFrame, key: str, article: str | None = None) -> DataFrame:
    """(key, n) by n descending, ties by key; with article each counts once per article."""
    n = F.count_distinct(article) if article else F.count("*")
    return df.groupBy(key).agg(n.alias("n"))


def shares(counts: DataFrame, key: str) -> DataFrame:
    """counts (key, n) plus rank, share and running share. The windows run over the distinct keys, which are counted already."""
    order = Window.orderBy(F.desc("n"), key)
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("rank", F.row_number().over(order)).withColumn("share", F.col("n") / total).withColumn("running", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total)


def top_per_key(df: DataFrame, key: str, value: str, k: int = 5) -> DataFrame:
    """(key, value, n, rank): the k most frequent values of each key, ties by value."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_examples(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.where(F.trim(value) != "").groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(value, order).alias("example"))


def keyword_groups(df: DataFrame, text: str, keywords: list[str]) -> DataFrame:
    """(keyword, text) for texts that equal a keyword or start with it and a blank, case counting."""
    c = F.col(text)
    found = F.array_compact(F.array(*(F.when((c == k) | F.startswith(c, F.lit(k + " ")), F.lit(k)) for k in keywords)))
    return df.select(F.explode(found).alias("keyword"), text)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, the same each time: those with the least digest of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
