"""Intermediate results of loops, kept in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes, by Spark's estimate, of a part of a table that is dealt out; the most parts, as the rows of more are kept in memory before they are written.
PART, MOST_PARTS = 1 << 19, 200


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a table in spark.checkpoint.dir. Only a local session may leave that unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quadrel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    back = spark.read.schema(df.schema).parquet(path)
    back._quadrel_table = path
    return back


def parts(df: DataFrame) -> int:
    """Parts for a table that is dealt out: so many that a part doesn't grow with the table until there are MOST_PARTS; those of any shuffle if
    Spark doesn't know the size, as of rows from the driver."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_PARTS, 1 + size // PART if size < 1 << 60 else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, for rows that are much work each, whatever the files they come from."""
    return df.repartition(min(MOST_PARTS, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def unique(df: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """The distinct rows of df, which is made of like (for a join, Spark estimates a product). They are dealt out first, so
    no task has a table of all that it reads, which few tasks may do."""
    return df.repartition(parts(df) if like is None else min(MOST_PARTS, 4 * parts(like)), *df.columns).distinct()


def without(df: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct rows of df that known doesn't have, by one grouping of both: Spark would move an anti join below the dealing out, to
    partitions that grow with the rows. Columns are the same."""
    n = min(MOST_PARTS, 4 * parts(known))
    both = df.withColumn("_known", F.lit(0)).unionByName(known.select(df.columns).withColumn("_known", F.lit(1)))
    return both.repartition(n, *df.columns).groupBy(*df.columns).agg(F.max("_known").alias("_known")).where("_known = 0").drop("_known")


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._quadrel_table)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
