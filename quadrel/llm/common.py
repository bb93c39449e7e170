"""Shared helpers: table access, written intermediate tables, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only where a local session names none (tests) one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quadrel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path_of(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df below the shared folder and read it back. Deleted by discard(), at the latest when the JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, files = _path_of(spark, path)
    files.deleteOnExit(hadoop)
    back = spark.read.schema(df.schema).parquet(path)
    back._quadrel_table = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        hadoop, files = _path_of(t.sparkSession, t._quadrel_table)
        files.delete(hadoop, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: rows (v, root), root being the least vertex reachable.

    Min-label propagation with pointer jumping; every round is a join and a partially aggregated
    minimum, its result a written table; it ends when no label moves. Vertices without an edge do not appear.
    """
    both = written(
        edges.select(F.col(a).alias("s"), F.col(b).alias("d"))
        .unionByName(edges.select(F.col(b).alias("s"), F.col(a).alias("d")))
        .where("s <> d")
        .distinct()
    )
    labels = written(both.groupBy(F.col("s").alias("v")).agg(F.min("d").alias("m")).selectExpr("v", "least(v, m) AS root"))
    while True:
        heard = (
            both.join(labels.withColumnRenamed("v", "s"), "s")
            .groupBy(F.col("d").alias("v"))
            .agg(F.min("root").alias("m"))
        )
        lower = labels.join(heard, "v").select("v", F.col("root").alias("old"), F.least("root", "m").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("root").alias("far"))
        new = written(
            lower.join(jump, "low", "left").select("v", "old", F.least("low", F.coalesce("far", "low")).alias("root"))
        )
        discard(labels)
        labels = new.select("v", "root")
        labels._quadrel_table = new._quadrel_table
        if new.where("root <> old").isEmpty():
            discard(both)
            return labels
