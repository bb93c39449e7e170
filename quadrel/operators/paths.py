"""Closures and breadth-first walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.state import settled, unique, without


def transitive(edges: DataFrame) -> DataFrame:
    """(s, o): pairs joined by one or more edges. Pairs new in a round are extended by all pairs known, so the length of the paths
    doubles in every round; cycles end it."""
    total = delta = settled(unique(edges.select("s", "o")))
    while True:
        longer = delta.join(total.select(F.col("s").alias("o"), F.col("o").alias("far")), "o").select("s", F.col("far").alias("o"))
        delta = settled(without(longer, total))
        if delta.isEmpty():
            return total
        total = total.unionByName(delta)


def reach(starts: DataFrame, edges: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """(s, o): what starts (s) reach in low to high edges (None: any number), walking from them only."""
    base = edges.select(F.col("s").alias("o"), F.col("o").alias("far")).distinct()
    front = settled(starts.select("s", F.col("s").alias("o")).distinct())
    found = front if low == 0 else None
    step = 0
    while high is None or step < high:
        step += 1
        front = front.join(base, "o").select("s", F.col("far").alias("o")).distinct()
        if high is None and found is not None:  # what has been found is not walked from again
            front = front.join(found, ["s", "o"], "left_anti")
        front = settled(front)
        if front.isEmpty():
            break
        if step >= low:
            found = front if found is None else found.unionByName(front)
    return found.distinct() if found is not None else front.select("s", "o")


def bounded(edges: DataFrame, low: int, high: int) -> DataFrame:
    """(s, o): pairs joined by low to high edges (low >= 1), each once."""
    base = edges.select("s", "o").distinct()
    hop, out = base, None
    for n in range(1, high + 1):
        if n > 1:
            hop = hop.join(base.select(F.col("s").alias("o"), F.col("o").alias("far")), "o").select("s", F.col("far").alias("o")).distinct()
        if n >= low:
            out = hop if out is None else out.unionByName(hop)
    return out.distinct()


def crawl(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first walk from roots (node, depth: how many levels below may be opened) along edges (parent, child).

    (node, level, left): every node once, at its least level with the depth left there; a node is never opened again
    from a later level, even with more depth left. It ends with the largest depth."""
    seen = settled(roots.groupBy("node").agg(F.max("depth").alias("left")).withColumn("level", F.lit(0)))
    front, level = seen, 0
    while True:
        level += 1
        step = front.where("left > 0").join(edges, F.col("node") == F.col("parent")).groupBy(F.col("child").alias("node")).agg(F.max(F.col("left") - 1).alias("left"))
        front = settled(step.join(seen.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            return seen.select("node", "level", "left")
        seen = seen.unionByName(front)
