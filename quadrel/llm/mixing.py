"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources by code point (null last) weigh 3, 1, 2, repeating, and share 150% of all words. A source stops at
CAP times its size and its excess is reshared by weight: target = min(CAP * size, level * weight) for the one level at
which the targets add up. A document of a source is taken target / size times; the whole part is certain, the rest is a
copy probability p.

Pivotal rounding: two documents exchange expected words (one's p rises by t / size, the other's falls by t / size, with
odds that keep both expectations) until one p is 0 or 1. The words taken from a bucket of documents then differ from their
expectation by less than one document, the bucket's residual. Residuals meet in a reduction tree, FAN buckets of a source
at a time, until a single one per source is drawn. Buckets hold about BUCKET documents, so a source of any share is
split. Rows that are equal (id, text and source; in repeated() all columns) are counted first and rounded together, so any number of them
is one row of a bucket; their copies are shared out evenly. Seeds come from the source, bucket and level, and rows are ordered by hash:
reruns agree. Ranks and targets come from aggregates over sources, of which none is brought to one task.

Defined cases: null and blank texts have size 0 and are never taken; a null source is a source of its own, and sources that differ in anything are
apart; sources without words get target 0; repeated rows are separate documents; rows that share an id are told apart by text and source;
texts of any length count in full; ties in size or level do not matter; other columns are ignored by mix() and kept by repeated(), whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

CAP, SHARE, WEIGHTS = 2, 1.5, (3, 1, 2)
BUCKET, FAN = 2048, 64
WORDS = r"[^\x20\x09-\x0D]+"
_COLUMNS = "doc_id bigint, mark bigint, n bigint, source string, bucket bigint, size bigint, whole bigint, p double, copies bigint"


def _placed(sums: DataFrame) -> DataFrame:
    """sums with place, the rank of the source by code point (null last) from 0. Sources are dealt out by ranges; only the
    number of rows of each range goes to the driver."""
    order = F.col("source").asc_nulls_last()
    ranged = sums.repartitionByRange(order).sortWithinPartitions(order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("part")).count().collect()))
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    offsets = ranged.sparkSession.createDataFrame(before, "part bigint, before bigint")
    # one row a partition, so it may be broadcast
    return ranged.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + within).drop("part", "before", "at")


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, n_docs, source_size, target. sized has a row for each document: source, size."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    plan = written(_placed(sums).withColumn("w", weight).withColumn("cap", CAP * F.col("source_size")))
    total = SHARE * (plan.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # sources that fill up give their excess to the others, which may fill up then
        over = F.col("cap") <= F.col("w") * F.lit(level)
        row = plan.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("w")))).first()
        if row[0] == full or not row[2]:
            break
        full, level = row[0], (total - row[1]) / row[2]
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)) if row[2] else F.col("cap").cast("double")
    return plan.select("source", "n_docs", "source_size", target.alias("target"))


def pivot(sizes: list[int], p: list[float], rng: np.random.Generator) -> tuple[list[int | None], float]:
    """(0 or 1 of each document, or None for the residual; the residual's p)."""
    out: list[int | None] = [None] * len(sizes)
    held, q = -1, 0.0
    draws = rng.random(len(sizes)).tolist()
    for i, (s, r) in enumerate(zip(sizes, p, strict=True)):
        if held < 0:
            held, q = i, r
            continue
        t = sizes[held]
        up, down = min((1 - q) * t, r * s), min(q * t, (1 - r) * s)
        move = up if draws[i] * (up + down) < down else -down
        q, r = q + move / t, r - move / s
        if q < 1e-9 or q > 1 - 1e-9:
            out[held] = int(q > 0.5)
            held, q = (-1, 0.0) if r < 1e-9 or r > 1 - 1e-9 else (i, r)
            if held < 0:
                out[i] = int(r > 0.5)
        else:
            out[i] = int(r > 0.5)
    return out, q


def _round(level: int, last: bool):
    def run(key, rows):
        rows = rows.sort_by([("mark", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        seed = hashlib.sha256(repr((level, key[0].as_py(), key[1].as_py())).encode()).digest()
        rng = np.random.default_rng(int.from_bytes(seed[:8], "little"))
        p, size, whole = rows["p"].to_pylist(), rows["size"].to_pylist(), rows["whole"].to_pylist()
        open_ = [i for i, (x, s) in enumerate(zip(p, size, strict=True)) if s > 0 and 1e-9 < x < 1 - 1e-9]
        done, q = pivot([size[i] for i in open_], [p[i] for i in open_], rng)
        copies: list[int | None] = [w + int(x > 0.5) for w, x in zip(whole, p, strict=True)]
        for i, d in zip(open_, done, strict=True):
            copies[i] = whole[i] + d if d is not None else whole[i] + int(rng.random() < q) if last else None
            if d is None:
                p[i] = q
        names = rows.schema.names
        rows = rows.set_column(names.index("p"), "p", pa.array(p, pa.float64()))
        rows = rows.set_column(names.index("copies"), "copies", pa.array(copies, pa.int64()))
        return rows.set_column(names.index("bucket"), "bucket", pa.array([b // FAN for b in rows["bucket"].to_pylist()], pa.int64()))

    return run


def _decided(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, mark, n, size, source_size, target, copies: equal rows of docs (by columns and text) are one row here, n their number and
    copies what the mix takes of all of them."""
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(*(docs[c] for c in columns)).alias("mark"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint").alias("size"),
    )
    sized = written(sized.groupBy("doc_id", "mark", "source", "size").agg(F.count("*").alias("n")))
    every = sized.select("source", (F.col("n") * F.col("size")).alias("size"))
    plan = written(targets(every).withColumn("buckets", F.expr(f"cast(ceil(n_docs / {BUCKET}) AS bigint)")))
    most = plan.agg(F.max("buckets")).first()[0] or 1
    same = sized["source"].eqNullSafe(plan["source"])
    rows = sized.join(plan, same).select(
        "doc_id", "mark", "n", sized["source"], F.expr("pmod(xxhash64(doc_id, mark), buckets)").alias("bucket"), "size",
        F.expr("CASE WHEN source_size > 0 THEN n * (target / source_size) ELSE 0D END").alias("times"),
    )
    rows = rows.selectExpr("doc_id", "mark", "n", "source", "bucket", "size", "cast(floor(times) AS bigint) AS whole", "times - floor(times) AS p", "cast(NULL AS bigint) AS copies")
    decided = None
    level = 0
    while True:
        last = most <= 1
        out = rows.groupBy("source", "bucket").applyInArrow(_round(level, last), _COLUMNS)
        out = out if last and not level else written(out)
        fixed = out.where("copies IS NOT NULL")
        decided = fixed if decided is None else decided.unionByName(fixed)
        if last:
            break
        rows, most, level = out.where("copies IS NULL"), -(-most // FAN), level + 1
    same = decided["source"].eqNullSafe(plan["source"])
    return decided.join(plan, same).select("doc_id", "mark", "n", "size", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of docs (doc_id, text, source)."""
    rows = _decided(docs, ["doc_id", "text", "source"]).withColumn("i", F.explode(F.expr("sequence(1L, n)")))
    share = F.expr("copies div n + CASE WHEN i <= copies % n THEN 1 ELSE 0 END")
    return rows.select("doc_id", "size", "source_size", "target", share.alias("copies"))


def repeated(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it; rows that are equal in all columns count together."""
    columns = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    times = written(_decided(docs, columns).where("copies > 0").selectExpr("doc_id AS quadrel_id", "mark AS quadrel_mark", "n AS quadrel_n", "cast(copies AS int) AS quadrel_times"))
    mark = F.xxhash64(*(docs[c] for c in columns))

    def taken(rows: DataFrame, some: DataFrame) -> DataFrame:
        found = rows.join(some, rows["doc_id"].eqNullSafe(some["quadrel_id"]) & (rows["quadrel_row"] == some["quadrel_mark"]))
        return found.withColumn("quadrel_copy", F.explode(F.expr("sequence(1, quadrel_times)"))).select(*(rows[c] for c in docs.columns))

    marked = docs.withColumn("quadrel_row", mark)
    out = taken(marked, times.where("quadrel_n = 1"))
    many = times.where("quadrel_n > 1")
    if many.isEmpty():
        return out
    equal = marked.join(many.select("quadrel_mark"), marked["quadrel_row"] == many["quadrel_mark"], "left_semi").dropDuplicates(["doc_id", "quadrel_row"])
    return out.unionByName(taken(equal, many))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "copies")
