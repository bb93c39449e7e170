"""SimHash fingerprints, in DataFrame operations only.

The terms of a text are its pairs of neighbouring words (a lone word pairs with nothing). Each occurrence votes on the 64
bits of the pair's hash with weight 1, plus 1 for each word of more than three characters; a bit is set if more than half of
the weight is for it. Four 16-bit counters share a long, so a term costs sixteen additions; a text of more than CHUNK
terms is counted in chunks, in which no counter can overflow: a term weighs 3 at most, and the top counter has 15 bits, as the
sums of longs are signed and checked.

The next document by id is found without a global sort: ids are cut into ranges at ids of a bounded sample of rows (exact
64-bit values, so each is the id of some row), and the rows at a cut are also sent, as sentinels, to the range before it
(those with the first id to the last range). One shuffle by range serves the successor, the counting and the successor's
fingerprint. All cuts are one literal, so the plan has as many expressions for 8192 ranges as for two.

within_radius() finds all fingerprints within a Hamming radius: the 64 bits are cut into BLOCKS blocks, and for every
choice of BLOCKS - radius blocks there is a table keyed by them; two fingerprints within the radius agree in all the
blocks of at least one table. Candidates of a table are verified, and each pair is taken from the first table that has it.
The tables are joined by shuffles: Spark's estimate is of fingerprints before each has become a row of every table, so what it
would broadcast grows with the input, past any threshold.

Defined cases: null text is empty; an empty text has the fingerprint of the empty word; equal texts have equal
fingerprints; rows with null ids come first; rows of one id follow each other by the hash of the text; a lone row is its own
successor; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import isqrt
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CHUNK_BITS, LANES, MASK = 13, 16, 0x0001000100010001
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Rows of a range, and the most ranges.
RANGE_ROWS, MOST_RANGES = 256, 8192
#: Sampled rows of a range, about.
SAMPLED = 16
BLOCKS, RADIUS = 6, 3
#: Rows whose ids this divides are the queries of the search.
SEARCHED = 100


def _longs(xs: list[int]) -> Column:
    """An array of bigint, as a single literal: an expression for each of thousands takes a minute, and much of the driver's memory, to plan."""
    return F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")


def _range_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below doc_id: a search among every k-th cut, then among the k behind it."""
    if not cuts:
        return F.lit(0)
    k = isqrt(len(cuts)) + 1
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= doc_id))
    part = below(_longs(cuts[::k]))
    inner = below(F.slice(_longs(cuts), F.greatest(part - 1, F.lit(0)) * k + 1, F.lit(k)))
    return F.when(doc_id.isNull() | (part == 0), F.lit(0)).otherwise((part - 1) * k + inner)


def _cuts(docs: DataFrame, n_rows: int, ranges: int) -> list[int]:
    """Ids, in order, that cut docs into about so many ranges, of a sample of SAMPLED * ranges rows by hash of their place."""
    step = max(1, n_rows // (SAMPLED * ranges))
    some = docs.select("doc_id", F.monotonically_increasing_id().alias("at")).where(F.pmod(F.xxhash64("at"), F.lit(step)) == 0)
    ids = sorted(r.doc_id for r in some.select("doc_id").where("doc_id IS NOT NULL").collect())
    return sorted({ids[len(ids) * i // ranges] for i in range(1, ranges)}) if ids else []


def with_next(docs: DataFrame) -> DataFrame:
    """bucket, rn, sentinel, doc_id, text, next_text; rn orders the rows of a bucket."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    ranges = min(seen["n"] // RANGE_ROWS, MOST_RANGES)
    cuts = [c for c in _cuts(docs, seen["n"], ranges) if c > seen["low"] or seen["nulls"]] if ranges > 1 else []
    first = F.col("doc_id").isNull() if seen["nulls"] else F.col("doc_id") == F.lit(seen["low"])
    own = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("sentinel"))
    before = F.struct((F.col("own") - 1).alias("bucket"), F.lit(1).alias("sentinel"))
    at_end = F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("sentinel"))
    cut = F.get(_longs(cuts), F.col("own") - 1) == F.col("doc_id") if cuts else F.lit(False)
    places = F.filter(F.array(own, F.when(cut, before), F.when(first, at_end)), lambda x: x.isNotNull())
    rows = docs.withColumn("own", _range_of(F.col("doc_id"), cuts)).withColumn("place", F.explode(places)).select("place.*", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("sentinel", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.select("*", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("rn"))


def _votes(rows: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """keys, carried and fp, the fingerprint of the column text of each group of keys (one text)."""
    words = rows.select(*keys, *carried, F.split("text", SPACE).alias("words"))
    at = words.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0)))).alias("i"))
    a, b = F.get("words", F.col("i")), F.get("words", F.col("i") + 1)
    weight = 1 + (F.length(a) > 3).cast("bigint") + F.coalesce((F.length(b) > 3).cast("bigint"), F.lit(0))
    terms = at.select(*keys, *carried, F.shiftright("i", CHUNK_BITS).alias("chunk"), F.xxhash64(a, b).alias("h"), weight.alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(MASK)) * F.col("w")).alias(f"v{k}") for k in range(LANES)]
    counted = terms.groupBy(*keys, "chunk").agg(F.sum("w").alias("w"), *lanes, *(F.max(c).alias(c) for c in carried))
    bits = [F.sum(F.shiftrightunsigned(f"v{k % LANES}", 16 * (k // LANES)).bitwiseAND(F.lit(0xFFFF))).alias(f"b{k}") for k in range(64)]
    summed = counted.groupBy(*keys).agg(F.sum("w").alias("w"), *bits, *(F.max(c).alias(c) for c in carried))
    # sixteen bits an expression: one of all 64 would be too long for compiled code
    quarter = [
        reduce(add, (F.when(2 * F.col(f"b{k}") > F.col("w"), F.lit(1 << (k - low)).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for k in range(low, low + 16)))
        for low in range(0, 64, 16)
    ]
    parts = summed.select(*keys, *carried, *(q.alias(f"q{i}") for i, q in enumerate(quarter)))
    fp = reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(f"q{i}", 16 * i) for i in range(4)))
    return parts.select(*keys, *carried, fp.alias("fp"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (bigint) of the text of every row of docs."""
    rows = docs.select(F.monotonically_increasing_id().alias("rn"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _votes(rows, ["rn"], ["doc_id"]).select("doc_id", "fp")


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near of every row of docs.

    n_near: for ids divisible by SEARCHED, how many other fingerprints of docs are within RADIUS; else null."""
    rows = with_next(docs).withColumn("n", F.length("text").cast("bigint"))
    cut = F.expr("cast(n div 4 AS int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(F.col("sentinel") == 0, edited))
    sha = F.sha2("edited", 256)
    parts = [F.expr(f"cast(conv(substring(sha, {1 + 8 * i}, 8), 16, 10) AS bigint)").alias(f"s{i}") for i in range(8)]
    rows = rows.withColumn("sha", sha).select("bucket", "rn", "sentinel", "doc_id", "n", *parts, F.array("text", "edited").alias("texts"))
    both = rows.select("*", F.posexplode("texts").alias("variant", "text")).where("text IS NOT NULL").drop("texts")
    carried = ["sentinel", "doc_id", "n", *(f"s{i}" for i in range(8))]
    fps = _votes(both, ["bucket", "rn", "variant"], carried)
    one = fps.groupBy("bucket", "rn").agg(
        *(F.max(c).alias(c) for c in carried), F.max(F.when(F.col("variant") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("variant") == 1, F.col("fp"))).alias("efp")
    )
    nxt = one.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn"))).where("sentinel = 0")
    sha = F.concat(*(F.lower(F.lpad(F.hex(f"s{i}"), 8, "0")) for i in range(8)))
    out = written(nxt.select(
        "doc_id", F.col("n").alias("n_chars"), sha.alias("edited_sha256"), hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "fp",
    ))
    searched = F.coalesce(F.col("doc_id") % SEARCHED == 0, F.lit(False))
    near = within_radius(out, out.where(searched)).groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n_near"))
    asked = out.where(searched).join(near, "fp", "left").na.fill(0, ["n_near"]).drop("fp")
    return asked.unionByName(out.where(~searched).drop("fp").withColumn("n_near", F.lit(None).cast("bigint")))


def _masks(blocks: int, radius: int) -> list[int]:
    ends = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(block, blocks - radius)]


def within_radius(fps: DataFrame, queries: DataFrame | None = None, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b, distance): pairs of distinct fingerprints (column fp) at most radius bits apart, a < b.

    With queries (column fp), a is a query and b any other fingerprint. Equal fingerprints are one value here."""
    masks = _masks(blocks, radius)

    def dealt(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks))
        return df.select("fp").where("fp IS NOT NULL").distinct().select(F.col("fp").alias(name), F.posexplode(keys).alias("t", "key"))

    a, b = dealt(queries if queries is not None else fps, "a"), dealt(fps, "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m).cast("bigint")) == 0, F.lit(i)) for i, m in enumerate(masks)), F.lit(-1))
    near = (F.col("a") != F.col("b") if queries is not None else F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius)
    pairs = a.hint("merge").join(b, (a["t"] == b["t"]) & (a["key"] == b["key"]) & near & (first == a["t"]))
    return pairs.select("a", "b", F.bit_count(differ).alias("distance"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))
