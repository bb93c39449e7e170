"""Entity linking: blocked pair features, weighted scores, one-to-one assignment, evaluation, validation."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.functions.terms import fold_name
from quadrel.operators.state import discard, settled

#: The weights of the measures.
WEIGHTS = {"name": 0.6, "type": 0.2, "homepage": 0.25, "geo": 0.1, "year": 0.05}
KEPT, THRESHOLD, SURE_NAME, HOMEPAGE_FLOOR = 0.3, 0.75, 0.95, 0.9
EARTH_DIAMETER_KM = 12742.0
#: Pairs that the driver assigns itself.
LOCAL = 100_000
#: Pairs of a tile of a block, and the most tiles that are dealt out apart; rows of equal values that go together.
TILE, MOST_TILES, CHUNK = 1_000_000, 4096, 1024
#: Pairs of different values of a block that one task assigns.
IN_A_TASK = 2_000_000


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp; the order of the arguments counts. Pairs repeat within a batch, so they are remembered."""
    known: dict[tuple[str, str], float] = {}
    out = []
    for x, y in zip(a, b, strict=True):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x, y).ratio()
        out.append(known[x, y])
    return pd.Series(out, dtype="float64")


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.filter(F.array_distinct(F.split(c, " +")), lambda t: t != "") for c in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """0 if one is empty, 1 if equal but for blanks, else the greater of the sequence ratio and the Jaccard index of the tokens."""
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    return F.when((a == "") | (b == ""), 0.0).when(bare(a) == bare(b), 1.0).otherwise(F.greatest(_ratio(a, b), token_jaccard(a, b)))


def name_key(name: Column, generic: list[str], glossary: list[tuple[str, str]] = ()) -> Column:
    """The folded name without generic words, after ordered replacements of whole words (outputs may match again)."""
    key = fold_name(name)
    for a, b in glossary:
        key = F.regexp_replace(key, rf"\b{a}\b", b)
    if generic:
        key = F.regexp_replace(key, r"\b(?:" + "|".join(generic) + r")\b", " ")
    return F.trim(F.regexp_replace(key, " +", " "))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = F.radians
    h = F.pow(F.sin((rad(lat2) - rad(lat1)) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin((rad(lon2) - rad(lon1)) / 2), 2)
    return EARTH_DIAMETER_KM * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def geo_similarity(km: Column, full: Column) -> Column:
    """1 up to full, falling linearly to 0 at ten times that."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (km - full) / (9 * full)))


def year_similarity(a: Column, b: Column) -> Column:
    """1 up to a year apart, a half up to three, else 0."""
    d = F.abs(a - b)
    return F.when(d <= 1, 1.0).when(d <= 3, 0.5).when(d > 3, 0.0)


def year_of(text: Column) -> Column:
    return F.regexp_extract(text, r"\b(1\d{3}|20\d{2})\b", 1).try_cast("int")


def domain(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.regexp_replace(host, r"^www\d?\.", "")


def weighted(measures: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the measures that are not null; a shared homepage lifts it to HOMEPAGE_FLOOR."""
    total = reduce(Column.__add__, [F.coalesce(weights[k] * c, F.lit(0.0)) for k, c in measures.items()])
    norm = reduce(Column.__add__, [F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in measures.items()])
    score = F.try_divide(total, norm)
    return F.when(measures["homepage"] >= 1, F.greatest(score, F.lit(HOMEPAGE_FLOOR))).otherwise(score) if "homepage" in measures else score


def confident(name: Column, others: list[Column]) -> Column:
    """A name of at least SURE_NAME and one other measure of 1."""
    return (name >= SURE_NAME) & reduce(Column.__or__, [F.coalesce(c == 1.0, F.lit(False)) for c in others])


def _chunks(df: DataFrame, values: list[str], name: str) -> DataFrame:
    """block, values, _chunk and name: the other columns of at most CHUNK rows of equal values."""
    keys = [c for c in df.columns if c not in ("block", *values)]
    place = F.row_number().over(Window.partitionBy("block", *values).orderBy(*keys)) - 1
    rows = df.where("block IS NOT NULL").withColumn("_chunk", F.floor(place / CHUNK))
    return rows.groupBy("block", *values, "_chunk").agg(F.collect_list(F.struct(*keys)).alias(name))


def block_pairs(ours: DataFrame, theirs: DataFrame, mine: list[str], other: list[str], measures: dict[str, Column]) -> DataFrame:
    """All pairs within a block: the keys of ours (block, keys, mine) and theirs (block, keys, other) with measures of the columns mine and other.

    A measure is taken once for each two different values; rows of equal values go along in chunks and are told apart behind it. A block
    is cut on both sides into tiles of about TILE pairs, so no task has a block's pairs, and a row is sent once a tile, not once a pair."""
    n, m = (df.groupBy("block").agg(F.count("*").cast("double").alias(k)) for df, k in ((ours, "_n"), (theirs, "_m")))
    tiles = F.greatest(F.ceil(F.col("_n") * F.col("_m") / TILE), F.lit(1))
    rows = F.least(F.greatest(F.ceil(F.sqrt(tiles * F.col("_n") / F.col("_m"))), F.lit(1)), tiles)
    sizes = settled(n.join(m, "block").select("block", (F.col("_n") * F.col("_m")).alias("_pairs"), rows.cast("int").alias("_a"), F.ceil(tiles / rows).cast("int").alias("_b")))
    parts = int(min(MOST_TILES, 1 + (sizes.agg(F.sum("_pairs")).first()[0] or 0) // TILE))
    cut = F.broadcast(sizes.where("_a > 1 OR _b > 1").select("block", "_a", "_b"))  # blocks of more than a tile: fewer than tiles

    def dealt(df: DataFrame, values: list[str], name: str, own: str, across: str) -> DataFrame:
        df = _chunks(df, values, name).join(cut, "block", "left").na.fill(1, ["_a", "_b"])
        df = df.withColumn(f"_at{own}", F.pmod(F.xxhash64(*values, "_chunk"), F.col(own))).withColumn(f"_at{across}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(across).cast("bigint") - 1)))
        return df.select("block", "_at_a", "_at_b", *values, name).repartition(parts, "block", "_at_a", "_at_b")

    met = dealt(ours, mine, "_x", "_a", "_b").hint("merge").join(dealt(theirs, other, "_y", "_b", "_a"), ["block", "_at_a", "_at_b"])
    met = met.select("_x", "_y", *(c.alias(k) for k, c in measures.items()))
    return met.select(F.explode("_x").alias("_x"), "_y", *measures).select("_x", F.explode("_y").alias("_y"), *measures).select("_x.*", "_y.*", *measures)


def assign(pairs: DataFrame, keep: float = KEPT, local: int = LOCAL) -> DataFrame:
    """Greedy one-to-one pairs of (s, u, score): score descending, then s, then u.

    Round by round, the pairs that are best for both ends are taken and the pairs of their ends dropped; this gives what
    taking pairs one by one in that order gives. Aggregates only, so a node with many pairs is combined before the shuffle. Once at most
    local pairs are left (a bounded table, however long its chains) the driver takes them one by one."""
    left = settled(pairs.select("s", "u", "score").where(F.col("score") >= keep).groupBy("s", "u").agg(F.max("score").alias("score")))
    out = left.limit(0)
    while left.count() > local:
        rank = F.struct((-F.col("score")).alias("n"), "s", "u")
        by_s = left.groupBy("s").agg(F.min(rank).alias("a"))
        by_u = left.groupBy("u").agg(F.min(rank).alias("b"))
        both = by_s.select("s", F.col("a.u").alias("u"), "a").join(by_u, "u").where((F.col("a.s") == F.col("b.s")) & (F.col("a.u") == F.col("b.u")))
        taken = settled(both.select("s", "u", (-F.col("a.n")).alias("score")))
        out = out.unionByName(taken)
        rest = settled(left.join(taken.select("s"), "s", "left_anti").join(taken.select("u"), "u", "left_anti"))
        discard(left)
        left = rest
    used_s, used_u, last = set(), set(), []
    for s, u, score in sorted(map(tuple, left.collect()), key=lambda r: (-r[2], r[0], r[1])):
        if s not in used_s and u not in used_u:
            used_s.add(s)
            used_u.add(u)
            last.append((s, u, score))
    return out.unionByName(out.sparkSession.createDataFrame(last, left.schema))


def _in_order(pairs: pd.DataFrame, ours: dict, theirs: dict) -> Iterator[tuple]:
    """(s, u, score) as taken one by one, score descending, then s, then u; pairs (a, b, score) are of classes, ours and theirs the ids of each in
    order. Of a class the least free id is always taken first, so a place in it says which are left."""
    at_a, at_b = dict.fromkeys(ours, 0), dict.fromkeys(theirs, 0)
    score = pairs["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    a, b, score = pairs["a"].to_numpy()[order], pairs["b"].to_numpy()[order], score[order]
    edges = np.flatnonzero(np.r_[True, score[1:] != score[:-1], True]) if len(score) else []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        partners: dict = {}
        for x, y in zip(a[low:high], b[low:high], strict=True):
            if at_a[x] < len(ours[x]) and at_b[y] < len(theirs[y]):
                partners.setdefault(x, []).append(y)
        heap = [(ours[x][at_a[x]], x) for x in partners]
        heapify(heap)
        while heap:
            s, x = heappop(heap)
            partners[x] = [y for y in partners[x] if at_b[y] < len(theirs[y])]
            if partners[x]:
                y = min(partners[x], key=lambda y: theirs[y][at_b[y]])
                yield s, theirs[y][at_b[y]], score[low]
                at_a[x] += 1
                at_b[y] += 1
                if at_a[x] < len(ours[x]):
                    heappush(heap, (ours[x][at_a[x]], x))


def assign_blocks(ours: DataFrame, theirs: DataFrame, mine: list[str], other: list[str], score: Column, keep: float = KEPT) -> DataFrame:
    """assign() of all pairs within a block, ours (block, s, mine) and theirs (block, u, other), score being of the columns mine and other.

    Where every s and every u is in one row, blocks are apart, and rows of equal values are a class: a task takes a block from the pairs of
    its classes, and pairs of rows are never made. Blocks of more than IN_A_TASK pairs of classes, and all where ids repeat, go by assign()."""
    apart = all(r["n"] == r["d"] for r in (df.where("block IS NOT NULL").agg(F.count("*").alias("n"), F.count_distinct(k).alias("d")).first() for df, k in ((ours, "s"), (theirs, "u"))))
    if not apart:
        return assign(block_pairs(ours, theirs, mine, other, {"score": score}), keep)
    a = ours.where("block IS NOT NULL").groupBy("block", *mine).agg(F.array_sort(F.collect_list("s")).alias("ids"))
    b = theirs.where("block IS NOT NULL").groupBy("block", *other).agg(F.array_sort(F.collect_list("u")).alias("ids"))
    a, b = settled(a), settled(b)
    sizes = a.groupBy("block").agg(F.count("*").alias("n")).join(b.groupBy("block").agg(F.count("*").alias("m")), "block")
    large = settled(sizes.where(F.col("n") * F.col("m") > IN_A_TASK).select("block"))
    head = lambda df, values, name: df.join(F.broadcast(large), "block", "left_anti").select("block", F.col("block").alias("of"), *values, F.get("ids", F.lit(0)).alias(name))
    pairs = block_pairs(head(a, mine, "a"), head(b, other, "b").drop("of"), mine, other, {"score": score}).where(F.col("score") >= keep)
    ids = {"s": ours.schema["s"].dataType, "u": theirs.schema["u"].dataType}
    none = {k: F.lit(None).cast(T.ArrayType(t)).alias(k) for k, t in ids.items()}
    members = a.select(F.col("block").alias("of"), F.col("ids").alias("s"), none["u"]).unionByName(b.select(F.col("block").alias("of"), none["s"], F.col("ids").alias("u")))
    schema = T.StructType([*(T.StructField(k, t) for k, t in ids.items()), T.StructField("score", T.DoubleType())])

    def block(pairs: pa.Table, members: pa.Table) -> pa.Table:
        known = {k: {x[0]: x for x in members[k].to_pylist() if x} for k in ("s", "u")}
        rows = list(_in_order(pairs.select(["a", "b", "score"]).to_pandas(), known["s"], known["u"]))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pairs.schema.field("a").type, pairs.schema.field("b").type, pa.float64()))], names=["s", "u", "score"])

    out = pairs.groupBy("of").cogroup(members.join(F.broadcast(large.select(F.col("block").alias("of"))), "of", "left_anti").groupBy("of")).applyInArrow(block, schema)
    if large.isEmpty():
        return out
    some = lambda df: df.join(F.broadcast(large), "block", "left_semi")
    return out.unionByName(assign(block_pairs(some(ours), some(theirs), mine, other, {"score": score}), keep))


def lookup(titles: DataFrame, names: DataFrame, prefix: str, known: DataFrame) -> DataFrame:
    """(s, o): IRIs from a name table (s, name) for subjects that are known."""
    return names.join(known.select("s").distinct(), "s", "left_semi").select("s", F.concat(F.lit(prefix), F.replace(F.trim("name"), F.lit(" "), F.lit("_"))).alias("o"))


def identifiers(names: DataFrame, prefix: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (s, o), missing (s)): IRIs from identifiers (s, name) that are Q and digits, for known subjects; known subjects without one."""
    found = lookup(known, names.where(F.trim("name").rlike(r"^Q\d+$")), prefix, known)
    return found, known.select("s").distinct().join(found, "s", "left_anti")


def type_table(links: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """cls, types, n: linked pairs (s, o) by our class and the sorted types of the other end."""
    kinds = theirs.groupBy(F.col("s").alias("o")).agg(F.array_join(F.array_sort(F.collect_set("c")), ", ").alias("types"))
    both = links.join(ours.select("s", F.col("c").alias("cls")), "s").join(kinds, "o", "left")
    return both.groupBy("cls", F.coalesce("types", F.lit("")).alias("types")).agg(F.count("*").alias("n")).orderBy("cls", F.desc("n"), "types")


def validated(links: DataFrame, seen: DataFrame, redirects: DataFrame) -> DataFrame:
    """links (s, o) plus status (exists, redirect, missing) and target, the redirect's end if there is one."""
    df = links.join(redirects.select(F.col("source").alias("o"), F.col("target").alias("_to")), "o", "left")
    df = df.join(seen.select(F.col("iri").alias("o")).distinct().withColumn("_seen", F.lit(True)), "o", "left")
    status = F.when(F.col("_to").isNotNull(), "redirect").when(F.col("_seen"), "exists").otherwise("missing")
    return df.select("s", "o", status.alias("status"), F.coalesce("_to", "o").alias("target"))


def type_conflicts(links: DataFrame, ours: DataFrame, theirs: DataFrame, disjoint: DataFrame) -> DataFrame:
    """links (s, o) whose ends have disjoint types, either way round."""
    both = disjoint.unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b")))
    a = links.join(ours.select("s", F.col("c").alias("a")), "s").join(both, "a")
    return a.join(theirs.select(F.col("s").alias("o"), F.col("c").alias("b")), ["o", "b"]).select("s", "o").distinct()


def final_links(gold: DataFrame, new: DataFrame) -> DataFrame:
    """gold (s, u) and those of new whose subject and target are not linked yet."""
    return gold.unionByName(new.join(gold.select("s"), "s", "left_anti").join(gold.select("u"), "u", "left_anti").select("s", "u"))


def evaluate(best: DataFrame, gold: DataFrame, thresholds: list[float], by: str | None = None) -> DataFrame:
    """threshold, judged, correct, gold, new, precision, recall, f1 of best (s, u, score) against gold (s, g), per threshold and value of by.

    Judged are predictions for subjects with gold. One pass: every pair is compared with all thresholds in one aggregate."""
    keys = [by] if by else []
    left = best.select("s", "u", "score", *([] if not by or by not in best.columns else [by]))
    df = gold.select("s", "g", *keys).join(left.drop(*keys), "s", "full")
    at = F.explode(F.array(*map(F.lit, thresholds)))
    df = df.withColumn("threshold", at)
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    has = F.col("g").isNotNull()
    out = df.groupBy("threshold", *keys).agg(
        F.count_if(hit & has).alias("judged"), F.count_if(hit & (F.col("u") == F.col("g"))).alias("correct"), F.count_if(has).alias("gold"), F.count_if(hit & ~has).alias("new")
    )
    p, r = (F.coalesce(F.try_divide("correct", x), F.lit(0.0)) for x in ("judged", "gold"))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95% interval of a share; (0, 0) without observations."""
    p, zz = F.try_divide(k, n), z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return tuple(F.when(n > 0, x).otherwise(0.0) for x in (F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))))


def contributions(scored: DataFrame, measures: list[str]) -> DataFrame:
    """Per measure of scored (true pairs): present and perfect."""
    cols = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in measures]
    return scored.select(F.explode(F.array(*cols)).alias("x")).groupBy("x.measure").agg(F.count("x.v").alias("present"), F.count_if(F.col("x.v") == 1.0).alias("perfect"))
