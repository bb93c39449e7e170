"""MinHash near-duplicates by tensored banding, links confirmed on full shingle sets.

A text is a set of word shingles. Two small collections of MinHash sub-keys (A and B, n of BAND minhashes each) are
combined pairwise: table (i, j) is keyed by A_i with B_j, so n * n tables cost 2 * n * BAND minhashes instead of
2 * n * n * BAND. A pair of similarity x shares no table with probability 2 * (1 - x**BAND)**n at most; n is the least
for which that is MISS or less at the threshold: 9 at 0.85, 12 at 0.8.

Equal sets collapse into one class first. Candidates are verified on full sets before anything is joined up, in two steps:
1. Every class meets the least class of each of its keys. The classes that meet one least class are its star; all that share a key are
   in one. A star is dealt into chunks of about BLOCK classes and the least one, and a chunk compares its sets exactly. Most stars are one
   chunk; a template with any number of near copies is settled here in linear work, as its copies are linked to the least of them.
2. Stars of several chunks whose classes are still in several components are left. Their classes are cut by size (linked sets
   differ by one size class at most) and dealt into blocks of about BLOCK classes, every pair of which is compared exactly.
So each pair that shares a key is compared or already connected: no link is lost to a hot key, chance agreements are never
chained into larger groups, and no task holds more than two blocks. Step 2 is quadratic in the classes of one star that are close in size but
not all linked.

Defined cases: null or empty texts and texts without words have empty sets, are linked with nothing and are kept;
rows with a null id take no part and are kept; rows that share an id are one document: its texts' groups become one group; exact
copies, and repeated rows, are one class; ties do not arise, as the least id names a group; texts of any length count in full;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import U, lean, mix, pieces, utf8
from .common import components, discard, table, written
from .shingles import shingle_sets

BAND, MISS, BLOCK = 3, 4e-4, 1024
#: Shingles of a block, at which it is cut smaller.
HELD = 1 << 21


def sub_keys(percent: int) -> int:
    """Sub-keys of a collection."""
    n = 1
    while 2 * (1 - (percent / 100) ** BAND) ** n > MISS:
        n += 1
    return n


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _signatures(size: int, sub: int):
    seeds = mix(np.arange(1, 2 * BAND * sub + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    odd = mix(seeds) | U(1)

    @lean
    def run(batches):
        for batch in batches:
            ids, marks, text = batch.column(0), batch.column(1), batch.column(2)
            for i, j, data, offs in pieces(text):
                sets, at = shingle_sets(data, offs, size)
                n = np.diff(at)
                has = np.flatnonzero(n)
                first = at[:-1][has]
                h = np.zeros((2, j - i), U)
                keys = np.zeros((2 * sub, j - i), U)
                if len(has):
                    h[0, has] = np.add.reduceat(sets, first)
                    h[1, has] = np.add.reduceat(mix(sets ^ U(0x5851F42D4C957F2D)), first)
                    for k in range(2 * sub):
                        key = np.zeros(len(has), U)
                        for b in range(k * BAND, (k + 1) * BAND):
                            low = np.minimum.reduceat((sets ^ seeds[b]) * odd[b], first)
                            key = mix(key + low + U(b))
                        keys[k, has] = key
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), marks.slice(i, j - i), pa.array(n.astype(np.int64)), _signed(h[0]), _signed(h[1]), *map(_signed, keys)],
                    ["doc_id", "mark", "n", "h1", "h2", *(f"k{k}" for k in range(2 * sub))],
                )

    return run


#: Shared elements that are multiplied at once, and rows that are compared at once.
WIDTH, STRIP = 1024, 256


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted arrays, from dense products over runs of shared elements. Sizes are below 2**24, which
    single precision holds exactly."""
    n = len(sets)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    dense = np.cumsum(count > 1) - 1
    col, owner = dense[col[shared]], owner[shared]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    out = np.zeros((n, n), np.float32)
    m = np.zeros((n, WIDTH), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, WIDTH):
        a, b = np.searchsorted(col, [lo, lo + WIDTH])
        m[:] = 0
        m[owner[a:b], col[a:b] - lo] = 1
        used = np.unique(owner[a:b])
        out[np.ix_(used, used)] += m[used] @ m[used].T
    return out


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least index that links of 100 * intersection >= percent * union lead to."""
    size = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    both = overlaps(sets)
    near = np.zeros((n, n), bool)
    for i in range(0, n, STRIP):
        x = both[i : i + STRIP].astype(np.int64)
        near[i : i + STRIP] = 100 * x >= percent * (size[i : i + STRIP, None] + size - x)
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        low = np.concatenate([np.where(near[i : i + STRIP], label, n).min(1) for i in range(0, n, STRIP)])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(size: int, percent: int):
    """Edges (a, b) of the links among the rows (fam, v, text) of each fam."""

    def run(rows: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        fams, ids = rows["fam"].to_numpy(), rows["v"].to_numpy()
        order = np.lexsort((ids, fams))
        cuts = np.flatnonzero(np.diff(fams[order])) + 1
        text = rows["text"].combine_chunks()
        for part in np.split(order, cuts):
            part = part[np.append(True, np.diff(ids[part]) != 0)]
            if len(part) > 1:
                sets, at = shingle_sets(*utf8(text.take(pa.array(part))), size)
                root = linked(np.split(sets, at[1:-1]), percent)
                moved = np.flatnonzero(root != np.arange(len(root)))
                a.append(ids[part[moved]])
                b.append(ids[part[root[moved]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _confirmed(fams: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among the classes of each fam: fams has (fam, v), texts (v, text)."""
    pools = max(1, fams.count() // (2 * BLOCK))
    rows = fams.join(texts, "v").select(F.pmod("fam", F.lit(pools)).alias("cell"), "fam", "v", "text")
    return written(rows.groupBy("cell").applyInArrow(_verify(shingle, percent), "a bigint, b bigint"))


def _blocks(count: str, total: str) -> str:
    """Blocks for count classes of total shingles."""
    return f"cast(greatest(ceil({count} / {BLOCK}), ceil({total} / {HELD})) AS int)"


def _links(classes: DataFrame, docs: DataFrame, sub: int, shingle: int, percent: int) -> DataFrame:
    """(v, root) of the classes that have links: connected components of all links between classes that share a key."""
    cells = [F.xxhash64(F.lit(i * sub + j), f"k{i}", f"k{sub + j}") for i in range(sub) for j in range(sub)]
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a class is small, but its keys are many
    tables = classes.repartition(tasks).select("v", "n", F.explode(F.array(*cells)).alias("key"))
    shared = tables.groupBy("key").agg(F.min("v").alias("first"), F.max("v").alias("most")).where("first < most").select("key", "first")
    live = written(tables.join(shared, "key").where("v <> first").select("first", "v", "n").distinct())
    seen = live.select("v").unionByName(live.select(F.col("first").alias("v"))).distinct()
    owners = classes.join(seen, "v").select("v", F.col("first_row.doc_id").alias("doc_id"), F.col("first_row.mark").alias("mark"))
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    texts = written(named.join(owners, ["doc_id", "mark"]).select("v", "text"))

    stars = live
    sizes = written(stars.groupBy("first").agg(F.expr(_blocks("count(*)", "sum(n)")).alias("nb")))
    leaves = stars.join(sizes, "first").select("first", F.expr("pmod(xxhash64(v), nb)").cast("int").alias("part"), "v")
    hubs = sizes.select("first", F.explode(F.expr("sequence(0, nb - 1)")).alias("part"), F.col("first").alias("v"))
    fams = written(leaves.unionByName(hubs).select(F.xxhash64("first", "part").alias("fam"), "v"))
    links = _confirmed(fams, texts, shingle, percent)
    roots = components(links)
    discard(fams)

    large = stars.join(sizes.where("nb > 1").select("first"), "first").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    found = written(large.select("first", "v", "n", "root"))
    open_ = found.groupBy("first").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("first")
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int") if percent < 100 else F.col("n").cast("int")
    cut = found.join(open_, "first").withColumn("bucket", bucket).withColumn("bucket", F.explode(F.expr("array(bucket, bucket - 1)")))
    cut = written(cut.select(F.xxhash64("first", "bucket").alias("grp"), "v", "n", "root"))
    groups = cut.groupBy("grp").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.expr(_blocks("count(*)", "sum(n)")).alias("nb")).where("a < b").select("grp", "nb")
    dealt = cut.join(groups, "grp").withColumn("own", F.expr("pmod(xxhash64(v), nb)").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    fams = written(dealt.select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("fam"), "v"))
    more = _confirmed(fams, texts, shingle, percent)
    out = roots if more.isEmpty() else components(links.unionByName(more))
    discard(stars, sizes, texts, found, cut, fams, links, more)
    return out


def _signed_rows(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of the rows, (h1, h2, n, v, first, root) of their classes); first is the least row of the class,
    root the class that names its component."""
    sub = sub_keys(percent)
    names = [f"k{i}" for i in range(2 * sub)]
    keys = ", ".join(f"{k} bigint" for k in names)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sig = written(rows.mapInArrow(_signatures(shingle, sub), f"doc_id bigint, mark bigint, n bigint, h1 bigint, h2 bigint, {keys}"))
    classes = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("first_row"), *(F.min(k).alias(k) for k in names))
    classes = written(classes.withColumn("v", F.monotonically_increasing_id()))
    roots = _links(classes, docs, sub, shingle, percent)
    done = written(classes.select("h1", "h2", "n", "v", "first_row").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v")))
    discard(classes, roots)
    return sig, done


def _bridged(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """classes with the roots of components that rows of one id connect as one root."""
    equal = F.struct("h1", "h2", "n")
    several = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(equal).alias("a"), F.max(equal).alias("b")).where("a <> b").select("doc_id")
    several = written(several)
    if several.isEmpty():
        return classes
    rows = sig.join(several, "doc_id").where("n > 0").join(classes.select("h1", "h2", "n", "root"), ["h1", "h2", "n"])
    ends = written(rows.select("doc_id", "root").distinct())
    least = ends.groupBy("doc_id").agg(F.min("root").alias("a"))
    tops = components(ends.join(least, "doc_id").where("root > a").select("a", F.col("root").alias("b")).distinct()).selectExpr("v AS root", "root AS top")
    return written(classes.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    sig, classes = _signed_rows(docs, shingle, percent)
    classes = _bridged(sig, classes)
    names = classes.groupBy("root").agg(F.min("first_row.doc_id").alias("component"))
    named = written(classes.join(names, "root").select("h1", "h2", "n", "component"))
    return (
        sig.select("doc_id", "n", "h1", "h2")
        .join(named, ["h1", "h2", "n"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.expr("CASE WHEN doc_id IS NOT NULL THEN coalesce(component, doc_id) END AS component_id"))
        .withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def without_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least id, of these the one with the least hash
    of the text. Rows count by their text here, so no text is lost to another one of the same id. Rows without words and rows with null ids stay."""
    sig, classes = _signed_rows(docs, shingle, percent)
    first = classes.groupBy("root").agg(F.min("first_row").alias("f")).select(F.col("f.doc_id").alias("_quadrel_id"), F.col("f.mark").alias("_quadrel_mark"))
    alone = sig.where("n = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_quadrel_id"), F.col("mark").alias("_quadrel_mark")).distinct()
    marked = docs.withColumn("_quadrel_mark", F.xxhash64("text"))
    on = lambda other: (marked["doc_id"] == other["_quadrel_id"]) & (marked["_quadrel_mark"] == other["_quadrel_mark"])
    plain = [f.name for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]
    one = Window.partitionBy("doc_id", "_quadrel_mark").orderBy(F.xxhash64(*(docs[c] for c in plain)))
    kept = marked.join(first, on(first), "left_semi").withColumn("_place", F.row_number().over(one)).where("_place = 1")
    empty = marked.join(alone, on(alone), "left_semi")
    out = kept.select(*docs.columns).unionByName(empty.select(*docs.columns))
    return out.unionByName(docs.where("doc_id IS NULL"))
