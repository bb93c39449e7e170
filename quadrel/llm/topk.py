"""Exact top-k inner products over a bit-sliced index.

Components become integers, floor(SCALE * x). Rows are dealt out to shards by their number; a shard builds its index once: each dimension is
stored as bitmaps of its offset value's bits, one bit of a row per place, for BLOCK rows at a time. Queries are sent to the shards, not the
index to the queries: a shard's rows come first, then its queries one after another, so a task holds one index and a batch of queries. The
score of all rows of a block for one query is added up with bitmap arithmetic: a query component is a sum of signed powers of two with the
fewest terms; each takes the dimension's slices (or their complements) with that weight, and carry-save adders compress the slices
of a weight (three bitmaps become one of it and one of the next), until the score is there as slices. The top rows are then selected from
the most significant slice downward: rows with a 1 are sure while they are fewer than k, else only they stay; boundary rows that tie in every
slice are resolved by the smaller id. A shard sends k rows a query, reduced per query.

A shard is SHARD bytes of bitmaps, and smaller where there are fewer shards than PARALLEL; a query is sent once a shard. The work is that of every
query with every row, by the nature of an exact answer.

Defined cases: null and empty vectors, those with null, NaN or infinite components and those with components of 2**54 or more in size
take no part; vectors of other lengths than the query's are no candidates of it; rows with null ids take no part; repeated rows are separate
queries and candidates, except that no row with the query's own id is a candidate; ties go to the smaller id; scores beyond 63 bits are ranked as they
are and given as the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import lean
from .common import table

SCALE, BLOCK, SHARD, PARALLEL, LEAST = 256, 65_536, 1 << 26, 64, 8192
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Added to a score so that its digits sort as it does; more than the largest sum of products can be.
_WIDE = 1 << 164


def full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, carry) of three bitmaps, or of many side by side."""
    x = a ^ b
    return x ^ c, a & b | x & c


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray | None]:
    """The slices of the total of bitmaps, columns[w] being stacks (n, words) of those of weight 2**w."""
    out, w = [], 0
    columns = [list(c) for c in columns]
    while w < len(columns):
        stack = np.concatenate(columns[w]) if len(columns[w]) > 1 else columns[w][0] if columns[w] else None
        n = 0 if stack is None else len(stack)
        if n > 1 and w + 1 == len(columns):
            columns.append([])
        while n > 2:
            third = n // 3
            s, carry = full_add(stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third])
            columns[w + 1].append(carry)
            stack = np.concatenate([stack[3 * third :], s]) if n > 3 * third else s
            n = len(stack)
        if n == 2:
            columns[w + 1].append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        out.append(stack[0] if n else None)
        w += 1
    return out


def signed_digits(m: int) -> list[tuple[int, int]]:
    """(power, 1 or -1) of the fewest signed powers of two that add up to m."""
    out, j = [], 0
    while m:
        if m & 1:
            d = 2 - (m & 3)
            out.append((j, d))
            m -= d
        m >>= 1
        j += 1
    return out


class Index:
    """The bitmaps of a block of integer vectors, rows ordered by id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], v[order]
        self.n, self.dims = v.shape
        low = v.min(0)
        shifted = v.view(np.uint64) - low.view(np.uint64)
        self.low = low.tolist()
        self.bits = [int(x).bit_length() for x in shifted.max(0)]
        self.first = np.concatenate([[0], np.cumsum(self.bits)]).tolist()
        self.words = -(-self.n // 64)
        self.slices = np.zeros((self.first[-1], self.words), np.uint64)
        for d in range(self.dims):
            column = np.ascontiguousarray(shifted[:, d])
            for b in range(self.bits[d]):
                self.slices[self.first[d] + b] = self._bitmap((column >> np.uint64(b) & np.uint64(1)).astype(bool))
        self.all = self._bitmap(np.ones(self.n, bool))

    def _bitmap(self, x: np.ndarray) -> np.ndarray:
        raw = np.packbits(x, bitorder="little")
        out = np.zeros(self.words * 8, np.uint8)
        out[: len(raw)] = raw
        return out.view(np.uint64)

    def scores(self, q: list[int]) -> tuple[list[np.ndarray | None], int]:
        """(slices of score - base, base) of all rows."""
        plain: list[list[int]] = []
        turned: list[list[int]] = []
        base = 0
        for m, low, bits, first in zip(q, self.low, self.bits, self.first, strict=False):
            base += m * low
            for j, sign in signed_digits(m):
                while len(plain) < j + bits:
                    plain.append([])
                    turned.append([])
                into = plain if sign > 0 else turned
                for b in range(bits):
                    into[j + b].append(first + b)
                if sign < 0:  # -x = (top - x) - top
                    base -= (1 << j) * ((1 << bits) - 1)
        columns = []
        for up, down in zip(plain, turned, strict=True):
            columns.append(([self.slices[up]] if up else []) + ([self.all & ~self.slices[down]] if down else []))
        return add_slices(columns), base

    def top(self, q: list[int], k: int, own: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows but own: most by score, then least by id."""
        slices, base = self.scores(q)
        sure, open_ = np.zeros_like(self.all), self.all.copy()
        for i in range(*np.searchsorted(self.ids, [own, own + 1])):
            open_[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        have = 0
        for s in reversed(slices):
            if s is None:
                continue
            hit = open_ & s
            n = int(np.bitwise_count(hit).sum())
            if have + n > k:
                open_ = hit
            else:
                sure |= hit
                have += n
                open_ &= ~s
                if have == k:
                    break
        rows = self._rows(sure)
        if have < k:
            rows = np.concatenate([rows, self._rows(open_)[: k - have]])
        value = np.zeros(len(rows), object)
        for w, s in enumerate(slices):
            if s is not None:
                value += (s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(object) << w
        return sorted(((int(x) + base, int(i)) for x, i in zip(value, self.ids[rows], strict=True)), key=lambda r: (-r[0], r[1]))

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x), one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.astype(np.float64)).astype(np.int64).reshape(-1, dims)


def _searched(k: int, block: int):
    """Over rows in the order (dims, shard, asked): an index of the rows of a shard, then the answers to its queries."""

    @lean
    def run(batches):
        now: tuple | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        blocks: list[Index] = []

        def built(all_: bool) -> None:
            while held and (all_ or sum(len(i) for i, _ in held) >= block):
                ids, v = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
                held[:] = [(ids[block:], v[block:])] if len(ids) > block else []
                blocks.append(Index(ids[:block], v[:block]))

        for batch in batches:
            dims, shard, asked = (batch.column(c).to_numpy() for c in ("dims", "shard", "asked"))
            ids, rows, vectors = batch.column("vec_id").to_numpy(), batch.column("row").to_numpy(), batch.column("embedding")
            cut = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shard) != 0) | (np.diff(asked) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if now != (dims[a], shard[a]):
                    now, held, blocks = (dims[a], shard[a]), [], []
                v = _integers(vectors.slice(a, b - a), int(dims[a]))
                if not asked[a]:
                    held.append((ids[a:b], v))
                    built(False)
                    continue
                built(True)
                out: list[tuple[int, int, int, int, str]] = []
                for own, row, q in zip(ids[a:b].tolist(), rows[a:b].tolist(), v.tolist(), strict=True):
                    best = sorted((r for x in blocks for r in x.top(q, k, own)), key=lambda r: (-r[0], r[1]))[:k]
                    out += [(row, own, i, min(max(s, _LONG[0]), _LONG[1]), f"{s + _WIDE:042x}") for s, i in best]
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                arrays = [*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["row", "query_id", "vec_id", "score", "exact"])

    return run


def search(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) that the SQL condition queries selects, the
    k best other rows by the inner product of the integers floor(SCALE * x)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    as_it_is = "embedding" if kind in ("float", "double") else "cast(embedding as array<double>) AS embedding"
    usable = f"vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND x = x AND abs(x) < {1 << 54}D)"
    rows = vectors.selectExpr("cast(vec_id as bigint) AS vec_id", as_it_is).where(usable).withColumn("dims", F.size("embedding").cast("bigint"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    found = rows.agg(F.count("*").alias("n"), F.sum("dims").alias("cells")).first()
    n, cells = found["n"], found["cells"] or 0
    shards = max(-(-2 * cells // SHARD), min(PARALLEL, -(-n // LEAST)), 1)
    index = rows.select("dims", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("bigint").alias("shard"), F.lit(0).alias("asked"), "vec_id", "row", "embedding")
    asked = rows.where(queries).select("dims", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.lit(1).alias("asked"), "vec_id", "row", "embedding")
    dealt = index.unionByName(asked).repartition(2 * shards, "dims", "shard").sortWithinPartitions("dims", "shard", "asked", "row")
    best = dealt.mapInArrow(_searched(k, BLOCK), "row bigint, query_id bigint, vec_id bigint, score bigint, exact string")
    order = Window.partitionBy("row").orderBy(F.desc("exact"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
