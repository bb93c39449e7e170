"""Language ID by error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1; a binary logistic classifier over n-gram counts of the whole text predicts
each bit. Decoding is loss-weighted: the language whose codeword has the least sum of log(1 + exp(-bit * margin)) wins.
The score is its share in the softmax of the negated losses; ambiguous marks scores under CLEAR. Up to EXHAUSTIVE
languages every split of them is a bit; more get random words of 10 * log2 bits from a fixed seed.

The classifiers are fitted on a sample in strata: of each of the k languages the SAMPLE / k documents (LEAST at least) with the
least hash of id and text, so a rare language is learned too; texts over LEARNED bytes are not learned from. The sample is bounded
by max(SAMPLE, k * LEAST) rows of counts, whatever the lengths and repetitions of rows are.
Defined cases: null texts and texts without a letter are 'und' with score 0; rows with a null id or lang are never
learned from; without any such row everything is 'und'; texts of any length are counted whole, a piece of ROWS rows at a time; of
languages at equal loss the first by code point wins; repeated rows count once in learning and are predicted alike; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import U, lean, mix, pieces
from .common import table
from .letters import folded, has_letter

SAMPLE, LEAST, LEARNED, DIMS, CLEAR, EXHAUSTIVE = 3000, 50, 1 << 20, 4096, 0.75, 6
#: Rows whose counts are held at once, and parts in which the rows of a language are ranked first.
ROWS, PARTS = 256, 64
_MASK = U(DIMS - 1)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= EXHAUSTIVE:
        bits = [[1 if c == 0 or not split >> (c - 1) & 1 else -1 for c in range(k)] for split in range(1, 1 << max(k - 1, 0))]
        return np.array(bits, np.int8).T.reshape(k, -1) if bits else np.ones((k, 1), np.int8)
    rng, length = np.random.default_rng(7), ceil(10 * log2(k))
    best, far = None, -1
    for _ in range(50):
        m = rng.choice(np.array([-1, 1], np.int8), (k, length)).astype(np.int64)
        apart = (length - m @ m.T) // 2 + length * np.eye(k, dtype=np.int64)
        if apart.min() > far and (np.abs(m.sum(0)) < k).all():
            best, far = m, apart.min()
    return best


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Normalised log counts of hashed 1- to 3-grams of bytes, one row per text."""
    rows = len(offs) - 1
    out = np.zeros((rows, DIMS), np.float32)
    low = folded(data).astype(U)
    low[(low < U(97)) | ((low > U(122)) & (low < U(128)))] = U(32)
    keys = [mix(low + U(1)) & _MASK]
    if len(low) > 1:
        two = low[:-1] << U(8) | low[1:]
        keys.append(mix(two + U(1 << 20)) & _MASK)
    if len(low) > 2:
        keys.append(mix((two[:-1] << U(8) | low[2:]) + U(1 << 40)) & _MASK)
    keys = [k.astype(np.int32) for k in keys]
    for r in range(rows):
        a, b = offs[r], offs[r + 1]
        for order, k in enumerate(keys):
            if b - a > order:
                out[r] += np.bincount(k[a : b - order], minlength=DIMS)
    np.log1p(out, out)
    out /= np.sqrt(np.maximum((out * out).sum(1, keepdims=True), 1e-9))
    return out


def fit(x: np.ndarray, m: np.ndarray, y: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Weights (DIMS + 1, bits) of ridge logistic classifiers of the codeword bits m[y], by Adam on all rows."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    bits = m[y].astype(np.float32)
    w = np.zeros((x.shape[1], bits.shape[1]), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        slope = -bits / (1 + np.exp(np.clip(bits * (x @ w), -30, 30)))
        g = x.T @ slope / len(x) + 1e-5 * w
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w -= 0.5 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    return w


def decode(margins: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class, score) of each row of margins."""
    loss = np.logaddexp(0, -margins[:, None, :] * m[None]).sum(2)
    share = np.exp(loss.min(1, keepdims=True) - loss)
    return loss.argmin(1), share.max(1) / share.sum(1)


@lean
def _counted(batches):
    for batch in batches:
        for i, j, data, offs in pieces(batch.column("text"), rows=ROWS):
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), pa.array([r.tobytes() for r in grams(data, offs).astype(np.float16)], pa.binary())], ["lang", "x"])


def _predicted(langs, m, w):
    @lean
    def run(batches):
        for batch in batches:
            for i, j, data, offs in pieces(batch.column("text"), rows=ROWS):
                part = batch.slice(i, j - i)
                ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
                has = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
                for r in np.flatnonzero(~has):
                    has[r] = has_letter(part.column("text")[int(r)].as_py())
                who, score = decode(grams(data, offs).astype(np.float64) @ w[:-1] + w[-1], m) if langs else (None, None)
                name = ["und" if not h or not langs else langs[who[r]] for r, h in enumerate(has)]
                score = np.where(has, score, 0.0) if langs else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(name, pa.string()), pa.array(score), pa.array(has & (score < CLEAR))],
                    ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    return run


def sampled(docs: DataFrame, kind: str, sample: int, least: int, most_bytes: int) -> DataFrame:
    """(doc_id, mark, kind, text) of a sample of docs (doc_id, kind, text) in strata: of each value of kind the documents with the
    least hash, each once; rows without id or kind and texts over most_bytes take no part."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(kind).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).where(f"doc_id IS NOT NULL AND kind IS NOT NULL AND octet_length(text) <= {most_bytes}")
    keys = rows.select("doc_id", "mark", "kind").distinct()
    kinds = max(1, keys.select("kind").distinct().count())
    most = max(least, sample // kinds)
    order = F.xxhash64("doc_id", "mark"), "doc_id", "mark"
    chosen = keys.withColumn("part", F.pmod(F.xxhash64("mark", "doc_id"), F.lit(PARTS)))
    for by in (["kind", "part"], ["kind"]):  # a value that most rows have is ranked in parts first
        chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
    chosen = chosen.select("doc_id", "mark", "kind")
    # bounded by max(sample, kinds * least) rows, so it may be broadcast
    return rows.join(F.broadcast(chosen), ["doc_id", "mark", "kind"]).dropDuplicates(["doc_id", "mark", "kind"])


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row of docs; rows held out are never learned from."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learn = sampled(docs.where("NOT held_out"), "lang", sample, LEAST, LEARNED).select(F.col("kind").alias("lang"), "text")
    rows = sorted(map(tuple, learn.mapInArrow(_counted, "lang string, x binary").collect()))
    langs = sorted({r[0] for r in rows}, key=lambda s: s.encode())
    m = w = None
    if langs:
        x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
        m = codewords(len(langs))
        w = fit(x, m, np.array([langs.index(r[0]) for r in rows])).astype(np.float64)
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predicted(langs, m, w), "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
