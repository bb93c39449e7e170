"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

A logistic model over hashed n-grams of the whole text gives each document the probability of label 1: log counts of runs of one
to three bytes and of words, both normalised, and the spectrum of how often words recur. It is fitted on at most SAMPLE labelled
documents, the ones with the least hash of id and text; texts over LEARNED bytes are not learned from. Every document counts
towards its site: the mean of a host (source) is shrunk towards the global mean, that of a path (source and lang) towards its host, each
with a prior strength estimated by moments from the spread of all sites, so sparse sites stay near their prior. The score shifts the
document's log odds by what its path differs from the global mean; documents under CUT are rejected.

Defined cases: null text is empty; null source or lang is a site of its own; rows with null ids are scored and never
sampled; repeated rows count as often as they occur for their sites and once in learning; of several labels of an id the largest counts;
texts of any length are counted whole, a piece of ROWS rows at a time; ties do not arise; without labels of both kinds all evidence is
neutral and all rows are kept; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import U, lean, lowered, mix, pieces, words, Rolling
from .common import table, written

SAMPLE, LEARNED = 4000, 1 << 20
CUT = 0.5
#: Hashed places of byte runs, and as many of words; classes of recurrence; rows whose counts are held at once.
DIMS, SPECTRUM, ROWS = 2048, 8, 256
_MASK = U(DIMS - 1)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[48:58] = 48


def spectrum(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Shares of the words of each row: equal to the word before; the first, second, third or fourth, ... occurrence of
    their kind by powers of two; and the log of their number."""
    out = np.zeros((rows, SPECTRUM))
    count = np.bincount(row, minlength=rows)
    if len(h):
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
        first = np.flatnonzero(new)
        place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h)))) + 1
        kind = np.minimum(np.log2(place).astype(np.int64), SPECTRUM - 3)
        out[:, 0] = np.bincount(row, same, minlength=rows)
        out[:, 1:-1] = np.bincount(row[order] * (SPECTRUM - 2) + kind, minlength=rows * (SPECTRUM - 2)).reshape(rows, -1)
        out[:, :-1] /= np.maximum(count, 1)[:, None]
    out[:, -1] = np.log1p(count) / 8
    return out


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Normalised log counts of hashed byte runs and of hashed words, and the spectrum, of each row of a piece."""
    rows = len(offs) - 1
    out = np.zeros((rows, 2 * DIMS + SPECTRUM), np.float32)
    plain = _PLAIN[data].astype(U)
    keys = [mix(plain + U(1)) & _MASK]
    if len(plain) > 1:
        two = plain[:-1] << U(8) | plain[1:]
        keys.append(mix(two + U(1 << 20)) & _MASK)
    if len(plain) > 2:
        keys.append(mix((two[:-1] << U(8) | plain[2:]) + U(1 << 40)) & _MASK)
    keys = [k.astype(np.int32) for k in keys]
    s, e, row = words(data, offs)
    h = Rolling(lowered(data)).of(s, e) if len(s) else np.zeros(0, U)
    at, word = np.searchsorted(row, np.arange(rows + 1)), (h & _MASK).astype(np.int32)
    for r in range(rows):
        a, b = offs[r], offs[r + 1]
        for order, k in enumerate(keys):
            if b - a > order:
                out[r, :DIMS] += np.bincount(k[a : b - order], minlength=DIMS)
        out[r, DIMS : 2 * DIMS] = np.bincount(word[at[r] : at[r + 1]], minlength=DIMS)
    np.log1p(out, out)
    for part in (out[:, :DIMS], out[:, DIMS : 2 * DIMS]):
        part /= np.sqrt(np.maximum((part * part).sum(1, keepdims=True), 1e-9))
    out[:, 2 * DIMS :] = spectrum(h, row, rows)
    return out


@lean
def _counted(batches):
    for batch in batches:
        for i, j, data, offs in pieces(batch.column("text"), rows=ROWS):
            yield pa.RecordBatch.from_arrays([batch.column("quality").slice(i, j - i), pa.array([r.tobytes() for r in features(data, offs).astype(np.float16)], pa.binary())], ["quality", "x"])


def _judged(w: np.ndarray | None):
    @lean
    def run(batches):
        for batch in batches:
            for i, j, data, offs in pieces(batch.column("text"), rows=ROWS):
                part = batch.slice(i, j - i)
                p = np.full(j - i, 0.5) if w is None else 1 / (1 + np.exp(-np.clip(features(data, offs) @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "source", "lang", "mark")), pa.array(p.astype(np.float64))], ["doc_id", "source", "lang", "mark", "evidence"])

    return run


def learn(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights, the intercept last, of a ridge logistic model, by Adam on all rows."""
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        slope = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y) / len(x)
        g = np.append(x.T @ slope + 1e-5 * w[:-1], slope.sum()).astype(np.float32)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w -= 0.3 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic regression on few columns, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _posterior(sites: DataFrame, prior: str) -> DataFrame:
    """Add post, the mean of a site shrunk to prior; n, good and square are sums over its documents.

    The prior strength is within / between: the variance inside sites against that of site means beyond it. It is one
    number from one aggregated row.
    """
    row = sites.agg(
        F.expr("sum(square - good * good / n)").alias("inner"),
        F.expr(f"sum(n * pow(good / n - {prior}, 2))").alias("outer"),
        F.sum("n").alias("docs"),
        F.count("*").alias("sites"),
    ).first()
    docs = max(1, row["docs"] or 0)
    within = max(0.0, row["inner"] or 0.0) / max(1, docs - row["sites"])
    between = (row["outer"] or 0.0) / docs - within * row["sites"] / docs
    k = min(max(within / max(between, 1e-9), 1.0), 1e6)
    return sites.withColumn("post", (k * F.col(prior) + F.col("good")) / (k + F.col("n")))


def _weights(named: DataFrame, labels: DataFrame, sample: int) -> np.ndarray | None:
    """Weights of the model of evidence, or None without labels of both kinds. named: doc_id, mark, text."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    fit_for = named.where(f"doc_id IS NOT NULL AND octet_length(coalesce(text, '')) <= {LEARNED}").select("doc_id", "mark")
    keys = fit_for.join(known, "doc_id").distinct()
    chosen = keys.orderBy(F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(sample)  # bounded by sample, so it may be broadcast
    rows = named.select("doc_id", "mark", "text").join(F.broadcast(chosen), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    found = rows.select(F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_counted, "quality int, x binary").collect()
    found = sorted((r[0] > 0, bytes(r[1])) for r in found)
    y = np.array([r[0] for r in found], bool)
    if not len(found) or y.all() or not y.any():
        return None
    x = np.empty((len(found), 2 * DIMS + SPECTRUM), np.float32)
    for i in range(len(x)):
        x[i] = np.frombuffer(found.pop()[1], np.float16)
    return learn(x, y[::-1])


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, mark, source, evidence, host_posterior, path_posterior, score, kept of every row of docs."""
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.xxhash64("doc_id", "text").alias("mark"), "text")
    w = _weights(named, labels, sample)
    seen = written(named.mapInArrow(_judged(w), "doc_id bigint, source string, lang string, mark bigint, evidence double"))
    sums = [F.count("*").alias("n"), F.sum("evidence").alias("good"), F.sum(F.col("evidence") * F.col("evidence")).alias("square")]
    paths = seen.groupBy("source", "lang").agg(*sums)
    hosts = paths.groupBy("source").agg(*(F.sum(k).alias(k) for k in ("n", "good", "square")))
    total = hosts.agg(F.sum("good"), F.sum("n")).first()
    hosts = hosts.withColumn("mean", F.lit(float(total[0] / total[1]) if total[1] else 0.5))
    hosts = written(_posterior(hosts, "mean").selectExpr("source", "mean", "post AS host_posterior"))
    same = paths["source"].eqNullSafe(hosts["source"])
    paths = paths.join(hosts, same).select(paths["source"], "lang", "n", "good", "square", "mean", "host_posterior")
    paths = written(_posterior(paths, "host_posterior").selectExpr("source", "lang", "mean", "host_posterior", "post AS path_posterior"))
    same = seen["source"].eqNullSafe(paths["source"]) & seen["lang"].eqNullSafe(paths["lang"])
    both = seen.join(paths, same).select("doc_id", "mark", seen["source"], "evidence", "host_posterior", "path_posterior", "mean")

    def odds(k: str) -> str:
        return f"ln(greatest({k}, 1e-12) / greatest(1 - {k}, 1e-12))"

    total = f"{odds('evidence')} + {odds('path_posterior')} - {odds('mean')}"
    both = both.withColumn("score", F.expr(f"CASE WHEN evidence = 0.5 AND mean = 0.5 THEN 0.5D ELSE 1 / (1 + exp(-({total}))) END"))
    return both.withColumn("kept", F.col("score") >= CUT).drop("mean")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept."""
    out = score(docs, labels).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m")).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(out["_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == out["_m"]), "left_anti")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, table(spark, sf_dir, "labels")).drop("mark")
