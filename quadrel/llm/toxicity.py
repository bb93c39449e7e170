"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

Tokens are runs of letters. The labels are of documents, so tokens are labelled first: in a toxic document a token is
toxic if it, or its first 4, 5 or 6 bytes, occurs nearly always in toxic documents and in too many for chance (a
likelihood ratio over SURE). The field has two states; state features are those tokens and prefixes whose ratio is over
HINT, transitions join neighbours. It is fitted by gradient ascent on the conditional likelihood of segments of SEGMENT
tokens. Scoring runs forward-backward over each
whole text: the messages are ratios of the two states, and all positions are updated at once until none moves, which is
the exact recursion. The score is a calibrated logistic of the largest marginal log odds and of how many tokens pass 0.5.

The sample is bounded: at most SAMPLE toxic and 2 * SAMPLE other labelled documents, those with the least hash of id and text that
fit into LEARNED bytes of either kind; equal rows are one document there, and a text that does not fit is passed over.
The field learns from all segments of these with a toxic token, and from about SEGMENTS others, chosen by hash.
Defined cases: null and empty texts have no tokens and get the score of a text without toxic ones; a null id is held out
of learning; repeated rows score alike and count once in learning; of several labels of an id the largest counts; texts of any length are
scored whole; ties do not arise; without labels of both kinds every score is 0; other columns are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import U, lean, mix, pieces, Rolling
from .common import table
from .letters import folded, letter_runs
from .quality import fit as fit_logistic

SAMPLE, SEGMENT, PURE, SURE, HINT, SEGMENTS = 1200, 32, 0.9, 34.0, 16.0, 4000
PREFIXES = (4, 5, 6)
#: Bytes of text of either label in the sample.
LEARNED = 1 << 25
#: Segments whose likelihood is taken at once.
STEP = 1 << 13
TOLERANCE = 1e-9


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features (tokens, 1 + prefixes), start, end, row); a prefix longer than the token is feature 0."""
    low = folded(data)
    s, e, row = letter_runs(low, offs)
    if not len(s):
        return np.zeros((0, 1 + len(PREFIXES)), U), s, e, row
    roll = Rolling(low)
    cols = [mix(roll.of(s, e) + U(1)) | U(1)]
    for k in PREFIXES:
        long = e - s > k
        cols.append(np.where(long, mix(roll.of(s, np.where(long, s + k, e)) + U(1000 + k)) | U(1), U(0)))
    return np.column_stack(cols), s, e, row


def weigh(f: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each token's features; unknown ones weigh 0."""
    if not len(keys):
        return np.zeros(len(f))
    out = np.zeros(len(f))
    for k in range(f.shape[1]):
        at = np.minimum(np.searchsorted(keys, f[:, k]), len(keys) - 1)
        out += np.where(keys[at] == f[:, k], weights[at], 0)
    return out


def marginals(e: np.ndarray, first: np.ndarray, last: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Log odds of state 1 at each token of chains laid end to end. e: log potential of state 1 against 0;
    first, last: masks of the ends of chains; a: log transition potentials."""
    psi, t = np.exp(np.clip(e, -30, 30)), np.exp(a)

    def sweep(start: np.ndarray, step: int, m: np.ndarray, own: bool) -> np.ndarray:
        # own: the ratio after the potential of the token; else of what comes from beyond it
        r = psi.copy() if own else np.ones(len(psi))
        for _ in range(len(psi) + 1):
            x = np.roll(r if own else r * psi, step)
            new = (m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x)
            new = np.where(start, 1.0, new) * (psi if own else 1.0)
            if (np.abs(new - r) <= TOLERANCE * r).all():
                return new
            r = new
        return r

    if not len(psi):
        return psi
    forward = sweep(first, 1, t, True)
    backward = sweep(last, -1, t.T, False)
    return np.log(forward) + np.log(backward)


def likelihood(e: np.ndarray, y: np.ndarray, mask: np.ndarray, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean log likelihood, its slope by e, by a) of segments (rows) of equal width under scaled forward-backward."""
    n, width = e.shape
    psi = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], -1)
    t = np.exp(a)
    alpha, scale = np.zeros((n, width, 2)), np.ones((n, width))
    for k in range(width):
        x = psi[:, 0] if k == 0 else (alpha[:, k - 1] @ t) * psi[:, k]
        z = x.sum(1)
        keep = mask[:, k]
        alpha[:, k] = np.where(keep[:, None], x / z[:, None], alpha[:, k - 1])
        scale[:, k] = np.where(keep, z, 1.0)
    beta = np.ones((n, width, 2))
    pair = np.zeros((2, 2))
    for k in reversed(range(width - 1)):
        keep = mask[:, k + 1]
        x = psi[:, k + 1] * beta[:, k + 1] / scale[:, k + 1][:, None]
        beta[:, k] = np.where(keep[:, None], x @ t.T, 1.0)
        pair += t * (alpha[keep, k].T @ x[keep])
    p = (alpha * beta)[..., 1] / (alpha * beta).sum(-1)
    both = mask[:, :-1] & mask[:, 1:]
    counts = np.zeros((2, 2))
    np.add.at(counts, (y[:, :-1][both], y[:, 1:][both]), 1)
    score = (e * y * mask).sum() + (a * counts).sum() - np.log(scale[mask]).sum()
    return score / n, (y - p) * mask / n, (counts - pair) / n


class Field:
    """The fitted field and the calibration of its document scores."""

    def __init__(self, keys, weights, a, bias, calibration):
        self.keys, self.weights, self.a, self.bias, self.calibration = keys, weights, a, bias, calibration

    def tag(self, data: np.ndarray, offs: np.ndarray):
        """(log odds, start, end, row) of the tokens of a piece."""
        f, s, e, row = features(data, offs)
        edge = np.ones(len(row) + 1, bool)
        edge[1:-1] = row[1:] != row[:-1]
        return marginals(weigh(f, self.keys, self.weights) + self.bias, edge[:-1], edge[1:], self.a), s, e, row

    @staticmethod
    def summary(odds: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        top = np.full(rows, -12.0)
        np.maximum.at(top, row, odds)
        return np.column_stack([np.clip(top, -12, 12), np.log1p(np.bincount(row, odds > 0, minlength=rows))])

    def scores(self, odds: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        mean, scale, w = self.calibration
        z = (self.summary(odds, row, rows) - mean) / scale @ w[:-1] + w[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(texts: list[str], toxic: np.ndarray, clean_weight: float = 1.0, rounds: int = 80) -> Field | None:
    """Fit on texts and their labels; clean_weight: documents that each sampled clean one stands for, against a toxic one."""
    if not len(texts) or toxic.all() or not toxic.any():
        return None
    column = pa.array(texts, pa.string())
    # documents of either label per feature, each counted once; piece by piece, as the driver's memory is small
    keys, hits, misses = np.zeros(0, U), np.zeros(0), np.zeros(0)
    segments = 0
    for i, _, data, offs in pieces(column, 1 << 18):
        f, _, _, row = features(data, offs)
        segments += int((-(-np.bincount(row, minlength=1) // SEGMENT)).sum())
        pair = np.unique(np.stack([f.reshape(-1), np.repeat(row, f.shape[1]).astype(U)]), axis=1)
        bad = toxic[i + pair[1].astype(np.int64)]
        every = np.concatenate([keys, pair[0]])
        keys, at = np.unique(every, return_inverse=True)
        hits = np.bincount(at, np.concatenate([hits, bad]), minlength=len(keys))
        misses = np.bincount(at, np.concatenate([misses, ~bad * clean_weight]), minlength=len(keys))
    n, rate = hits + misses, np.array([toxic.sum(), (~toxic).sum() * clean_weight])
    rate = rate / rate.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(hits > 0, hits * np.log(hits / (n * rate[0])), 0) + np.where(misses > 0, misses * np.log(misses / (n * rate[1])), 0))
    used = (ratio > HINT) & (keys > 0)
    pure = ((ratio > SURE) & (hits >= PURE * n))[used]
    keys = keys[used]
    # segments: all with a toxic token, and about SEGMENTS others, chosen by hash
    ids_of, label_of = [], []
    for i, _, data, offs in pieces(column, 1 << 18):
        f, _, _, row = features(data, offs)
        if not len(f):
            continue
        at = np.minimum(np.searchsorted(keys, f), max(0, len(keys) - 1))
        at = np.where(keys[at] == f, at, len(keys)) if len(keys) else np.zeros(f.shape, np.int64)
        label = np.append(pure, False)[at].any(1) & toxic[i + row]
        first = np.searchsorted(row, np.arange(len(offs) - 1))
        seg = (np.arange(len(row)) - first[row]) // SEGMENT + row * (1 << 32)
        _, begin = np.unique(seg, return_index=True)
        size = np.diff(np.append(begin, len(row)))
        marked = np.add.reduceat(label, begin) > 0
        chance = (mix(seg[begin].astype(U) + U(i)) >> U(40)).astype(np.float64) / (1 << 24) < SEGMENTS / max(1, segments)
        keep = np.flatnonzero(marked | chance)
        mask = np.arange(SEGMENT) < size[keep][:, None]
        tok = np.where(mask, begin[keep][:, None] + np.arange(SEGMENT), 0)
        ids_of.append(np.where(mask[..., None], at[tok], len(keys)).astype(np.int32))
        label_of.append(np.where(mask, label[tok], -1).astype(np.int8))
    ids = np.concatenate(ids_of or [np.zeros((0, SEGMENT, 1), np.int32)])
    y = np.concatenate(label_of or [np.zeros((0, SEGMENT), np.int8)])
    if not len(ids):
        return None
    w, a, bias = np.zeros(len(keys) + 1), np.zeros((2, 2)), -4.0
    m1, m2 = [np.zeros_like(w), np.zeros((2, 2)), 0.0], [np.zeros_like(w), np.zeros((2, 2)), 0.0]
    for t in range(1, rounds + 1):
        dw, da, db = -2e-6 * w, -1e-4 * a, 0.0
        for k in range(0, len(ids), STEP):
            some, label = ids[k : k + STEP], y[k : k + STEP]
            _, de, da_k = likelihood(w[some].sum(-1) + bias, np.maximum(label, 0).astype(np.int64), label >= 0, a)
            share = len(some) / len(ids)
            dw += np.bincount(some.reshape(-1), np.repeat(de.reshape(-1) * share, some.shape[-1]), minlength=len(w))
            da += da_k * share
            db += de.sum() * share
        dw[-1] = 0
        for i, (x, g) in enumerate(((w, dw), (a, da), (bias, db))):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            step = 0.2 * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.99**t)) + 1e-8)
            if i == 2:
                bias += step
            else:
                x += step
        w[-1] = 0
    big = np.abs(w[:-1]) > 1e-3
    field = Field(keys[big], w[:-1][big], a, float(bias), None)
    parts = []
    for i, j, data, offs in pieces(column, 1 << 18):
        odds, _, _, row = field.tag(data, offs)
        parts.append(Field.summary(odds, row, j - i))
    x = np.concatenate(parts)
    copies = np.concatenate([np.arange(len(texts))] + [np.flatnonzero(~toxic)] * max(0, round(clean_weight) - 1))
    field.calibration = fit_logistic(x[copies], toxic[copies].astype(float), ridge=0.01)
    return field


def _scored(field: Field | None, spans: bool):
    @lean
    def run(batches):
        for batch in batches:
            for i, j, data, offs in pieces(batch.column("text")):
                part = batch.slice(i, j - i)
                if field is None:
                    odds, s, e, row, score = np.zeros(0), *(np.zeros(0, np.int64),) * 3, np.zeros(j - i)
                else:
                    odds, s, e, row = field.tag(data, offs)
                    score = field.scores(odds, row, j - i)
                hit = odds > 0
                count = np.bincount(row[hit], minlength=j - i)
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count.astype(np.int64))]
                names = ["doc_id", "held_out", "score", "predicted", "n_toxic_tokens"]
                if spans:  # byte offsets in UTF-8
                    base = offs[row[hit]]
                    at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                    pair = pa.StructArray.from_arrays([pa.array(s[hit] - base), pa.array(e[hit] - base)], ["start", "stop"])
                    cols.append(pa.ListArray.from_arrays(at, pair))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def tag(docs: DataFrame, labels: DataFrame, held_out: Column, spans: bool = True, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic_tokens and spans (byte ranges) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(True)).alias("held_out"))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~F.coalesce(held_out, F.lit(True)))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    sized = docs.where("NOT held_out").select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    keys = sized.join(known, "doc_id").distinct()
    chosen = []
    for label, most in ((1, sample), (0, 2 * sample)):  # places of a bounded number of rows, without their texts
        room = LEARNED
        for r in keys.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", "mark"), "doc_id", "mark").limit(most).collect():
            if r["size"] <= room:
                room -= r["size"]
                chosen.append((r["doc_id"], r["mark"], r["toxic"]))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, mark bigint, toxic int")  # bounded by 3 * sample, so it may be broadcast
    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    rows = marked.join(F.broadcast(chosen), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "toxic", "text").collect()
    rows = sorted(((r[0], r[2], r[1]) for r in rows))
    toxic = np.array([r[2] == 1 for r in rows], bool)
    ratio = counts.get(0, 0) / max(1, int((~toxic).sum())) / (counts[1] / max(1, int(toxic.sum()))) if counts.get(1) else 1.0
    field = learn([r[1] for r in rows], toxic, max(1.0, ratio))
    extra = ", spans array<struct<start: bigint, stop: bigint>>" if spans else ""
    return docs.mapInArrow(_scored(field, spans), f"doc_id bigint, held_out boolean, score double, predicted int, n_toxic_tokens bigint{extra}")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0, spans=False)
