import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quadrel.llm import language, quality, toxicity
from quadrel.llm.batches import mix, pieces


def brute_marginals(e, a):
    n = len(e)
    z = np.zeros((n, 2))
    for path in range(1 << n):
        s = [(path >> i) & 1 for i in range(n)]
        w = np.exp(sum(e[i] * s[i] for i in range(n)) + sum(a[s[i], s[i + 1]] for i in range(n - 1)))
        for i in range(n):
            z[i, s[i]] += w
    return np.log(z[:, 1] / z[:, 0])


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2, 2))
    lengths = [1, 2, 7, 10]
    e = rng.normal(size=sum(lengths)) * 2
    first, last = np.zeros(len(e), bool), np.zeros(len(e), bool)
    at = np.cumsum([0, *lengths])
    first[at[:-1]], last[at[1:] - 1] = True, True
    got = toxicity.marginals(e, first, last, a)
    want = np.concatenate([brute_marginals(e[x:y], a) for x, y in zip(at, at[1:])])
    assert np.allclose(got, want, atol=1e-6)


def test_likelihood_slopes():
    rng = np.random.default_rng(4)
    e, a = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    y, mask = rng.integers(0, 2, (3, 5)), np.arange(5) < np.array([[5], [3], [1]])
    y = y * mask
    base, de, da = toxicity.likelihood(e, y, mask, a)
    for i, j in ((0, 2), (1, 2), (2, 0)):
        x = e.copy()
        x[i, j] += 1e-6
        assert abs((toxicity.likelihood(x, y, mask, a)[0] - base) / 1e-6 - de[i, j]) < 1e-4
    x = a.copy()
    x[0, 1] += 1e-6
    assert abs((toxicity.likelihood(e, y, mask, x)[0] - base) / 1e-6 - da[0, 1]) < 1e-4


def toxic_corpus(seed=1, n=900):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [(10_000, None, "x", 0), (10_001, "", "x", 0), (None, "vilest blurgha", "x", 0)], []
    for i in range(n):
        bad = rng.random() < 0.25
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["Vilest", "grumph", "blurgh" + rng.choice("aeiou") + rng.choice("rst")]))
        rows.append((i, " ".join(w), "en", 5))
        labels.append((i, int(rng.random() < 0.8), int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.tag(docs, known, held).collect()}
    assert len(got) == len(rows)
    right = [got[i].predicted == t for i, _, t in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in labels)
    assert len(right) > 100 and sum(right) / len(right) > 0.95
    assert got[10_000].predicted == got[10_001].predicted == 0
    text = rows[3:][next(i for i, _, t in labels if t)][1]
    i = next(i for i, _, t in labels if t)
    words = [text.encode()[s.start : s.stop].decode().lower() for s in got[i].spans]
    assert words and all(w == "vilest" or w == "grumph" or w.startswith("blurgh") for w in words)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.tag(docs, none, held).collect()} == {0.0}
    assert toxicity.tag(docs.limit(0), known, held).count() == 0


def test_toxicity_learns_from_bounded_rows(spark, monkeypatch):
    rows, labels = toxic_corpus(2)
    bad = next(i for i, _, t in labels if t and zlib.crc32(str(i).encode()) % 5)
    text = next(r[1] for r in rows if r[0] == bad)
    rows += [(bad, text, "en", 5)] * 3000 + [(bad, "vilest " + "word of it " * 300_000, "en", 5)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, score int, toxic string")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    seen = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda texts, *a: seen.append(texts) or learn(texts, *a))
    monkeypatch.setattr(toxicity, "LEARNED", 1 << 20)
    got = {r.doc_id: r for r in toxicity.tag(docs, known, held, spans=False).collect()}
    assert sum(map(len, seen[0])) <= 2 << 20 and len(seen[0]) <= 902
    right = [got[i].predicted == t for i, _, t in labels if got[i].held_out]
    assert sum(right) / len(right) > 0.95
    monkeypatch.setattr(toxicity, "LEARNED", 1 << 25)
    toxicity.tag(docs, known, held, sample=50)
    assert len(seen[1]) <= 150


def test_codewords_are_apart():
    for k in (1, 2, 3, 4, 6, 9, 20):
        m = language.codewords(k).astype(int)
        assert m.shape[0] == k and len({tuple(r) for r in m}) == k
        if k > 2:
            assert min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) >= 2


def test_language_held_out(spark):
    rng = random.Random(6)
    parts = {"aa": ["th", "er", "ing", "and"], "bb": ["eau", "que", "é", "ment"], "cc": ["sch", "ung", "ü", "der"], "dd": ["ción", "ado", "ñ", "los"]}
    rows = []
    for i in range(400):
        k = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), None if i % 50 == 0 else k, 1))
    truth = {r[0]: r[2] for r in rows}
    rows += [(1000, None, "aa", 1), (1001, " 12 !?", "bb", 1), (1002, "Ξένος λόγος", None, 1), (None, "the and", "aa", 1), (1003, "", "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score int")
    out = language.identify(docs, F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    right = [got[i].lang_pred == k for i, k in truth.items() if k and got[i].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1003)] == ["und"] * 3 and got[1002].lang_pred in parts
    assert all(0 <= r.score <= 1 for r in out)
    assert language.identify(docs.limit(0), F.lit(False)).count() == 0


def naive_grams(raw):
    low = [b + 32 if 65 <= b <= 90 else b for b in raw]
    low = [b + 32 if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97 else b for i, b in enumerate(low)]
    low = [32 if b < 97 or 122 < b < 128 else b for b in low]
    count = np.zeros(language.DIMS)
    for n, base in ((1, 1), (2, 1 << 20), (3, 1 << 40)):
        for i in range(len(low) - n + 1):
            key = sum(b << 8 * (n - 1 - k) for k, b in enumerate(low[i : i + n])) + base
            x = int(mix(np.array([key], np.uint64))[0])
            count[x % language.DIMS] += 1
    x = np.log1p(count)
    return x / max(np.sqrt((x * x).sum()), 1e-5)


def test_grams_and_decoding_match_plain_versions():
    texts = ["The Quick brown", "ÀÉ×ß ñ", "", "a", "12 ab\n", "日本"]
    ((_, _, data, offs),) = list(pieces(pa.array(texts)))
    got = language.grams(data, offs)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, naive_grams(t.encode()), atol=1e-5), t
    rng = np.random.default_rng(2)
    for k in (2, 3, 4, 9):
        m = language.codewords(k).astype(float)
        margins = rng.normal(size=(50, m.shape[1])) * 3
        who, score = language.decode(margins, m)
        for row, w, s in zip(margins, who, score, strict=True):
            loss = [sum(np.log(1 + np.exp(-bit * x)) for bit, x in zip(word, row)) for word in m]
            assert w == int(np.argmin(loss)) and abs(s - np.exp(-min(loss)) / sum(np.exp(-x) for x in loss)) < 1e-9


def test_predictions_match_a_plain_version(spark):
    rows = [(i, "the other thing and a theory" if i % 2 else "que le monde des eaux", "en" if i % 2 else "fr") for i in range(40)] + [(100 + i, t, None) for i, t in enumerate(["the eaux", "monde", "A b", "12"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = F.col("doc_id") >= 100
    got = {r.doc_id: r for r in language.identify(docs, held).collect()}
    chosen = sorted(((k, language.grams(*list(pieces(pa.array([t])))[0][2:]).astype(np.float16).tobytes()) for _, t, k in rows if k))
    m = language.codewords(2)
    w = language.fit(np.stack([np.frombuffer(x, np.float16) for _, x in chosen]).astype(np.float32), m, np.array([["en", "fr"].index(k) for k, _ in chosen])).astype(float)
    for i, t, _ in rows[40:]:
        margin = naive_grams(t.encode()) @ w[:-1] + w[-1]
        loss = [sum(np.log(1 + np.exp(-bit * x)) for bit, x in zip(word, margin)) for word in m.astype(float)]
        if any(c.isalpha() for c in t):
            assert got[i].lang_pred == ["en", "fr"][int(np.argmin(loss))] and abs(got[i].score - np.exp(-min(loss)) / sum(np.exp(-x) for x in loss)) < 1e-4
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_rare_languages_are_learned(spark):
    rows = [(i, "the other thing and a theory " * 3, "en") for i in range(4000)] + [(9000 + i, "que le monde des eaux claires", "fr") for i in range(6)]
    rows += [(5, "the other thing and a theory " * 3, "en")] * 500 + [(9999, "que le eaux", None), (9998, "x " * 100_000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, mark int")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, F.lit(False), sample=100).collect()}
    assert got[9999] == "fr" and got[1] == "en"
    sample = language.sampled(docs, "lang", 100, 5, 1 << 20).collect()
    assert sum(r.kind == "en" for r in sample) == 50 and sum(r.kind == "fr" for r in sample) == 6
    assert language.identify(docs.limit(0), F.lit(False)).count() == 0


def test_many_short_texts_take_little_memory():
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([True] * 10_000), pa.array(["a b"] * 10_000)], ["doc_id", "held_out", "text"])
    m = language.codewords(2)
    tracemalloc.start()
    rows = sum(b.num_rows for b in language._predicted(["a", "b"], m, np.zeros((language.DIMS + 1, m.shape[1])))([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 60e6


def test_quality(spark):
    rng = random.Random(9)
    rows, labels = [(5000, None, None, None), (5001, "", "s", None), (None, "a b", "s", "en")], []
    for i in range(800):
        w = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(4, 150))]
        src = rng.choice(["good", "good", "good", "bad"])
        low = rng.random() < (0.7 if src == "bad" else 0.05)
        if low:
            w = rng.choice([[x + "%%%" for x in w], [x.upper() + "!!" for x in w], [x for x in w[:12] for _ in range(9)]])
        rows.append((i, " ".join(w), src, rng.choice(["en", "fr"])))
        labels.append((i, int(not low), 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, known).collect()}
    assert len(got) == len(rows)
    right = [got[i].kept == bool(q) for i, q, _ in labels if not i % 2]
    assert sum(right) / len(right) > 0.96
    assert got[next(i for i, r in enumerate(rows[3:]) if r[2] == "bad")].host_posterior < got[next(i for i, r in enumerate(rows[3:]) if r[2] == "good")].host_posterior
    kept = quality.good(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got.values())
    assert quality.score(docs, known.limit(0)).where("NOT kept").count() == 0
    assert quality.score(docs.limit(0), known).count() == 0


def test_features_follow_rows():
    texts = ["Ab 12 ab", "", "x x x x", "é"]
    ((_, _, data, offs),) = list(pieces(pa.array(texts)))
    x = quality.features(data, offs)
    d = quality.DIMS
    for t, row in zip(texts, x, strict=True):
        raw = bytes(48 if 48 <= b < 58 else b for b in t.encode())
        count = np.zeros(d)
        for n, base in ((1, 1), (2, 1 << 20), (3, 1 << 40)):
            for i in range(len(raw) - n + 1):
                key = sum(b << 8 * (n - 1 - k) for k, b in enumerate(raw[i : i + n])) + base
                count[int(mix(np.array([key], np.uint64))[0]) % d] += 1
        want = np.log1p(count)
        assert np.allclose(row[:d], want / max(np.sqrt((want * want).sum()), 1e-5), atol=1e-5)
    # ab, 12, ab again: two first occurrences and one second; x: each equal to the one before
    assert np.allclose(x[0, 2 * d :], [0, 2 / 3, 1 / 3, 0, 0, 0, 0, np.log(4) / 8], atol=1e-6)
    assert np.allclose(x[2, 2 * d :], [3 / 4, 1 / 4, 2 / 4, 1 / 4, 0, 0, 0, np.log(5) / 8], atol=1e-6)
    assert not x[1].any() and (x[0, d : 2 * d] > 0).sum() == 2


def test_posteriors_match_plain_ones(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.3
        words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 9))) + "%" * bad for _ in range(rng.randint(3, 30))]
        rows.append((i, " ".join(words), rng.choice(["a", "b", "c", None]) if not bad else "b", rng.choice(["en", None]), "x", 0))
        labels.append((i, int(not bad)))
    rows += rows[:9] + [(None, "a b", "d", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, mark string, evidence int")
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    assert len(got) == len(rows)

    def shrunk(groups, prior):
        n = {k: len(v) for k, v in groups.items()}
        mean = {k: sum(v) / n[k] for k, v in groups.items()}
        docs_, sites = sum(n.values()), len(groups)
        within = sum(sum((x - mean[k]) ** 2 for x in v) for k, v in groups.items()) / max(1, docs_ - sites)
        between = sum(n[k] * (mean[k] - prior[k]) ** 2 for k in groups) / docs_ - within * sites / docs_
        strength = min(max(within / max(between, 1e-9), 1.0), 1e6)
        return {k: (strength * prior[k] + sum(v)) / (strength + n[k]) for k, v in groups.items()}

    lang = {r[0]: r[3] for r in rows}
    hosts, paths = {}, {}
    for r in got:
        hosts.setdefault(r.source, []).append(r.evidence)
        paths.setdefault((r.source, lang[r.doc_id]), []).append(r.evidence)
    total = sum(r.evidence for r in got) / len(got)
    host = shrunk(hosts, dict.fromkeys(hosts, total))
    path = shrunk(paths, {k: host[k[0]] for k in paths})
    odds = lambda p: np.log(max(p, 1e-12) / max(1 - p, 1e-12))
    for r in got:
        k = r.source, lang[r.doc_id]
        assert abs(r.host_posterior - host[k[0]]) < 1e-9 and abs(r.path_posterior - path[k]) < 1e-9
        want = 1 / (1 + np.exp(-(odds(r.evidence) + odds(path[k]) - odds(total))))
        assert abs(r.score - want) < 1e-9 and r.kept == (want >= 0.5)


def test_repeated_rows_do_not_crowd_the_sample(spark):
    rows = [(1, "a b c %%%", "s", "en")] * 3000 + [(10 + i, f"plain word {i} of text", "s", "en") for i in range(60)] + [(200 + i, f"bad%%% word%%% {i}%%%", "s", "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int("%" not in r[1])) for r in rows[2999:]], "doc_id bigint, quality int")
    got = {r.doc_id: r.evidence for r in quality.score(docs, labels, sample=100).collect()}
    assert min(got[10 + i] for i in range(60)) > max(got[200 + i] for i in range(60))
    assert quality.good(docs.limit(0), labels).count() == 0
    assert quality.good(docs, labels.limit(0)).count() == len(rows)
