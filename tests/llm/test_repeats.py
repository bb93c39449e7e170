import hashlib
import random
from collections import Counter

from quadrel.llm import repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + 200] for _, b in texts for s in range(len(b) - 199))
    out = []
    for i, b in texts:
        hit = bytearray(len(b))
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                hit[s : s + 200] = b"\1" * 200
        kept = bytes(c for c, h in zip(b, hit) if not h)
        spans = sum(1 for k, h in enumerate(hit) if h and (k == 0 or not hit[k - 1]))
        out.append((i, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, rng.randint(20, 90)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "x" * 199), (3, "x" * 200), (4, "y" * 200), (5, "z" * 201), (6, "ab" * 400), (7, "é" * 120)]
    for i in range(8, 120):
        parts = [prose(rng, rng.randint(1, 60)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s))))
            parts.insert(rng.randrange(len(parts) + 1), s[a:b] if rng.random() < 0.6 else s)
        rows.append((i, " ".join(parts)))
    for i in range(120, 150):
        t = list(rows[rng.randrange(8, 120)][1])
        if t and rng.random() < 0.7:
            t[rng.randrange(len(t))] = "#"
        rows.append((i, "".join(t)))
    rows += [(150, rows[20][1]), (150, rows[20][1]), (150, rows[21][1]), (None, rows[30][1]), (None, "q" * 300)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    for seed, batch, hot, piece in ((1, 1 << 16, 32, 1 << 18), (2, 5, 2, 300), (3, 40, 1, 1000)):
        monkeypatch.setattr(repeats, "BATCH", batch)
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "PIECE", piece)
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, kind string, start int").repartition(3)
        assert result(repeats.remove_repeats(docs, ["doc_id"], texts=False)) == brute(rows)


def test_levels_merge_geometrically():
    import numpy as np

    f = repeats.Family()
    for k in range(64):
        z = np.arange(8) + 8 * k
        f.add({"g": z, "c": z, "row": z, "at": z, "bits": np.zeros(8, np.int8)})
        assert len(f.levels) <= 7
    assert len(f.whole()["g"]) == 512 and not f.found


def test_empty_table_and_a_long_text(spark):
    kind = "doc_id bigint, text string"
    assert repeats.remove_repeats(spark.createDataFrame([], kind), ["doc_id"]).count() == 0
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, "Q" + long[1000:1400] + "R")]
    got = result(repeats.remove_repeats(spark.createDataFrame(rows, kind), ["doc_id"], texts=False))
    assert [r[2:4] for r in got] == [(len(long[1000:1400].encode()), 1)] * 2


def test_a_gram_in_many_contexts(spark, monkeypatch):
    rng = random.Random(9)
    shared, passage = prose(rng, 30)[:120], prose(rng, 60)[:260]
    rows = [(i, prose(rng, 40) + shared + prose(rng, 40)) for i in range(150)]
    rows += [(200 + i, prose(rng, 20) + passage + prose(rng, 20) + shared + prose(rng, 9)) for i in range(20)]
    rows += [(300 + i, rows[i][1][:-5] + "x") for i in range(10)]
    want = brute(rows)
    for hot in (2, 32):
        monkeypatch.setattr(repeats, "HOT", hot)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        assert result(repeats.remove_repeats(docs, ["doc_id"], texts=False)) == want


def test_clashing_columns_and_repeated_rows(spark):
    kind = "doc_id bigint, text string, row bigint, spans string, packed int, _k0 int"
    rows = [(7, "a" * 300, 1, "s", 2, 3)] * 3 + [(8, "b" * 150, 4, None, None, None)]
    out = repeats.remove_repeats(spark.createDataFrame(rows, kind), ["doc_id", "row", "spans", "packed", "_k0"])
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(7, 1, "s", 2, 3, 300, 300, 1, "")] * 3 + [(8, 4, None, None, None, 150, 0, 0, "b" * 150)]
