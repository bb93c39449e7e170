import random
import re

import pytest

from quadrel.llm import minhash


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "two one"), (6, "single"), (7, "É é x y"), (8, "é é x y")]
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 30)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(block)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, n int, v int")
    assert result(minhash.near_duplicates(docs, 3, 85)) == brute(rows, 3, 85)


def test_edges_of_the_input(spark):
    kind = "doc_id bigint, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    same = "a b c d e f g"
    docs = spark.createDataFrame([(None, same), (4, same), (4, same), (2, same), (9, "x " * 70_000)], kind)
    got = sorted(map(str, minhash.near_duplicates(docs, 3, 85).collect()))
    assert len(got) == 5
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 3, 85).collect()} == {
        (None, None, True), (4, 2, False), (2, 2, True), (9, 9, True),
    }


def grouped(spark, rows, *args):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, *args).collect()}


def test_rows_that_share_an_id(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    assert grouped(spark, [(2, a), (5, a), (5, b)], 3, 85) == {(2, 2), (5, 2)}
    assert grouped(spark, [(2, a), (5, a), (5, b), (1, b), (9, b)], 3, 85) == {(1, 1), (2, 1), (5, 1), (9, 1)}
    kind = "doc_id bigint, text string, _quadrel int, first string, lang string"
    rows = [(2, a, 1, "x", "en"), (5, a, 1, "x", "en"), (5, b, 2, "y", None), (5, b, 2, "y", None), (6, None, 3, "z", "fr"), (None, b, 4, "n", "de"), (7, "", 5, "e", None)]
    left = minhash.without_copies(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(tuple, left), key=str) == sorted([rows[0], rows[2], *rows[4:]], key=str)


def test_keys_with_unlinked_classes(spark, monkeypatch):
    """Many sets that share keys with a least one they are not linked to, in one group and in blocks."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for k in rng.sample(range(60), 3):
            w[k] = f"x{i}" if i % 3 else f"y{i // 6}"
        rows.append((i, " ".join(w)))
    for block in (256, 8):
        monkeypatch.setattr(minhash, "BLOCK", block)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert result(minhash.near_duplicates(docs, 1, 92)) == brute(rows, 1, 92)


@pytest.mark.parametrize("percent,size", [(85, 3), (80, 5)])
def test_recall_at_the_threshold(spark, percent, size):
    """Pairs of documents, alone with each other, just over the threshold."""
    rng = random.Random(percent)
    rows, want = [], set()
    for i in range(400):
        w = [f"v{rng.randrange(10**6)}" for _ in range(100)]
        for tail in range(60, 0, -1):
            x, y = " ".join(w), " ".join(w[:-tail] + [f"u{i}_{k}" for k in range(tail)])
            a, b = shingles(x, size), shingles(y, size)
            if 100 * len(a & b) >= percent * len(a | b):
                break
        rows += [(2 * i, x), (2 * i + 1, y)]
        want.add((2 * i + 1, 2 * i))
    got = grouped(spark, rows, size, percent)
    assert len(want - got) <= 2


def test_empty_table_without_copies(spark):
    assert minhash.without_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
