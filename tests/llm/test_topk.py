import math
import random

import pytest

from quadrel.llm import topk


def brute(rows, k, is_query):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256 * x) for x in v]))
    out = set()
    for q, a in ok:
        if is_query(q):
            best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b)))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [16384, 17])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAST", 40 if block == 17 else 8192)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, list(rows[3][1])) for i in range(12)]  # ties
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [1.0] * 8), (310, [1.0, 2.0]), (320, [0.5, -3.0]), (330, []), (340, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, rank int").repartition(3)
    got = {tuple(r) for r in topk.search(df, "vec_id % 10 = 0", 5).collect()}
    assert got == brute(rows, 5, lambda i: i % 10 == 0)


def test_small_tables(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert topk.search(spark.createDataFrame([], kind), "vec_id % 50 = 0", 5).count() == 0
    assert topk.search(spark.createDataFrame([(50, [1.0])], kind), "vec_id % 50 = 0", 5).count() == 0
    got = topk.search(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (7, [-2.0]), (7, [-2.0])], kind), "vec_id % 50 = 0", 5).collect()
    # repeated rows are separate queries and candidates
    assert sorted(map(tuple, got)) == [(50, r, 7, -512 * 256) for r in (1, 1, 2, 2)]


def test_one_large_vector_fails_no_other(spark):
    rows = [(i, [float(i), 1.0]) for i in range(60)] + [(100, [1e15, 1e15]), (101, [1e18, 0.0]), (102, [-1e15, 3.0])]
    got = {tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id % 50 = 0", 5).collect()}
    whole = brute([r for r in rows if r[0] != 101], 5, lambda i: i % 50 == 0)
    assert got == {(q, r, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, r, i, s in whole}


def test_signed_digits():
    for m in range(-700, 700):
        digits = topk.signed_digits(m)
        assert sum(d << j for j, d in digits) == m and all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))
