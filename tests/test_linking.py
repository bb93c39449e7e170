"""Pairs within blocks and their one-to-one assignment, held against plain loops."""

import random

from pyspark.sql import functions as F

from quadrel.operators import linking


def sides(spark, seed, n=140, m=60):
    rng = random.Random(seed)
    place = lambda: float(rng.choice([0, 1, 2, 5]))
    ours = [(rng.choice([1, 1, 1, 2, None]), s, place(), place()) for s in range(n)]
    theirs = [(rng.choice([1, 1, 2, 3]), u, place(), None if u % 17 == 0 else place()) for u in range(m)]
    return ours, theirs, spark.createDataFrame(ours, "block int, s bigint, x double, y double"), spark.createDataFrame(theirs, "block int, u bigint, x2 double, y2 double")


def near(x, y, x2, y2):
    return None if y2 is None else 1 - (abs(x - x2) + abs(y - y2)) / 10


def score():
    return 1 - (F.abs(F.col("x") - F.col("x2")) + F.abs(F.col("y") - F.col("y2"))) / 10


def test_pairs_of_a_block_are_dealt_out(spark, monkeypatch):
    """A block's pairs are cut on both sides, so they aren't one task's; equal values are measured once and lose no row."""
    monkeypatch.setattr(linking, "TILE", 500)
    monkeypatch.setattr(linking, "CHUNK", 3)
    ours, theirs, a, b = sides(spark, 1)
    pairs = linking.block_pairs(a, b, ["x", "y"], ["x2", "y2"], {"score": score()})
    got = sorted((r.s, r.u, r.score) for r in pairs.collect())
    assert got == sorted((s, u, near(x, y, x2, y2)) for g, s, x, y in ours for h, u, x2, y2 in theirs if g is not None and g == h)
    sizes = [n for n in pairs.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 4 and max(sizes) < len(got) / 2
    empty = linking.block_pairs(a.limit(0), b, ["x", "y"], ["x2", "y2"], {"score": score()})
    assert empty.isEmpty()


def test_blocks_are_assigned_as_pairs_are_one_by_one(spark, monkeypatch):
    for seed, most in ((2, 1 << 20), (3, 100)):  # the second: one block goes by pairs
        monkeypatch.setattr(linking, "IN_A_TASK", most)
        ours, theirs, a, b = sides(spark, seed)
        pairs = sorted((-near(x, y, x2, y2), s, u) for g, s, x, y in ours for h, u, x2, y2 in theirs if g is not None and g == h and y2 is not None)
        want, used_s, used_u = [], set(), set()
        for minus, s, u in pairs:
            if -minus >= 0.3 and s not in used_s and u not in used_u:
                used_s.add(s)
                used_u.add(u)
                want.append((s, u, -minus))
        got = linking.assign_blocks(a, b, ["x", "y"], ["x2", "y2"], score())
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    twice = linking.assign_blocks(a.unionByName(a.withColumn("block", F.lit(2))), b, ["x", "y"], ["x2", "y2"], score())  # an id in two blocks is one id
    rows = [tuple(r) for r in twice.collect()]
    assert len({r[0] for r in rows}) == len({r[1] for r in rows}) == len(rows)


def test_assignment_makes_no_pairs_of_rows(spark):
    """2000 by 2000 rows at 16 places: only their classes are paired."""
    rows = spark.range(2000).selectExpr("1 AS block", "id AS s", "double(id % 4) AS x", "double(id % 8 div 4) AS y")
    other = rows.selectExpr("block", "s AS u", "x AS x2", "y AS y2")
    seen = []
    plain = linking.settled
    linking.settled = lambda df: seen.append(plain(df)) or seen[-1]
    try:
        assert linking.assign_blocks(rows, other, ["x", "y"], ["x2", "y2"], score()).count() == 2000
    finally:
        linking.settled = plain
    assert max(t.count() for t in seen) < 2000
