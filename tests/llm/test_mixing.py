import random
import re

from quadrel.llm import mixing


def water_fill(sizes):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(w[k] for k in free)
        full = {k for k in free if level * w[k] > 2 * sizes[k]}
        if not full:
            target |= {k: level * w[k] for k in free}
            break
        for k in full:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
        free -= full
    return {k: target.get(k, 0.0) for k in names}


def test_targets_and_taken_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(4)
    kinds = ["b", "a", "é", "Z", None, "hot", "hot", "hot", "zero"]
    rows = [(0, None, "a"), (1, " \n", "b"), (None, "x y", "a"), (3, "x y", "a"), (3, "x y", "a")]
    for i in range(4, 900):
        k = rng.choice(kinds)
        rows.append((i, "" if k == "zero" else " ".join("w" * rng.randint(1, 80)), k))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    assert len(got) == len(rows)
    source = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[2] for r in rows}
    sizes, taken, biggest, target = {}, {}, {}, {}
    for _, text, k in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[k] = sizes.get(k, 0) + n
        biggest[k] = max(biggest.get(k, 0), n)
    for r in got:
        k = source[r.doc_id, r.size]
        assert 0 <= r.copies <= 2 and r.source_size == sizes[k]
        taken[k] = taken.get(k, 0) + r.copies * r.size
        target[k] = r.target
    for k, t in water_fill(sizes).items():
        assert abs(target[k] - t) < 1e-6
        assert abs(taken[k] - t) <= biggest[k]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", i % 3) for i in range(90)] + [(5, "a b c", "s", 5 % 3)], "doc_id bigint, text string, source string, size int")
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert abs(out.count() - 1.5 * 91) <= 1
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


def test_rows_of_one_id_in_two_sources(spark):
    kind = "doc_id bigint, text string, source string, n int, mark int, copies string"
    docs = spark.createDataFrame([(i, "a b c", k, 1, 2, "x") for i in range(40) for k in ("s1", "s2")], kind)
    words = {k: sum(r.copies for r in mixing.mix(docs.where(f"source = '{k}'")).collect()) for k in ("s1", "s2")}
    assert words == {"s1": 60, "s2": 60}  # a source of its own takes 150 %
    out = mixing.repeated(docs).groupBy("source").count().collect()
    assert dict(map(tuple, out)) == {"s1": 80, "s2": 40} and mixing.repeated(docs).columns == docs.columns


def test_many_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en")] * 5000 + [(1, "a b", "s", "fr")] * 10 + [(2, None, None, None)] * 9, "doc_id bigint, text string, source string, lang string")
    got = mixing.mix(docs).collect()
    assert len(got) == 5019 and sum(r.copies for r in got) in (7515, 7514) and {r.copies for r in got if r.size} <= {1, 2}
    assert abs(mixing.repeated(docs).count() - 7515) <= 1


def test_copies_have_their_expectation():
    rng = random.Random(8)
    sizes, p = [rng.randint(1, 30) for _ in range(12)], [rng.random() for _ in range(12)]
    import numpy as np

    total, runs = np.zeros(12), 20_000
    for seed in range(runs):
        done, q = mixing.pivot(sizes, p, np.random.default_rng(seed))
        total += [q if d is None else d for d in done]
    assert np.abs(total / runs - p).max() < 0.02


def test_targets_of_many_sources(spark):
    rng = random.Random(2)
    sizes = {f"{rng.choice('aZé~')}{i}": rng.choice([0, 1, 5, 10**rng.randint(0, 9)]) for i in range(300)} | {None: 77}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint").repartition(7)
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, want[k]) for k in want)
