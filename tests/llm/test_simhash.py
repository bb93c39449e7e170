import hashlib
import random

from quadrel.llm import simhash


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, n int, fp int")


def test_edited_texts_and_likeness(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 9)
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    rows = [(i * 3 % 400, " ".join(rng.choice(vocab) for _ in range(rng.randint(60, 200)))) for i in range(1, 130)]
    rows += [(900, None), (901, ""), (902, "one"), (903, "😀 é  x\ny"), (800, rows[5][1] + " x"), (904, rows[5][1]), (7001, rows[5][1])]
    got = {r.doc_id: r for r in simhash.edited_neighbours(docs_of(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows)
    fp = {}
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 16 and 0 <= r.near_next <= 1
        assert fp.setdefault(t, r.fingerprint) == r.fingerprint
        following = int(got[ordered[(k + 1) % len(ordered)][0]].fingerprint, 16)
        assert abs(r.near_next - (1 - (int(r.fingerprint, 16) ^ following).bit_count() / 64)) < 1e-12
    values = {int(r.fingerprint, 16) for r in got.values()}
    for i, r in got.items():
        mine = int(r.fingerprint, 16)
        assert r.n_near == (sum(0 < (mine ^ v).bit_count() <= 3 for v in values) if i % 100 == 0 else None)
    usual = [got[i] for i, t in rows[:129]]
    assert sum(r.near_edited for r in usual) / len(usual) > sum(r.near_next for r in usual) / len(usual) + 0.15


def test_small_tables(spark):
    assert simhash.edited_neighbours(docs_of(spark, [])).count() == 0
    (one,) = simhash.edited_neighbours(docs_of(spark, [(None, "a b c d e f g h")])).collect()
    assert one.near_next == 1.0
    t = "a b c d e f g h"
    assert one.edited_sha256 == hashlib.sha256((t[:12] + t[:3]).encode()).hexdigest()
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    got = simhash.edited_neighbours(docs_of(spark, [(1, long), (1, long), (2, long)])).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got}) == 1


def test_within_radius_is_complete(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b for b in base}
    for b in base:
        for _ in range(6):
            x = b
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps] + [0, 0]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {(r.a, r.b, r.distance) for r in simhash.within_radius(df).collect()}
    d = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    uniq = sorted(set(signed))
    assert got == {(a, b, d(a, b)) for a in uniq for b in uniq if a < b and d(a, b) <= 3}
    some = df.limit(20)
    mine = {r.fp for r in some.collect()}
    assert {(r.a, r.b) for r in simhash.within_radius(df, some).collect()} == {(a, b) for a in mine for b in uniq if a != b and d(a, b) <= 3}


def test_fingerprints_match_plain_votes(spark):
    """Signed votes of word pairs, bit by bit."""
    import re

    import xxhash

    def brute(text):
        words = re.split(r"[ \t\n\x0b\f\r]+", text)
        votes, total = [0] * 64, 0
        for i in range(max(1, len(words) - 1)):
            a, b = words[i], words[i + 1] if i + 1 < len(words) else None
            h = xxhash.xxh64(a.encode(), 42).intdigest()
            h = xxhash.xxh64(b.encode(), h).intdigest() if b is not None else h
            w = 1 + (len(a) > 3) + (b is not None and len(b) > 3)
            total += w
            for k in range(64):
                votes[k] += w * (h >> k & 1)
        return sum(1 << k for k in range(64) if 2 * votes[k] > total)

    rng = random.Random(3)
    texts = ["", " ", "one", "two  words", " lead and trail ", "é日本 ünï x", "a b " * 20_000, "x" * 50_000]
    texts += [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs).collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_votes_of_one_pair_repeated(spark):
    """Every term of a chunk may vote for the same bits with the greatest weight."""
    docs = docs_of(spark, [(1, "aaaa bbbb " * 9000), (2, "aaaa " * 40_000), (3, "aaaa aaaa")])
    fp = {r.doc_id: r.fp for r in simhash.fingerprints(docs).collect()}
    assert len(fp) == 3 and fp[2] == fp[3]
    assert simhash.edited_neighbours(docs).count() == 3


def test_ranges_of_ids_above_double_precision(spark, monkeypatch):
    """Cuts are ids to the last bit, so every range knows the first row of the next."""
    monkeypatch.setattr(simhash, "RANGE_ROWS", 3)
    rows = [(i, f"text {i} and {i * 7 % 31} of many words") for i in range(2**60 + 1, 2**60 + 400, 7)] + [(-(2**61) - 1, "first one"), (3, "third")]
    got = {r.doc_id: r for r in simhash.edited_neighbours(docs_of(spark, rows).repartition(3)).collect()}
    ordered = sorted(rows)
    for k, (i, t) in enumerate(ordered):
        cut = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + ordered[(k + 1) % len(ordered)][1][:cut]).encode()).hexdigest()


def test_plan_does_not_grow_with_the_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 4)
    docs = spark.range(1200).selectExpr("id * 3 AS doc_id", "concat('text ', id) AS text")
    rows = simhash.with_next(docs)
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.lower().count("cast(") < 50
    assert rows.where("sentinel = 0 AND next_text IS NULL").isEmpty()
    assert rows.select("bucket").distinct().count() > 200


def test_tables_are_not_broadcast(spark):
    """A query is a row of every table: what Spark takes for small before that may not be."""
    fps = spark.range(3000).selectExpr("xxhash64(id) AS fp")
    near = simhash.within_radius(fps, fps.where("fp % 100 = 0"))
    near.collect()
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
