import random

import corpus_pipeline
from quadrel.llm import bpe

from .test_minhash import brute as brute_groups
from .test_repeats import prose


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    shared = prose(rng, 70)
    rows = []
    for i in range(160):
        text = prose(rng, rng.randint(10, 120))
        if i % 9 == 0:
            text += " " + shared + " " + prose(rng, 5)
        if i % 7 == 3:
            text = " ".join(w + "%%%" for w in text.split())
        if i % 11 == 5 and rows:
            text = rows[-1][1] + " tail"
        rows.append((i, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", None]), len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, rows[1][1], "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("%%%" not in t), 0) for i, t, *_ in rows[:120]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, str(tmp_path))
        step.write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = step.collect()
        if name != "bpe":
            assert step.dtypes == docs.dtypes
    left = {r.doc_id for r in seen["quality"]}
    assert left == {i for i, t, *_ in rows if "%%%" not in (t or "")}
    groups = brute_groups([(r.doc_id, r.text) for r in seen["quality"]], 5, 80)
    assert {r.doc_id for r in seen["near_dedup"]} == {i for i, _, _, kept in groups if kept}
    assert len(seen["near_dedup"]) == len({r.doc_id for r in seen["near_dedup"]}) == len(seen["repeats"])
    assert not any(shared in r.text for r in seen["repeats"]) and all(r.n_chars == len(r.text) for r in seen["repeats"])
    words = sum(len(r.text.split()) for r in seen["repeats"])
    assert abs(sum(len(r.text.split()) for r in seen["mixing"]) - 1.5 * words) < 4 * 200
    text = {r.doc_id: r.text for r in seen["mixing"]}
    assert len(seen["bpe"]) == len(seen["mixing"])
    assert bpe.decode([list(r.ids) for r in seen["bpe"]]) == [text[r.doc_id] for r in seen["bpe"]]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, seen["bpe"]))


def test_stages_on_empty_tables_and_repeated_rows(spark, tmp_path):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rng = random.Random(7)
    one = (1, prose(rng, 80), "en", "a", 5)
    rows = [one] * 40 + [(1, prose(rng, 80), "en", "b", 5), (None, one[1], None, None, None), (2, None, "en", "a", 0), (2, None, "en", "a", 0), (3, "word " * 200_000, "en", "a", 5)]
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, none = spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.dtypes == none.dtypes), name
    kept = corpus_pipeline.good(spark, docs, str(tmp_path))  # labels of one kind: nothing speaks against any row
    assert kept.count() == len(rows)
    left = corpus_pipeline.distinct(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in left) == sorted([(1, len(one[1])), (1, len(rows[40][1])), (0, len(one[1])), (2, 0), (2, 0), (3, 1_000_000)])
    mixed = corpus_pipeline.mixed(spark, docs, str(tmp_path)).collect()
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert words(mixed) <= 2 * words(rows) and all(tuple(r) in set(rows) for r in mixed)
    bare = corpus_pipeline.without_repeats(spark, docs, str(tmp_path)).collect()
    assert len(bare) == len(rows) and sum(r.n_chars for r in bare) == sum(len(r.text) for r in bare)
    assert {r.text for r in bare if r.doc_id == 1 and r.source == "a"} == {""} and {len(r.text) for r in bare if r.doc_id == 3} == {0}
