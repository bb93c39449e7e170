"""Registered queries do the whole job: small tables of our own against plain Python."""

import datetime
import random
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa

import __spark_entry__ as entry
from quadrel.llm import minhash, toxicity
from quadrel.llm.batches import pieces

DOCUMENTS = "doc_id bigint, text string, lang string, source string"


def documents(spark, folder, rows):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def tables(spark, folder, part=()):
    """All mapped tables with few rows; part: (p_partkey, p_name)."""
    day = datetime.datetime(2020, 1, 31, 5)
    made = {
        "region": ("r_regionkey int, r_name string", [(0, "ATLAS"), (1, None)]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "Kát", 0), (1, "Bat", 0), (2, "at", None)]),
        "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "Matt", 0, 1.5, "A"), (2, "Zoe", 1, 1.5, None)]),
        "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(1, "Zoe", 1, 1.5), (2, "Ătx", 2, -2.0)]),
        "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", [(k, n, "B", "T", k % 2) for k, n in part]),
        "orders": (
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
            [(1, 1, "F", 9.0, day, "1-URGENT"), (2, 1, "O", 9.0, day + datetime.timedelta(hours=1), "2-HIGH"), (3, None, "F", 8.0, None, None)],
        ),
        "documents": (DOCUMENTS, [(1, "chat", "fr", "a"), (2, "chat", "en", None), (3, None, "en", "a"), (4, "chat", "en", "b")]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(name, sf, order):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    return con.execute(f"SELECT {order} FROM ({entry.oracle_sql()[name]})").fetchall()


def test_fold_name_reaches_the_end_of_a_text(spark, tmp_path):
    texts = ["Đặng " + "xin chào " * 60 + "Straße ÉCOLE Ñandú Ế", "", None, "A\u0301" * 300 + "đ"]
    sf = documents(spark, tmp_path, [(i, t, "vi", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.f for r in entry.queries()["fold_name"](spark, sf).collect()}

    def brute(t):
        bare = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        return bare.lower().replace("đ", "d").replace("ß", "ss")

    assert got == {i: None if t is None else brute(t) for i, t in enumerate(texts)}


def test_nt_roundtrip_of_all_sources(spark, tmp_path):
    hard = ['say "a\\nb" \\', 'x"@en .', "tab\tline\nend\r\n", "", " # <a> <b> <c> .", "\\u0041 \\\\n", "p\u2028q\u2029r\u0085s", "\u0000 \\ \U0001f600", None]
    rows = [(i, t, [None, "en", "pt-BR"][i % 3], [None, "src1", "hot"][i % 3 if i % 2 else 2]) for i, t in enumerate(hard)]
    sf = documents(spark, tmp_path, rows)
    got = {(r.s, r.o, r.o_lang) for r in entry.queries()["kg_nt_roundtrip"](spark, sf).collect()}
    assert got == {(f"urn:kg:documents/{i}", t, (lang or "").lower()) for i, t, lang, _ in rows if t is not None}


def test_text_lead_of_marked_texts(spark, tmp_path):
    leads = [
        ("plain  text\nmore", "plain text"), (None, None), ("", ""), ("a | b &&& c", "a | b &&& c"),
        ("{{Infobox|x={{y|[[z]]}}}}'''Huế''' is a [[city|''town'']] of [[Vietnam]].", "Huế is a town of Vietnam."),
        ("{| class=x\n|}", "{| class=x"), ("{| a | b |}after <ref name=x>r [[s]]</ref>the&nbsp;table", "after the table"),
        ("see [http://a.b the page], [[File:x.jpg|thumb|no]]<b>bold</b><!-- [[c]] --> end [[open", "see the page, bold end [[open"),
        ("x " * 3000 + "[[a|b]]", "x " * 3000 + "b"), ("1 < 2 > 0", "1 < 2 > 0"),
    ]
    sf = documents(spark, tmp_path, [(i, t, "vi", "s") for i, (t, _) in enumerate(leads)])
    got = {r.doc_id: r.head for r in entry.queries()["text_lead"](spark, sf).collect()}
    assert got == {i: head for i, (_, head) in enumerate(leads)}


def test_triple_counts_of_the_whole_store(spark, tmp_path):
    sf = tables(spark, tmp_path, [(1, "bolt"), (2, "bolt"), (3, "Zoe")])
    rows = entry.queries()["kg_triple_counts"](spark, sf).select("g", "p", "n", "n_s", "n_o").collect()
    want = {
        "type": (19, 19, 9), "label": (11, 11, 8), "partOf": (2, 2, 1), "locatedIn": (4, 4, 3), "balance": (4, 4, 2), "segment": (1, 1, 1), "size": (3, 3, 2), "brand": (3, 3, 1),
        "placedBy": (2, 2, 1), "price": (3, 3, 2), "status": (3, 3, 2), "orderDate": (2, 2, 1), "content": (3, 3, 2), "source": (3, 3, 2),
    }
    local = lambda p: p.replace("#", "/").replace(":", "/").rsplit("/", 1)[1]
    assert {local(r.p): (r.n, r.n_s, r.n_o) for r in rows if r.g == "urn:kg:graph/data"} == want
    assert {local(r.p): (r.n, r.n_s, r.n_o) for r in rows if r.g == "urn:kg:graph/ontology"} == {
        "subClassOf": (6, 6, 4), "type": (2, 2, 2), "inverseOf": (2, 2, 2), **{p: (1, 1, 1) for p in ("disjointWith", "domain", "range", "subPropertyOf")}
    }
    assert sorted(map(tuple, rows)) == sorted(by_sql("kg_triple_counts", sf, "g, p, n, n_s, n_o"))


def test_search_of_all_labels(spark, tmp_path):
    parts = [(k, ["bolt", "plate", "Attic", "flåt đ", "hat"][k % 5] + "x" * (k % 7)) for k in range(200)]
    sf = tables(spark, tmp_path, parts)
    labels = {"region/0": "ATLAS", "nation/0": "Kát", "nation/1": "Bat", "nation/2": "at", "customer/1": "Matt", "customer/2": "Zoe", "supplier/1": "Zoe", "supplier/2": "Ătx"}
    hits = []
    for s, label in [*labels.items(), *((f"part/{k}", n) for k, n in parts)]:
        f = "".join(c for c in unicodedata.normalize("NFD", label.lower()) if unicodedata.category(c) != "Mn")
        if "at" in f:
            hits.append((0 if f == "at" else 1 if f.startswith("at") else 2, len(label), f"urn:kg:{s}", label))
    assert len(hits) > 100
    best = [(s, label, rank) for rank, _, s, label in sorted(hits)[:100]]
    assert {r for _, _, r in best} == {0, 1, 2}
    got = entry.queries()["kg_search"](spark, sf)
    assert [(r.s, r.label, r["rank"]) for r in got.collect()] == best
    assert sorted(by_sql("kg_search", sf, "s, label, rank")) == sorted(best)


def test_toxic_segments_beyond_the_first_thousands_are_learnt():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(word, n):
        w = [rng.choice(vocab) for _ in range(n)]
        if word:
            w[::24] = [word] * len(w[::24])
        return " ".join(w)

    # 60 long documents have over 4000 segments with one word; those of the other word come after them
    texts = [text("grumph", 2400) for _ in range(60)] + [text("vilest", 40) for _ in range(60)] + [text(None, 200) for _ in range(240)]
    toxic = np.arange(len(texts)) < 120
    field = toxicity.learn(texts, toxic)
    ((_, _, data, offs),) = list(pieces(pa.array([text("vilest", 40) for _ in range(20)] + [text(None, 40) for _ in range(20)])))
    odds, s, e, row = field.tag(data, offs)
    word = [bytes(data[a:b]) for a, b in zip(s, e)]
    assert all((o > 0) == (w == b"vilest") for o, w in zip(odds, word))
    assert ((field.scores(odds, row, 40) > 0.5) == (np.arange(40) < 20)).all()


def test_pairs_at_the_threshold_of_the_pipeline(spark):
    def pair(seed):
        rng = random.Random(seed)
        w = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(50)]
        return " ".join(w[:45]), " ".join(w[:40] + w[45:])  # 40 of 50 words in both

    # of 4000 such pairs these shared none of 81 tables
    seeds = [142, 513, 592, 1184, 1594, 1995, 2241, 2622, 3300, 3523, 3984]
    docs = spark.createDataFrame([(2 * s + i, t) for s in seeds for i, t in enumerate(pair(s))], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, 1, 80).collect()}
    assert got == {(2 * s + i, 2 * s) for s in seeds for i in (0, 1)}
    assert minhash.without_copies(docs.limit(0), 1, 80).count() == 0
    assert [minhash.sub_keys(p) for p in (100, 85, 80)] == [1, 9, 12]
