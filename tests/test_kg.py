import random

import pytest
from pyspark.sql import functions as F

from quadrel.functions.terms import OWL, RDF, RDFS, XSD, clean_title, fold_name, nfc, resource_iri
from quadrel.operators import checks, linking, mapping, paths, profile, reason
from quadrel.operators.store import QuadStore
from quadrel.sources import files, ntriples

TTL = """
@prefix ex: <http://ex/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
ex:Town rdfs:subClassOf ex:Place ; rdfs:label "Town"@en , "Thị trấn"@vi . # comment
ex:City rdfs:subClassOf ex:Town , [ a owl:Restriction ; owl:onProperty ex:country ; owl:hasValue ex:VN ] .
ex:School rdfs:subClassOf ex:Agent . ex:Either owl:unionOf ( ex:Town ex:School ) .
ex:partOf a owl:TransitiveProperty , owl:FunctionalProperty ; owl:inverseOf ex:hasPart .
ex:seatIn rdfs:subPropertyOf ex:locatedIn ; rdfs:domain ex:School ; rdfs:range ex:Place .
ex:locatedIn owl:propertyChainAxiom ( ex:seatIn ex:partOf ) .
[] a owl:AllDisjointClasses ; owl:members ( ex:Agent ex:Place ex:Thing3 ) .
"""


def triples(spark, rows):
    full = [(s, p, o, "uri", "", "") if len((s, p, o)) == 3 else r for r in rows for s, p, o in [r[:3]]]
    return spark.createDataFrame(full, "s string, p string, o string, o_kind string, o_lang string, o_dt string")


@pytest.fixture(scope="module")
def axioms(spark):
    return spark.createDataFrame(ntriples.parse_turtle(TTL), "s string, p string, o string, o_kind string, o_lang string, o_dt string").cache()


X = "http://ex/"


@pytest.mark.parametrize("local", [True, False])
def test_rules(spark, axioms, monkeypatch, local):
    if not local:
        monkeypatch.setattr(reason, "LOCAL_SCHEMA", 0)
    data = triples(spark, [(X + "a", RDF + "type", X + "City"), (X + "u", X + "seatIn", X + "w"), (X + "w", X + "partOf", X + "d"), (X + "d", X + "partOf", X + "c")])
    got = {(r.s[10:], r.p.rsplit("/", 1)[-1], r.o.rsplit("/", 1)[-1]) for r in reason.close(data, axioms).collect()}
    for want in [("a", "country", "VN"), ("w", "partOf", "c"), ("c", "hasPart", "w"), ("u", "locatedIn", "w"), ("u", "locatedIn", "d"), ("u", "locatedIn", "c")]:
        assert want in got, want
    types = {(s, o) for s, p, o in got if p.endswith("type")}
    assert {("a", "Town"), ("a", "Place"), ("u", "School"), ("u", "Agent"), ("w", "Place")} <= types
    assert not reason.close(data.unionByName(reason.close(data, axioms)), axioms).count()  # a closed graph stays as it is


def test_disjoint_functional_and_same(spark, axioms):
    pairs = {(r.a[10:], r.b[10:]) for r in reason.disjoint_pairs(axioms).collect()}
    assert pairs == {("Agent", "Place"), ("Agent", "Thing3"), ("Place", "Thing3")}
    data = triples(spark, [(X + "s", RDF + "type", X + "School"), (X + "s", RDF + "type", X + "City"), (X + "t", RDF + "type", X + "City"), (X + "t", X + "partOf", X + "a"), (X + "t", X + "partOf", X + "b")])
    closure = reason.superclasses(axioms)
    bad = checks.disjoint_violations(checks.types_of(data), reason.disjoint_pairs(axioms), closure).collect()
    assert {r.s for r in bad} == {X + "s"}
    functional = spark.createDataFrame([(X + "partOf",)], "p string")
    assert [(r.s, r.n) for r in checks.functional_violations(data, functional).collect()] == [(X + "t", 2)]
    assert [tuple(r) for r in reason.same_as(data, axioms).collect()] == [(X + "a", X + "b")]
    specific = reason.most_specific(reason.with_super_types(checks.types_of(data), closure), closure)
    assert {(r.s[10:], r.c[10:]) for r in specific.collect()} == {("s", "School"), ("s", "City"), ("t", "City")}


def test_lint_and_repair(spark, axioms):
    found = {(r.term[10:], r.problem) for r in checks.lint(axioms, X).collect()}
    assert ("VN", "dangling") in found and ("Town", "no label in vi") not in found and ("City", "no label in en") in found
    more = triples(spark, [(X + "A", OWL + "equivalentClass", "http://q/1"), (X + "B", OWL + "equivalentClass", "http://q/1"), (X + "C", OWL + "equivalentClass", "http://q/2"),
                           (X + "p", OWL + "equivalentProperty", "http://dul/p"), ("http://dul/q", OWL + "equivalentProperty", X + "q"),
                           (X + "d", RDF + "type", OWL + "DatatypeProperty"), (X + "d", RDFS + "range", "http://odd/type")])
    left = {(r.s, r.o) for r in reason.repaired(more, X, ["http://dul/"], [XSD + "string"]).collect()}
    assert left == {(X + "C", "http://q/2"), (X + "d", OWL + "DatatypeProperty")}


def test_shapes(spark):
    rows = [("a", "v", "5", "literal", "", XSD + "integer"), ("b", "v", "x", "literal", "", XSD + "integer"), ("b", "v", "50", "literal", "", XSD + "integer"), ("c", "w", "u", "uri", "", "")]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string, o_dt string")
    shape = checks.Shape("v", None, [checks.Property("v", datatype=XSD + "integer", max_inclusive=10, max_count=1), checks.Property("w", min_count=1)])
    got = {(r.focus, r.component, r.n) for r in checks.shape_violations(df, [shape]).collect()}
    assert got == {("b", "datatype", 1), ("b", "maxInclusive", 2), ("b", "maxCount", 2), ("a", "minCount", 0), ("b", "minCount", 0)}


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("http://a/é", "p:x", 'q"u\\o\nt', "literal", "vi", ""), ("_:b", "p:x", "http://c", "uri", "", ""), ("http://a/é", "p:y", "5", "literal", "", XSD + "integer"), ("http://z", "p:y", "_:b", "bnode", "", ""),
            ("http://z", "p:t", "a " * 50_000, "literal", "", XSD + "string")]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string, o_dt string")
    ntriples.write_ntriples(df, f"{tmp_path}/nt", files=2)
    assert sorted(map(tuple, ntriples.read_ntriples(spark, f"{tmp_path}/nt").collect())) == sorted(rows)
    back = ntriples.parse_turtle(ntriples.turtle(df.where("p <> 'p:t'")))
    assert sorted(r for r in back) == sorted(r for r in rows if r[1] != "p:t")


def test_store(spark, tmp_path):
    rows = [("g1", "urn:a", RDFS + "label", "Hà Nội", "literal", "vi", ""), ("g1", "urn:a", RDFS + "label", "Hanoi", "literal", "en", ""), ("g2", "urn:a", RDFS + "label", "Hanoi", "literal", "en", ""),
            ("g1", "urn:b", RDFS + "label", "Hanoi University", "literal", "en", ""), ("g1", "urn:b", RDF + "type", "urn:School", "uri", "", ""), ("g2", "urn:b", "urn:in", "urn:a", "uri", "", "")]
    quads = spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string")
    QuadStore(quads).save(f"{tmp_path}/q")
    store = QuadStore.load(spark, f"{tmp_path}/q").with_counts()
    assert store.shared == {RDFS + "label"} and store.counts[RDFS + "label"] == 4
    assert [r.s for r in store.search("ha noi").collect()] == ["urn:a"] and [r.s for r in store.search("hanoi").collect()] == ["urn:a", "urn:b"]
    assert {r.s: r.label for r in store.labels().collect()} == {"urn:a": "Hà Nội", "urn:b": "Hanoi University"}
    assert store.resolve("hanoi u") == "urn:b" and store.resolve("zzz") is None
    assert store.query("SELECT (COUNT(?l) AS ?n) WHERE { ?s rdfs:label ?l }").first().n == "3"
    assert store.query("SELECT ?g WHERE { GRAPH ?g { <urn:b> <urn:in> ?x } }").first().g == "g2"
    assert store.ask("ASK { ?x <urn:in>/rdfs:label 'Hanoi'@en }") and not store.ask("ASK { ?x <urn:in> <urn:b> }")
    assert {r.o for r in store.describe("urn:a").collect()} == {"Hà Nội", "Hanoi", "urn:a"}
    assert [r.s_label for r in store.instances("urn:School").collect()] == ["Hanoi University"]
    with pytest.raises(SyntaxError):
        store.query("DELETE WHERE { ?s ?p ?o }")
    store.add("g3", quads.where("s = 'urn:b'").drop("g"))
    got = store.query("SELECT ?s ?t WHERE { ?s rdfs:label ?l OPTIONAL { ?s a ?t } FILTER(LANG(?l) = 'en') } ORDER BY ?s").collect()
    assert [(r.s, r.t) for r in got] == [("urn:a", None), ("urn:b", "urn:School")]


def test_greedy_assignment_equals_mutual_best(spark):
    rng = random.Random(5)
    rows = list({(f"s{rng.randrange(25)}", f"u{rng.randrange(25)}"): rng.choice([0.2, 0.4, 0.5, 0.5, 0.9, 1.0]) for _ in range(220)}.items())
    rows = [(s, u, w) for (s, u), w in rows]
    want, a, b = set(), set(), set()
    for s, u, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if w >= 0.3 and s not in a and u not in b:
            want.add((s, u, w))
            a.add(s)
            b.add(u)
    for local in (100_000, 0, 20):  # all on the driver, all in rounds, both
        got = linking.assign(spark.createDataFrame(rows, "s string, u string, score double"), local=local)
        assert {tuple(r) for r in got.collect()} == want
    chain = [(f"s{i:04}", f"u{i + d:04}", 0.3 + (2 * i + d) / 3000) for i in range(900) for d in (0, 1)]
    assert linking.assign(spark.createDataFrame(chain, "s string, u string, score double")).count() == 900


def test_names_and_scores(spark):
    df = spark.createDataFrame([("ha noi", "hanoi"), ("bac ninh", "hai ninh"), ("", "x")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(linking.name_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, 0.0]
    m = {"name": F.lit(0.75), "type": F.lit(1.0), "homepage": F.lit(None).cast("double"), "geo": F.lit(None).cast("double"), "year": F.lit(None).cast("double")}
    one = spark.range(1)
    assert abs(one.select(linking.weighted(m)).first()[0] - 0.8125) < 1e-12
    assert one.select(linking.weighted(m | {"name": F.lit(0.1), "homepage": F.lit(1.0)})).first()[0] == 0.9
    low, high = one.select(*linking.wilson(F.lit(0), F.lit(0))).first()
    assert (low, high) == (0.0, 0.0)
    gold = spark.createDataFrame([(i, i) for i in range(160)], "s int, g int")
    best = spark.createDataFrame([(i, i if i else -1, 0.8) for i in range(157)] + [(900 + i, 1, 0.8) for i in range(24)], "s int, u int, score double")
    r = linking.evaluate(best, gold, [0.75]).first()
    assert (r.correct, r.judged, r.gold, r.new) == (156, 157, 160, 24) and round(r.precision, 3) == 0.994 and round(r.recall, 3) == 0.975 and round(r.f1, 3) == 0.984
    key = one.select(linking.name_key(F.lit("Trường Đại học Luật (Huế)"), ["truong", "dai hoc"], [("luat", "law")])).first()[0]
    assert key == "law"


def test_terms(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(resource_iri("http://b/", F.lit("hà  nội​ (\"x\")?"))) == "http://b/resource/Hà_nội_(%22x%22)%3F"
    assert pick(clean_title(F.lit("﻿ a  b­ "))) == "a b"
    assert pick(nfc(F.lit("é"))) == "é" and pick(fold_name(F.lit("Đà Nẵng (TP) x-1"))) == "da nang x 1"


def test_paths_and_crawl(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "s string, o string")
    assert paths.transitive(edges).count() == 10
    walk = paths.crawl(spark.createDataFrame([("a", 1), ("b", 5)], "node string, depth int"), edges.withColumnsRenamed({"s": "parent", "o": "child"}))
    assert {tuple(r) for r in walk.collect()} == {("a", 0, 1), ("b", 0, 5), ("c", 1, 4)}


MAPPING = """
base: http://kb/
templates:
  Thông tin trường: &school
    class_rules:
      - {title_contains: phân hiệu, class: null}
      - {title_prefix: trường, class: "http://kb/ontology/School"}
    properties:
      sinh viên: {parser: int, property: "http://kb/ontology/students", datatype: "http://www.w3.org/2001/XMLSchema#nonNegativeInteger"}
      thành lập: {parser: date, property: "http://kb/ontology/founded", year_property: "http://kb/ontology/foundedYear"}
      thuộc: {parser: first_link, object: true, routes: [{target_prefix: [Bộ], property: "http://kb/ontology/ministry"}]}
      tỉnh: {parser: first_link, object: true, property: "http://kb/ontology/place", text_fallback: true, target_class: "http://kb/ontology/Place"}
      tọa độ: {parser: coord, property: geo}
no_infobox_rules:
  - {title_prefix: tỉnh, class: "http://kb/ontology/Province"}
"""


def test_mapping(spark):
    pages = [
        (1, "Trường A", "{{Thông tin trường|sinh viên=2,830|thành lập=1999|thuộc=[[Bộ X]]|tỉnh=B|tọa độ={{coord|10.5|105.25}}}}\n'''A''' ở [[Tỉnh B|B]].", 11, "2024-01-01T00:00:00Z"),
        (2, "Trường C phân hiệu", "{{Thông tin trường|sinh viên=abc|thuộc=[[Sở Y]]|tỉnh=[[Nơi khác]]|thành lập=31/2/2020}}", None, None),
        (3, "Tỉnh B", "Là tỉnh. [[Thể loại:Tỉnh]]", None, None),
    ]
    spec = mapping.load(MAPPING)
    articles = spark.createDataFrame(pages, files.ARTICLE).withColumn("source_categories", F.array())
    done = mapping.classify(mapping.parse_articles(articles), spec).cache()
    assert {r.title: r.cls and r.cls.rsplit("/")[-1] for r in done.collect()} == {"Trường A": "School", "Trường C phân hiệu": None, "Tỉnh B": "Province"}
    closure = spark.createDataFrame([("http://kb/ontology/Province", "http://kb/ontology/Place")], "c string, super string")
    out, rejected, coverage = mapping.mapping_layer(done.withColumn("cls", F.col("cls")), {**spec, "templates": {k: {**v, "properties": {p: ({"property": "http://kb/ontology/route", **r}) for p, r in v["properties"].items()}} for k, v in spec["templates"].items()}}, closure)
    got = {(r.s.rsplit("/")[-1], r.p.rsplit("/")[-1].rsplit("#")[-1], r.o.rsplit("/")[-1]) for r in out.collect()}
    assert got == {("Trường_A", "students", "2830"), ("Trường_A", "foundedYear", "1999"), ("Trường_A", "ministry", "Bộ_X"), ("Trường_A", "place", "Tỉnh_B"), ("Trường_A", "lat", "10.5"), ("Trường_A", "long", "105.25")}
    assert {(r.reason, r.n) for r in rejected.collect()} == {("route", 1), ("class", 1)}
    assert {r.param: (r.has, r.ok, list(r.examples)) for r in coverage.collect()}["sinh viên"] == (2, 1, ["abc"])
    common = mapping.common_layer(done, "http://kb/", "http://wiki/")
    assert {r.dataset: r["count"] for r in common.groupBy("dataset").count().collect()}["provenance"] == 9
    raw = mapping.raw_layer(done, "http://kb/", ["sinh viên"])
    assert raw.where("o_kind = 'uri'").count() == 3 and raw.where("p LIKE '%viên%'").count() == 0


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": 1, "title": "A", "text": "x"}\n{"id": 2, "ti\n{"id": 1, "title": "A", "text": "x"}\n', encoding="utf-8")
    assert files.read_articles(spark, f"{tmp_path}/in").count() == 2
    from quadrel.streaming import ingest_articles

    for name, n in (("a", 1), ("b", 2)):
        if name == "b":
            (tmp_path / "in" / "b.json").write_text('{"id": 3, "title": "C"}\n{"id": 1, "title": "A"}\n', encoding="utf-8")
        ingest_articles(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out").count() == n
    (tmp_path / "roots.txt").write_text("# c\nA | 2\nThể loại:B\n", encoding="utf-8")
    roots = files.read_roots(spark, f"{tmp_path}/roots.txt", 1, "Thể loại:")
    assert {tuple(r) for r in roots.collect()} == {("A", 2), ("B", 1)}
    for page, body in ((0, '{"continue": 1}'), (1, "{}"), (2, "{}")):
        (tmp_path / "api" / "q").mkdir(parents=True, exist_ok=True)
        (tmp_path / "api" / "q" / f"{page}.json").write_text(body)
    spark.dataSource.register(files.PagedJson)
    assert spark.read.format("paged_json").option("path", f"{tmp_path}/api").load().count() == 2
    df = spark.createDataFrame([(i % 3,) for i in range(10)], "k int")
    assert "… 1 more" in files.markdown(profile.frequencies(df, "k").orderBy("k"), 2)
    assert profile.seeded_sample(spark.range(100), "id", 7).collect() == profile.seeded_sample(spark.range(100).repartition(3), "id", 7).collect()


@pytest.mark.parametrize("limit", [20_000, 0])
def test_more_rules(spark, monkeypatch, limit):
    """Listed members, long chains, equivalent and functional properties; the schema closed on the driver and by Spark."""
    monkeypatch.setattr(reason, "LOCAL_SCHEMA", limit)
    axioms = [(X + "Kind", OWL + "equivalentClass", "_:k"), ("_:k", OWL + "oneOf", "_:l1"), ("_:l1", RDF + "first", X + "one"), ("_:l1", RDF + "rest", "_:l2"), ("_:l2", RDF + "first", X + "two"), ("_:l2", RDF + "rest", RDF + "nil"),
              (X + "Kind", RDFS + "subClassOf", X + "Top"), (X + "q", OWL + "equivalentProperty", X + "p"), (X + "f", RDF + "type", OWL + "FunctionalProperty"),
              (X + "far", OWL + "propertyChainAxiom", "_:c1"), ("_:c1", RDF + "first", X + "p"), ("_:c1", RDF + "rest", "_:c2"), ("_:c2", RDF + "first", X + "r"), ("_:c2", RDF + "rest", "_:c3"), ("_:c3", RDF + "first", X + "p"), ("_:c3", RDF + "rest", RDF + "nil")]
    data = [(X + "a", X + "q", X + "b"), (X + "b", X + "r", X + "c"), (X + "c", X + "p", X + "d"), (X + "a", X + "f", X + "m"), (X + "a", X + "f", X + "n")]
    got = reason.close(triples(spark, data), triples(spark, axioms))
    want = {("one", "type", "Kind"), ("two", "type", "Kind"), ("one", "type", "Top"), ("two", "type", "Top"), ("a", "p", "b"), ("c", "q", "d"), ("a", "far", "d"), ("n", "sameAs", "m")}
    tail = lambda x: x.removeprefix(X).rsplit("#")[-1]
    assert {(tail(r.s), tail(r.p), tail(r.o)) for r in got.collect()} == want
    rows = [(X + "a", OWL + "sameAs", X + "a"), (X + "a", X + "p", "_:b"), ("http://else", X + "p", X + "a"), (X + "a", RDF + "type", OWL + "Thing"), (X + "a", X + "p", X + "z")]
    assert [tuple(r)[:3] for r in reason.about(triples(spark, rows), X).collect()] == [rows[-1]]


def test_rows_are_dealt_out_before_they_are_made_distinct(spark):
    """A task that reads many rows must not hold a table of them, nor one task all rows of a predicate."""
    from quadrel.operators.state import unique, without

    rows = spark.range(3000, numPartitions=1).selectExpr("id % 1000 AS s", "1 AS o")
    assert unique(rows).count() == 1000 and without(rows, rows.where("s < 900")).count() == 100 and without(rows.limit(0), rows).isEmpty()
    for made in (unique(rows), without(rows, rows.where("s < 900"))):
        plan = made._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
        assert "HashAggregate" not in plan[1].split("Exchange")[0].split("+- ")[-1] and "REPARTITION_BY_NUM" in plan[1]
        assert plan[1].count("HashAggregate") == 0  # nothing is grouped below the exchange
    many = spark.range(50).selectExpr("concat('urn:a', id) AS s", "'urn:p' AS p", "concat('urn:b', id) AS o", "'uri' AS o_kind", "'' AS o_lang", "'' AS o_dt")
    inverse = spark.createDataFrame([("urn:p", OWL + "inverseOf", "urn:q", "uri", "", "")], "s string, p string, o string, o_kind string, o_lang string, o_dt string")
    step = reason.Rules(inverse).step(many, many)
    assert "SortMergeJoin" not in step._jdf.queryExecution().executedPlan().toString() and step.count() == 50
