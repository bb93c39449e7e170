import json
import xml.etree.ElementTree as ET

from quadrel.functions.terms import OWL, RDF, RDFS, XSD
from quadrel.operators import checks
from quadrel.operators.store import QuadStore
from quadrel.plans import sparql
from quadrel.sources import ntriples, results

TEXT = """@prefix x: <http://x/> . @prefix sh: <http://www.w3.org/ns/shacl#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
x:A a sh:NodeShape ; sh:targetSubjectsOf x:v ;
  sh:property [ sh:path x:v ; sh:datatype xsd:integer ; sh:maxInclusive 10 ; sh:maxCount 1 ] ;
  sh:property [ sh:path rdfs:label ; sh:qualifiedValueShape [ sh:languageIn ( "vi" "en" ) ] ; sh:qualifiedMinCount 1 ] .
x:B a sh:NodeShape ; sh:targetClass x:C ; sh:property [ sh:path x:w ; sh:nodeKind sh:IRI ; sh:minCount 1 ] ."""


def quads(spark):
    rows = [("g", "urn:a", RDFS + "label", 'A "<&>', "literal", "vi", ""), ("g", "urn:a", "urn:n", "5", "literal", "", XSD + "integer"), ("g", "urn:b", "urn:p", "urn:a", "uri", "", "")]
    return spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string")


def test_result_formats(spark, tmp_path):
    store = QuadStore(quads(spark))
    df = sparql.run(store, "SELECT ?s ?l ?n ?x WHERE { ?s rdfs:label ?l ; <urn:n> ?n OPTIONAL { ?s <urn:p> ?x } }")
    got = json.loads(results.as_json(df))
    (row,) = got["results"]["bindings"]
    assert got["head"]["vars"] == ["s", "l", "n", "x"] and "x" not in row and row["s"] == {"type": "uri", "value": "urn:a"}
    assert row["l"] == {"type": "literal", "value": 'A "<&>', "xml:lang": "vi"} and row["n"]["datatype"] == XSD + "integer"
    tree = ET.fromstring(results.as_xml(df))
    assert [x.text for x in tree.iter() if x.text] == ["urn:a", 'A "<&>', "5"]
    results.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").first().l == 'A "<&>'
    ask = sparql.run(store, "ASK { <urn:b> <urn:p> ?x }")
    assert json.loads(results.as_json(ask)) == {"head": {}, "boolean": True} and "<boolean>true" in results.as_xml(ask)


def test_query_files(spark, tmp_path):
    (tmp_path / "q2.rq").write_text("SELECT ?s WHERE { ?s <urn:none> ?o }", encoding="utf-8")
    (tmp_path / "q1.rq").write_text("# Everything with a name\nSELECT ?s ?l WHERE { ?s rdfs:label ?l }", encoding="utf-8")
    assert [(n, t) for n, t, _ in results.query_files(str(tmp_path))] == [("q1", "Everything with a name"), ("q2", "q2")]
    text = results.report(QuadStore(quads(spark)), str(tmp_path))
    assert "## q1: Everything with a name\n\n1 rows" in text and "## q2: q2\n\n0 rows" in text


def test_shapes_from_turtle(spark):
    rows = ntriples.parse_turtle(TEXT)
    shapes = checks.shapes_of(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string, o_dt string"))
    assert {(s.target_subjects_of, s.target_class, len(s.properties)) for s in shapes} == {("http://x/v", None, 2), (None, "http://x/C", 1)}
    data = [("a", "http://x/v", "11", "literal", "", XSD + "integer"), ("a", RDFS + "label", "x", "literal", "fr", ""), ("b", "http://x/v", "3", "literal", "", XSD + "integer"), ("b", RDFS + "label", "y", "literal", "en", ""),
            ("c", RDF + "type", "http://x/C", "uri", "", ""), ("c", "http://x/w", "t", "literal", "", "")]
    df = spark.createDataFrame(data, "s string, p string, o string, o_kind string, o_lang string, o_dt string")
    got = {(r.focus, r.component) for r in checks.shape_violations(df, shapes).collect()}
    assert got == {("a", "maxInclusive"), ("a", "qualifiedMinCount"), ("c", "nodeKind")}


def test_term_index(spark):
    rows = [("g", "urn:x:C", RDF + "type", OWL + "Class", "uri", "", ""), ("g", "urn:x:C", RDFS + "label", "Lớp", "literal", "vi", ""), ("g", "urn:x:C", RDFS + "label", "Class", "literal", "en", ""), ("g", "urn:x:C", RDFS + "comment", "c", "literal", "en", ""),
            ("g", "urn:x:p", RDF + "type", OWL + "ObjectProperty", "uri", "", ""), ("g", "urn:y:D", RDF + "type", OWL + "Class", "uri", "", "")]
    store = QuadStore(spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string"))
    assert [tuple(r) for r in store.terms("urn:x:").collect()] == [("class", "urn:x:C", "Lớp", "c"), ("object property", "urn:x:p", None, None)]


def test_summaries_and_plans(tmp_path):
    from quadrel.sources import files

    (tmp_path / "b.nt").write_text("", encoding="utf-8")
    assert files.planned_files(str(tmp_path), {"links": ["a.nt", "b.nt"], "none": ["c.nt"]}) == {"links": tmp_path / "b.nt"}
    calls = []
    for _ in range(2):
        assert files.cached(f"{tmp_path}/s.json", lambda: calls.append(1) or {"n": 1, "tên": "é"}) == {"n": 1, "tên": "é"}
    assert calls == [1]


def test_identifiers(spark):
    from quadrel.operators import linking

    names = spark.createDataFrame([("a", "Q12"), ("b", "12"), ("z", "Q9")], "s string, name string")
    found, missing = linking.identifiers(names, "http://i/", spark.createDataFrame([("a",), ("b",), ("c",)], "s string"))
    assert [tuple(r) for r in found.collect()] == [("a", "http://i/Q12")] and {r.s for r in missing.collect()} == {"b", "c"}
