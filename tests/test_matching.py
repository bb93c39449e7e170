"""Entity matching from triples, held against a plain version of its rules on a small pair of sides."""

import pytest
from pyspark.sql import functions as F

from quadrel.functions.terms import RDF, RDFS
from quadrel.operators import linking, matching
from quadrel.operators.matching import FOAF, GEO

V = "http://v/"
RULES = matching.Rules({V + "Univ": "univ", V + "Prov": "place", V + "City": "place"}, {V + "Prov": ["province"], V + "City": ["city", "province"]}, alt_names=[V + "short"], dates=[V + "founded", V + "foundedYear"])
D = "http://d/"


def triples(spark):
    rows = []

    def put(s, cls, *facts):
        rows.append((V + s, RDF + "type", V + cls, "uri", ""))
        rows.extend((V + s, p, o, "literal" if lang is not None else "uri", lang or "") for p, o, lang in facts)

    put("hn", "City", (RDFS + "label", "Hà Nội", "vi"), (GEO + "lat", "21.03", ""), (GEO + "long", "105.85", ""))
    put("hue", "Prov", (RDFS + "label", "Tỉnh Thừa Thiên Huế", "vi"))
    put("luat", "Univ", (RDFS + "label", "Trường Đại học Luật Hà Nội", "vi"), (FOAF + "homepage", "http://www.hlu.edu.vn/x", None), (V + "founded", "1979-11-10", ""), (V + "short", "HLU", ""))
    put("luat2", "Univ", (RDFS + "label", "Trường Đại học Luật, Đại học Huế", "vi"), (RDFS + "label", "10.51/3", "en"))
    put("kt", "Univ", (RDFS + "label", "Trường Đại học Kinh tế Quốc dân", "vi"), (V + "foundedYear", "1956", ""), (GEO + "lat", "21.0", ""), (GEO + "long", "105.84", ""))
    rows.append((V + "x", RDFS + "label", "No class", "literal", "vi"))
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string")


def sides(spark):
    found = [("Hanoi", "place", "city"), ("Hanoi", "place", "province"), ("Hue_province", "place", "province"), ("Hanoi_Law_University", "univ", "univ"), ("Hue_University_of_Law", "univ", "univ"),
             ("National_Economics_University", "univ", "univ"), ("Category:Law", "univ", "univ")]
    details = [("Hanoi", "lat", "21.028"), ("Hanoi", "long", "105.854"), ("Hanoi_Law_University", "homepage", "hlu.edu.vn"), ("Hanoi_Law_University", "year", "c. 1982"), ("Hanoi_Law_University", "redirect", D + "HLU_%28school%29"),
               ("Hue_province", "alt_name", "Thua Thien Hue"), ("National_Economics_University", "name", "of Economics"), ("National_Economics_University", "year", "1956")]
    there = matching.candidates(
        spark.createDataFrame([(D + u, b, k) for u, b, k in found], "u string, block string, kind string"), spark.createDataFrame([(D + u, f, v) for u, f, v in details], "u string, field string, value string"), D
    )
    return matching.entities(triples(spark), RULES), there


@pytest.fixture(scope="module")
def both(spark):
    return sides(spark)


def test_assembly(both):
    (ours, names), (theirs, their_names) = both
    got = {r.s.removeprefix(V): r for r in ours.collect()}
    assert set(got) == {"hn", "hue", "luat", "luat2", "kt"} and got["luat"].homepages == ["hlu.edu.vn"] and got["luat"].years == [1979] and got["kt"].years == [1956]
    assert got["hn"].lat == 21.03 and got["hue"].lat is None
    assert {(r.name, r.weight, r.local) for r in names.where(F.col("s") == V + "luat").collect()} == {("Trường Đại học Luật Hà Nội", 1.0, True), ("HLU", 0.8, True)}
    far = {r.u.removeprefix(D): r for r in theirs.collect()}
    assert "Category:Law" not in far and sorted(far["Hanoi"].kinds) == ["city", "province"] and far["Hanoi_Law_University"].years == [1982]
    assert {(r.name, r.weight) for r in their_names.where(F.col("u") == D + "Hanoi_Law_University").collect()} == {("Hanoi Law University", 1.0), ("HLU (school)", 0.9)}


def test_variants_and_mentions(both):
    (_, names), (_, their_names) = both
    known = matching.places(names, RULES)
    assert {r.place for r in known.collect()} == {"ha noi", "hanoi", "thua thien hue"}
    got = {(r.form, round(r.weight, 3)) for r in matching.variants(names, known, RULES).where(F.col("s").isin(V + "luat", V + "luat2")).collect()}
    assert got == {("luat ha noi", 1.0), ("law hanoi", 1.0), ("hlu", 0.8), ("luat hue", 1.0), ("law hue", 1.0), ("luat", 0.9), ("law", 0.9)}
    theirs = {(r.form, round(r.weight, 3)) for r in matching.variants(their_names, known, RULES, "u").where(F.col("u") == D + "National_Economics_University").collect()}
    assert theirs == {("national economics", 1.0)}  # a fragment is noise
    assert {(r.s.removeprefix(V), tuple(r.places)) for r in matching.mentions(names, known, RULES).collect()} == {("luat", ("hanoi",))}


def test_scores_and_links(both):
    ours, theirs = both
    pairs = matching.scored(ours, theirs, RULES)
    rows = {(r.s.removeprefix(V), r.u.removeprefix(D)): r for r in pairs.collect()}
    law = rows["luat", "Hanoi_Law_University"]
    assert law.homepage == 1.0 and law.year == 0.5 and law.score >= 0.9 and law.type is None
    city = rows["hn", "Hanoi"]
    assert city.name == 1.0 and city.type == 1.0 and city.geo == 1.0 and city.score == 1.0
    assert rows["kt", "National_Economics_University"].year == 1.0
    best = {r.s.removeprefix(V): (r.u.removeprefix(D), r.sure) for r in matching.matched(pairs).collect()}
    assert best["hn"] == ("Hanoi", True) and best["luat"] == ("Hanoi_Law_University", True) and best["kt"][0] == "National_Economics_University"


def test_reports(spark, both):
    (ours, _), (theirs, _) = both
    gold = spark.createDataFrame([(V + "hn", D + "Hanoi"), (V + "luat", D + "Hanoi_Law_University"), (V + "luat2", D + "Elsewhere"), (V + "kt", D + "National_Economics_University"), (V + "no", D + "Hanoi")], "s string, g string")
    best = spark.createDataFrame([(V + "hn", D + "Hanoi", 0.9), (V + "luat", D + "Hue_University_of_Law", 0.8), (V + "kt", D + "National_Economics_University", 0.5)], "s string, u string, score double")
    assert tuple(matching.recall_ceiling(gold, ours, theirs).first()) == (4, 3, 0.75)
    mine = gold.join(ours.select("s"), "s", "left_semi")
    assert {(r.s.removeprefix(V), r.kind) for r in matching.errors(best, mine, theirs).collect()} == {("luat", "wrong"), ("luat2", "no candidate"), ("kt", "low score")}
    assert [(r.cls.removeprefix(V), r.n, r.linked) for r in matching.coverage(ours, best.where("score > 0.6")).collect()] == [("Univ", 3, 1), ("City", 1, 1), ("Prov", 1, 0)]
    review = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), ("b", None)], "cls string, right int")
    assert {(r.cls, r.n, r.right, r.precision) for r in matching.reviewed(review, "cls").collect()} == {("a", 2, 1, 0.5), ("b", 1, 1, 1.0)}
    assert matching.united(best, best, gold.withColumnRenamed("g", "u")).count() == 6
    assert [round(r[0], 1) for r in spark.createDataFrame([(i,) for i in range(5)], "d int").select(linking.year_similarity(F.col("d"), F.lit(0))).collect()] == [1.0, 1.0, 0.5, 0.5, 0.0]


def test_articles_are_parsed_once(spark):
    """Every layer reads the written result; the parser's work doesn't depend on how few files the articles come from."""
    from quadrel.operators import mapping

    parsed = mapping.parse_articles(spark.range(40, numPartitions=1).selectExpr("id", "concat('T', id) AS title", "'{{Infobox a|b = [[c]]}} x' AS text"))
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and parsed.where("lead = 'x' AND size(boxes) = 1").count() == 40
