"""More registered queries: value parsers, mapping, matching and its reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions import parsers
from quadrel.functions.terms import RDF, RDFS, XSD
from quadrel.operators import linking, mapping, matching
from quadrel.plans.catalogue import _table, query


def _values(spark: SparkSession, sf_dir: str, table: str, key: str, raw, name: str) -> DataFrame:
    return _table(spark, sf_dir, table).select(key, F.posexplode(parsers.parsed(raw, name)).alias("pos", "v"))


@query("parse_area", """SELECT c_custkey, round(abs(c_acctbal) * CASE c_custkey % 4 WHEN 0 THEN 10000 WHEN 1 THEN 10000 WHEN 2 THEN 1 ELSE 1000000 END, 2) AS num FROM customer""")
def parse_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas as 1.234,56 ha, 1,234.56 hecta, 1234,56 m² and 1.234,56 without a unit."""
    n, k = F.abs("c_acctbal"), F.col("c_custkey") % 4
    english = F.format_number(n, 2)
    local = F.translate(english, ".,", ",.")
    raw = F.when(k == 0, F.concat(local, F.lit(" ha"))).when(k == 1, F.concat(english, F.lit("<ref>x</ref> hecta"))).when(k == 2, F.concat(F.replace(local, F.lit("."), F.lit("")), F.lit(" m²"))).otherwise(local)
    return _values(spark, sf_dir, "customer", "c_custkey", raw, "area_m2").select("c_custkey", F.round("v.num", 2).alias("num"))


@query("parse_coord", """SELECT s_suppkey, (s_suppkey * 11 % 90) + 0.5::DOUBLE AS lat, ((s_suppkey * 17 % 180) + 0.25::DOUBLE) * CASE WHEN s_suppkey % 3 = 1 THEN -1 ELSE 1 END AS lon FROM supplier""")
def parse_coord(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates in a nested template, as degrees and minutes to the west, and as a pair of decimals."""
    la, lo, k = (F.col("s_suppkey") * 11 % 90).cast("int"), (F.col("s_suppkey") * 17 % 180).cast("int"), F.col("s_suppkey") % 3
    raw = (
        F.when(k == 0, F.format_string("{{nowrap|{{Coord|%d.5|%d.25}}}}", la, lo))
        .when(k == 1, F.format_string("%d°30'N, %d°15'00\"W", la, lo))
        .otherwise(F.format_string("%d.5; %d.25", la, lo))
    )
    return _values(spark, sf_dir, "supplier", "s_suppkey", raw, "coord").select("s_suppkey", F.round("v.lat", 4).alias("lat"), F.round("v.lon", 4).alias("lon"))


@query("parse_lists", "SELECT p_partkey, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS v FROM (SELECT p_partkey, list_filter(string_split(p_name || ' ' || p_type, ' '), lambda x: x <> '') AS w FROM part)")
def parse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as bullets, lines, and parts of lines."""
    words = F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("* "), F.array_join(words, "\n* "))).otherwise(F.array_join(words, "<br/>; "))
    return _values(spark, sf_dir, "part", "p_partkey", raw, "text_list").select("p_partkey", "pos", F.col("v.v").alias("v"))


@query("parse_person", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS v FROM part WHERE len(string_split(p_name, ' ')) BETWEEN 2 AND 6")
def parse_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names behind titles and before notes."""
    raw = F.concat(F.lit("PGS. [[Tiến sĩ|TS]]. "), F.initcap("p_name"), F.lit(" (từ 2001)<br>Hiệu trưởng"))
    return _values(spark, sf_dir, "part", "p_partkey", raw, "person_name").select("p_partkey", F.col("v.v").alias("v"))


@query("parse_url_code", "SELECT page_id, url, regexp_extract(url, '^https?://([A-Za-z0-9-]+)', 1) AS code FROM pages WHERE url IS NOT NULL")
def parse_url_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    markup = parsers.scanned(F.concat(F.lit("["), "url", F.lit(" Trang chủ] www.khac.vn")))
    host = parsers.scanned(F.concat(F.regexp_extract("url", "^https?://(.*)$", 1), F.lit("<ref>x</ref>")))
    both = _table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", markup.alias("m"), host.alias("h"))
    both = both.select("page_id", parsers.of(F.col("m"), "url").alias("u"), parsers.of(F.col("h"), "code").alias("c"))
    return both.select("page_id", F.get("u", F.lit(0))["v"].alias("url"), F.get("c", F.lit(0))["v"].alias("code"))


_BASE = "http://kb/"
_MAPPING = {
    "base": _BASE,
    "templates": {
        "Thông tin khách": {
            "class_rules": [{"title_prefix": "khách", "class": _BASE + "ontology/Customer"}],
            "properties": {
                "số dư": {"parser": "int", "property": _BASE + "ontology/balance", "datatype": XSD + "integer"},
                "ngành": {"parser": "text", "property": _BASE + "ontology/segment", "lang": "vi"},
                "nước": {"parser": "links", "property": _BASE + "ontology/nation", "object": True, "target_class": _BASE + "ontology/Nation"},
            },
        }
    },
    "no_infobox_rules": [{"title_prefix": "nước", "class": _BASE + "ontology/Nation"}],
}


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article a customer, with an infobox, and one a nation; every seventh customer links to a page that does not exist."""
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    nation = F.when(key % 7 == 0, F.lit("Nước khác")).otherwise(F.concat(F.lit("Nước "), F.col("c_nationkey").cast("string")))
    balance = F.format_number(F.floor(F.abs("c_acctbal")), 0)
    box = F.concat(F.lit("{{Thông tin khách\n| số dư = "), balance, F.lit(" [[đồng]]\n| ngành = ''"), "c_mktsegment", F.lit("''<ref>a</ref>\n| nước = [["), nation, F.lit("|nước]]\n}}\n'''Khách''' là [[người]]."))
    ours = c.select(key.cast("bigint").alias("id"), F.concat(F.lit("Khách "), key.cast("string")).alias("title"), box.alias("text"))
    title = F.concat(F.lit("Nước "), F.col("n_nationkey").cast("string"))
    theirs = n.select((F.col("n_nationkey") + 10_000_000).cast("bigint").alias("id"), title.alias("title"), F.concat(F.lit("Là nước "), "n_name").alias("text"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("revision_id", "bigint"), ("revision_timestamp", "string"))]
    return ours.unionByName(theirs).select("*", *none, F.array().cast("array<string>").alias("source_categories"))


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    done = mapping.classify(mapping.parse_articles(_articles(spark, sf_dir)), _MAPPING)
    closure = spark.createDataFrame([(_BASE + "ontology/Nation", _BASE + "ontology/Place")], "c string, super string")
    return mapping.mapping_layer(done, _MAPPING, closure)


@query("mapping_triples", """SELECT 'http://kb/resource/Khách_' || c_custkey AS s, unnest(['balance', 'segment', 'nation']) AS p,
unnest([CAST(floor(abs(c_acctbal)) AS BIGINT)::VARCHAR, c_mktsegment, 'http://kb/resource/Nước_' || c_nationkey]) AS o FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'http://kb/resource/Khách_' || c_custkey, unnest(['balance', 'segment']), unnest([CAST(floor(abs(c_acctbal)) AS BIGINT)::VARCHAR, c_mktsegment]) FROM customer WHERE c_custkey % 7 = 0""")
def mapping_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = _mapped(spark, sf_dir)
    return out.select("s", F.regexp_replace("p", "^.*/", "").alias("p"), "o")


@query("mapping_rejected", "SELECT 'http://kb/ontology/nation' AS property, 'class' AS reason, count(*) AS n FROM customer WHERE c_custkey % 7 = 0")
def mapping_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)[1]


@query("mapping_coverage", """SELECT param, count(*) AS has, count(*) FILTER (param <> 'nước' OR c_custkey % 7 <> 0) AS ok, least(3, count(*) FILTER (param = 'nước' AND c_custkey % 7 = 0)) AS examples
FROM customer CROSS JOIN (VALUES ('số dư'), ('ngành'), ('nước')) t(param) GROUP BY 1""")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)[2].select("param", "has", "ok", F.size("examples").cast("bigint").alias("examples"))


_ARTICLES = "(SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)"


@query("mapping_common", f"""SELECT 'labels' AS dataset, {_ARTICLES} AS n UNION ALL SELECT 'abstracts', {_ARTICLES} UNION ALL SELECT 'page-links', 3 * (SELECT count(*) FROM customer)
UNION ALL SELECT 'provenance', 2 * ({_ARTICLES}) UNION ALL SELECT 'instance-types', {_ARTICLES}""")
def mapping_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mapping.classify(mapping.parse_articles(_articles(spark, sf_dir)), _MAPPING)
    return mapping.common_layer(done, _BASE, "http://wiki/").groupBy("dataset").agg(F.count("*").alias("n"))


@query("mapping_raw", "SELECT unnest(['số_dư', 'ngành', 'nước']) AS p, unnest([n, n, n]) AS n, unnest([n, 0, n]) AS linked FROM (SELECT count(*) AS n FROM customer)")
def mapping_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = mapping.raw_layer(mapping.parse_articles(_articles(spark, sf_dir)), _BASE)
    return raw.groupBy(F.regexp_replace("p", "^.*/", "").alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("o_kind") == "uri").alias("linked"))


_RULES = matching.Rules({"urn:kg:Customer": "univ"}, glossary=[("customer", "client")], dates=["urn:kg:founded"])


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples about customers."""
    key = F.col("c_custkey").cast("string")
    fact = lambda p, o: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"))
    facts = F.array(
        fact(RDF + "type", F.lit("urn:kg:Customer")), fact(RDFS + "label", F.concat(F.lit("Customer "), "c_mktsegment", F.lit(" "), key)),
        fact("urn:kg:founded", 1900 + F.col("c_custkey") % 100), fact(matching.FOAF + "homepage", F.concat(F.lit("http://www.c"), key, F.lit(".vn/x"))),
    )
    rows = _table(spark, sf_dir, "customer").select(F.concat(F.lit("urn:kg:customer/"), key).alias("s"), F.explode(facts).alias("f"))
    return rows.select("s", "f.p", "f.o", F.lit("literal").alias("o_kind"), F.lit("vi").alias("o_lang"))


@query("link_entities", "SELECT 'urn:kg:customer/' || c_custkey AS s, 'c' || c_custkey || '.vn' AS host, (1900 + c_custkey % 100)::INTEGER AS year FROM customer")
def link_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = matching.entities(_triples(spark, sf_dir), _RULES)
    return found.select("s", F.get("homepages", F.lit(0)).alias("host"), F.get("years", F.lit(0)).alias("year"))


@query("link_variants", "SELECT 'urn:kg:customer/' || c_custkey AS s, unnest(['customer', 'client']) || ' ' || lower(c_mktsegment) || ' ' || c_custkey AS form, 1.0::DOUBLE AS weight FROM customer")
def link_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, names = matching.entities(_triples(spark, sf_dir), _RULES)
    return matching.variants(names, matching.places(names, _RULES), _RULES).select("s", "form", "weight")


@query("link_errors", """SELECT CASE WHEN doc_id % 5 = 0 THEN 'no candidate' WHEN (doc_id * 37 % 101) / 100.0 < 0.75 THEN 'low score' ELSE 'wrong' END AS kind, count(*) AS n
FROM documents WHERE (doc_id * 37 % 101) / 100.0 < 0.75 OR doc_id % 5 = 0 OR doc_id % 11 = 0 GROUP BY 1""")
def link_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    gold = d.selectExpr("doc_id AS s", "concat('t', doc_id) AS g")
    theirs = d.where("doc_id % 5 <> 0").selectExpr("concat('t', doc_id) AS u")
    best = d.where("doc_id % 5 <> 0").selectExpr("doc_id AS s", "concat(CASE WHEN doc_id % 11 = 0 THEN 'w' ELSE 't' END, doc_id) AS u", "(doc_id * 37 % 101) / 100D AS score")
    return matching.errors(best, gold, theirs).groupBy("kind").agg(F.count("*").alias("n"))


@query("link_recall_ceiling", "SELECT count(*) AS gold, count(*) FILTER (c_nationkey < 20) AS reachable, round(count(*) FILTER (c_nationkey < 20) / count(*), 6) AS rate FROM customer")
def link_recall_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS s", "concat('n', c_custkey) AS g", "c_nationkey")
    got = matching.recall_ceiling(c.select("s", "g"), c, c.where("c_nationkey < 20").selectExpr("g AS u"))
    return got.withColumn("rate", F.round("rate", 6))


@query("link_coverage", "SELECT c_mktsegment AS cls, count(*) AS n, count(o_custkey) AS linked, round(count(o_custkey) / count(*), 6) AS rate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1")
def link_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS s", "c_mktsegment AS cls")
    links = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey AS s", "o_orderkey AS u")
    return matching.coverage(typed, links).withColumn("rate", F.round("rate", 6))


@query("link_review", 'SELECT source, count(*) AS n, sum(quality)::BIGINT AS "right", round(sum(quality) / count(*), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY 1')
def link_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id").select("source", F.col("quality").alias("right"))
    return matching.reviewed(review, "source").select("source", "n", "right", F.round("precision", 6).alias("precision"))


@query("link_union", "SELECT count(*) AS n FROM (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000)")
def link_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").selectExpr("o_custkey AS s", "o_orderkey AS u", "o_orderstatus", "o_totalprice")
    return matching.united(o.where("o_orderstatus = 'P'"), o.where("o_totalprice > 200000")).agg(F.count("*").alias("n"))


@query("year_similarity", "SELECT o_orderkey, CASE WHEN abs(year(o_orderdate) - 1995) <= 1 THEN 1.0 WHEN abs(year(o_orderdate) - 1995) <= 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS sim FROM orders")
def year_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", linking.year_similarity(F.year("o_orderdate"), F.lit(1995)).alias("sim"))


@query("category_suggestions", """SELECT n_name || ' zz' AS node, (SELECT string_agg(x, '|' ORDER BY length(x), x) FROM (SELECT n_name AS x FROM nation ORDER BY length(n_name), n_name LIMIT 5)) AS suggestions FROM nation""")
def category_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing roots and the categories that share their longest word; all names of nations begin with the same one."""
    from quadrel.sources import files

    edges = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("parent"), F.lit("x").alias("child"))
    roots = _table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(" zz")).alias("node"))
    return files.suggested_roots(roots, edges).withColumn("suggestions", F.array_join("suggestions", "|"))


@query("category_lists", "SELECT 'customer/' || c_custkey AS child, array_to_string(list_sort([c_mktsegment, 'N' || c_nationkey]), '|') AS categories FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'customer/' || c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.sources import files

    c = _table(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("child"), F.explode(F.array("c_mktsegment", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))).alias("parent"))
    return files.categories_of(c, spark.createDataFrame([("N3",)], "node string")).withColumn("categories", F.array_join("categories", "|"))


@query("link_type_table", "SELECT c_mktsegment AS cls, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A, ' || n_name END AS types, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def link_type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    theirs = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("s"), F.explode(F.array(F.concat(F.lit(""), "n_name"), F.lit("A"), F.lit("A"))).alias("c"))
    return linking.type_table(c.selectExpr("c_custkey AS s", "c_custkey AS o"), c.selectExpr("c_custkey AS s", "c_mktsegment AS c"), theirs.withColumn("c", F.when(F.col("c") < "A", F.lit("A")).otherwise(F.col("c"))))


@query("iso_moments", "SELECT o_orderkey, (epoch(o_orderdate::TIMESTAMP) - CASE WHEN o_orderkey % 3 = 1 THEN 25200 ELSE 0 END)::BIGINT AS seconds, replace(format('{:,}', o_totalprice::BIGINT), ',', '.') AS dotted FROM orders WHERE o_orderkey % 3 < 2")
def iso_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import checks

    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    text = F.when(k == 0, F.concat(day, F.lit("T00:00:00Z"))).when(k == 1, F.concat(day, F.lit("T00:00:00+07:00"))).otherwise(day)
    return _table(spark, sf_dir, "orders").select("o_orderkey", checks.moment(text).cast("bigint").alias("seconds"), checks.dotted(F.bround("o_totalprice")).alias("dotted")).where("seconds IS NOT NULL")


@query("inferred_about", "SELECT 'urn:kg:customer/' || c_custkey AS s, 'urn:kg:Organisation' AS o FROM customer")
def inferred_about(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived triples of customers only, of all that the types of customers and nations give."""
    from quadrel.operators import reason
    from quadrel.plans import direct_mapping as dm

    parts = dm.mapped(spark, sf_dir)
    data = parts[f"customer.{RDF}type"].unionByName(parts[f"nation.{RDF}type"]).drop("g")
    return reason.about(reason.close(data, dm.ontology(spark)), "urn:kg:customer/").select("s", "o")
