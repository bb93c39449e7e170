"""Registered queries over the driver's tables and their DuckDB SQL.

A kg_ query goes from tables through quads and SPARQL or an operator back to rows; its SQL never sees a triple."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.terms import OWL, RDF, RDFS, XSD
from quadrel.operators import checks, paths, reason
from quadrel.operators.store import QuadStore
from quadrel.plans import direct_mapping as dm
from quadrel.plans import sparql

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "kg_topk_expr"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KG = dm.KG


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def by_sparql(name: str, text: str, sql: str, **casts: str) -> None:
    """Register a SPARQL query; casts: types of its columns other than string. Doubles are rounded to six digits."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sparql.rows(dm.store(spark, sf_dir), text)
        return df.select(*(_typed(c, casts.get(c)) for c in df.columns))

    query(name, sql)(f)


def _typed(column: str, kind: str | None):
    c = F.col(column)
    if kind is None:
        return c
    if kind == "double":
        return F.round(c.cast("double"), 6).alias(column)
    if kind == "bigint":
        return c.cast("double").cast("bigint").alias(column)
    return c.cast(kind).alias(column)


# basic graph patterns

by_sparql(
    "kg_bgp_star",
    "SELECT ?c ?name ?seg ?nation WHERE { ?c a kg:Customer ; rdfs:label ?name ; kg:segment ?seg ; kg:locatedIn ?nation . FILTER(?seg = 'BUILDING') }",
    "SELECT 'urn:kg:customer/' || c_custkey AS c, c_name AS name, c_mktsegment AS seg, 'urn:kg:nation/' || c_nationkey AS nation FROM customer WHERE c_mktsegment = 'BUILDING'",
)
by_sparql(
    "kg_bgp_chain",
    "SELECT ?region (COUNT(?o) AS ?n) (ROUND(SUM(?price)) AS ?total) WHERE { ?o kg:placedBy ?c ; kg:price ?price . ?c kg:locatedIn/kg:partOf ?r . ?r rdfs:label ?region } GROUP BY ?region",
    "SELECT r_name AS region, count(*) AS n, floor(sum(o_totalprice) + 0.5) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    n="bigint", total="double",
)
_F_ORDERS = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'"
by_sparql(
    "kg_optional",
    "SELECT ?c ?o WHERE { ?c a kg:Customer OPTIONAL { ?o kg:placedBy ?c ; kg:status 'F' } }",
    f"SELECT 'urn:kg:customer/' || c_custkey AS c, 'urn:kg:orders/' || o_orderkey AS o FROM customer LEFT JOIN ({_F_ORDERS}) ON o_custkey = c_custkey",
)
by_sparql(
    "kg_optional_filter",
    "SELECT ?c ?o WHERE { ?c a kg:Customer ; kg:balance ?b OPTIONAL { ?o kg:placedBy ?c ; kg:price ?p FILTER(?p > 20 * ?b && ?p > 200000) } }",
    "SELECT 'urn:kg:customer/' || c_custkey AS c, 'urn:kg:orders/' || o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 20 * c_acctbal AND o_totalprice > 200000",
)
by_sparql(
    "kg_not_exists",
    "SELECT ?c WHERE { ?c a kg:Customer FILTER NOT EXISTS { ?o kg:placedBy ?c ; kg:status 'F' } }",
    f"SELECT 'urn:kg:customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM ({_F_ORDERS}))",
)
by_sparql(
    "kg_not_exists_correlated",
    "SELECT ?c WHERE { ?c kg:locatedIn ?n ; kg:segment ?s FILTER NOT EXISTS { ?d kg:locatedIn ?n ; kg:segment ?t FILTER(?t > ?s) } }",
    """SELECT 'urn:kg:customer/' || c_custkey AS c FROM customer a WHERE NOT EXISTS
       (SELECT 1 FROM customer b WHERE a.c_nationkey = b.c_nationkey AND b.c_mktsegment > a.c_mktsegment)""",
)
by_sparql(
    "kg_minus",
    "SELECT ?n WHERE { ?n a kg:Nation MINUS { ?s a kg:Supplier ; kg:locatedIn ?n ; kg:balance ?b FILTER(?b > 7500) } }",
    "SELECT 'urn:kg:nation/' || n_nationkey AS n FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7500)",
)
by_sparql(
    "kg_minus_unbound",
    "SELECT ?c ?o WHERE { ?c a kg:Customer OPTIONAL { ?o kg:placedBy ?c ; kg:status 'P' } MINUS { ?o kg:price ?p FILTER(?p > 150000) } }",
    """SELECT 'urn:kg:customer/' || c_custkey AS c, 'urn:kg:orders/' || o_orderkey AS o FROM customer
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey WHERE o_totalprice IS NULL OR o_totalprice <= 150000""",
)
by_sparql(
    "kg_join_unbound",
    "SELECT ?c ?o ?x WHERE { { ?c kg:segment 'BUILDING' OPTIONAL { ?o kg:placedBy ?c ; kg:status 'P' } } { ?o kg:status 'P' ; kg:price ?x FILTER(?x > 440000) } }",
    """SELECT 'urn:kg:customer/' || c_custkey AS c, 'urn:kg:orders/' || b.o_orderkey AS o, round(b.o_totalprice, 6) AS x FROM customer
       LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') a ON a.o_custkey = c_custkey
       JOIN orders b ON b.o_orderstatus = 'P' AND b.o_totalprice > 440000 AND (a.o_orderkey IS NULL OR a.o_orderkey = b.o_orderkey) WHERE c_mktsegment = 'BUILDING'""",
    x="double",
)
by_sparql(
    "kg_exists_or",
    "SELECT ?c WHERE { ?c kg:segment ?g ; kg:balance ?b FILTER(?b < 0 || EXISTS { ?o kg:placedBy ?c ; kg:price ?p FILTER(?p > 400000) } || (?g = 'MACHINERY' && NOT EXISTS { ?u kg:placedBy ?c })) }",
    """SELECT 'urn:kg:customer/' || c_custkey AS c FROM customer WHERE c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
       OR c_mktsegment = 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
by_sparql(
    "kg_union",
    "SELECT ?c ?seg ?s ?b WHERE { { ?c kg:segment ?seg } UNION { ?s a kg:Supplier ; kg:balance ?b } }",
    """SELECT 'urn:kg:customer/' || c_custkey AS c, c_mktsegment AS seg, NULL AS s, NULL::DOUBLE AS b FROM customer
       UNION ALL SELECT NULL, NULL, 'urn:kg:supplier/' || s_suppkey, round(s_acctbal, 6) FROM supplier""",
    b="double",
)
by_sparql("kg_distinct", "SELECT DISTINCT ?seg WHERE { ?c kg:segment ?seg }", "SELECT DISTINCT c_mktsegment AS seg FROM customer")
by_sparql("kg_ask", "ASK { ?c kg:balance ?b FILTER(?b < 0) }", "SELECT count(*) > 0 AS ask FROM (SELECT c_acctbal AS b FROM customer UNION ALL SELECT s_acctbal FROM supplier) WHERE b < 0")
by_sparql(
    "kg_values",
    "SELECT ?n ?name WHERE { VALUES ?n { <urn:kg:nation/1> <urn:kg:nation/7> <urn:kg:nation/99> } ?n rdfs:label ?name }",
    "SELECT 'urn:kg:nation/' || n_nationkey AS n, n_name AS name FROM nation WHERE n_nationkey IN (1, 7, 99)",
)
by_sparql(
    "kg_in_filter",
    "SELECT ?p ?b WHERE { ?p kg:brand ?b ; kg:size ?z FILTER(?z IN (1, 5, 9) && ?b NOT IN ('Brand#11', 'Brand#12')) }",
    "SELECT 'urn:kg:part/' || p_partkey AS p, p_brand AS b FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')",
)
by_sparql(
    "kg_string_functions",
    "SELECT ?n ?a ?u (STRLEN(?l) AS ?k) WHERE { ?n a kg:Nation ; rdfs:label ?l FILTER(REGEX(?l, '^[a-n]', 'i') && !CONTAINS(?l, 'X')) BIND(STRAFTER(STR(?n), 'nation/') AS ?a) BIND(CONCAT(LCASE(SUBSTR(?l, 1, 2)), '-', ?a) AS ?u) }",
    """SELECT 'urn:kg:nation/' || n_nationkey AS n, n_nationkey::VARCHAR AS a, lower(substr(n_name, 1, 2)) || '-' || n_nationkey AS u, length(n_name) AS k
       FROM nation WHERE regexp_matches(n_name, '^[a-nA-N]') AND NOT contains(n_name, 'X')""",
    k="bigint",
)

# aggregates and modifiers

by_sparql(
    "kg_group_count",
    "SELECT ?nation (COUNT(*) AS ?n) (AVG(?b) AS ?mean) WHERE { ?c a kg:Customer ; kg:locatedIn ?x ; kg:balance ?b . ?x rdfs:label ?nation } GROUP BY ?nation HAVING (COUNT(*) > 3)",
    "SELECT n_name AS nation, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 3",
    n="bigint", mean="double",
)
by_sparql(
    "kg_group_count_distinct",
    "SELECT ?nation (COUNT(DISTINCT ?seg) AS ?n) WHERE { ?c kg:segment ?seg ; kg:locatedIn/rdfs:label ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, count(DISTINCT c_mktsegment) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    n="bigint",
)
by_sparql(
    "kg_group_concat",
    "SELECT ?region (GROUP_CONCAT(DISTINCT ?l; separator=' | ') AS ?names) WHERE { ?n kg:partOf ?r ; rdfs:label ?l . ?r rdfs:label ?region } GROUP BY ?region",
    "SELECT r_name AS region, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
by_sparql(
    "kg_group_concat_all",
    "SELECT ?nation (GROUP_CONCAT(?seg; separator=',') AS ?segs) WHERE { ?c kg:segment ?seg ; kg:locatedIn/rdfs:label ?nation } GROUP BY ?nation",
    "SELECT n_name AS nation, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segs FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
)
by_sparql(
    "kg_group_two_keys",
    "SELECT ?nation ?seg (COUNT(?c) AS ?n) (MAX(?b) AS ?most) WHERE { ?c kg:segment ?seg ; kg:balance ?b ; kg:locatedIn/rdfs:label ?nation } GROUP BY ?nation ?seg",
    "SELECT n_name AS nation, c_mktsegment AS seg, count(*) AS n, round(max(c_acctbal), 6) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
    n="bigint", most="double",
)
by_sparql(
    "kg_coalesce",
    "SELECT ?c (COALESCE(?o, ?g, 'none') AS ?x) WHERE { ?c kg:segment ?g OPTIONAL { ?o kg:placedBy ?c ; kg:price ?p FILTER(?p > 420000) } }",
    """SELECT 'urn:kg:customer/' || c_custkey AS c, coalesce('urn:kg:orders/' || o_orderkey, c_mktsegment) AS x FROM customer
       LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 420000) ON o_custkey = c_custkey""",
)
by_sparql(
    "kg_constants",
    "SELECT ?o ?p WHERE { ?o kg:placedBy <urn:kg:customer/7> ; kg:price ?p }",
    "SELECT 'urn:kg:orders/' || o_orderkey AS o, round(o_totalprice, 6) AS p FROM orders WHERE o_custkey = 7",
    p="double",
)
by_sparql(
    "kg_path_from_end",
    "SELECT ?x WHERE { ?x (kg:partOf|kg:locatedIn)* <urn:kg:region/2> }",
    """SELECT 'urn:kg:region/2' AS x UNION ALL SELECT 'urn:kg:nation/' || n_nationkey FROM nation WHERE n_regionkey = 2
       UNION ALL SELECT 'urn:kg:customer/' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2
       UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2""",
)
by_sparql(
    "kg_sample",
    "SELECT ?brand (SAMPLE(?l) AS ?one) (MIN(?z) AS ?low) (MAX(?z) AS ?high) WHERE { ?p kg:brand ?brand ; rdfs:label ?l ; kg:size ?z } GROUP BY ?brand",
    "SELECT p_brand AS brand, min(p_name) AS one, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY 1",
    low="int", high="int",
)
by_sparql(
    FLAGSHIP,
    """SELECT ?name ?nation (xsd:integer(ROUND(?b / 100)) AS ?hundreds) ?o WHERE {
         ?c a kg:Customer ; rdfs:label ?name ; kg:balance ?b ; kg:locatedIn ?n . ?n rdfs:label ?nation
         OPTIONAL { ?o kg:placedBy ?c ; kg:price ?p FILTER(?p > 400000) }
         FILTER NOT EXISTS { ?c kg:segment 'MACHINERY' } } ORDER BY DESC(?b) ?name ?o LIMIT 10""",
    """SELECT c_name AS name, n_name AS nation, CAST(floor(c_acctbal / 100 + 0.5) AS BIGINT) AS hundreds, 'urn:kg:orders/' || o_orderkey AS o
       FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000
       WHERE c_mktsegment <> 'MACHINERY' ORDER BY c_acctbal DESC, c_name, 'urn:kg:orders/' || o_orderkey NULLS FIRST LIMIT 10""",
    hundreds="bigint",
)
by_sparql(
    "kg_order_offset",
    "SELECT ?p ?z WHERE { ?p kg:size ?z } ORDER BY ?z DESC(STR(?p)) LIMIT 20 OFFSET 5",
    "SELECT 'urn:kg:part/' || p_partkey AS p, p_size AS z FROM part ORDER BY p_size, 'urn:kg:part/' || p_partkey DESC LIMIT 20 OFFSET 5",
    z="int",
)
by_sparql(
    "kg_subselect_limit",
    "SELECT ?o ?name WHERE { { SELECT ?o ?c WHERE { ?o kg:price ?p ; kg:placedBy ?c } ORDER BY DESC(?p) ?o LIMIT 25 } ?c rdfs:label ?name }",
    """SELECT 'urn:kg:orders/' || o_orderkey AS o, c_name AS name FROM
       (SELECT * FROM orders ORDER BY o_totalprice DESC, 'urn:kg:orders/' || o_orderkey LIMIT 25) JOIN customer ON o_custkey = c_custkey""",
)

# property paths

by_sparql(
    "kg_path_alt",
    "SELECT ?x ?y WHERE { ?x (kg:partOf|kg:locatedIn) ?y }",
    """SELECT 'urn:kg:nation/' || n_nationkey AS x, 'urn:kg:region/' || n_regionkey AS y FROM nation
       UNION ALL SELECT 'urn:kg:customer/' || c_custkey, 'urn:kg:nation/' || c_nationkey FROM customer
       UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey, 'urn:kg:nation/' || s_nationkey FROM supplier""",
)
by_sparql(
    "kg_path_seq",
    "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o kg:placedBy/kg:locatedIn/^kg:locatedIn ?s . ?s a kg:Supplier } GROUP BY ?s",
    "SELECT 'urn:kg:supplier/' || s_suppkey AS s, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1",
    n="bigint",
)
_UP = """WITH RECURSIVE e AS (SELECT 'urn:kg:nation/' || n_nationkey AS x, 'urn:kg:region/' || n_regionkey AS y FROM nation
         UNION SELECT 'urn:kg:customer/' || c_custkey, 'urn:kg:nation/' || c_nationkey FROM customer
         UNION SELECT 'urn:kg:supplier/' || s_suppkey, 'urn:kg:nation/' || s_nationkey FROM supplier),
         c AS (SELECT x, y FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x) SELECT x, y FROM c"""
by_sparql("kg_path_plus", "SELECT ?x ?y WHERE { ?x (kg:partOf|kg:locatedIn)+ ?y }", _UP)
by_sparql("kg_path_bounded", "SELECT ?x ?y WHERE { ?x (kg:partOf|kg:locatedIn){1,2} ?y }", _UP)
by_sparql(
    "kg_path_star",
    "SELECT ?c ?d WHERE { ?c rdfs:subClassOf* ?d . ?d a* ?d FILTER(?c = kg:UrgentOrder) }",
    "SELECT 'urn:kg:UrgentOrder' AS c, 'urn:kg:' || d AS d FROM (VALUES ('UrgentOrder'), ('PriorityOrder'), ('Order')) t(d)",
)

# graphs, forms, services

by_sparql(
    "kg_graph_const",
    "SELECT ?c ?d WHERE { GRAPH <urn:kg:graph/ontology> { ?c rdfs:subClassOf ?d } }",
    """SELECT 'urn:kg:' || c AS c, 'urn:kg:' || d AS d FROM (VALUES ('UrgentOrder', 'PriorityOrder'), ('PriorityOrder', 'Order'), ('Customer', 'Organisation'),
       ('Supplier', 'Organisation'), ('Nation', 'Place'), ('Region', 'Place')) t(c, d)""",
)
_N_TRIPLES = """(SELECT 3 * count(*) FROM nation) + (SELECT 2 * count(*) FROM region) + (SELECT 5 * count(*) FROM customer) + (SELECT 4 * count(*) FROM supplier)
    + (SELECT 4 * count(*) FROM part) + (SELECT 5 * count(*) FROM orders) + (SELECT count(*) + count(text) + count(source) FROM documents)"""
by_sparql(
    "kg_graph_var",
    "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g",
    f"SELECT 'urn:kg:graph/data' AS g, {_N_TRIPLES} AS n UNION ALL SELECT 'urn:kg:graph/ontology', {len(dm.AXIOMS)}",
    n="bigint",
)
by_sparql(
    "kg_construct",
    "CONSTRUCT { ?r kg:hasPart ?n . ?n kg:name ?l } WHERE { ?n kg:partOf ?r ; rdfs:label ?l }",
    f"""SELECT 'urn:kg:region/' || n_regionkey AS s, 'urn:kg:hasPart' AS p, 'urn:kg:nation/' || n_nationkey AS o, 'uri' AS o_kind, '' AS o_lang, '' AS o_dt FROM nation
       UNION ALL SELECT 'urn:kg:nation/' || n_nationkey, 'urn:kg:name', n_name, 'literal', '', '{XSD}string' FROM nation""",
)


@query("kg_describe", f"""
SELECT 'urn:kg:nation/3' AS s, '{RDF}type' AS p, 'urn:kg:Nation' AS o, 'uri' AS o_kind FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'urn:kg:nation/3', '{RDFS}label', n_name, 'literal' FROM nation WHERE n_nationkey = 3
UNION ALL SELECT 'urn:kg:nation/3', 'urn:kg:partOf', 'urn:kg:region/' || n_regionkey, 'uri' FROM nation WHERE n_nationkey = 3
UNION ALL (SELECT s, 'urn:kg:locatedIn', 'urn:kg:nation/3', 'uri' FROM (
  SELECT 'urn:kg:customer/' || c_custkey AS s FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey FROM supplier WHERE s_nationkey = 3)
  ORDER BY s LIMIT 300)""")  # fmt: skip
def kg_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparql.rows(dm.store(spark, sf_dir), "DESCRIBE <urn:kg:nation/3>").select("s", "p", "o", "o_kind")


@query("kg_service", """SELECT 'urn:kg:nation/' || n_nationkey AS n, count(*) AS k, round(max(s_acctbal), 6) AS top
FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1""")
def kg_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers are in a second store, reached as a service."""
    parts = dm.mapped(spark, sf_dir)
    here = [parts[k] for k in parts if k.startswith("nation.")]
    there = [parts[k] for k in parts if k.startswith("supplier.")]
    union = lambda xs: QuadStore(_union(xs), set())
    text = "SELECT ?n (COUNT(?s) AS ?k) (MAX(?b) AS ?top) WHERE { ?n a kg:Nation SERVICE <urn:kg:suppliers> { ?s kg:locatedIn ?n ; kg:balance ?b } } GROUP BY ?n"
    df = sparql.rows(union(here), text, {"urn:kg:suppliers": union(there)})
    return df.select("n", _typed("k", "bigint"), _typed("top", "double"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _counted(p: str, *parts: tuple[str, str, str]) -> str:
    """SQL that counts the rows, keys and values of columns (table, key, value) of one predicate; rows with nulls are no quads."""
    rows = " UNION ALL ".join(f"SELECT '{t}' AS t, {k} AS k, {v} AS v FROM {t}" for t, k, v in parts)
    return f"""SELECT 'urn:kg:graph/data' AS g, '{p}' AS p, count(*) AS n, count(DISTINCT (t, k)) AS n_s, count(DISTINCT v) AS n_o
FROM ({rows}) WHERE k IS NOT NULL AND v IS NOT NULL HAVING count(*) > 0"""


@query("kg_triple_counts", " UNION ALL ".join([
    _counted(f"{RDF}type", ("region", "r_regionkey", "'Region'"), ("nation", "n_nationkey", "'Nation'"), ("customer", "c_custkey", "'Customer'"),
        ("supplier", "s_suppkey", "'Supplier'"), ("part", "p_partkey", "'Part'"), ("documents", "doc_id", "'Document'"),
        ("orders", "o_orderkey", "CASE WHEN o_orderpriority LIKE '1%' THEN 'UrgentOrder' WHEN o_orderpriority LIKE '2%' THEN 'PriorityOrder' ELSE 'Order' END")),
    _counted(f"{RDFS}label", ("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")),
    _counted("urn:kg:partOf", ("nation", "n_nationkey", "n_regionkey")),
    _counted("urn:kg:locatedIn", ("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")),
    _counted("urn:kg:balance", ("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")),
    _counted("urn:kg:segment", ("customer", "c_custkey", "c_mktsegment")),
    _counted("urn:kg:size", ("part", "p_partkey", "p_size")),
    _counted("urn:kg:brand", ("part", "p_partkey", "p_brand")),
    _counted("urn:kg:placedBy", ("orders", "o_orderkey", "o_custkey")),
    _counted("urn:kg:price", ("orders", "o_orderkey", "o_totalprice")),
    _counted("urn:kg:status", ("orders", "o_orderkey", "o_orderstatus")),
    _counted("urn:kg:orderDate", ("orders", "o_orderkey", "CAST(o_orderdate AS DATE)")),
    _counted("urn:kg:content", ("documents", "doc_id", "CASE WHEN text IS NOT NULL THEN (text, coalesce(lang, '')) END")),
    _counted("urn:kg:source", ("documents", "doc_id", "source")),
    f"""SELECT 'urn:kg:graph/ontology', * FROM (VALUES ('{RDFS}subClassOf', 6, 6, 4), ('{OWL}disjointWith', 1, 1, 1), ('{RDF}type', 2, 2, 2),
('{OWL}inverseOf', 2, 2, 2), ('{RDFS}domain', 1, 1, 1), ('{RDFS}range', 1, 1, 1), ('{RDFS}subPropertyOf', 1, 1, 1))""",
]))
def kg_triple_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.store(spark, sf_dir).stats().select("g", "p", "n", "n_s", "n_o")


# reasoning

def _some(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Triples of some tables, without the texts of documents."""
    parts = dm.mapped(spark, sf_dir)
    return _union([parts[k] for k in parts if k in names or k.split(".")[0] in names]).drop("g")


@query("kg_closure_types", """SELECT c, count(*) AS n FROM (
SELECT unnest(CASE WHEN o_orderpriority LIKE '1%' THEN ['UrgentOrder', 'PriorityOrder', 'Order'] WHEN o_orderpriority LIKE '2%' THEN ['PriorityOrder', 'Order'] ELSE ['Order'] END) AS c FROM orders) GROUP BY 1""")
def kg_closure_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = checks.types_of(_some(spark, sf_dir, f"orders.{RDF}type"))
    every = reason.with_super_types(types, reason.superclasses(dm.ontology(spark)))
    return every.groupBy(F.substring("c", 8, 99).alias("c")).agg(F.count("*").alias("n"))


@query("kg_most_specific", """SELECT 'urn:kg:orders/' || o_orderkey AS s,
CASE WHEN o_orderpriority LIKE '1%' THEN 'urn:kg:UrgentOrder' WHEN o_orderpriority LIKE '2%' THEN 'urn:kg:PriorityOrder' ELSE 'urn:kg:Order' END AS c FROM orders""")
def kg_most_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = checks.types_of(_some(spark, sf_dir, f"orders.{RDF}type"))
    closure = reason.superclasses(dm.ontology(spark))
    return reason.most_specific(reason.with_super_types(types, closure), closure)


@query("kg_rl_inferred_counts", f"""
SELECT '{RDF}type' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)
  + (SELECT coalesce(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 2 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 0 END), 0)::BIGINT FROM orders) AS n
UNION ALL SELECT 'urn:kg:hasPart', count(*) FROM nation UNION ALL SELECT 'urn:kg:placed', count(*) FROM orders
UNION ALL SELECT 'urn:kg:relatedTo', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)""")  # fmt: skip
def kg_rl_inferred_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _some(spark, sf_dir, "region", "nation", "customer", "supplier", f"orders.{RDF}type", "orders.placedBy")
    return reason.close(data, dm.ontology(spark)).groupBy("p").agg(F.count("*").alias("n"))


def _closed(spark: SparkSession, data: DataFrame, axioms: list[tuple]) -> DataFrame:
    rows = [(s, p, o, kind, "", "") for s, p, o, kind in axioms]
    return reason.close(data, spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_lang string, o_dt string"))


@query("kg_inverse", "SELECT 'urn:kg:customer/' || o_custkey AS s, 'urn:kg:orders/' || o_orderkey AS o FROM orders")
def kg_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _closed(spark, _some(spark, sf_dir, "orders.placedBy"), [(KG + "placedBy", OWL + "inverseOf", KG + "placed", "uri")])
    return out.where(F.col("p") == KG + "placed").select("s", "o")


@query("kg_transitive", """SELECT 'urn:kg:customer/' || c_custkey AS s, 'urn:kg:region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def kg_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _some(spark, sf_dir, "customer.locatedIn", "nation.partOf").withColumn("p", F.lit(KG + "within"))
    return _closed(spark, data, [(KG + "within", RDF + "type", OWL + "TransitiveProperty", "uri")]).select("s", "o")


@query("kg_chain", """SELECT 'urn:kg:customer/' || c_custkey AS s, 'urn:kg:region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey, 'urn:kg:region/' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def kg_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _some(spark, sf_dir, "customer.locatedIn", "supplier.locatedIn", "nation.partOf")
    chain = [
        (KG + "locatedIn", OWL + "propertyChainAxiom", "_:a", "bnode"), ("_:a", RDF + "first", KG + "locatedIn", "uri"), ("_:a", RDF + "rest", "_:b", "bnode"),
        ("_:b", RDF + "first", KG + "partOf", "uri"), ("_:b", RDF + "rest", RDF + "nil", "uri"),
    ]
    return _closed(spark, data, chain).where(F.col("p") == KG + "locatedIn").select("s", "o")


@query("kg_domain_range", """SELECT 'urn:kg:orders/' || o_orderkey AS s, 'urn:kg:Order' AS c FROM orders UNION ALL SELECT DISTINCT 'urn:kg:customer/' || o_custkey, 'urn:kg:Customer' FROM orders""")
def kg_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    axioms = [(KG + "placedBy", RDFS + "domain", KG + "Order", "uri"), (KG + "placedBy", RDFS + "range", KG + "Customer", "uri")]
    return _closed(spark, _some(spark, sf_dir, "orders.placedBy"), axioms).select("s", F.col("o").alias("c"))


@query("kg_has_value", "SELECT 'urn:kg:nation/' || n_nationkey AS s, 'urn:kg:earth' AS o FROM nation")
def kg_has_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    axioms = [(KG + "Nation", RDFS + "subClassOf", "_:r", "bnode"), ("_:r", OWL + "onProperty", KG + "planet", "uri"), ("_:r", OWL + "hasValue", KG + "earth", "uri")]
    return _closed(spark, _some(spark, sf_dir, f"nation.{RDF}type"), axioms).where(F.col("p") == KG + "planet").select("s", "o")


# constraints

@query("kg_disjoint_violation", """SELECT 'urn:kg:customer/' || c_custkey AS s, 'urn:kg:Organisation' AS a, 'urn:kg:Place' AS b FROM customer WHERE c_custkey % 97 = 0""")
def kg_disjoint_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = checks.types_of(_some(spark, sf_dir, f"customer.{RDF}type", f"nation.{RDF}type"))
    wrong = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 97 = 0").select(dm.node("customer", "c_custkey").alias("s"), F.lit(KG + "Region").alias("c"))
    axioms = dm.ontology(spark)
    return checks.disjoint_violations(types.unionByName(wrong), reason.disjoint_pairs(axioms), reason.superclasses(axioms))


@query("kg_functional_violation", "SELECT 'urn:kg:orders/' || o_orderkey AS s, 'urn:kg:placedBy' AS p, 2 AS n FROM orders WHERE o_orderkey % 89 = 0 AND o_custkey <> 1")
def kg_functional_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _some(spark, sf_dir, "orders.placedBy")
    extra = data.where("cast(substring(s, 15) AS bigint) % 89 = 0").withColumn("o", F.lit(KG + "customer/1"))
    functional = reason.pairs(dm.ontology(spark), RDF + "type").where(F.col("o") == OWL + "FunctionalProperty").select(F.col("s").alias("p"))
    return checks.functional_violations(data.unionByName(extra), functional)


@query("kg_datatype_violation", f"""SELECT 'urn:kg:orders/' || o_orderkey AS s, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') || '-32' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS o, '{XSD}date' AS o_dt
FROM orders WHERE o_orderkey % 50 = 0""")
def kg_datatype_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _some(spark, sf_dir, "orders.orderDate", "orders.price")
    key, day = F.expr("cast(substring(s, 15) AS bigint)"), F.col("o")
    bad = F.when(key % 3 == 0, F.concat(F.substring(day, 1, 7), F.lit("-32"))).otherwise(F.concat(F.substring(day, 9, 2), F.lit("/"), F.substring(day, 6, 2), F.lit("/"), F.substring(day, 1, 4)))
    data = data.withColumn("o", F.when((key % 50 == 0) & (F.col("o_dt") == XSD + "date"), bad).otherwise(day))
    return checks.datatype_violations(data).select("s", "o", "o_dt")


def _shaped(spark: SparkSession, sf_dir: str, names: tuple[str, ...], shape: checks.Shape) -> DataFrame:
    return checks.shape_violations(_some(spark, sf_dir, *names), [shape]).select("focus", "component", "n")


@query("kg_shape_mincount", f"""SELECT 'urn:kg:customer/' || c_custkey AS focus, CASE WHEN n = 0 THEN 'minCount' ELSE 'maxCount' END AS component, n FROM
(SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN ({_F_ORDERS}) ON o_custkey = c_custkey GROUP BY 1) WHERE n = 0 OR n > 8""")
def kg_shape_mincount(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = _some(spark, sf_dir, "orders.status").where("o = 'F'").select("s")
    placed = _some(spark, sf_dir, "orders.placedBy").join(closed, "s", "left_semi")
    mine = placed.select(F.col("o").alias("s"), F.lit(KG + "closed").alias("p"), F.col("s").alias("o"), "o_kind", "o_lang", "o_dt")
    data = _some(spark, sf_dir, f"customer.{RDF}type").unionByName(mine)
    shape = checks.Shape(target_class=KG + "Customer", properties=[checks.Property(KG + "closed", min_count=1, max_count=8)])
    return checks.shape_violations(data, [shape]).select("focus", "component", "n")


@query("kg_shape_range", """SELECT 'urn:kg:customer/' || c_custkey AS focus, CASE WHEN c_acctbal < 0 THEN 'minInclusive' ELSE 'maxInclusive' END AS component, 1 AS n FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000""")
def kg_shape_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir, ("customer.balance",), checks.Shape(KG + "balance", None, [checks.Property(KG + "balance", datatype=XSD + "double", min_inclusive=0, max_inclusive=9000)]))


@query("kg_shape_lang", """SELECT 'urn:kg:documents/' || doc_id AS focus, unnest(['languageIn', 'qualifiedMinCount']) AS component, unnest([1, 0]) AS n FROM documents WHERE coalesce(lang, '') NOT IN ('en', 'fr')""")
def kg_shape_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = checks.Property(KG + "content", languages=["en", "fr"], qualified=(["en", "fr"], 1))
    return _shaped(spark, sf_dir, ("documents.content",), checks.Shape(KG + "content", None, [shape]))


@query("kg_shape_nodekind", "SELECT 'urn:kg:nation/' || n_nationkey AS focus, 'nodeKind' AS component, 1 AS n FROM nation")
def kg_shape_nodekind(spark: SparkSession, sf_dir: str) -> DataFrame:
    properties = [checks.Property(RDFS + "label", node_kind="IRI"), checks.Property(KG + "partOf", node_kind="IRI")]
    return _shaped(spark, sf_dir, ("nation",), checks.Shape(KG + "partOf", None, properties))


# labels, facts

@query("kg_label_pref", """SELECT source AS s, text AS label FROM (
SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, text) AS r FROM documents) WHERE r = 1""")
def kg_label_pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    quads = docs.select(F.lit("g").alias("g"), F.col("source").alias("s"), F.lit(RDFS + "label").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.col("lang").alias("o_lang"), F.lit("").alias("o_dt"))
    return QuadStore(quads, set()).labels(("fr", "de"))


@query("kg_asserted_over_inferred", """SELECT 'urn:kg:Nation' AS o, false AS inferred UNION ALL SELECT 'urn:kg:Place', true""")
def kg_asserted_over_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _some(spark, sf_dir, f"nation.{RDF}type")
    derived = reason.close(data, dm.ontology(spark))
    quads = data.withColumn("g", F.lit(dm.DATA)).unionByName(derived.unionByName(data).withColumn("g", F.lit(dm.INFERRED)))
    return QuadStore(quads).facts("urn:kg:nation/2", dm.INFERRED).select("o", "inferred")


@query("crawl_depth", """WITH RECURSIVE e AS (SELECT 'region/' || n_regionkey AS a, 'nation/' || n_nationkey AS b FROM nation UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer
  UNION ALL SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey FROM orders),
w AS (SELECT 'region/1' AS node, 0 AS level UNION ALL SELECT 'nation/2', 0 UNION ALL SELECT b, level + 1 FROM w JOIN e ON node = a WHERE level < 2)
SELECT node, min(level) AS level FROM w GROUP BY 1""")
def crawl_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    edge = lambda t, a, ka, b, kb: read(t).select(F.concat(F.lit(a + "/"), ka).alias("parent"), F.concat(F.lit(b + "/"), kb).alias("child"))
    edges = _union([edge("nation", "region", "n_regionkey", "nation", "n_nationkey"), edge("customer", "nation", "c_nationkey", "customer", "c_custkey"), edge("orders", "customer", "o_custkey", "orders", "o_orderkey")])
    roots = spark.createDataFrame([("region/1", 2), ("nation/2", 2)], "node string, depth int")
    return paths.crawl(roots, edges).select("node", "level")


# extraction, profiles and linking over the driver's tables

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("kg_nt_roundtrip", f"""SELECT 'urn:kg:documents/' || doc_id AS s, text AS o, coalesce(lang, '') AS o_lang FROM documents WHERE text IS NOT NULL""")
def kg_nt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of all texts written as N-Triples lines and read again; a null text is no quad."""
    from quadrel.operators.state import settled
    from quadrel.sources import ntriples

    lines = settled(ntriples.as_lines(dm.mapped(spark, sf_dir)["documents.content"].drop("g")))
    path = lines.inputFiles()[0].rsplit("/", 1)[0] + "-lines"
    lines.write.mode("overwrite").text(path)
    return ntriples.read_ntriples(spark, path).select("s", "o", "o_lang")


@query("kg_search", """SELECT s, label, CASE WHEN f = 'at' THEN 0 WHEN starts_with(f, 'at') THEN 1 ELSE 2 END AS rank FROM (
SELECT s, label, replace(lower(strip_accents(label)), 'đ', 'd') AS f FROM (SELECT 'urn:kg:region/' || r_regionkey AS s, r_name AS label FROM region
UNION ALL SELECT 'urn:kg:nation/' || n_nationkey, n_name FROM nation UNION ALL SELECT 'urn:kg:customer/' || c_custkey, c_name FROM customer
UNION ALL SELECT 'urn:kg:supplier/' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'urn:kg:part/' || p_partkey, p_name FROM part))
WHERE contains(f, 'at') ORDER BY rank, length(label), s LIMIT 100""")
def kg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.store(spark, sf_dir).search("ÁT", 100)


@query("rule_classify", """SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' AND p_name LIKE 'a%' THEN NULL WHEN p_brand IN ('Brand#11', 'Brand#21') THEN 'Branded' WHEN lower(p_type) LIKE 'small%' THEN 'Small' WHEN p_type LIKE '%BRASS%' THEN 'Brass' END AS cls FROM part""")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import mapping

    part = _table(spark, sf_dir, "part").withColumn("cats", F.array("p_brand"))
    blocked = (F.contains("p_type", F.lit("STEEL")) & F.startswith("p_name", F.lit("a")))
    rules = [{"source_category": "Brand#11", "class": "Branded"}, {"source_category": "Brand#21", "class": "Branded"}, {"title_prefix": "small", "class": "Small"}, {"title_contains": "brass", "class": "Brass"}]
    return part.select("p_partkey", F.when(~blocked, mapping.first_rule(rules, F.col("p_type"), F.col("cats"))["cls"]).alias("cls"))


@query("parse_year", "SELECT o_orderkey, CAST(nullif(regexp_extract(CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN 'in ' || strftime(o_orderdate, '%Y') WHEN 2 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '\\b(1\\d{3}|20\\d{2})\\b', 1), '') AS INTEGER) AS y FROM orders")
def parse_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    return _date_forms(spark, sf_dir).select("o_orderkey", linking.year_of(F.col("form")).alias("y"))


def _date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    form = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.concat(F.lit("in "), F.date_format(d, "yyyy"))).when(k == 2, F.lit("x")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", form.alias("form"))


@query("parse_date_forms", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v, CASE o_orderkey % 4 WHEN 1 THEN 'gYear' ELSE 'date' END AS kind FROM orders WHERE o_orderkey % 4 <> 2")
def parse_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.functions import parsers

    forms = _date_forms(spark, sf_dir).withColumn("v", F.explode(parsers.parsed(F.col("form"), "date")))
    return forms.select("o_orderkey", "v.v", "v.kind")


@query("parse_number_vi", "SELECT c_custkey, floor(abs(c_acctbal)) AS num FROM customer")
def parse_number_vi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.functions import parsers

    n = F.format_number(F.floor(F.abs("c_acctbal")), 0)
    raw = F.when(F.col("c_custkey") % 2 == 0, n).otherwise(F.translate(n, ",", "."))
    return _table(spark, sf_dir, "customer").select("c_custkey", F.explode(parsers.parsed(F.concat(raw, F.lit(" '''x'''")), "int")).alias("v")).select("c_custkey", "v.num")


@query("parse_url_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\d?\.', '') AS host FROM pages")
def parse_url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    return _table(spark, sf_dir, "pages").select("page_id", linking.domain(F.col("url")).alias("host"))


@query("page_link_counts", """SELECT p_size, count(*) AS n, count(DISTINCT t) AS n_targets FROM (SELECT p_size, unnest([upper(substr(p_name, 1, 1)) || substr(p_name, 2), upper(substr(p_type, 1, 1)) || substr(p_type, 2)]) AS t FROM part) GROUP BY 1""")
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of markup made of the names and types of parts: shown texts, fragments, a file and a reference around them."""
    from quadrel.functions import parsers

    marks = F.concat(F.lit("'''[["), "p_name", F.lit("#x|"), "p_type", F.lit("]]''' [[Tập tin:a.jpg|nhỏ|[["), "p_type", F.lit("]]]]<ref>[["), "p_brand", F.lit("]]</ref>"))
    links = _table(spark, sf_dir, "part").select("p_size", F.explode(parsers.scanned(marks)["links"]).alias("h"))
    return links.groupBy("p_size").agg(F.count("*").alias("n"), F.count_distinct("h").alias("n_targets"))


@query("text_lead", r"SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), ' +', ' ', 'g')) AS head FROM documents")
def text_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of all texts, with a heading put after the first line; a null text has a null lead. The SQL only knows texts
    without wiki marks, as those of the driver's tables are; tests hold marks against leads written by hand."""
    from quadrel.functions import wikitext

    @F.pandas_udf("string")
    def lead(s: pd.Series) -> pd.Series:
        return s.map(lambda t: wikitext.lead(t.replace("\n", "\n== h ==\n", 1), 1 << 30), na_action="ignore")

    return _table(spark, sf_dir, "documents").select("doc_id", lead("text").alias("head"))


@query("fold_name", "SELECT doc_id, replace(replace(lower(strip_accents(text)), 'đ', 'd'), 'ß', 'ss') AS f FROM documents")
def fold_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.functions.terms import fold

    return _table(spark, sf_dir, "documents").select("doc_id", F.replace(fold(F.col("text")), F.lit("ß"), F.lit("ss")).alias("f"))


@query("profile_shares", """SELECT event_type, n, rank, round(n / total, 6) AS share, round(run / total, 6) AS running FROM (
SELECT event_type, n, row_number() OVER o AS rank, sum(n) OVER () AS total, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) WINDOW o AS (ORDER BY n DESC, event_type))""")
def profile_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import profile

    df = profile.shares(profile.frequencies(_table(spark, sf_dir, "events"), "event_type"), "event_type")
    return df.select("event_type", "n", "rank", F.round("share", 6).alias("share"), F.round("running", 6).alias("running"))


@query("profile_top_per_key", """SELECT source, lang, n, rank FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS rank FROM documents GROUP BY 1, 2) WHERE rank <= 2""")
def profile_top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import profile

    return profile.top_per_key(_table(spark, sf_dir, "documents"), "source", "lang", 2)


@query("keyword_prefix", "SELECT k AS keyword, count(*) AS n FROM part JOIN (VALUES ('SMALL'), ('SMALL PLATED'), ('ECONOMY'), ('STANDARD')) t(k) ON p_type = k OR starts_with(p_type, k || ' ') GROUP BY 1")
def keyword_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import profile

    return profile.keyword_groups(_table(spark, sf_dir, "part"), "p_type", ["SMALL", "SMALL PLATED", "ECONOMY", "STANDARD"]).groupBy("keyword").agg(F.count("*").alias("n"))


_PLACES = """WITH a AS (SELECT c_custkey, c_nationkey, c_name, (c_custkey * 7 % 180) - 90.0 AS lat, (c_custkey * 13 % 360) - 180.0 AS lon FROM customer),
b AS (SELECT s_suppkey, s_nationkey, s_name, (s_suppkey * 11 % 180) - 90.0 AS lat, (s_suppkey * 17 % 360) - 180.0 AS lon FROM supplier)"""


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers with places that their keys give."""
    a = _table(spark, sf_dir, "customer").selectExpr("c_nationkey AS block", "c_custkey", "double(c_custkey * 7 % 180 - 90) AS lat", "double(c_custkey * 13 % 360 - 180) AS lon")
    b = _table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS block", "s_suppkey", "double(s_suppkey * 11 % 180 - 90) AS lat2", "double(s_suppkey * 17 % 360 - 180) AS lon2")
    return a, b


_KM = "12742 * asin(least(1, sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query("haversine", f"{_PLACES} SELECT c_custkey, s_suppkey, round({_KM}, 3) AS km FROM a JOIN b ON c_nationkey = s_nationkey")
def haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    km = linking.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return linking.block_pairs(*_places(spark, sf_dir), ["lat", "lon"], ["lat2", "lon2"], {"km": F.round(km, 3)}).select("c_custkey", "s_suppkey", "km")


@query("weighted_score", f"""{_PLACES}, m AS (SELECT c_custkey, s_suppkey, greatest(0, least(1, 1 - ({_KM} - 800) / 7200)) AS geo, CASE WHEN abs(c_custkey % 50 - s_suppkey % 50) <= 1 THEN 1.0 WHEN abs(c_custkey % 50 - s_suppkey % 50) <= 3 THEN 0.5 ELSE 0.0 END AS yr,
CASE WHEN c_custkey % 5 = s_suppkey % 5 THEN 1.0 END AS hp FROM a JOIN b ON c_nationkey = s_nationkey)
SELECT c_custkey, s_suppkey, round(CASE WHEN hp >= 1 THEN greatest(0.9, (0.25 + 0.1 * geo + 0.05 * yr) / 0.4) ELSE (0.1 * geo + 0.05 * yr) / (0.1 + 0.05) END, 6) AS score FROM m""")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    km = linking.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    measures = {
        "geo": linking.geo_similarity(km, F.lit(800.0)), "year": linking.year_similarity(F.col("year"), F.col("year2")), "homepage": F.when(F.col("host") == F.col("host2"), 1.0),
    }
    a, b = _places(spark, sf_dir)
    a, b = a.selectExpr("*", "c_custkey % 50 AS year", "c_custkey % 5 AS host"), b.selectExpr("*", "s_suppkey % 50 AS year2", "s_suppkey % 5 AS host2")
    mine = ["lat", "lon", "year", "host"]
    return linking.block_pairs(a, b, mine, [c + "2" for c in mine], {"score": F.round(linking.weighted(measures), 6)}).select("c_custkey", "s_suppkey", "score")


@query("token_jaccard", """SELECT a.p_partkey AS x, b.p_partkey AS y, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS j
FROM (SELECT *, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part) a JOIN (SELECT *, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_size").alias("block"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    alike = F.round(linking.token_jaccard(F.col("a"), F.col("b")), 6)
    pairs = linking.block_pairs(part.withColumnsRenamed({"p_partkey": "x", "t": "a"}), part.withColumnsRenamed({"p_partkey": "y", "t": "b"}), ["a"], ["b"], {"j": alike})
    return pairs.where("x < y").select("x", "y", "j")


@query("seqmatch_ratio")
def seqmatch_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    part = _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_size").alias("block"), F.lower("p_name").alias("t"))
    alike = linking.name_similarity(F.col("a"), F.col("b"))
    pairs = linking.block_pairs(part.withColumnsRenamed({"p_partkey": "x", "t": "a"}), part.withColumnsRenamed({"p_partkey": "y", "t": "b"}), ["a"], ["b"], {"sim": alike})
    return pairs.where("x < y").select("x", "y", "sim")


@query("greedy_one_to_one", f"""{_PLACES.replace("WITH", "WITH RECURSIVE")}, p AS (SELECT row_number() OVER (ORDER BY score DESC, s, u) AS i, * FROM (
SELECT c_custkey::BIGINT AS s, s_suppkey::BIGINT AS u, round(1 - ({_KM}) / 20016, 4) AS score FROM a JOIN b ON c_nationkey = s_nationkey) WHERE score >= 0.3),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS us, []::BIGINT[] AS uu, NULL::BIGINT AS s, NULL::BIGINT AS u, NULL::DOUBLE AS score
UNION ALL SELECT i, CASE WHEN ok THEN list_append(us, ps) ELSE us END, CASE WHEN ok THEN list_append(uu, pu) ELSE uu END, CASE WHEN ok THEN ps END, CASE WHEN ok THEN pu END, CASE WHEN ok THEN pscore END
FROM (SELECT p.i AS i, us, uu, p.s AS ps, p.u AS pu, p.score AS pscore, NOT list_contains(us, p.s) AND NOT list_contains(uu, p.u) AS ok FROM r JOIN p ON p.i = r.i + 1))
SELECT s, u, score FROM r WHERE s IS NOT NULL""")
def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    km = linking.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    a, b = _places(spark, sf_dir)
    return linking.assign_blocks(a.withColumnRenamed("c_custkey", "s"), b.withColumnRenamed("s_suppkey", "u"), ["lat", "lon"], ["lat2", "lon2"], F.round(1 - km / 20016, 4))


_BEST = "(SELECT doc_id AS s, doc_id % 3 AS u, (doc_id * 37 % 101) / 100.0 AS score, source FROM documents)"
_GOLD = "(SELECT doc_id AS s, quality AS g FROM labels)"


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    best = _table(spark, sf_dir, "documents").selectExpr("doc_id AS s", "doc_id % 3 AS u", "(doc_id * 37 % 101) / 100D AS score")
    return best, _table(spark, sf_dir, "labels").selectExpr("doc_id AS s", "quality AS g")


@query("threshold_sweep", f"""SELECT threshold, judged, correct, gold, "new", round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM (
SELECT *, CASE WHEN judged = 0 THEN 0 ELSE correct / judged END AS p, CASE WHEN gold = 0 THEN 0 ELSE correct / gold END AS r FROM (
SELECT t AS threshold, count(*) FILTER (score >= t AND g IS NOT NULL) AS judged, count(*) FILTER (score >= t AND u = g) AS correct, count(g) AS gold, count(*) FILTER (score >= t AND g IS NULL) AS "new"
FROM {_BEST} b FULL JOIN {_GOLD} g USING (s) CROSS JOIN (VALUES (0.5::DOUBLE), (0.75), (0.9)) v(t) GROUP BY 1))""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    df = linking.evaluate(*_judged(spark, sf_dir), [0.5, 0.75, 0.9])
    return df.select("threshold", "judged", "correct", "gold", "new", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("wilson_interval", """WITH k AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, n, round(greatest(0, (good / n + 3.8416 / (2 * n) - 1.96 * sqrt(good / n * (1 - good / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
round(least(1, (good / n + 3.8416 / (2 * n) + 1.96 * sqrt(good / n * (1 - good / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high FROM k""")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    k = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    low, high = linking.wilson(F.col("good"), F.col("n"))
    return k.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("link_status", """SELECT status, count(*) AS n, count(DISTINCT target) AS n_targets FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'redirect' WHEN c_nationkey < 20 THEN 'exists' ELSE 'missing' END AS status,
CASE WHEN c_custkey % 10 = 0 THEN 'r' || c_custkey ELSE 'n' || c_custkey END AS target FROM customer) GROUP BY 1""")
def link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import linking

    c = _table(spark, sf_dir, "customer").selectExpr("c_custkey AS s", "concat('n', c_custkey) AS o", "c_nationkey")
    seen = c.where("c_nationkey < 20").select(F.col("o").alias("iri"))
    moved = c.where("s % 10 = 0").selectExpr("o AS source", "concat('r', s) AS target")
    return linking.validated(c.select("s", "o"), seen, moved).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("target").alias("n_targets"))


@query("graph_union_dedupe", "SELECT count(*) AS n FROM (SELECT DISTINCT text, lang FROM documents)")
def graph_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.lit("x").alias("s"), F.lit("p").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), F.col("lang").alias("o_lang"), F.lit("").alias("o_dt"))
    store = QuadStore(docs.withColumn("g", F.lit("a"))).add("b", docs)
    return store.scan(None, "p").agg(F.count("*").alias("n"))


@query("intersect_sets", "SELECT count(*) AS n FROM (SELECT text FROM documents WHERE source = 'src1' INTERSECT SELECT text FROM documents WHERE source <> 'src1')")
def intersect_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.where("source = 'src1'").select("text").intersect(d.where("source <> 'src1'").select("text")).agg(F.count("*").alias("n"))


@query("except_asserted", "SELECT 'urn:kg:UrgentOrder' AS c, 'urn:kg:Order' AS super")
def except_asserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the class hierarchy that are derived and not asserted."""
    axioms = dm.ontology(spark)
    asserted = axioms.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("c"), F.col("o").alias("super"))
    return reason.superclasses(axioms).where("c <> super").select("c", "super").exceptAll(asserted)


@query("except_sets", "SELECT source, count(*) AS n FROM (SELECT DISTINCT source, text FROM documents EXCEPT SELECT source, text FROM documents WHERE lang = 'en') GROUP BY 1")
def except_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("source", "text").subtract(d.where("lang = 'en'").select("source", "text")).groupBy("source").agg(F.count("*").alias("n"))


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.operators import profile

    return profile.seeded_sample(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 7)


@query("windowed_events", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadrel.streaming import windowed_counts

    return windowed_counts(_table(spark, sf_dir, "events")).select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


from quadrel.plans import catalogue_more  # noqa: E402, F401  registers its queries
