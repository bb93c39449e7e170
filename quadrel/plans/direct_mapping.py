"""Relational tables as quads under urn:kg:. Each predicate is one projection, so a query reads only its tables and columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.terms import OWL, RDF, RDFS, XSD
from quadrel.operators.store import COLUMNS, QuadStore

KG = "urn:kg:"
DATA, ONTOLOGY, LINKS, INFERRED = (f"{KG}graph/{n}" for n in ("data", "ontology", "links", "inferred"))

#: Class tree, property axioms and disjointness of the mapped tables, as (subject, predicate, object).
AXIOMS = [
    ("UrgentOrder", RDFS + "subClassOf", "PriorityOrder"), ("PriorityOrder", RDFS + "subClassOf", "Order"),
    ("Customer", RDFS + "subClassOf", "Organisation"), ("Supplier", RDFS + "subClassOf", "Organisation"),
    ("Nation", RDFS + "subClassOf", "Place"), ("Region", RDFS + "subClassOf", "Place"),
    ("Organisation", OWL + "disjointWith", "Place"),
    ("partOf", RDF + "type", OWL + "TransitiveProperty"), ("partOf", OWL + "inverseOf", "hasPart"),
    ("placedBy", RDF + "type", OWL + "FunctionalProperty"), ("placedBy", OWL + "inverseOf", "placed"),
    ("placedBy", RDFS + "domain", "Order"), ("placedBy", RDFS + "range", "Customer"),
    ("locatedIn", RDFS + "subPropertyOf", "relatedTo"),
]


def node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{KG}{kind}/"), F.col(key).cast("string"))


def _quads(df: DataFrame, s: Column, p: str, o: Column, kind: str = "uri", lang: Column | str = "", dt: str = "", g: str = DATA) -> DataFrame:
    lang = F.lit(lang) if isinstance(lang, str) else lang
    p = p if ":" in p else KG + p
    return df.select(F.lit(g).alias("g"), s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), lang.alias("o_lang"), F.lit(dt).alias("o_dt")).where("s IS NOT NULL AND o IS NOT NULL")


def ontology(spark: SparkSession) -> DataFrame:
    full = lambda x: x if ":" in x else KG + x
    return spark.createDataFrame([(ONTOLOGY, full(s), full(p), full(o), "uri", "", "") for s, p, o in AXIOMS], ", ".join(f"{c} string" for c in COLUMNS))


class Parts(Mapping):
    """name -> quads of one predicate of one table; a table is opened and a projection built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.plans: dict[str, tuple] = {}
        self.tables: dict[str, DataFrame] = {}
        self.built: dict[str, DataFrame] = {}
        self.keys: dict[str, str] = {}  # of the subjects by table
        self.linked: dict[str, tuple[str, str]] = {}  # kind and key of objects that are rows, by part

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.built:
            table, *how = self.plans[name]
            if table not in self.tables:
                self.tables[table] = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
            self.built[name] = _quads(self.tables[table], *how)
        return self.built[name]

    def only(self, name: str, s: str | None, o: str | None) -> DataFrame:
        """The quads of a part that may have s as their subject and the IRI o as their object."""
        if s is None and o is None:
            return self[name]
        self[name]  # opens the table
        table, *how = self.plans[name]
        df = self.tables[table]
        for iri, kind, key in ((s, table, self.keys[table]), (o, *self.linked.get(name, (None, None)))):
            if iri is not None and key is not None:
                prefix, text = f"{KG}{kind}/", iri.removeprefix(f"{KG}{kind}/")
                value = F.lit(text).try_cast(df.schema[key].dataType)
                same = (F.col(key) == value) & (value.cast("string") == text)
                df = df.where(same if iri.startswith(prefix) else F.lit(False))
        return _quads(df, *how)

    def __iter__(self):
        return iter(self.plans)

    def __len__(self) -> int:
        return len(self.plans)


def mapped(spark: SparkSession, sf_dir: str) -> Parts:
    """The mapped predicates, named table.predicate."""
    out = Parts(spark, sf_dir)

    def put(table: str, key: str, p: str, o: Column, kind: str = "uri", lang: Column | str = "", dt: str = "") -> None:
        out.plans[f"{table}.{p}"] = (table, node(table, key), p, o, kind, lang, dt)
        out.keys[table] = key

    def link(table: str, key: str, p: str, to: str, by: str) -> None:
        put(table, key, p, node(to, by))
        out.linked[f"{table}.{p}"] = to, by

    string, double, integer = XSD + "string", XSD + "double", XSD + "integer"
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id"}
    names = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name"}
    classes = {"region": "Region", "nation": "Nation", "customer": "Customer", "supplier": "Supplier", "part": "Part", "documents": "Document"}
    for name, cls in classes.items():
        put(name, keys[name], RDF + "type", F.lit(KG + cls))
    urgent = F.col("o_orderpriority")
    put("orders", "o_orderkey", RDF + "type", F.when(F.startswith(urgent, F.lit("1")), KG + "UrgentOrder").when(F.startswith(urgent, F.lit("2")), KG + "PriorityOrder").otherwise(KG + "Order"))
    for name, col in names.items():
        put(name, keys[name], RDFS + "label", F.col(col), "literal", "", string)
    link("nation", "n_nationkey", "partOf", "region", "n_regionkey")
    link("customer", "c_custkey", "locatedIn", "nation", "c_nationkey")
    link("supplier", "s_suppkey", "locatedIn", "nation", "s_nationkey")
    put("customer", "c_custkey", "balance", F.col("c_acctbal"), "literal", "", double)
    put("supplier", "s_suppkey", "balance", F.col("s_acctbal"), "literal", "", double)
    put("customer", "c_custkey", "segment", F.col("c_mktsegment"), "literal", "", string)
    put("part", "p_partkey", "size", F.col("p_size"), "literal", "", integer)
    put("part", "p_partkey", "brand", F.col("p_brand"), "literal", "", string)
    link("orders", "o_orderkey", "placedBy", "customer", "o_custkey")
    put("orders", "o_orderkey", "price", F.col("o_totalprice"), "literal", "", double)
    put("orders", "o_orderkey", "status", F.col("o_orderstatus"), "literal", "", string)
    put("orders", "o_orderkey", "orderDate", F.date_format("o_orderdate", "yyyy-MM-dd"), "literal", "", XSD + "date")
    put("documents", "doc_id", "content", F.col("text"), "literal", F.coalesce(F.col("lang"), F.lit("")), "")
    put("documents", "doc_id", "source", F.col("source"), "literal", "", string)
    return out


class MappedStore(QuadStore):
    """The mapped tables and their ontology: a scan with a constant predicate only plans the projections that have it.

    The keys of the tables are unique and only rdf:type is in both graphs, about different subjects, so the union of the
    graphs has no duplicates."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.parts, self.schema_part = spark, mapped(spark, sf_dir), ontology(spark)
        self.shared, self.counts = set(), _COUNTS
        self.by_predicate: dict[str, list[str | None]] = {}  # names of parts; None: the ontology
        for name in self.parts:
            p = name.partition(".")[2]
            self.by_predicate.setdefault(p if ":" in p else KG + p, []).append(name)
        for p in {p if ":" in p else KG + p for _, p, _ in AXIOMS}:
            self.by_predicate.setdefault(p, []).append(None)

    @cached_property
    def quads(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [*self.parts.values(), self.schema_part])

    def scan(self, graph, predicate: str | None, s: str | None = None, o: str | None = None) -> DataFrame:
        """IRIs of rows become conditions on the keys of their tables, which reach the files."""
        if predicate is not None and predicate not in self.by_predicate:
            return super().scan(graph, predicate)
        names = [*self.parts, None] if predicate is None else self.by_predicate[predicate]
        found = [self.schema_part if n is None else self.parts.only(n, s, o) for n in names]
        if predicate is None:
            df = reduce(DataFrame.unionByName, found)
            return super().scan(graph, None) if s is None and o is None else df.select(COLUMNS[1:]) if graph is None else df.where(F.col("g") == graph[2]) if graph[0] == "term" else df
        df = reduce(DataFrame.unionByName, found).where(F.col("p") == predicate)
        return df.select(COLUMNS[1:]) if graph is None else df.where(F.col("g") == graph[2]) if graph[0] == "term" else df


def store(spark: SparkSession, sf_dir: str) -> MappedStore:
    return MappedStore(spark, sf_dir)


#: Relative sizes, for the order of joins.
_COUNTS = {
    KG + "partOf": 25, KG + "locatedIn": 10_000, KG + "placedBy": 150_000, KG + "price": 150_000, KG + "status": 150_000, KG + "orderDate": 150_000,
    KG + "balance": 10_000, KG + "segment": 10_000, KG + "size": 20_000, KG + "brand": 20_000, RDFS + "label": 50_000, RDF + "type": 300_000,
}
