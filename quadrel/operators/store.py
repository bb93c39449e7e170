"""The quad store: a DataFrame of (g, s, p, o, o_kind, o_lang, o_dt), one row per quad."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.terms import OWL, RDF, RDFS, compact, fold

COLUMNS = ["g", "s", "p", "o", "o_kind", "o_lang", "o_dt"]
TRIPLE = COLUMNS[1:]


class QuadStore:
    """Named graphs over one quads DataFrame. A query without GRAPH sees their union, without duplicates.

    shared: predicates that occur in several graphs; only for these (None: for all) the union has to be made distinct.
    counts: quads per predicate, for the order of joins."""

    def __init__(self, quads: DataFrame, shared: set[str] | None = None, counts: dict[str, int] | None = None):
        self.quads, self.spark, self.shared, self.counts = quads, quads.sparkSession, shared, counts or {}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuadStore:
        return cls(spark.read.parquet(path).select(COLUMNS))

    def save(self, path: str, graphs: list[str] | None = None) -> None:
        """Parquet partitioned by graph and predicate; with graphs only these are replaced."""
        df = self.quads.dropDuplicates().where(F.col("g").isin(graphs)) if graphs else self.quads.dropDuplicates()
        writer = df.repartition("g", "p", F.pmod(F.xxhash64("s"), F.lit(16))).sortWithinPartitions("g", "p", "s").write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic" if graphs else "static").partitionBy("g", "p").parquet(path)

    def add(self, graph: str, triples: DataFrame) -> QuadStore:
        return QuadStore(self.quads.unionByName(triples.select(F.lit(graph).alias("g"), *TRIPLE)), None, self.counts)

    def scan(self, graph, predicate: str | None, s: str | None = None, o: str | None = None) -> DataFrame:
        """Quads of a graph (a term or variable of the parser, None: the union) with a predicate (None: any); s, o: IRIs of the only
        subject or object asked for. The caller still filters by them."""
        df = self.quads if predicate is None else self.quads.where(F.col("p") == predicate)
        if graph is None:
            once = self.shared is not None and (predicate not in self.shared if predicate else not self.shared)
            return df.select(TRIPLE) if once else df.select(TRIPLE).distinct()
        return df.where(F.col("g") == graph[2]) if graph[0] == "term" else df

    def expected(self, p) -> float:
        """Quads that a predicate or path of the parser may match."""
        if p[0] == "term":
            return self.counts.get(p[2], 1e6)
        return 1e7 if p[0] in ("var", "repeat") else min(map(self.expected, p[1] if isinstance(p[1], list) else [p[1]]))

    def stats(self) -> DataFrame:
        """Quads, distinct subjects and distinct objects (with their kinds, languages and types) per graph and predicate."""
        return self.quads.groupBy("g", "p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_s"), F.count_distinct("o", "o_kind", "o_lang", "o_dt").alias("n_o"))

    def with_counts(self) -> QuadStore:
        """The same with counts and shared from one pass; predicates are few."""
        seen = self.quads.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("g").alias("graphs")).collect()
        return QuadStore(self.quads, {r["p"] for r in seen if r["graphs"] > 1}, {r["p"]: r["n"] for r in seen})

    def labels(self, langs: tuple[str, ...] = ("vi", "en")) -> DataFrame:
        """(s, label): by language rank, then any other, ties by code point."""
        rank = reduce(lambda c, i: c.when(F.col("o_lang") == langs[i], i), range(1, len(langs)), F.when(F.col("o_lang") == langs[0], 0)).otherwise(len(langs))
        known = self.scan(None, RDFS + "label").where("o_kind = 'literal'")
        return known.groupBy("s").agg(F.min(F.struct(rank.alias("r"), F.col("o").alias("v")))["v"].alias("label"))

    def named(self, df: DataFrame, column: str, langs: tuple[str, ...] = ("vi", "en")) -> DataFrame:
        """df with column_label: the label, else the compact or local name."""
        known = self.labels(langs).withColumnsRenamed({"s": column, "label": "_label"})
        local = F.regexp_extract(compact(F.col(column)), r"([^/#]*)$", 1)
        return df.join(known, column, "left").withColumn(f"{column}_label", F.coalesce("_label", local)).drop("_label")

    def describe(self, iri: str, incoming: int = 300, skip: tuple[str, ...] = ()) -> DataFrame:
        """Triples out of iri, and at most so many into it, least first; skip: predicates left out of the latter."""
        out = self.quads.where(F.col("s") == iri).select(TRIPLE)
        into = self.quads.where((F.col("o") == iri) & (F.col("o_kind") == "uri") & ~F.col("p").isin(list(skip))).select(TRIPLE)
        return out.unionByName(into.distinct().orderBy("p", "s").limit(incoming)).distinct()

    def facts(self, iri: str, inferred: str) -> DataFrame:
        """Triples out of iri with inferred: false if any other graph asserts them."""
        return self.quads.where(F.col("s") == iri).groupBy(TRIPLE).agg(F.min(F.col("g") == inferred).alias("inferred"))

    def instances(self, cls: str, limit: int = 500) -> DataFrame:
        found = self.scan(None, RDF + "type").where((F.col("o") == cls) & (F.col("o_kind") == "uri")).select("s").distinct()
        return self.named(found, "s").orderBy("s_label", "s").limit(limit)

    def terms(self, own: str, langs: tuple[str, ...] = ("vi", "en")) -> DataFrame:
        """(kind, s, label, comment): the classes, properties and datatypes of a namespace that the schema declares, by kind and IRI."""
        kinds = {OWL + "Class": "class", RDFS + "Class": "class", OWL + "ObjectProperty": "object property", OWL + "DatatypeProperty": "datatype property", RDF + "Property": "property", RDFS + "Datatype": "datatype"}
        kind = reduce(lambda out, k: out.when(F.col("o") == k, kinds[k]), kinds, F.when(F.lit(False), ""))
        typed = self.scan(None, RDF + "type").select("s", kind.alias("kind")).where(F.col("kind").isNotNull() & F.startswith("s", F.lit(own)))
        rank = reduce(lambda c, i: c.when(F.col("o_lang") == langs[i], i), range(1, len(langs)), F.when(F.col("o_lang") == langs[0], 0)).otherwise(len(langs))

        def said(p: str, name: str) -> DataFrame:
            known = self.scan(None, p).where("o_kind = 'literal'")
            return known.groupBy("s").agg(F.min(F.struct(rank.alias("r"), F.col("o").alias("v")))["v"].alias(name))

        out = typed.groupBy("s").agg(F.min("kind").alias("kind")).join(said(RDFS + "label", "label"), "s", "left").join(said(RDFS + "comment", "comment"), "s", "left")
        return out.select("kind", "s", "label", "comment").orderBy("kind", "s")

    def search(self, text: str, limit: int = 20) -> DataFrame:
        """(s, label, rank): labels that hold text without regard to case and accents; equal, then prefix, then inside;
        then the shorter label, then the IRI."""
        want = fold(F.lit(text))
        label = self.scan(None, RDFS + "label").where("o_kind = 'literal'").select("s", F.col("o").alias("label"), fold(F.col("o")).alias("f"))
        rank = F.when(F.col("f") == want, 0).when(F.startswith("f", want), 1).otherwise(2)
        hits = label.where(F.contains("f", want)).withColumn("rank", rank)
        best = hits.groupBy("s").agg(F.min(F.struct("rank", F.length("label").alias("n"), "label")).alias("b"))
        return best.select("s", "b.label", "b.rank", "b.n").orderBy("rank", "n", "s").limit(limit).drop("n")

    def resolve(self, name: str, base: str = "") -> str | None:
        """The IRI of an IRI, of a resource of that name, or of the best search hit."""
        if "://" in name or name.startswith("urn:"):
            return name
        iri = base + name.replace(" ", "_")
        if not self.quads.where(F.col("s") == iri).isEmpty():
            return iri
        hit = self.search(name, 1).first()
        return hit["s"] if hit else None

    def query(self, text: str, services: dict[str, QuadStore] | None = None) -> DataFrame:
        from quadrel.plans import sparql

        return sparql.rows(self, text, services)

    def ask(self, text: str) -> bool:
        return bool(self.query(text).first()[0])
