"""Constraints on triples: disjoint classes, functional properties, literal validity, shapes, ontology lint."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions.terms import NUMERIC, RDF, RDFS, XSD
from quadrel.operators.reason import with_super_types


def types_of(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("p") == RDF + "type") & (F.col("o_kind") == "uri")).select("s", F.col("o").alias("c")).distinct()


def disjoint_violations(types: DataFrame, disjoint: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(s, a, b): subjects with two disjoint types, after adding superclasses if closure is given."""
    every = with_super_types(types, closure) if closure is not None else types
    a = every.join(disjoint.withColumnRenamed("a", "c"), "c").select("s", F.col("c").alias("a"), "b")
    return a.join(every.withColumnRenamed("c", "b"), ["s", "b"]).select("s", "a", "b").distinct()


def functional_violations(triples: DataFrame, functional: DataFrame) -> DataFrame:
    """(s, p, n): more than one distinct object of a functional property (column p)."""
    values = triples.join(functional, "p", "left_semi").groupBy("s", "p").agg(F.count_distinct("o", "o_kind", "o_lang", "o_dt").alias("n"))
    return values.where("n > 1")


def valid_literal(value: Column, dt: Column) -> Column:
    """Whether the text is a value of its datatype; other datatypes are not checked."""
    whole = value.rlike(r"\A[+-]?\d+\z")
    number = value.rlike(r"\A(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN)\z")
    day = value.rlike(r"\A-?\d{4,}-\d\d-\d\d(?:Z|[+-]\d\d:\d\d)?\z") & F.substring(value, 1, 10).try_cast("date").isNotNull()
    moment = value.rlike(r"\A-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?\z") & value.try_cast("timestamp").isNotNull()
    return (
        F.when(dt == XSD + "date", day).when(dt == XSD + "dateTime", moment).when(dt == XSD + "integer", whole)
        .when(dt == XSD + "nonNegativeInteger", value.rlike(r"\A(?:\+?\d+|-0+)\z")).when(dt.isin(XSD + "double", XSD + "float", XSD + "decimal"), number).otherwise(True)
    )


def moment(text: Column) -> Column:
    """The timestamp of an ISO text, Z for an offset of zero; null if it is none."""
    iso = text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)?$")
    return F.when(iso, F.regexp_replace(text, "Z$", "+00:00").try_cast("timestamp"))


def dotted(n: Column) -> Column:
    """A whole number with dots between thousands."""
    return F.translate(F.format_number(n.cast("bigint"), 0), ",", ".")


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * x, digits), F.lit("%"))


def datatype_violations(triples: DataFrame) -> DataFrame:
    return triples.where((F.col("o_kind") == "literal") & ~valid_literal(F.col("o"), F.col("o_dt"))).select("s", "p", "o", "o_dt")


SH = "http://www.w3.org/ns/shacl#"


@dataclass
class Property:
    """A property shape; None means unconstrained. qualified: (languages, least number) of values in one of these languages."""

    path: str
    datatype: str | None = None
    node_kind: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    languages: list[str] | None = None
    qualified: tuple[list[str], int] | None = None


@dataclass
class Shape:
    """Targets are the subjects of target_subjects_of or the instances of target_class."""

    target_subjects_of: str | None = None
    target_class: str | None = None
    properties: list[Property] = field(default_factory=list)


def shapes_of(triples: DataFrame) -> list[Shape]:
    """The node shapes of a small SHACL graph, a shape per target; what is not served is refused."""
    from quadrel.operators.reason import lists

    members: dict[str, list[str]] = {}
    for r in lists(triples).orderBy("head", "place").collect():
        members.setdefault(r["head"], []).append(r["member"])
    facts: dict[str, dict[str, list[str]]] = {}
    for r in triples.where(F.startswith("p", F.lit(SH)) | (F.col("p") == RDF + "type")).select("s", "p", "o").distinct().orderBy("s", "p", "o").collect():
        facts.setdefault(r["s"], {}).setdefault(r["p"].removeprefix(SH), []).append(r["o"])
    one = lambda node, k: facts.get(node, {}).get(k, [None])[0]
    number = lambda x: None if x is None else float(x)
    whole = lambda x: None if x is None else int(x)

    def constraint(node: str) -> Property:
        known = {"path", "datatype", "nodeKind", "minCount", "maxCount", "minInclusive", "maxInclusive", "languageIn", "qualifiedValueShape", "qualifiedMinCount", "name", "description", "message", "severity", RDF + "type"}
        if odd := set(facts.get(node, {})) - known:
            raise ValueError(f"not served: {sorted(odd)}")
        inner = one(node, "qualifiedValueShape")
        qualified = (members[one(inner, "languageIn")], int(one(node, "qualifiedMinCount") or 1)) if inner else None
        langs = one(node, "languageIn")
        kind = one(node, "nodeKind")
        return Property(
            one(node, "path"), one(node, "datatype"), kind and kind.removeprefix(SH), whole(one(node, "minCount")), whole(one(node, "maxCount")), number(one(node, "minInclusive")),
            number(one(node, "maxInclusive")), members[langs] if langs else None, qualified,
        )

    out = []
    for f in facts.values():
        if SH + "NodeShape" in f.get(RDF + "type", ()):
            properties = [constraint(n) for n in f.get("property", ())]
            out += [Shape(target_subjects_of=p, properties=properties) for p in f.get("targetSubjectsOf", ())]
            out += [Shape(target_class=c, properties=properties) for c in f.get("targetClass", ())]
    return out


def shape_violations(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """(focus, path, component, n): one row per focus node and violated component; n is the number of values at fault or counted."""
    out = []
    for shape in shapes:
        p = shape.target_subjects_of or RDF + "type"
        target = triples.where(F.col("p") == p)
        if shape.target_class:
            target = target.where(F.col("o") == shape.target_class)
        target = target.select("s").distinct()
        for c in shape.properties:
            values = triples.where(F.col("p") == c.path)
            number = F.when(F.col("o_dt").isin(NUMERIC), F.col("o").try_cast("double"))
            tests: dict[str, Column] = {}
            if c.datatype:
                tests["datatype"] = (F.col("o_kind") == "literal") & (F.col("o_dt") == c.datatype) & valid_literal(F.col("o"), F.col("o_dt"))
            if c.node_kind:
                tests["nodeKind"] = F.col("o_kind") == {"IRI": "uri", "Literal": "literal", "BlankNode": "bnode"}[c.node_kind]
            if c.min_inclusive is not None:
                tests["minInclusive"] = number >= c.min_inclusive
            if c.max_inclusive is not None:
                tests["maxInclusive"] = number <= c.max_inclusive
            if c.languages:
                tests["languageIn"] = F.col("o_lang").isin(c.languages)
            wanted = F.col("o_lang").isin(c.qualified[0]) if c.qualified else F.lit(False)
            counts = values.groupBy("s").agg(
                F.count("*").alias("count"), F.count_if(wanted).alias("qualified"), *(F.count_if(~F.coalesce(t, F.lit(False))).alias(f"bad_{k}") for k, t in tests.items())
            )
            per = target.join(counts, "s", "left").na.fill(0)
            rules = {k: (F.col(f"bad_{k}") > 0, F.col(f"bad_{k}")) for k in tests}
            if c.min_count is not None:
                rules["minCount"] = (F.col("count") < c.min_count, F.col("count"))
            if c.max_count is not None:
                rules["maxCount"] = (F.col("count") > c.max_count, F.col("count"))
            if c.qualified:
                rules["qualifiedMinCount"] = (F.col("qualified") < c.qualified[1], F.col("qualified"))
            found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(k).alias("component"), n.alias("n"))) for k, (bad, n) in rules.items())))
            out.append(per.select(F.col("s").alias("focus"), F.lit(c.path).alias("path"), F.explode(found).alias("v")).select("focus", "path", "v.component", "v.n"))
    return reduce(DataFrame.unionByName, out)


def lint(axioms: DataFrame, own: str, langs: tuple[str, ...] = ("vi", "en")) -> DataFrame:
    """(term, problem): IRIs of the namespace own that are used but never described, and described ones without a label in a language."""
    mine = lambda c: F.startswith(c, F.lit(own))
    defined = axioms.where(mine(F.col("s"))).select(F.col("s").alias("term")).distinct()
    used = axioms.where(mine(F.col("o")) & (F.col("o_kind") == "uri")).select(F.col("o").alias("term")).distinct()
    out = [used.join(defined, "term", "left_anti").withColumn("problem", F.lit("dangling"))]
    for lang in langs:
        has = axioms.where((F.col("p") == RDFS + "label") & (F.col("o_lang") == lang)).select(F.col("s").alias("term"))
        out.append(defined.join(has, "term", "left_anti").withColumn("problem", F.lit(f"no label in {lang}")))
    return reduce(DataFrame.unionByName, out)
