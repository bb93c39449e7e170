"""OWL 2 RL rules that can fire on schema axioms, run semi-naively, and repairs of an ontology."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.terms import OWL, RDF, RDFS
from quadrel.operators.paths import transitive
from quadrel.operators.state import settled, unique, without
from quadrel.operators.store import TRIPLE

#: Schemas up to this many triples are closed on the driver and joined as local tables; larger ones are closed by Spark.
LOCAL_SCHEMA = 20_000
#: Predicates that a filter lists; more are joined.
LISTED = 200
SAME = OWL + "sameAs"
#: Begins predicates that stand for the first parts of chains.
STEP = "urn:chain:"
TYPE, SUBCLASS, SUBPROPERTY = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf"


def pairs(axioms: DataFrame, p: str) -> DataFrame:
    """(s, o) of a predicate between IRIs."""
    return axioms.where((F.col("p") == p) & (F.col("o_kind") == "uri") & ~F.startswith("s", F.lit("_:")) & ~F.startswith("o", F.lit("_:"))).select("s", "o").distinct()


def _collected(axioms: DataFrame) -> list[tuple] | None:
    """The rows of a schema whose size is within LOCAL_SCHEMA."""
    rows = axioms.select(TRIPLE).limit(LOCAL_SCHEMA + 1).collect()
    return list({tuple(r) for r in rows}) if len(rows) <= LOCAL_SCHEMA else None


def _local_lists(rows: list[tuple]) -> dict[str, list[str]]:
    first = {s: o for s, p, o, *_ in rows if p == RDF + "first"}
    rest = {s: o for s, p, o, *_ in rows if p == RDF + "rest"}
    out = {}
    for head in first.keys() - set(rest.values()):
        cell, out[head], seen = head, [], set()
        while cell in first and cell not in seen:
            seen.add(cell)
            out[head].append(first[cell])
            cell = rest.get(cell)
    return out


def _local_closure(edges: set[tuple[str, str]]) -> set[tuple[str, str]]:
    above: dict[str, set[str]] = {}
    for a, b in edges:
        above.setdefault(a, set()).add(b)
    out = set()
    for a in above:
        todo, seen = list(above[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += above.get(b, ())
        out |= {(a, b) for b in seen}
    return out


def _local_superclasses(rows: list[tuple]) -> set[tuple[str, str]]:
    """Strict or cyclic pairs, without the reflexive ones that superclasses() adds."""
    named = [(s, p, o) for s, p, o, k, *_ in rows if k == "uri" and not s.startswith("_:") and not o.startswith("_:")]
    edges = {(s, o) for s, p, o in named if p == SUBCLASS}
    for s, p, o in named:
        if p == OWL + "equivalentClass":
            edges |= {(s, o), (o, s)}
    members = _local_lists(rows)
    alias = {}
    for s, p, o, *_ in rows:
        if p == OWL + "equivalentClass" and o.startswith("_:"):
            alias.setdefault(o, []).append(s)
    for s, p, o, *_ in rows:
        if p == OWL + "unionOf":
            edges |= {(m, u) for m in members.get(o, ()) for u in alias.get(s, [s])}
    return _local_closure(edges)


def _frame(axioms: DataFrame, rows, fields: str) -> DataFrame:
    """A local table, to be broadcast: Spark doesn't know that it is small, and a shuffle by predicate or class is one task's for data of one."""
    return F.broadcast(axioms.sparkSession.createDataFrame(sorted(rows), ", ".join(f"{f} string" for f in fields.split())))


def lists(axioms: DataFrame) -> DataFrame:
    """(head, member, place) of RDF lists."""
    rows = _collected(axioms)
    if rows is not None:
        found = [(h, m, i) for h, ms in _local_lists(rows).items() for i, m in enumerate(ms)]
        return axioms.sparkSession.createDataFrame(found, "head string, member string, place int")
    first = axioms.where(F.col("p") == RDF + "first").select(F.col("s").alias("cell"), F.col("o").alias("member"))
    rest = axioms.where((F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    heads = first.join(rest.select(F.col("next").alias("cell")), "cell", "left_anti").select(F.col("cell").alias("head"), "cell")
    out, front = None, settled(heads)
    place = 0
    while not front.isEmpty():
        part = front.join(first, "cell").select("head", "member", F.lit(place).alias("place"))
        out = part if out is None else out.unionByName(part)
        front = settled(front.join(rest, "cell").select("head", F.col("next").alias("cell")))
        place += 1
    return out if out is not None else axioms.sparkSession.createDataFrame([], "head string, member string, place int")


def superclasses(axioms: DataFrame) -> DataFrame:
    """(c, super): reflexive and transitive over IRIs; equivalent classes and union members count as below each other and the union."""
    rows = _collected(axioms)
    if rows is not None:
        up = _local_superclasses(rows)
        return _frame(axioms, up | {(x, x) for pair in up for x in pair}, "c super")
    edges = pairs(axioms, SUBCLASS)
    same = pairs(axioms, OWL + "equivalentClass")
    members = lists(axioms)
    union = axioms.where(F.col("p") == OWL + "unionOf").select(F.col("s").alias("u"), F.col("o").alias("head")).join(members, "head").select(F.col("member").alias("s"), F.col("u").alias("o"))
    named = axioms.where((F.col("p") == OWL + "equivalentClass") & F.startswith("o", F.lit("_:"))).select(F.col("o").alias("u"), F.col("s").alias("c"))
    direct = union.join(named.withColumnRenamed("u", "o"), "o", "left").select("s", F.coalesce("c", "o").alias("o"))
    edges = reduce(DataFrame.unionByName, [edges, same, same.select(F.col("o").alias("s"), F.col("s").alias("o")), direct])
    nodes = edges.select("s").unionByName(edges.select(F.col("o").alias("s"))).distinct()
    return transitive(edges).unionByName(nodes.select("s", F.col("s").alias("o"))).distinct().select(F.col("s").alias("c"), F.col("o").alias("super"))


def with_super_types(types: DataFrame, closure: DataFrame) -> DataFrame:
    """(s, c): asserted types and all above them."""
    up = types.join(closure, "c", "left").select("s", F.coalesce("super", "c").alias("c"))
    return unique(up.unionByName(types.select("s", "c")), types)


def most_specific(types: DataFrame, closure: DataFrame) -> DataFrame:
    """(s, c) without classes that have another type of the same subject strictly below them."""
    strict = closure.where("c <> super")
    return without(types.select("s", "c"), types.join(strict, "c").select("s", F.col("super").alias("c")))


def disjoint_pairs(axioms: DataFrame) -> DataFrame:
    """(a, b), a < b, from disjointWith and all pairs of AllDisjointClasses lists."""
    plain = pairs(axioms, OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    sets = axioms.where((F.col("p") == TYPE) & (F.col("o") == OWL + "AllDisjointClasses")).select("s")
    heads = axioms.where(F.col("p") == OWL + "members").join(sets, "s", "left_semi").select(F.col("o").alias("head"))
    members = lists(axioms).join(heads, "head", "left_semi")
    other = members.select("head", F.col("member").alias("b"), F.col("place").alias("place_b"))
    listed = members.withColumnRenamed("member", "a").join(other, "head").where("place < place_b").select("a", "b")
    both = plain.unionByName(listed)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


class Rules:
    """The schema of an ontology, closed once; its tables are small against the data and joined as they are."""

    def __init__(self, axioms: DataFrame):
        rows = _collected(axioms)
        if rows is not None:
            self._from_rows(axioms, rows)
        else:
            self._from_frame(axioms)

    def _from_rows(self, axioms: DataFrame, rows: list[tuple]) -> None:
        """Tables that have no rows are None, and their rules are left out of the plan."""
        named = [(s, p, o) for s, p, o, k, *_ in rows if k == "uri" and not s.startswith("_:") and not o.startswith("_:")]
        of = lambda *ps: {(s, o) for s, p, o in named if p in ps}
        table = lambda found, fields: _frame(axioms, found, fields) if found else None
        self.classes = table({(a, b) for a, b in _local_superclasses(rows) if a != b}, "c super")
        same = of(OWL + "equivalentProperty")
        self.properties = table({(a, b) for a, b in _local_closure(of(SUBPROPERTY) | same | {(b, a) for a, b in same}) if a != b}, "s o")
        inverse = of(OWL + "inverseOf")
        self.inverse = table(inverse | {(b, a) for a, b in inverse}, "s o")
        self.domain, self.range = table(of(RDFS + "domain"), "s o"), table(of(RDFS + "range"), "s o")
        kinds = lambda k: sorted(s for s, o in of(TYPE) if o == OWL + k)
        self.transitive = kinds("TransitiveProperty")
        self.symmetric = table({(s,) for s in kinds("SymmetricProperty")}, "s")
        self.functional = table({(s,) for s in kinds("FunctionalProperty")}, "s")
        members = _local_lists(rows)
        alias = {o: s for s, p, o, *_ in rows if p == OWL + "equivalentClass" and o.startswith("_:")}
        self.members = table({(m, alias.get(s, s)) for s, p, o, *_ in rows if p == OWL + "oneOf" for m in members.get(o, ()) if not alias.get(s, s).startswith("_:")}, "s o")
        self.chains = {(s, o): members[o] for s, p, o, *_ in rows if p == OWL + "propertyChainAxiom" and o in members}
        on = {s: o for s, p, o, *_ in rows if p == OWL + "onProperty"}
        values = {s: (o, *rest) for s, p, o, *rest in rows if p == OWL + "hasValue"}
        found = {(s, on[o], *values[o]) for s, p, o, *_ in rows if p in (SUBCLASS, OWL + "equivalentClass") and o in on and o in values}
        self.has_value = table(found, "c p o o_kind o_lang o_dt")
        #: Predicates that a rule reads or gives; triples of others never take part.
        both = of(SUBPROPERTY, OWL + "equivalentProperty") | inverse
        self.used = {TYPE, SAME, *self.transitive, *kinds("SymmetricProperty"), *kinds("FunctionalProperty"), *(x for pair in both for x in pair)}
        self.used |= {s for s, _ in of(RDFS + "domain", RDFS + "range")} | {row[1] for row in found} | {p for p, _ in self.chains} | {m for c in self.chains.values() for m in c}

    def _from_frame(self, axioms: DataFrame) -> None:
        self.used = None
        self.classes = settled(superclasses(axioms).where("c <> super"))
        same = pairs(axioms, OWL + "equivalentProperty")
        props = pairs(axioms, SUBPROPERTY).unionByName(same).unionByName(same.select(F.col("o").alias("s"), F.col("s").alias("o")))
        self.properties = settled(transitive(props).where("s <> o"))
        inverse = pairs(axioms, OWL + "inverseOf")
        self.inverse = settled(inverse.unionByName(inverse.select(F.col("o").alias("s"), F.col("s").alias("o"))).distinct())
        self.domain, self.range = settled(pairs(axioms, RDFS + "domain")), settled(pairs(axioms, RDFS + "range"))
        kinds = pairs(axioms, TYPE)
        self.transitive = [r["s"] for r in kinds.where(F.col("o") == OWL + "TransitiveProperty").collect()]
        self.symmetric = kinds.where(F.col("o") == OWL + "SymmetricProperty").select("s")
        self.functional = kinds.where(F.col("o") == OWL + "FunctionalProperty").select("s")
        alias = axioms.where((F.col("p") == OWL + "equivalentClass") & F.startswith("o", F.lit("_:"))).select(F.col("o").alias("c"), F.col("s").alias("named"))
        listed = axioms.where(F.col("p") == OWL + "oneOf").select(F.col("s").alias("c"), F.col("o").alias("head")).join(lists(axioms), "head").join(alias, "c", "left")
        self.members = settled(listed.select(F.col("member").alias("s"), F.coalesce("named", "c").alias("o")).where("o NOT LIKE '\\_:%'"))
        chains = axioms.where(F.col("p") == OWL + "propertyChainAxiom").select(F.col("s").alias("p"), F.col("o").alias("head")).join(lists(axioms), "head")
        self.chains: dict[tuple[str, str], list[str]] = {}
        for r in chains.orderBy("p", "head", "place").collect():
            self.chains.setdefault((r["p"], r["head"]), []).append(r["member"])
        on = axioms.where(F.col("p") == OWL + "onProperty").select(F.col("s").alias("r"), F.col("o").alias("p"))
        value = axioms.where(F.col("p") == OWL + "hasValue").select(F.col("s").alias("r"), F.col("o"), "o_kind", "o_lang", "o_dt")
        above = axioms.where(F.col("p").isin(SUBCLASS, OWL + "equivalentClass")).select(F.col("s").alias("c"), F.col("o").alias("r"))
        self.has_value = settled(on.join(value, "r").join(above, "r").select("c", "p", "o", "o_kind", "o_lang", "o_dt"))

    def premises(self, triples: DataFrame) -> DataFrame:
        """The triples that can take part in a rule."""
        if self.used is None:
            return triples
        if len(self.used) <= LISTED:
            return triples.where(F.col("p").isin(sorted(self.used)))
        return triples.join(_frame(triples, {(x,) for x in self.used}, "p"), "p", "left_semi").select(triples.columns)

    def facts(self, triples: DataFrame) -> DataFrame:
        """What holds without any premise: the types of listed members."""
        none = triples.select(TRIPLE).limit(0)
        if self.members is None:
            return none
        blank = [F.lit("uri").alias("o_kind"), F.lit("").alias("o_lang"), F.lit("").alias("o_dt")]
        return none.unionByName(self.members.select("s", F.lit(TYPE).alias("p"), "o", *blank))

    def compositions(self) -> list[tuple[str, str, str]]:
        """(p, first, second): p holds where first leads to second. Chains longer than two go through predicates of their own."""
        out = [(p, p, p) for p in self.transitive]
        for (p, head), chain in self.chains.items():
            left = chain[0]
            for k, right in enumerate(chain[1:], 2):
                name = p if k == len(chain) else f"{STEP}{p}|{head}|{k}"
                out.append((name, left, right))
                left = name
        return out

    def step(self, delta: DataFrame, total: DataFrame) -> DataFrame:
        """What the rules derive with at least one premise in delta; a triple may come several times."""
        typed = delta.where(F.col("p") == TYPE)
        objects = delta.where("o_kind = 'uri'")
        blank = [F.lit("uri").alias("o_kind"), F.lit("").alias("o_lang"), F.lit("").alias("o_dt")]
        named = lambda df, a, b: df.select(F.col("s").alias(a), F.col("o").alias(b))
        out = []

        def rule(table: DataFrame | None, build) -> None:
            if table is not None:
                out.append(build(table))

        rule(self.classes, lambda t: typed.select("s", F.col("o").alias("c")).join(t, "c").select("s", F.lit(TYPE).alias("p"), F.col("super").alias("o"), *blank))
        rule(self.properties, lambda t: delta.join(named(t, "p", "q"), "p").select("s", F.col("q").alias("p"), "o", "o_kind", "o_lang", "o_dt"))
        rule(self.inverse, lambda t: objects.join(named(t, "p", "q"), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"), *blank))
        rule(self.symmetric, lambda t: objects.join(t.select(F.col("s").alias("p")), "p").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), *blank))
        rule(self.domain, lambda t: delta.join(named(t, "p", "c"), "p").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"), *blank))
        rule(self.range, lambda t: objects.join(named(t, "p", "c"), "p").select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"), *blank))
        rule(self.has_value, lambda t: typed.select("s", F.col("o").alias("c")).join(t, "c").select(*TRIPLE))
        links = total.where("o_kind = 'uri'")
        for p, first, second in self.compositions():
            for left, right in ((objects, links), (links, objects)):
                a = left.where(F.col("p") == first).select("s", F.col("o").alias("m"))
                b = right.where(F.col("p") == second).select(F.col("s").alias("m"), "o")
                out.append(a.join(b, "m").select("s", F.lit(p).alias("p"), "o", *blank))
        for (p, _), chain in self.chains.items():
            if len(chain) == 1:
                out.append(delta.where(F.col("p") == chain[0]).select("s", F.lit(p).alias("p"), "o", "o_kind", "o_lang", "o_dt"))

        def functional(t: DataFrame) -> DataFrame:
            """Objects that a functional property gives one subject are the same: each as the least of them."""
            changed = objects.join(t.select(F.col("s").alias("p")), "p", "left_semi").select("s", "p").distinct()
            found = links.join(changed, ["s", "p"], "left_semi").select("s", "p", "o").distinct()
            least = found.groupBy("s", "p").agg(F.min("o").alias("a"), F.max("o").alias("b")).where("a <> b").select("s", "p", "a")
            return found.join(least, ["s", "p"]).where("o <> a").select(F.col("o").alias("s"), F.lit(SAME).alias("p"), F.col("a").alias("o"), *blank)

        rule(self.functional, functional)
        return reduce(DataFrame.unionByName, out, delta.limit(0))


def close(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """Triples derived from triples by the rules of axioms and not among them: no owl:Thing, no type of a literal. It ends when a round
    derives nothing."""
    rules = Rules(axioms)
    total = delta = settled(unique(rules.premises(triples.select(TRIPLE))))
    first = settled(without(rules.facts(triples), total))
    derived = None
    if not first.isEmpty():
        derived, total = first, total.unionByName(first)
        delta = total
    while True:
        delta = settled(without(rules.step(delta, total).where(F.col("o") != OWL + "Thing"), total))
        if delta.isEmpty():
            out = derived if derived is not None else delta
            return out.where(~F.startswith("p", F.lit(STEP)))
        derived = delta if derived is None else derived.unionByName(delta)
        total = total.unionByName(delta)


def about(derived: DataFrame, prefix: str) -> DataFrame:
    """The derived triples worth keeping: of subjects below prefix, without blank objects, owl:Thing and a thing being the same as itself."""
    same = (F.col("p") == SAME) & (F.col("s") == F.col("o"))
    return derived.where(F.startswith("s", F.lit(prefix)) & (F.col("o_kind") != "bnode") & ~F.startswith("o", F.lit("_:")) & (F.col("o") != OWL + "Thing") & ~same)


def same_as(triples: DataFrame, axioms: DataFrame) -> DataFrame:
    """(a, b): objects that a functional property makes the same, each with the least of them."""
    functional = pairs(axioms, TYPE).where(F.col("o") == OWL + "FunctionalProperty").select(F.col("s").alias("p"))
    links = triples.where("o_kind = 'uri'").join(functional, "p", "left_semi").select("s", "p", "o").distinct()
    low = links.groupBy("s", "p").agg(F.min("o").alias("a"), F.max("o").alias("top")).where("a <> top")
    return links.join(low, ["s", "p"]).where("o <> a").select("a", F.col("o").alias("b")).distinct()


def repaired(axioms: DataFrame, own: str, foreign: list[str], datatypes: list[str]) -> DataFrame:
    """Without equivalent properties to the namespaces foreign (either way), equivalences to an external term that two or
    more terms of the namespace own share, and ranges of datatype properties outside datatypes."""
    mine = lambda c: F.startswith(c, F.lit(own))
    alien = lambda c: reduce(lambda a, b: a | b, [F.startswith(c, F.lit(f)) for f in foreign], F.lit(False))
    same_p = F.col("p") == OWL + "equivalentProperty"
    out = axioms.where(~(same_p & (mine(F.col("s")) & alien(F.col("o")) | mine(F.col("o")) & alien(F.col("s")))))
    same = out.where(F.col("p").isin(OWL + "equivalentClass", OWL + "equivalentProperty") & mine(F.col("s")) & (F.col("o_kind") == "uri") & ~mine(F.col("o")))
    many = same.groupBy("p", "o").agg(F.count_distinct("s").alias("n")).where("n > 1").select("p", "o")
    shared = same.join(many, ["p", "o"], "left_semi").select("s", "p", "o")
    out = out.join(shared, ["s", "p", "o"], "left_anti")
    data = pairs(axioms, TYPE).where(F.col("o") == OWL + "DatatypeProperty").select("s")
    bad = out.where((F.col("p") == RDFS + "range") & ~F.col("o").isin(datatypes)).join(data, "s", "left_semi").select("s", "p", "o")
    return out.join(bad, ["s", "p", "o"], "left_anti")
