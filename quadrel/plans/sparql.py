"""SPARQL queries compiled to DataFrame plans over a quad store.

Every variable is a column holding a term struct (kind, value, lang, dt); null is unbound. Graph patterns become joins
(OPTIONAL: left, with the filters inside it as join conditions; NOT EXISTS and MINUS: anti), unions, closures and aggregates. Expressions that fail are
null, which SQL's three-valued logic treats as SPARQL treats errors. Constants of a pattern are filters on the flat
columns of the store, so they reach the scan.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrel.functions.terms import NUMERIC, XSD, term
from quadrel.operators import paths
from quadrel.plans.sparql_parser import parse

_FIELDS = ("kind", "value", "lang", "dt")


class Value:
    """A compiled expression of kind term, num, str or bool."""

    def __init__(self, kind: str, col: Column, dt: str = ""):
        self.kind, self.col, self.dt = kind, col, dt

    def term(self) -> Column:
        if self.kind == "term":
            return self.col
        if self.kind == "num":
            whole = F.when(self.col == F.floor(self.col), F.floor(self.col).cast("string"))
            text = self.col.cast("bigint").cast("string") if self.dt == XSD + "integer" else F.coalesce(whole, self.col.cast("string"))
            return F.when(self.col.isNotNull(), term("literal", text, "", self.dt or XSD + "decimal"))
        dt = XSD + ("boolean" if self.kind == "bool" else "string")
        return F.when(self.col.isNotNull(), term("literal", self.col.cast("string"), "", dt))

    def num(self) -> Column:
        if self.kind == "num":
            return self.col
        if self.kind == "term":
            return F.when(self.col["dt"].isin(NUMERIC), self.col["value"].try_cast("double"))
        return F.lit(None).cast("double")

    def str(self) -> Column:
        return self.col["value"] if self.kind == "term" else self.term()["value"]

    def bool(self) -> Column:
        if self.kind == "bool":
            return self.col
        if self.kind == "num":
            return self.col != 0
        if self.kind == "str":
            return self.col != ""
        c = self.col
        return F.when(c["dt"] == XSD + "boolean", c["value"] == "true").when(c["dt"].isin(NUMERIC), self.num() != 0).when(c["kind"] == "literal", c["value"] != "")


def constant(t) -> Column:
    return term(t[1], F.lit(t[2]), t[3], t[4])


class Solutions:
    """A DataFrame of bindings; maybe holds the variables that may be unbound."""

    def __init__(self, df: DataFrame, names: list[str], maybe: set[str] = frozenset()):
        self.df, self.names, self.maybe = df, names, set(maybe)


class Compiler:
    def __init__(self, store, services: dict | None = None):
        self.store, self.services, self.spark = store, services or {}, store.spark

    # graph patterns

    def unit(self) -> Solutions:
        return Solutions(self.spark.createDataFrame([(0,)], "_unit int").drop("_unit"), [])

    def group(self, node, graph=None) -> Solutions:
        out, filters = None, []
        for item in node[1]:
            kind = item[0]
            if kind == "filter":
                filters.append(item[1])
            elif kind == "optional":
                out = self.optional(out or self.unit(), item[1], graph)
            elif kind == "minus":
                out = self.minus(out or self.unit(), self.group(item[1], graph))
            elif kind == "bind":
                out = out or self.unit()
                value = self.expression(item[2], out, graph).term()
                out = Solutions(out.df.withColumn(item[1], value), [*out.names, item[1]], out.maybe | {item[1]})
            else:
                part = self.pattern(item, graph)
                out = part if out is None else self.join(out, part)
        out = out or self.unit()
        for f in filters:
            out = self.filtered(out, f, graph)
        return out

    def pattern(self, item, graph) -> Solutions:
        kind = item[0]
        if kind == "bgp":
            return self.bgp(item[1], graph)
        if kind == "group":
            return self.group(item, graph)
        if kind == "union":
            return self.union([self.group(g, graph) for g in item[1]])
        if kind == "graph":
            return self.group(item[2], item[1])
        if kind == "values":
            return self.values(item)
        if kind == "subselect":
            return self.select(item[1], graph)
        if kind == "service":
            if item[1][2] not in self.services:
                raise LookupError(f"no store is registered for {item[1][2]}")
            return Compiler(self.services[item[1][2]], self.services).group(item[2])
        raise NotImplementedError(kind)

    def values(self, item) -> Solutions:
        _, names, rows = item
        kind = T.StructType([T.StructField(n, T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS])) for n in names])
        data = [tuple(None if t is None else tuple(t[1:]) for t in row) for row in rows]
        return Solutions(self.spark.createDataFrame(data, kind), list(names), {n for i, n in enumerate(names) if any(r[i] is None for r in data)})

    def bgp(self, triples, graph) -> Solutions:
        """Join the patterns, next always the one with the fewest expected rows among those that share a variable."""
        todo = list(triples)
        if not todo:
            return self.unit()
        out, bound = None, set()
        names = lambda t: {x[1] for x in t if x[0] == "var"}
        while todo:
            linked = [t for t in todo if names(t) & bound] or todo
            best = min(linked, key=lambda t: (self.store.expected(t[1]) / (1000 if t[2][0] == "term" else 1) / (10_000 if t[0][0] == "term" else 1), todo.index(t)))
            todo.remove(best)
            part = self.triple(best, graph)
            out = part if out is None else self.join(out, part)
            bound |= names(best)
        return out

    def counted(self, triples, needed: set[str], graph) -> Solutions:
        """The solutions of a basic pattern in the variables needed, column _w saying how often each comes. Sequences of a path become patterns; the
        variables that are not needed are grouped away one by one, each time the one that leaves the fewest, so solutions are never spelled out."""
        flat, todo, fresh = [], list(triples), count()
        while todo:
            s, p, o = todo.pop(0)
            if p[0] == "seq":
                ends = [s, *(("var", f"_q{next(fresh)}") for _ in p[1][1:]), o]
                todo = [(a, x, b) for a, x, b in zip(ends[:-1], p[1], ends[1:], strict=True)] + todo
            elif p[0] == "inv":
                todo.insert(0, (o, p[1], s))
            else:
                flat.append((s, p, o))
        parts = []
        for t in flat:
            part = self.triple(t, graph)
            parts.append(Solutions(part.df.withColumn("_w", F.lit(1).cast("bigint")), part.names))

        def met(a: Solutions, b: Solutions) -> Solutions:
            left, right = (Solutions(x.df.withColumnRenamed("_w", w), [*x.names, w]) for x, w in ((a, "_wa"), (b, "_wb")))
            out = self.join(left, right).df.withColumn("_w", F.col("_wa") * F.col("_wb")).drop("_wa", "_wb")
            return Solutions(out, [*a.names, *(n for n in b.names if n not in a.names)])

        while rest := {n for x in parts for n in x.names} - needed:
            left = lambda v: {n for x in parts if v in x.names for n in x.names} - {v}
            v = min(sorted(rest), key=lambda v: len(left(v)))
            one = reduce(met, [x for x in parts if v in x.names])
            names = [n for n in one.names if n != v]
            parts = [x for x in parts if v not in x.names] + [Solutions(one.df.groupBy(*names).agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("_w")), names)]
        out = parts.pop(0)
        while parts:
            k = next((i for i, x in enumerate(parts) if set(x.names) & set(out.names)), 0)
            out = met(out, parts.pop(k))
        return out

    def triple(self, t, graph) -> Solutions:
        s, p, o = t
        if p[0] in ("term", "var"):
            known = {"s": s[2] if s[0] == "term" else None, "o": o[2] if o[0] == "term" and o[1] == "uri" else None}
            df = self.store.scan(graph, p[2] if p[0] == "term" else None, **known)
            subject, predicate = term(F.when(F.startswith("s", F.lit("_:")), "bnode").otherwise("uri"), F.col("s")), term("uri", F.col("p"))
            obj = term(F.col("o_kind"), F.col("o"), F.col("o_lang"), F.col("o_dt"))
        else:
            ends = {k: self.spark.range(1).select(constant(x).alias(k)) for k, x in (("s", s), ("o", o)) if x[0] == "term"}
            df = self.path(p, graph, ends.get("s"), None if "s" in ends else ends.get("o"))
            subject, obj, predicate = F.col("s"), F.col("o"), None
        cols: dict[str, Column] = {}
        where = []
        slots = [(s, subject), (o, obj)] + ([(p, predicate)] if p[0] == "var" else [])
        if graph is not None and graph[0] == "var":
            slots.append((graph, term("uri", F.col("g"))))
        for what, col in slots:
            if what[0] == "var":
                if what[1] in cols:
                    where.append(cols[what[1]] == col)
                cols.setdefault(what[1], col)
            elif p[0] in ("term", "var"):
                if what is s:
                    where.append(F.col("s") == what[2])
                else:
                    where += [F.col("o_kind") == what[1], F.col("o") == what[2], F.col("o_lang") == what[3], F.col("o_dt") == what[4]]
            else:
                where.append(col == constant(what))
        if where:
            df = df.where(reduce(Column.__and__, where))
        return Solutions(df.select(*(c.alias(n) for n, c in cols.items())), list(cols))

    def path(self, p, graph, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
        """(s, o) of a property path, both terms. starts (s) or ends (o), if given, are all that is asked for: walks begin there."""
        kind = p[0]
        if kind == "term":
            df = self.store.scan(graph, p[2])
            df = df.select(term(F.when(F.startswith("s", F.lit("_:")), "bnode").otherwise("uri"), F.col("s")).alias("s"), term(F.col("o_kind"), F.col("o"), F.col("o_lang"), F.col("o_dt")).alias("o"))
            df = df if starts is None else df.join(starts, "s", "left_semi")
            return df if ends is None else df.join(ends, "o", "left_semi")
        turned = lambda df, a, b: None if df is None else df.withColumnRenamed(a, b)
        if kind == "inv":
            return self.path(p[1], graph, turned(ends, "o", "s"), turned(starts, "s", "o")).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "alt":
            return reduce(DataFrame.unionByName, [self.path(x, graph, starts, ends) for x in p[1]])
        if kind == "seq":
            steps = list(p[1])
            if starts is None and ends is not None:
                out = self.path(steps.pop(), graph, None, ends)
                while steps:
                    middle = out.select(F.col("s").alias("o")).distinct()
                    out = self.path(steps.pop(), graph, None, middle).withColumnRenamed("o", "m").join(out.withColumnRenamed("s", "m"), "m").select("s", "o")
                return out
            out = self.path(steps[0], graph, starts)
            for x in steps[1:]:
                middle = out.select(F.col("o").alias("s")).distinct() if starts is not None else None
                out = out.withColumnRenamed("o", "m").join(self.path(x, graph, middle).withColumnRenamed("s", "m"), "m").select("s", "o")
            return out if ends is None else out.join(ends, "o", "left_semi")
        _, inner, low, high = p
        edges = self.path(inner, graph)
        if starts is not None:
            out = paths.reach(starts, edges, low, high)
            return out if ends is None else out.join(ends, "o", "left_semi")
        if ends is not None:
            back = paths.reach(turned(ends, "o", "s"), edges.select(F.col("o").alias("s"), F.col("s").alias("o")), low, high)
            return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
        parts = []
        if low == 0:
            every = self.store.scan(graph, None)
            node = every.select(term("uri", F.col("s")).alias("s")).unionByName(every.select(term(F.col("o_kind"), F.col("o"), F.col("o_lang"), F.col("o_dt")).alias("s")))
            parts.append(node.distinct().select("s", F.col("s").alias("o")))
        if high is None:
            parts.append(paths.transitive(edges) if low <= 1 else paths.transitive(edges).join(paths.bounded(edges, low, low), ["s", "o"]))
        elif high > 0:
            parts.append(paths.bounded(edges, max(low, 1), high))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()

    # joins

    def _on(self, a: Solutions, b: Solutions) -> tuple[list[str], list[str]]:
        shared = [n for n in a.names if n in b.names]
        return shared, [n for n in shared if n in a.maybe or n in b.maybe]

    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition=None) -> Solutions:
        """Joins are on equal keys: where a shared variable may be unbound, the rows are parted by which are bound. Groups that share no
        variable, and rows whose shared variables are all unbound, go with everything, as the language says."""
        shared, loose = self._on(a, b)
        names = a.names + [n for n in b.names if n not in a.names]
        maybe = {n for n in names if (n in a.maybe or n not in a.names) and (n in b.maybe or n not in b.names)}
        if how == "left":
            maybe |= {n for n in b.names if n not in a.names} | {n for n in a.maybe}
        right = b.df.select(*(F.col(n).alias("_r_" + n) for n in b.names)) if b.names else b.df
        cols = [F.coalesce(n, "_r_" + n).alias(n) if n in loose else F.col(n) if n in a.names else F.col("_r_" + n).alias(n) for n in names]
        met = [x.join(y, on, "inner") if on is not None else x.crossJoin(y) for x, y, on in self._parted(a, right, b, shared, loose, condition)]
        if how == "left" and len(met) == 1:
            x, y, on = next(self._parted(a, right, b, shared, loose, condition))
            return Solutions(x.join(y, F.lit(True) if on is None else on, "left").select(*cols), names, maybe)
        out = reduce(DataFrame.unionByName, [df.select(*cols) for df in met])
        if how == "left":
            alone = self._unmatched(a, right, b, shared, loose, condition)
            out = out.unionByName(alone.select(*(F.col(n) if n in a.names else F.lit(None).cast(out.schema[n].dataType).alias(n) for n in names)))
        return Solutions(out, names, maybe)

    @staticmethod
    def _patterns(df: DataFrame, names: list[str], prefix: str = ""):
        """(rows of df, which of the names are bound there)."""
        for bound in _subsets(names):
            yield df.where(reduce(Column.__and__, [F.col(prefix + n).isNotNull() == F.lit(n in bound) for n in names])) if names else df, bound

    def _parted(self, a: Solutions, right: DataFrame, b: Solutions, shared: list[str], loose: list[str], condition=None):
        """(rows of a, rows of right, condition or None) of the joins that together pair all compatible rows, each once."""
        of_a, of_b = [n for n in loose if n in a.maybe], [n for n in loose if n in b.maybe]
        for x, bound_a in self._patterns(a.df, of_a):
            for y, bound_b in self._patterns(right, of_b, "_r_"):
                open_ = set(of_a) - bound_a | set(of_b) - bound_b
                tests = [F.col(n) == F.col("_r_" + n) for n in shared if n not in open_] + ([] if condition is None else [condition])
                yield x, y, reduce(Column.__and__, tests) if tests else None

    def _unmatched(self, a: Solutions, right: DataFrame, b: Solutions, shared: list[str], loose: list[str], condition=None, known: bool = False) -> DataFrame:
        """The rows of a that are compatible with none of right; known: with none with which they share a bound variable."""
        of_a, of_b = [n for n in loose if n in a.maybe], [n for n in loose if n in b.maybe]
        out = a.df
        for y, bound_b in self._patterns(right, of_b, "_r_"):
            kept = []
            for x, bound_a in self._patterns(out, of_a):
                open_ = set(of_a) - bound_a | set(of_b) - bound_b
                equal = [F.col(n) == F.col("_r_" + n) for n in shared if n not in open_]
                tests = equal + ([] if condition is None else [condition])
                kept.append(x if known and not equal else x.join(y, reduce(Column.__and__, tests, F.lit(True)), "left_anti"))
            out = reduce(DataFrame.unionByName, kept)
        return out

    def optional(self, a: Solutions, group, graph) -> Solutions:
        inner = [x for x in group[1] if x[0] != "filter"]
        b = self.group(("group", inner), graph)
        filters = [x[1] for x in group[1] if x[0] == "filter"]
        plain = [f for f in filters if not _has_exists(f)]
        if len(plain) < len(filters):
            b = reduce(lambda s, f: self.filtered(s, f, graph), [f for f in filters if f not in plain], b)
        condition = None
        if plain:
            names = {n: F.col(n) for n in a.names} | {n: F.col("_r_" + n) for n in b.names if n not in a.names}
            condition = reduce(Column.__and__, [self.evaluate(f, names).bool() for f in plain])
        return self.join(a, b, "left", condition)

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        """Rows of a that are compatible with no row of b with which they share a bound variable."""
        shared, loose = self._on(a, b)
        if not shared:
            return a
        right = b.df.select(*(F.col(n).alias("_r_" + n) for n in b.names))
        return Solutions(self._unmatched(a, right, b, shared, loose, None, True), a.names, a.maybe)

    def anti(self, a: Solutions, b: Solutions, condition=None, how: str = "left_anti") -> Solutions:
        shared, loose = self._on(a, b)
        right = b.df.select(*(F.col(n).alias("_r_" + n) for n in b.names))
        if not loose:
            tests = [F.col(n) == F.col("_r_" + n) for n in shared] + ([] if condition is None else [condition])
            return Solutions(a.df.join(right, reduce(Column.__and__, tests) if tests else F.lit(True), how), a.names, a.maybe)
        alone = self._unmatched(a, right, b, shared, loose, condition)
        if how == "left_anti":
            return Solutions(alone, a.names, a.maybe)
        return Solutions(self._without(a.df, alone, a.names), a.names, a.maybe)

    def _without(self, df: DataFrame, gone: DataFrame, names: list[str], how: str = "left_anti") -> DataFrame:
        other = gone.select(*(F.col(n).alias("_w_" + n) for n in names)).distinct()
        return df.join(other, reduce(Column.__and__, [F.col(n).eqNullSafe(F.col("_w_" + n)) for n in names], F.lit(True)), how)

    def union(self, parts: list[Solutions]) -> Solutions:
        names = list(dict.fromkeys(n for p in parts for n in p.names))
        maybe = {n for n in names if any(n not in p.names or n in p.maybe for p in parts)}
        return Solutions(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [p.df for p in parts]).select(*names), names, maybe)

    # filters and expressions

    def filtered(self, a: Solutions, f, graph) -> Solutions:
        if f[0] == "exists":
            return self.exists(a, f, graph)
        if f[0] == "call" and f[1] == "AND":
            return reduce(lambda s, x: self.filtered(s, x, graph), f[2], a)
        if f[0] == "call" and f[1] == "NOT" and f[2][0][0] == "exists":
            return self.exists(a, ("exists", f[2][0][1], not f[2][0][2]), graph)
        if _has_exists(f):  # inside OR and the like: each becomes a column of flags
            df, flags = a.df, []

            def flagged(e):
                nonlocal df
                if e[0] == "exists":
                    name = f"_f{len(flags)}"
                    flags.append(name)
                    hits = self.exists(Solutions(a.df.distinct(), a.names, a.maybe), ("exists", e[1], False), graph).df
                    other = hits.select(*(F.col(n).alias("_w_" + n) for n in a.names), F.lit(True).alias(name))
                    df = df.join(other, reduce(Column.__and__, [F.col(n).eqNullSafe(F.col("_w_" + n)) for n in a.names], F.lit(True)), "left").drop(*("_w_" + n for n in a.names))
                    found = F.coalesce(F.col(name), F.lit(False))
                    return ("column", Value("bool", ~found if e[2] else found))
                return ("call", e[1], [flagged(x) for x in e[2]]) if e[0] == "call" else e

            test = flagged(f)
            return Solutions(df.where(self.evaluate(test, {n: F.col(n) for n in a.names}).bool()).select(*a.names), a.names, a.maybe)
        return Solutions(a.df.where(self.expression(f, a, graph).bool()), a.names, a.maybe)

    def exists(self, a: Solutions, f, graph) -> Solutions:
        """Semi or anti join; filters of the group that name outer variables become part of the condition."""
        inner = [x for x in f[1][1] if x[0] != "filter"]
        b = self.group(("group", inner), graph)
        condition = None
        for x in f[1][1]:
            if x[0] == "filter":
                if _has_exists(x[1]):
                    b = self.filtered(b, x[1], graph)
                    continue
                names = {n: F.col("_r_" + n) for n in b.names} | {n: F.col(n) for n in a.names if n not in b.names}
                c = self.evaluate(x[1], names).bool()
                condition = c if condition is None else condition & c
        return self.anti(a, b, condition, "left_anti" if f[2] else "left_semi")

    def expression(self, e, sol: Solutions, graph=None) -> Value:
        return self.evaluate(e, {n: F.col(n) for n in sol.names})

    def evaluate(self, e, names: dict[str, Column]) -> Value:
        if e[0] == "var":
            return Value("term", names[e[1]] if e[1] in names else F.lit(None).cast(T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS])))
        if e[0] == "term":
            return Value("term", constant(e))
        if e[0] == "column":
            return e[1]
        if e[0] != "call":
            raise NotImplementedError(f"{e[0]} inside an expression")
        name, args = e[1], [self.evaluate(x, names) for x in e[2]]
        return self.call(name, args)

    def call(self, name: str, a: list[Value]) -> Value:
        if name in ("AND", "OR"):
            x, y = a[0].bool(), a[1].bool()
            return Value("bool", x & y if name == "AND" else x | y)
        if name == "NOT":
            return Value("bool", ~a[0].bool())
        if name in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", self.compare(name, a[0], a[1]))
        if name == "IN":
            return Value("bool", reduce(Column.__or__, [self.compare("=", a[0], x) for x in a[1:]], F.lit(False)))
        if name in ("+", "-", "*", "/"):
            x, y = a[0].num(), a[1].num()
            return Value("num", {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[name])
        if name == "NEG":
            return Value("num", -a[0].num())
        if name == "STR":
            return Value("str", a[0].str())
        if name in ("LANG", "DATATYPE"):
            c = a[0].term()
            if name == "LANG":
                return Value("str", F.when(c["kind"] == "literal", c["lang"]))
            return Value("term", F.when(c["kind"] == "literal", term("uri", c["dt"])))
        if name in ("ISLITERAL", "ISIRI", "ISURI", "ISBLANK"):
            kind = {"ISLITERAL": "literal", "ISBLANK": "bnode"}.get(name, "uri")
            return Value("bool", a[0].term()["kind"] == kind)
        if name == "ISNUMERIC":
            return Value("bool", a[0].num().isNotNull())
        if name == "BOUND":
            return Value("bool", a[0].col.isNotNull())
        if name == "COALESCE":
            return Value("term", F.coalesce(*(x.term() for x in a)))
        if name == "IF":
            return Value("term", F.when(a[0].bool(), a[1].term()).when(~a[0].bool(), a[2].term()))
        text = {"STRSTARTS": F.startswith, "STRENDS": F.endswith, "CONTAINS": F.contains}
        if name in text:
            return Value("bool", text[name](a[0].str(), a[1].str()))
        if name == "STRAFTER":
            x, y = a[0].str(), a[1].str()
            return Value("str", F.when(F.contains(x, y), F.substring(x, F.position(y, x) + F.length(y), F.lit(1 << 30))).otherwise(""))
        if name == "STRBEFORE":
            x, y = a[0].str(), a[1].str()
            return Value("str", F.when(F.contains(x, y), F.substring(x, F.lit(1), F.position(y, x) - 1)).otherwise(""))
        if name == "STRLEN":
            return Value("num", F.length(a[0].str()).cast("double"), XSD + "integer")
        if name in ("LCASE", "UCASE"):
            return Value("str", (F.lower if name == "LCASE" else F.upper)(a[0].str()))
        if name == "CONCAT":
            return Value("str", F.concat(*(x.str() for x in a)))
        if name == "SUBSTR":
            n = a[2].num().cast("int") if len(a) > 2 else F.lit(1 << 30)
            return Value("str", F.substring(a[0].str(), a[1].num().cast("int"), n))
        if name == "REPLACE":
            return Value("str", F.regexp_replace(a[0].str(), a[1].str(), a[2].str()))
        if name == "REGEX":
            pattern = F.concat(F.lit("(?"), F.regexp_replace(a[2].str(), "[^ims]", ""), F.lit(")"), a[1].str()) if len(a) > 2 else a[1].str()
            return Value("bool", F.regexp_like(a[0].str(), pattern))
        if name == "LANGMATCHES":
            x, y = F.lower(a[0].str()), F.lower(a[1].str())
            return Value("bool", F.when(y == "*", x != "").otherwise((x == y) | F.startswith(x, F.concat(y, F.lit("-")))))
        if name in ("ROUND", "CEIL", "FLOOR", "ABS"):
            x = a[0].num()
            return Value("num", {"ROUND": F.floor(x + 0.5), "CEIL": F.ceil(x), "FLOOR": F.floor(x), "ABS": F.abs(x)}[name].cast("double"))
        if name in ("YEAR", "MONTH", "DAY"):
            i = {"YEAR": 0, "MONTH": 1, "DAY": 2}[name]
            return Value("num", F.split_part(F.substring(a[0].str(), 1, 10), F.lit("-"), F.lit(i + 1)).try_cast("double"), XSD + "integer")
        if name == XSD + "integer":
            return Value("num", F.coalesce(a[0].str().try_cast("bigint"), a[0].str().try_cast("double").try_cast("bigint")).cast("double"), XSD + "integer")
        if name in (XSD + "decimal", XSD + "double", XSD + "float"):
            return Value("num", a[0].str().try_cast("double"), name)
        if name == XSD + "string":
            return Value("str", a[0].str())
        if name in ("IRI", "URI"):
            return Value("term", term("uri", a[0].str()))
        raise NotImplementedError(f"function {name}")

    def compare(self, op: str, a: Value, b: Value) -> Column:
        ops = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}
        f = ops[op]
        if a.kind == "num" or b.kind == "num":
            return f(a.num(), b.num())
        if a.kind == "bool" and b.kind == "bool":
            return f(a.col, b.col)
        x, y, m, n = a.term(), b.term(), a.num(), b.num()
        if op in ("=", "!="):
            both = m.isNotNull() & n.isNotNull()
            return F.when(both, f(m, n)).otherwise(f(x, y))
        plain = (x["kind"] == "literal") & (y["kind"] == "literal") & m.isNull() & n.isNull()
        return F.when(m.isNotNull() & n.isNotNull(), f(m, n)).when(plain, f(x["value"], y["value"]))

    # solution modifiers

    def select(self, q, graph=None) -> Solutions:
        _, distinct, items, where, mod = q
        needed = self._only_counts(items, where, mod, graph)
        sol = self.group(where, graph) if needed is None else self.counted(where[1][0][1], needed, graph)
        if mod["values"]:
            sol = self.join(sol, self.values(mod["values"]))
        aggregated = mod["group"] or any(_has_aggregate(e) for _, e in items if e) or mod["having"]
        if aggregated:
            sol, items, mod = self.grouped(sol, items, mod)
        hidden = []
        names = [n for n, _ in items] or [n for n in sol.names if not n.startswith("_")]
        df, known = sol.df, list(sol.names)
        for n, e in items:
            if e is not None:
                df = df.withColumn(n, self.evaluate(e, {k: F.col(k) for k in known}).term())
                known.append(n)
            elif n not in known:
                df = df.withColumn(n, F.lit(None).cast(T.StructType([T.StructField(f, T.StringType()) for f in _FIELDS])))
                known.append(n)
        order = []
        for e, down in mod["order"]:
            for col in self.sort_keys(self.evaluate(e, {k: F.col(k) for k in known})):
                hidden.append(col)
                order.append(F.col(f"_o{len(hidden) - 1}").desc_nulls_last() if down else F.col(f"_o{len(hidden) - 1}").asc_nulls_first())
        if distinct:
            df = df.select(*names).distinct()
        if hidden:
            df = df.select(*names, *(c.alias(f"_o{i}") for i, c in enumerate(hidden)))
            df = df.orderBy(*order, *(F.col(n).asc_nulls_first() for n in names))  # ties by all columns, so limits are the same each time
        if mod["offset"]:
            df = df.offset(mod["offset"])
        if mod["limit"] is not None:
            df = df.limit(mod["limit"])
        return Solutions(df.select(*names), names, set(names))

    @staticmethod
    def _only_counts(items, where, mod, graph) -> set[str] | None:
        """The keys of groups, if solutions of one basic pattern with a sequence in it are only counted by them. In a basic pattern every variable is
        bound, so COUNT of one counts solutions."""
        if graph is not None and graph[0] == "var" or mod["values"] or [x[0] for x in where[1]] != ["bgp"]:
            return None
        triples = where[1][0][1]
        bound = {x[1] for t in triples for x in t if x[0] == "var"}
        keys = {n for n, e in mod["group"] if e is None}
        used = _aggregates([e for _, e in items if e] + list(mod["having"]) + [e for e, _ in mod["order"]])
        plain = all(a[1] == "COUNT" and not a[2] and (a[3] is None or a[3][0] == "var" and a[3][1] in bound) for a in used)
        chained = any(t[1][0] == "seq" or t[1][0] == "inv" and t[1][1][0] == "seq" for t in triples)
        return keys if used and plain and chained and len(keys) == len(mod["group"]) and keys <= bound else None

    def sort_keys(self, v: Value) -> list[Column]:
        """Unbound, blank nodes, IRIs, literals; numbers by value, the rest by code points."""
        if v.kind == "num":
            return [v.col]
        t = v.term()
        rank = F.when(t["kind"] == "bnode", 1).when(t["kind"] == "uri", 2).when(t["kind"] == "literal", 3)
        return [rank, v.num(), t["value"]]

    def grouped(self, sol: Solutions, items, mod):
        df, keys = sol.df, []
        for n, e in mod["group"]:
            if e is not None:
                df = df.withColumn(n, self.expression(e, sol).term())
            keys.append(n)
        aggregates: list[Column] = []
        inner = Solutions(df, [*sol.names, *(k for k in keys if k not in sol.names)])

        def lift(e):
            """Replace aggregates by columns of the grouped table."""
            if e[0] == "agg":
                kind, col = self.aggregate(e, inner)
                aggregates.append(col.alias(f"_a{len(aggregates)}"))
                ref = F.col(f"_a{len(aggregates) - 1}")
                return ("column", Value(kind, ref, XSD + "integer" if e[1] == "COUNT" else ""))
            if e[0] == "call":
                return ("call", e[1], [lift(x) for x in e[2]])
            return e

        items = [(n, lift(e) if e else None) for n, e in items]
        alias = {n: e for n, e in items if e}
        resolve = lambda e: alias.get(e[1], e) if e[0] == "var" else ("call", e[1], [resolve(x) for x in e[2]]) if e[0] == "call" else lift(e)
        having = [resolve(h) for h in mod["having"]]
        order = [(resolve(e), d) for e, d in mod["order"]]
        out = df.groupBy(*keys).agg(*aggregates) if aggregates else df.select(*keys).distinct()
        for h in having:
            out = out.where(self.evaluate(h, {k: F.col(k) for k in keys}).bool())
        return Solutions(out, keys, set(keys)), items, mod | {"order": order}

    def aggregate(self, e, sol: Solutions) -> tuple[str, Column]:
        _, name, distinct, arg, sep = e
        if "_w" in sol.df.columns:  # counted(): each row stands for so many
            return "num", F.coalesce(F.sum("_w"), F.lit(0)).cast("double")
        if arg is None:
            if distinct:
                return "num", F.countDistinct(F.struct(*sol.names)).cast("double")
            return "num", F.count(F.lit(1)).cast("double")
        v = self.expression(arg, sol)
        if name == "COUNT":
            return "num", (F.countDistinct(v.term()) if distinct else F.count(v.term())).cast("double")
        if name in ("SUM", "AVG"):
            f = {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg, ("AVG", True): lambda c: F.sum_distinct(c) / F.count_distinct(c)}[name, distinct]
            return "num", f(v.num())
        if name in ("MIN", "MAX"):
            key = F.struct(*self.sort_keys(v))
            return "term", (F.min_by if name == "MIN" else F.max_by)(v.term(), key)
        if name == "SAMPLE":  # the least, so that reruns agree
            return "term", F.min(v.term())
        texts = F.collect_set(v.str()) if distinct else F.collect_list(v.str())
        return "str", F.array_join(F.array_sort(texts), sep)


def _subsets(names: list[str]):
    return [set(c) for k in range(len(names) + 1) for c in combinations(names, k)]


def _has_exists(e) -> bool:
    return e[0] == "exists" or e[0] == "call" and any(map(_has_exists, e[2]))


def _aggregates(es) -> list:
    return [x for e in es for x in ([e] if e[0] == "agg" else _aggregates(e[2]) if e[0] == "call" else [])]


def _has_aggregate(e) -> bool:
    return e[0] == "agg" or e[0] == "call" and any(map(_has_aggregate, e[2]))


def run(store, text: str, services: dict | None = None) -> DataFrame:
    """SELECT: a term struct per variable. ASK: one boolean, ask. CONSTRUCT, DESCRIBE: distinct triples (s, p, o, o_kind, o_lang, o_dt)."""
    q, c = parse(text), Compiler(store, services)
    if q[0] == "select":
        return c.select(q).df
    if q[0] == "ask":
        return c.group(q[1]).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
    if q[0] == "construct":
        sol = c.group(q[2])
        if q[3]["limit"] is not None:
            sol = Solutions(sol.df.limit(q[3]["limit"]), sol.names)
        rows = []
        for triple in q[1]:
            s, p, o = (c.evaluate(x if x[0] != "iri" else x, {n: F.col(n) for n in sol.names}).term() for x in triple)
            rows.append(sol.df.select(s["value"].alias("s"), p["value"].alias("p"), o["value"].alias("o"), o["kind"].alias("o_kind"), o["lang"].alias("o_lang"), o["dt"].alias("o_dt")))
        return reduce(DataFrame.unionByName, rows).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()
    targets = [t[2] for t in q[1] if t[0] == "term"]
    out = [store.describe(t) for t in targets]
    names = [t[1] for t in q[1] if t[0] == "var"]
    if q[2] and names:
        sol = c.group(q[2])
        for n in names:
            nodes = sol.df.select(F.col(n)["value"].alias("s")).distinct()
            out.append(store.scan(None, None).join(nodes, "s", "left_semi").select("s", "p", "o", "o_kind", "o_lang", "o_dt"))
    return reduce(DataFrame.unionByName, out).distinct()


def rows(store, text: str, services: dict | None = None) -> DataFrame:
    """run() with the plain values of the terms."""
    df = run(store, text, services)
    return df.select(*(F.col(f.name)["value"].alias(f.name) if isinstance(f.dataType, T.StructType) else F.col(f.name) for f in df.schema))

