"""Queries over small graphs, held against results worked out by hand or by a plain evaluator."""

import itertools
import random

import pytest

from quadrel.operators import paths
from quadrel.operators.store import QuadStore
from quadrel.plans import direct_mapping

PRE = "PREFIX : <urn:> "


def store_of(spark, triples):
    rows = [("urn:g", f"urn:{s}", f"urn:{p}", f"urn:{o}", "uri", "", "") for s, p, o in triples]
    return QuadStore(spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_lang string, o_dt string"), set())


@pytest.fixture(scope="module")
def small(spark):
    return store_of(spark, [("a", "p", "o"), ("b", "p", "o"), ("c", "p", "o"), ("a", "y", "m"), ("b", "y", "n"), ("z", "q", "m"), ("w", "r", "b"), ("c", "t", "c")])


def values(df):
    return sorted(tuple(x and x.removeprefix("urn:") for x in r) for r in df.collect())


def test_minus_needs_a_shared_bound_variable(small):
    assert values(small.query(PRE + "SELECT ?s WHERE {?s :p :o OPTIONAL {?s :y ?y} MINUS {?z :q ?y}}")) == [("b",), ("c",)]
    assert values(small.query(PRE + "SELECT ?s WHERE {?s :p :o MINUS {?s :y ?y}}")) == [("c",)]
    assert values(small.query(PRE + "SELECT ?s WHERE {?s :p :o MINUS {?u :q ?v}}")) == [("a",), ("b",), ("c",)]


def test_exists_within_other_conditions(small):
    q = PRE + "SELECT ?s WHERE {?s :p :o FILTER(EXISTS {?s :t ?t} || EXISTS {?w :r ?s})}"
    assert values(small.query(q)) == [("b",), ("c",)]
    q = PRE + "SELECT ?s WHERE {?s :p :o FILTER(NOT EXISTS {?s :y ?y} || ?s = :a)}"
    assert values(small.query(q)) == [("a",), ("c",)]


def compatible(x, y):
    return all(x[k] == y[k] for k in x.keys() & y.keys() if x[k] is not None and y[k] is not None)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joins_of_unbound_variables(spark, seed):
    """OPTIONAL, MINUS and joins after OPTIONAL against pairs of rows tried one by one."""
    rng = random.Random(seed)
    triples = sorted({(rng.choice("abcde"), rng.choice("pqrs"), rng.choice("vwx")) for _ in range(26)})
    store = store_of(spark, triples)
    by = {p: [(s, o) for s, q, o in triples if q == p] for p in "pqrs"}

    def optional(first, second):
        out = []
        for s, _ in by[first]:
            hits = [o for t, o in by[second] if t == s]
            out += [{"s": s, "y": y} for y in hits] or [{"s": s, "y": None}]
        return out

    left, right = optional("p", "q"), [{"t": t, "y": y} for t, y in by["r"]] if seed != 3 else [{"t": x["s"], "y": x["y"]} for x in optional("r", "s")]
    tail = "?t :r ?y" if seed != 3 else "?t :r ?u OPTIONAL {?t :s ?y}"
    head = "?s :p ?o OPTIONAL {?s :q ?y}"
    merged = [(x["s"], x["y"] or y["y"], y["t"]) for x, y in itertools.product(left, right) if compatible(x, y)]
    order = lambda rows: sorted(rows, key=str)
    assert order(values_any(store.query(PRE + f"SELECT ?s ?y ?t WHERE {{ {{{head}}} {{{tail}}} }}"))) == order(merged)
    missing = [(x["s"], x["y"], None) for x in left if not any(compatible(x, y) for y in right)]
    assert order(values_any(store.query(PRE + f"SELECT ?s ?y ?t WHERE {{ {head} OPTIONAL {{{tail}}} }}"))) == order(merged + missing)
    shares = lambda x, y: compatible(x, y) and x["y"] is not None and y["y"] is not None
    kept = [(x["s"], x["y"]) for x in left if not any(shares(x, y) for y in right)]
    assert order(values_any(store.query(PRE + f"SELECT ?s ?y WHERE {{ {head} MINUS {{{tail}}} }}"))) == order(kept)


def values_any(df):
    return [tuple(x and x.removeprefix("urn:") for x in r) for r in df.collect()]


def walk(edges, start, low, high):
    out, front, k = set(), {start}, 0
    if low == 0:
        out.add(start)
    while front and k < high:
        k += 1
        front = {b for a, b in edges if a in front}
        if k >= low:
            out |= front
    return out


def test_paths_from_bound_ends(spark):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(20)})
    store = store_of(spark, [(a, "p", b) for a, b in edges] + [("n1", "q", "n2"), ("n2", "q", "n3")])
    back = [(b, a) for a, b in edges]
    for path, low, high in (("p+", 1, 99), ("p*", 0, 99), ("p?", 0, 1), ("p{2,3}", 2, 3)):
        assert {x for (x,) in values(store.query(PRE + f"SELECT ?x WHERE {{:n0 :{path} ?x}}"))} == walk(edges, "n0", low, high), path
        assert {x for (x,) in values(store.query(PRE + f"SELECT ?x WHERE {{?x :{path} :n3}}"))} == walk(back, "n3", low, high), path
        every = {(a, b) for a in {x for e in edges for x in e} for b in walk(edges, a, max(low, 1), high)}
        pairs = set(values(store.query(PRE + f"SELECT ?x ?y WHERE {{?x :{path} ?y}}")))
        assert pairs >= every and all(a == b for a, b in pairs - every)
    assert {x for (x,) in values(store.query(PRE + "SELECT ?x WHERE {:n1 :q/:p* ?x}"))} == walk(edges, "n2", 0, 99)
    assert {x for (x,) in values(store.query(PRE + "SELECT ?x WHERE {?x ^:p/:q :n3}"))} == {b for a, b in edges if a == "n2"}
    assert store.ask(PRE + "ASK {:zz :p* :zz}")


def test_long_chains_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(130)], "s int, o int")
    assert paths.transitive(chain).count() == 131 * 130 // 2
    assert paths.reach(spark.createDataFrame([(60,)], "s int"), chain).count() == 70


def test_constants_reach_the_files(spark):
    store = direct_mapping.store(spark, "/root/testdata/sf0.001")
    pre = "PREFIX : <urn:kg:> "
    plan = lambda q: store.query(pre + q)._jdf.queryExecution().executedPlan().toString()
    q = "SELECT ?x WHERE {<urn:kg:nation/3> :partOf ?x}"
    assert "EqualTo(n_nationkey,3)" in plan(q) and [r.x for r in store.query(pre + q).collect()] == ["urn:kg:region/3"]
    q = "SELECT ?x WHERE {?x :placedBy <urn:kg:customer/7>}"
    assert "EqualTo(o_custkey,7)" in plan(q)
    assert store.query(pre + "SELECT ?x WHERE {<urn:kg:nation/03> :partOf ?x}").isEmpty()
    assert store.query(pre + "SELECT ?x WHERE {<urn:kg:region/3> :partOf ?x}").isEmpty()
    whole = {(r.p, r.o) for r in store.query(pre + "SELECT ?p ?o WHERE {<urn:kg:nation/3> ?p ?o}").collect()}
    assert ("urn:kg:partOf", "urn:kg:region/3") in whole and len(whole) == 3


def test_counts_of_paths_do_not_spell_out_solutions(spark):
    """40 x 40 x 40 ways through a hub and back are counted, with all their multiplicities, as a plain count has them."""
    triples = [(f"a{i}", "p", "h") for i in range(40)] + [(f"a{i}", "p", "k") for i in range(3)] + [("h", "t", "x"), ("a1", "t", "c"), ("a2", "t", "c"), ("a39", "t", "d")]
    store = store_of(spark, triples)
    ways = [(a, d) for a, p, h in triples for b, q, k in triples for c, r, m in triples for d, w, n in triples if p == q == r == w == "p" and h == k and b == c and m == n]
    q = "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o :p/^:p/:p/^:p ?s . ?s :t :c } GROUP BY ?s"
    assert values(store.query(PRE + q)) == sorted((s, str(sum(d == s for _, d in ways))) for s in ("a1", "a2"))
    assert values(store.query(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?o :p/^:p/:p/^:p ?s }")) == [(str(len(ways)),)]
    assert values(store.query(PRE + "SELECT (COUNT(*) AS ?n) WHERE { ?o :p/:p ?s }")) == [("0",)]
    assert values(store.query(PRE + "SELECT ?s (COUNT(DISTINCT ?o) AS ?n) WHERE { ?o :p/^:p ?s . ?s :t :d } GROUP BY ?s")) == [("a39", "40")]
    plan = store.query(PRE + q)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") > 3
