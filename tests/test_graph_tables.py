"""Graph questions over tables against the small-graph code."""

import random
from itertools import combinations

import pytest
from kpiscope.operators import graph_tables as g
from kpiscope.operators.graph import Dag


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(6)
    names = [f"n{i:02}" for i in range(12)]
    edges = [(a, b) for a, b in combinations(names, 2) if r.random() < 0.28]
    return Dag.of(edges, nodes=names), spark.createDataFrame(edges, "source string, target string").repartition(3)


def test_closure_and_cycles(spark, graph):
    dag, edges = graph
    got = {(r.source, r.target) for r in g.closure(edges).collect()}
    assert got == {(a, b) for a in dag.nodes for b in dag.descendants({a})}
    assert g.cyclic(edges).count() == 0
    loop = spark.createDataFrame([("k", "a", "b"), ("k", "b", "c"), ("k", "c", "a"), ("k", "c", "d"), ("l", "a", "b"), ("l", "b", "c")], "g string, source string, target string")
    assert {(r.g, r.node) for r in g.cyclic(loop, ["g"]).collect()} == {("k", "a"), ("k", "b"), ("k", "c")}
    assert {(r.source, r.target, r.steps) for r in g.closure(loop, ["g"]).where("g = 'k'").collect()} >= {("a", "a", 3), ("a", "d", 3)}
    assert g.closure(loop.where("false")).count() == 0 and g.cyclic(loop.where("false")).count() == 0


def test_separation_of_all_triples(spark, graph):
    dag, edges = graph
    names = sorted(dag.nodes)
    asked = [(x, y, list(z)) for x, y in combinations(names, 2) for k in (0, 1) for z in combinations([n for n in names if n not in (x, y)], k)]
    asked += [(x, y, random.Random(str((x, y))).sample([n for n in names if n not in (x, y)], 3)) for x, y in combinations(names, 2)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(asked)], "id long, x string, y string, given array<string>")
    got = {r.id: r.separated for r in g.separated(edges, df).collect()}
    assert got == {i: dag.separated(*q) for i, q in enumerate(asked)}


def test_backdoor_sets_of_all_pairs(spark, graph):
    dag, edges = graph
    names = sorted(dag.nodes)
    hidden = set(names[::5])
    pairs = [(x, y) for x in names[:8] for y in names if x != y]
    rows = g.backdoor_sets(edges, spark.createDataFrame(pairs, "x string, y string"), spark.createDataFrame([(n,) for n in names if n not in hidden], "node string"), most=3).collect()
    got = {p: set() for p in pairs}
    for r in rows:
        got[r.x, r.y].add(tuple(r.set))
    assert got == {(x, y): set(dag.backdoor_sets(x, y, set(names) - hidden, 3)) for x, y in pairs}


def test_paths_and_front_doors(spark, graph):
    dag, edges = graph
    pairs = [(x, y) for x in sorted(dag.nodes) for y in sorted(dag.nodes) if x < y]
    df = spark.createDataFrame(pairs, "x string, y string")
    rows = g.directed_paths(edges, df).collect()
    assert {(r.x, r.y, tuple(r.path)) for r in rows} == {(x, y, tuple(p)) for x, y in pairs for p in dag.directed_paths(x, y)} and not any(r.cut for r in rows)
    few = g.directed_paths(edges, df, most=2).collect()
    for x, y in pairs:
        want = sorted((len(p), p) for p in dag.directed_paths(x, y))
        mine = [r for r in few if (r.x, r.y) == (x, y)]
        assert sorted((len(r.path), r.path) for r in mine) == want[:2] and all(r.cut == (len(want) > 2) for r in mine)
    small = Dag.of([("x", "m"), ("m", "y"), ("x", "k"), ("k", "y"), ("u", "x"), ("u", "y"), ("z", "x")], {}, [])
    table = spark.createDataFrame(sorted(small.edges), "source string, target string")
    seen = sorted(small.nodes - {"u"})
    got = g.frontdoor_sets(table, spark.createDataFrame([("x", "y"), ("z", "y"), ("z", "x")], "x string, y string"), spark.createDataFrame([(n,) for n in seen], "node string"))
    mine = {}
    for r in got.collect():
        mine.setdefault((r.x, r.y), set()).add(tuple(sorted(r.set)))
    assert mine.get(("x", "y")) == {("k", "m")} == set(small.frontdoor_sets("x", "y", seen))
    assert mine.get(("z", "y"), set()) == set(small.frontdoor_sets("z", "y", seen))
