"""Searches over graphs that tasks hold as arrays, against the joins and plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from repolens.operators import compact, cycles, edges, tests_for
from repolens.plans import catalogue
from repolens.sources.tables import Tables

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_edges(spark, seed, kind, nodes=40, count=110):
    rng = random.Random(seed)
    name = (lambda k: k * 7) if kind == "long" else (lambda k: f"f{k} x" if k % 3 else f"f{k}")
    hub = [(name(3), name(k)) for k in range(0, nodes, 2)]
    pairs = [(name(rng.randrange(nodes)), name(rng.randrange(nodes))) for _ in range(count)] + hub
    return spark.createDataFrame([*pairs, pairs[0], (None, name(1)), (name(1), None)], f"src {kind}, dst {kind}")


@pytest.mark.parametrize(("kind", "step", "held"), [("long", 1 << 20, 1 << 22), ("long", 8, 60), ("string", 8, 60)])
def test_nearest_paths_in_tasks_are_those_of_the_joins(spark, monkeypatch, kind, step, held):
    """With ties, a hub, self-edges, repeats and nulls; searches cut into steps and halves give the same."""
    monkeypatch.setattr(compact, "STEP", step)
    monkeypatch.setattr(compact, "HELD", held)
    graph = random_edges(spark, 5, kind)
    want = sorted(map(tuple, edges.nearest_paths(graph, held_edges=0).collect()))
    g = compact.graph(graph, text=True)
    got = []
    for part, levels in compact.nearest(g, np.arange(len(g)), 3):
        for depth, (own, path) in enumerate(levels, 1):
            for row in zip(part[own].tolist(), *(c.tolist() for c in path)):
                ids = [g.nodes[k].as_py() for k in row]
                got.append((ids[0], ids[-1], depth, ">".join(map(str, ids))))
    assert sorted(got) == want
    assert sorted(map(tuple, edges.nearest_paths(graph).collect())) == want


def test_paths_whose_texts_hold_the_mark_are_joined(spark):
    graph = spark.createDataFrame([("a", "b>"), ("b>", "c"), ("a", "b"), ("b", "c")], "src string, dst string")
    assert ("a", "c", 2, "a>b>>c") in {tuple(r) for r in edges.nearest_paths(graph).collect()}


def test_nearest_path_credit_deals_out_no_paths(spark):
    """The query made, shuffled and compared every simple path (F1)."""
    assert "Exchange" not in plan(catalogue.QUERIES["nearest_path_credit"](spark, SMALL))


@pytest.mark.parametrize(("seed", "step", "held"), [(1, 1 << 20, 1 << 22), (2, 4, 12), (3, 4, 12), (4, 1, 1)])
def test_cycles_in_tasks_are_those_of_the_joins(spark, monkeypatch, seed, step, held):
    monkeypatch.setattr(compact, "STEP", step)
    monkeypatch.setattr(compact, "HELD", held)
    rng = random.Random(seed)
    ring = [(100 + k, 100 + (k + 1) % 23) for k in range(23)]
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | set(ring) | {(7, 100), (200, 201), (201, 202), (300, 300)}
    graph = spark.createDataFrame(sorted(pairs), "src long, dst long")
    g = compact.graph(graph)
    own, out = compact.strong(g), {}
    for a, b in sorted(pairs):
        out.setdefault(a, []).append(b)
    want = cycles.local_components(sorted(pairs))
    assert {g.nodes[k].as_py(): g.nodes[c].as_py() for k, c in enumerate(own.tolist()) if c >= 0} == want
    found = np.concatenate([lengths for _, lengths in compact.cycle_lengths(g, g.reverse(), np.arange(len(g)))])
    assert dict(zip(g.nodes.to_pylist(), found.tolist())) == {a: cycles.local_cycle(a, out) for a in g.nodes.to_pylist()}
    assert {tuple(r) for r in cycles.all_cycles(graph).collect()} == {(a, c, cycles.local_cycle(a, out)) for a, c in want.items()}
    assert {tuple(r) for r in cycles.all_cycles(graph, 0).collect()} == {(a, c, cycles.local_cycle(a, out)) for a, c in want.items()}


def test_cycles_of_an_empty_graph_and_of_texts(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert cycles.all_cycles(empty).collect() == [] and edges.nearest_paths(empty).collect() == []
    texts = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in cycles.all_cycles(texts).collect()} == {("a", "b", 2), ("b", "b", 2)}


def test_shortest_cycles_of_a_large_graph_need_no_rounds_of_joins(spark, monkeypatch):
    """A graph over the driver's old bound of 100,000 edges went through rounds of joins (F3, F7)."""
    monkeypatch.setattr(cycles, "shortest_cycles", lambda *_: pytest.fail("joined in rounds"))
    n = 60_000
    ids = spark.range(n)
    ring = ids.selectExpr("id as src", f"(id + 1) % {n} as dst").union(ids.selectExpr("id as src", f"if(id % 3 = 2, id - 2, (id + 1) % {n}) as dst"))
    got = cycles.all_cycles(ring).groupBy("component", "length").count().collect()
    assert [tuple(r) for r in got] == [(n - 1, 3, n)]


@pytest.mark.parametrize(("seed", "step", "held"), [(1, 1 << 20, 1 << 22), (2, 6, 10)])
def test_credit_in_tasks_is_that_of_the_joins(spark, monkeypatch, seed, step, held):
    """With mocked nodes, tests that call tests, targets outside the graph; cut into steps and halves."""
    monkeypatch.setattr(compact, "STEP", step)
    monkeypatch.setattr(compact, "HELD", held)
    calls = random_edges(spark, seed, "string", 25, 70)
    names = sorted({r[0] for r in calls.selectExpr("src as n").union(calls.selectExpr("dst as n")).collect() if r[0]})
    tests = spark.createDataFrame([(x,) for x in names[::4]] + [("outside",)], "test string")
    mocks = spark.createDataFrame([(x, names[(k * 5 + 1) % len(names)]) for k, x in enumerate(names[::4] * 2)], "test string, target string")
    symbols = spark.createDataFrame([("m", x) for x in names], "path string, qualified_name string")
    module = spark.createDataFrame([(x, "outside", "low") for x in [*names, "alone", None]], "target string, test string, confidence string")
    rows = lambda **k: sorted(map(repr, tests_for.tests_for(calls, mocks, symbols, tests, module, **k).collect()))
    assert rows() == rows(held_edges=0)


def test_members_of_mocked_classes_are_found_by_their_prefixes(spark):
    """Every mocked name was paired with all symbols of its file (F2)."""
    symbols = spark.createDataFrame([("p", x) for x in ("K", "K.m", "K.m.n", "Km", "K.", "L.m")] + [("q", "K.o")], "path string, qualified_name string")
    mocked = tests_for.mocked_members(spark.createDataFrame([("t", "K"), ("u", "K.m")], "test string, target string"), symbols)
    assert {tuple(r) for r in mocked.collect()} == {("t", "K"), ("t", "K.m"), ("t", "K.m.n"), ("t", "K."), ("u", "K.m"), ("u", "K.m.n")}
    assert "startswith" not in plan(mocked).lower()


def test_changes_are_dealt_out_once_by_commit(spark):
    """The log was dealt out as texts by commit and path, and again by commit (F4)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(Tables(spark, SMALL).changes()).count("Exchange hashpartitioning") == 2  # lines and orders
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["legacy_signals_all", "legacy_signals_of_target"])
def test_signals_read_one_call_graph(spark, monkeypatch, name):
    """Fans and cycles each made the call graph (F5, F6)."""
    made = []
    calls = Tables.calls
    monkeypatch.setattr(Tables, "calls", lambda t: made.append(t) or calls(t))
    assert catalogue.QUERIES[name](spark, SMALL).columns and len(made) == 1


@pytest.mark.parametrize("target", ["src1/en/doc_1", "7", "part/7"])
def test_signals_of_a_target_are_those_of_all(spark, monkeypatch, target):
    """A target outside the call graph had the whole graph written down and searched (F5)."""
    t = Tables(spark, SMALL)
    want = sorted(map(tuple, catalogue.legacy_signals_all(t).where(F.col("target") == target).collect()))
    searched = []
    search = catalogue.cycles.all_cycles
    monkeypatch.setattr(catalogue.cycles, "all_cycles", lambda calls: searched.append(calls) or search(calls))
    assert sorted(map(tuple, catalogue.signals_of(t, target).collect())) == want
    assert len(searched) == (target == "7")
