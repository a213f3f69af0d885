"""Recursive operators against plain Python on small random graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from repolens.operators import cycles, edges, index, linking, snapshots
from repolens.plans.extraction import inline_files


def closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, front = set(), [a]
        while front:
            for b in out.get(front.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    front.append(b)
        reach[a] = seen
    return reach


@pytest.mark.parametrize(("seed", "local"), [(1, 1000), (2, 0), (3, 0)])
def test_components_and_shortest_cycles(spark, seed, local):
    rng = random.Random(seed)
    pairs = {(rng.randrange(14), rng.randrange(14)) for _ in range(22)}
    graph = cycles.settled(spark.createDataFrame(sorted(pairs), "src long, dst long"))
    found = cycles.components(graph, local)
    reach = closure(pairs)
    got = {r["node"]: r["component"] for r in found.collect()}
    assert set(got) == {a for a in reach if a in reach[a]}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (a == b or (b in reach[a] and a in reach[b]))
    lengths = {r["node"]: r["length"] for r in cycles.shortest_cycles(graph, found, local).collect()}
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    assert lengths == {a: cycles.local_cycle(a, out) for a in got}


def test_exclusion_is_by_path(spark):
    """c calls a and b, both call t; with a excluded, t is still reached through b."""
    graph = spark.createDataFrame([("t", "a"), ("t", "b"), ("a", "c"), ("b", "c"), ("c", "test")], "src string, dst string")
    kept = edges.without_interior(edges.simple_paths(graph), F.col("node") == "a")
    assert ["t", "b", "c", "test"] in [r["path"] for r in kept.collect()]
    assert ["t", "a", "c", "test"] not in [r["path"] for r in kept.collect()]


def test_merge_equals_rebuild(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (4, "d")], "k int, v string")
    status = {r["k"]: r["status"] for r in snapshots.diff(old, new, "k", ["v"]).collect()}
    assert status == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    changed, gone = new.where("k in (2, 4)"), old.where("k = 1")
    assert sorted(map(tuple, snapshots.merge(old, changed, gone, "k").collect())) == sorted(map(tuple, new.collect()))


def test_first_candidate_takes_the_first_that_exists(spark):
    asked = spark.createDataFrame([("m", ["a/__init__.py", "a.py"]), ("n", ["zz.py"])], "k string, c array<string>")
    known = spark.createDataFrame([("a.py",), ("a/__init__.py",)], "id string")
    assert [tuple(r) for r in linking.first_candidate(asked, "k", F.col("c"), known).collect()] == [("m", 1, "a/__init__.py")]


def test_index_links_a_small_repository(spark):
    built = index.build(inline_files(spark))
    found = {(r["src"], r["dst"], r["relationship_type"]) for r in built.edges.collect()}
    assert ("store/api.py", "store/base.py", "imports") in found
    assert ("tests/test_api.py", "store/api.py", "tests") in found
    assert ("store.api.Api", "store.base.Base", "inherits") in found
    assert ("store.api.Api.run", "store.base.helper", "calls") in found
    plan = built.edges._jdf.queryExecution().toString()
    assert "MapIn" not in plan  # nothing is parsed again


def test_a_method_calls_its_own_class(spark):
    source = b"class A:\n    def go(self):\n        self.stop()\n        self.missing()\n    def stop(self):\n        pass\nclass B:\n    def stop(self):\n        pass\n"
    rows = [("m.py", "python", "source", len(source), None, bytearray(source)), ("bad.py", "python", "source", 5, None, bytearray(b"def ("))]
    files = spark.createDataFrame(rows, "path string, language string, file_kind string, size long, modified timestamp, content binary")
    calls = index.build(files).edges.where("relationship_type = 'calls'").collect()
    assert {(r["src"], r["dst"]) for r in calls} == {("m.A.go", "m.A.stop")}
