"""Name lookups, paths and reach against plain Python."""

from __future__ import annotations

import difflib
import posixpath
import random

from pyspark.sql import functions as F

from repolens.functions import names
from repolens.operators import cycles, resolve, tests_for


def test_close_matches_equal_the_library(spark):
    rng = random.Random(3)
    known = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9))) for _ in range(150)})
    asked = ["abca", "ddd", "zzzz", known[3]]
    got = resolve.close_matches(spark.createDataFrame([(a,) for a in asked], "request string"), spark.createDataFrame([(k,) for k in known], "name string")).collect()
    for a in asked:
        found = [r["name"] for r in sorted(got, key=lambda r: r["position"]) if r["request"] == a]
        want = difflib.get_close_matches(a, known, 5, 0.6)
        ratio = lambda n: difflib.SequenceMatcher(None, n, a).ratio()  # noqa: B023, E731
        assert [ratio(n) for n in found] == [ratio(n) for n in want]


def test_paths_are_joined(spark):
    rng = random.Random(2)
    pairs = [("/".join(rng.choice("ab") for _ in range(rng.randrange(4))), "/".join(rng.choice(["..", ".", "x", "y"]) for _ in range(rng.randrange(1, 7)))) for _ in range(200)]
    got = spark.createDataFrame(pairs, "a string, b string").select(names.joined_path(F.col("a"), F.col("b"))).collect()
    assert [r[0] or "." for r in got] == [posixpath.normpath(posixpath.join(a, b)) for a, b in pairs]


def test_cascade_and_members(spark):
    known = spark.createDataFrame([(n,) for n in ("a.b.c", "x.b.c", "a.b", "a.d", "e")], "qualified_name string")
    asked = spark.createDataFrame([(n,) for n in ("a.b.c", "b.c", "d", "e", "q", "b")], "request string")
    got = {r["request"]: (r["status"], r["found"]) for r in resolve.cascade(asked, known).collect()}
    assert got == {"a.b.c": ("exact", "a.b.c"), "b.c": ("candidates", None), "d": ("unique_suffix", "a.d"), "e": ("exact", "e"), "q": ("suggestions", None), "b": ("unique_suffix", "a.b")}
    owners = spark.createDataFrame([("a",), ("a.b",)], "qualified_name string")
    assert {tuple(r) for r in resolve.direct_members(owners, known).collect()} == {("a", "a.b"), ("a", "a.d"), ("a.b", "a.b.c")}


def test_text_nodes_in_cycles_and_reach(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a")]
    graph = cycles.settled(spark.createDataFrame(pairs, "src string, dst string"))
    for local in (0, 1000):
        found = cycles.components(graph, local)
        assert {tuple(r) for r in found.collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("d", "e"), ("e", "e")}
        assert {tuple(r) for r in cycles.shortest_cycles(graph, found, local).collect()} == {("a", 3), ("b", 3), ("c", 3), ("d", 2), ("e", 2)}
    assert {r[0] for r in resolve.reach(graph, spark.createDataFrame([("d",), ("f",)], "node string")).collect()} == set("abcdef")
    assert {r[0] for r in resolve.reach(graph, spark.createDataFrame([("d",)], "node string")).collect()} == {"d", "e"}


def test_tested_modules(spark):
    paths = ["tests/test_a_b.py", "x/c_test.py", "x/test.py", "x/y.py"]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(names.tested_module(F.col("p"))).collect()] == ["a_b", "c", None, None]


def test_a_helper_credits_a_test(spark):
    calls = spark.createDataFrame([("t", "h"), ("h", "x"), ("u", "g"), ("g", "x")], "src string, dst string")
    none = spark.createDataFrame([], "target string, test string, confidence string")
    got = tests_for.tests_for(calls, spark.createDataFrame([("u", "g")], "test string, target string"), spark.createDataFrame([("m", "x")], "path string, qualified_name string"), spark.createDataFrame([("t",), ("u",)], "test string"), none)
    assert {(r["target"], r["test"], r["depth"]) for r in got.collect()} == {("h", "t", 1), ("x", "t", 2)}
