"""Tests of symbols, covering names, and the snapshot store."""

from __future__ import annotations

from repolens.operators import tests_for
from repolens.sources.store import Store


def test_diamond_with_a_mock(spark):
    """test_c calls c and mocks a; c calls a and b, both call t: t is tested through b."""
    calls = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "a"), ("c", "b"), ("test_c", "c")], "src string, dst string")
    symbols = spark.createDataFrame([("f.py", n) for n in ("a", "b", "c", "t", "K", "K.m")], "path string, qualified_name string")
    tests = spark.createDataFrame([("test_c",)], "test string")
    module = spark.createDataFrame([("t", "never", "low"), ("z", "test_z", "low")], "target string, test string, confidence string")
    for mocked, want in (("a", ["t", "b", "c"]), ("x", ["t", "a", "c"])):
        mocks = spark.createDataFrame([("test_c", mocked)], "test string, target string")
        got = {r["target"]: r for r in tests_for.tests_for(calls, mocks, symbols, tests, module).collect()}
        assert got["t"]["path"] == want and got["t"]["confidence"] == "medium" and got["t"]["evidence"] == "indirect_call"
        assert got["c"]["confidence"] == "high" and got["z"]["test"] == "test_z"
    both = spark.createDataFrame([("test_c", "a"), ("test_c", "b")], "test string, target string")
    got = {r["target"]: r for r in tests_for.tests_for(calls, both, symbols, tests, module).collect()}
    assert got["t"]["test"] == "never"
    members = tests_for.mocked_members(spark.createDataFrame([("q", "K")], "test string, target string"), symbols)
    assert {r["node"] for r in members.collect()} == {"K", "K.m"}


def test_covering_name(spark):
    names = spark.createDataFrame([("a.b.c.d",), ("x.y",)], "qualified_name string")
    tested = spark.createDataFrame([("a",), ("a.b.c",)], "target string")
    assert [tuple(r) for r in tests_for.covering(names, tested).collect()] == [("a.b.c.d", "a.b.c", 3)]


def test_store_publishes_whole_snapshots(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    files = spark.createDataFrame([("a.py", 1)], "path string, size int")
    assert store.status(files) == "never_indexed"
    assert store.publish({"files": files}) == 1 and store.status(files) == "fresh"
    more = spark.createDataFrame([("a.py", 2)], "path string, size int")
    assert store.status(more) == "stale"
    assert store.publish({"files": more}) == 2 and [tuple(r) for r in store.read("files").collect()] == [("a.py", 2)]
