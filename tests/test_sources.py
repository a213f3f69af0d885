"""File scan, change log, text rules and the streaming side."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from repolens.functions import extract_python, extract_text, names
from repolens.operators import history
from repolens.sources import repository
from repolens.streaming import changes


def test_scan_skips_secrets_binaries_and_excluded_folders(spark, tmp_path):
    for path, data in {"a/x.py": b"X = 1\n", ".env": b"k", "target/y.rs": b"fn y() {}", "b.bin": b"\0\1", "tests/test_x.py": b"\n", "bad.py": b"def ("}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    files = repository.scan_files(spark, str(tmp_path))
    kinds = {r["path"]: (r["language"], r["file_kind"]) for r in files.collect()}
    assert kinds == {"a/x.py": ("python", "source"), "tests/test_x.py": ("python", "test"), "bad.py": ("python", "source")}
    assert {r["qualified_name"] for r in repository.symbols(files).collect()} == {"a.x", "a.x.X", "tests.test_x"}


def test_scripted_history(spark, tmp_path):
    commits = [("2024-01-01T00:00:0%d+00:00" % i, ["a.py"] + ["b.py"] * (i < 4)) for i in range(5)]
    log = "".join("\0" + when + "\n\n" + "\n".join(paths) + "\n" for when, paths in reversed(commits))
    (tmp_path / "log.txt").write_text(log)
    rows = repository.read_log(spark, str(tmp_path / "log.txt"))
    assert {r["path"]: r["change_count"] for r in history.change_history(rows).collect()} == {"a.py": 5, "b.py": 4}
    (hit,) = history.coupling(rows, "a.py").collect()
    assert (hit["co_changes"], hit["confidence"], hit["label"]) == (4, 0.8, "4 / 5 recent changes")


def test_scalar_rules(spark):
    name, version = names.requirement(F.col("v"))
    lines = ["Some.Lib==1.2  # pin", "x[extra]>=2; python_version>'3'", "-r other.txt", "# note", "y"]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in lines], "v string").select(name, version).collect()]
    assert got == [("Some.Lib", "1.2"), ("x", ">=2"), (None, None), (None, None), ("y", None)]
    frame = spark.createDataFrame([("a\r\nb\x0bc",), ("",), ("x\n",)], "v string")
    assert [r[0] for r in frame.select(names.line_count(F.col("v"))).collect()] == [3, 0, 1]
    pages = spark.createDataFrame([("src/pages/blog/[slug].astro",), ("src/pages/index.astro",), ("src/pages/[...all].astro",)], "v string")
    route, kind = names.route(F.col("v"))
    assert [tuple(r) for r in pages.select(route, kind).collect()] == [("/blog/[slug]", "dynamic"), ("/", "static"), ("/[...all]", "rest")]


def test_python_extraction():
    facts = extract_python.read_python("tests/test_a.py", "import pytest\nfrom . import b as c\n@pytest.fixture(name='db', autouse=True)\ndef make(): pass\nclass TestX:\n    def test_y(self, db):\n        patch('a.b.c')\n")
    assert facts.tests == [{"name": "tests.test_a.TestX.test_y", "line": 6, "parameters": ["db"]}]
    assert facts.fixtures[0]["name"] == "db" and facts.fixtures[0]["autouse"]
    assert facts.patches[0]["target"] == "a.b.c"
    assert list(extract_python.candidates("tests/test_a.py", facts.imports[1]))[0] == "tests/b/__init__.py"
    assert extract_python.read_python("x.py", "def (").error


def test_text_extraction():
    js = "// import z from 'z'\nimport a, { b as c } from './m';\nconst s = \"class No {\";\nexport class Box {\n  open(x) {\n    if (x) { return 1; }\n  }\n}\nexport { a, c as d };\n"
    assert [(s["name"], s["kind"]) for s in extract_text.js_symbols("w/box.js", js)] == [("w.box", "module"), ("Box", "class"), ("open", "method")]
    assert [(r["module"], r["names"], r["default"]) for r in extract_text.js_imports(js)] == [("./m", ["b"], "a")]
    assert {e["name"] for e in extract_text.js_exports(js)} == {"Box", "a", "c"}
    rust = "use a::{b, c::{self, D as E}};\nimpl<T> fmt::Display for Box<T> {\n}\n"
    assert [(u["path"], u["local"]) for u in extract_text.rust_uses(rust)] == [("a::b", "b"), ("a::c", "c"), ("a::c::D", "E")]
    assert extract_text.rust_implements(rust) == [("Box", "Display")]
    assert extract_text.django_urls("path('a/<int:x>', views.A.as_view(), name='a')") == [{"route": "a/<int:x>", "view": "views.A", "name": "a"}]
    assert extract_text.react_usages("<Route path='/x' element={<Home/>} />")["routes"] == [("/x", "Home")]
    assert extract_text.astro_parts("---\nimport A from 'a';\n---\n<A/>") == ("import A from 'a';", "<A/>")


def test_stream_refresh_equals_the_last_versions(spark, tmp_path):
    feed = str(tmp_path / "feed")
    first = [(1, "a", 1, False), (2, "b", 1, False)]
    second = [(1, "z", 3, False), (1, "y", 2, False), (2, "b", 2, True), (3, "c", 1, False)]
    schema = "k int, v string, version int, deleted boolean"
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = changes.read_feed(spark, feed, spark.createDataFrame([], schema).schema)
        changes.refresh(stream, "k", str(tmp_path / "snap"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "snap/1")).collect())) == [(1, "z"), (3, "c")]


@pytest.mark.parametrize("count", [changes.windowed_counts, changes.sessions])
def test_stream_windows_match_the_batch(spark, tmp_path, count):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    feed = str(tmp_path / "feed")
    batch.repartition(3).write.parquet(feed)
    stream = changes.read_feed(spark, feed, batch.schema)
    out = count(stream, "ts", "event_type").writeStream.format("memory").queryName(count.__name__).outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    want = count(batch, "ts", "event_type")
    assert sorted(map(tuple, spark.table(count.__name__).collect())) == sorted(map(tuple, want.collect()))


def test_scripts_by_tokens():
    js = """import * as ns from 'ns';
const A = () => 1;
export function B(props: P): El { return (<div>Don't</div>); }
export const C: FC<P> = async ({a, b}) => (
  <Foo x={`a${b} const Z = () => 1`} />
);
const half = x => x / 2;
export default function Main() { const inner = () => <p/>; return 1 / 2 / 3; }
const lazy = import('./lazy'); const fs = require("fs");
class K extends L { static async go(a): Promise<number> { if (a) { } return 1 } }
"""
    kinds = {s["name"]: s["kind"] for s in extract_text.js_symbols("w.ts", js)}
    assert kinds == {"w": "module", "A": "function", "B": "component", "C": "component", "half": "function", "Main": "component", "K": "class", "go": "method"}
    assert [(r["module"], r["dynamic"]) for r in extract_text.js_imports(js)] == [("ns", False), ("./lazy", True), ("fs", True)]
    rust = "/* fn no() /* inner */ */ pub(crate) struct S<'a> { x: &'a str }\nfn t() { let c = '\\''; let s = r#\"fn z()\"#; }\nimpl S { pub async fn go(&self) {} }\nuse a::*;"
    assert [(s["name"], s["visibility"]) for s in extract_text.rust_symbols("m.rs", rust)] == [("m", "public"), ("S", "public"), ("t", "private"), ("go", "public")]
    assert [u["path"] for u in extract_text.rust_uses(rust)] == ["a::*"]
    assert extract_text.django_urls("x = [path('a', include('b')), re_path(r'^c$', v.f)]\n") == [{"route": "^c$", "view": "v.f", "name": None}]
    assert extract_text.django_urls("def (") == []


def test_use_lists_take_time_in_proportion():
    def seconds(n):
        source = "".join(f"use a{i}::b::{{c, d}};\n" for i in range(n)) + "use a::{" + ",".join(f"n{i}" for i in range(n)) + "};"
        took = []
        for _ in range(3):
            began = time.process_time()
            assert len(extract_text.rust_uses(source)) == 3 * n
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(8000) < 8 * seconds(2000)
