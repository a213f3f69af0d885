"""Registered queries of the extraction side, over sources given inline, and of the streaming side."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import extract_text
from repolens.operators import index
from repolens.sources import repository
from repolens.sources.tables import Tables
from repolens.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SOURCES = {
    "store/base.py": "LIMIT = 3\n\n\nclass Base:\n    size = 1\n\n    def load(self):\n        return helper()\n\n\ndef helper():\n    return LIMIT\n",
    "store/api.py": "from store.base import Base, helper\n\n\nclass Api(Base):\n    def run(self):\n        self.load()\n        return helper()\n",
    "tests/test_api.py": "from store.api import Api\n\n\ndef test_runs():\n    assert Api().run()\n",
    "web/button.jsx": "import React, { useState } from 'react';\n\nexport function Button() {\n  return <b>ok</b>;\n}\n\nclass Panel {\n  draw() {\n    return 1;\n  }\n}\nconst lazy = () => import('./panel');\n",
    "core/lib.rs": "use std::{fmt, io::{self, Read as R}};\n\npub struct Gear;\n\npub trait Turn {\n    fn turn(&self);\n}\n\nimpl Turn for Gear {\n    fn turn(&self) {}\n}\n",
    "pyproject.toml": '[project]\ndependencies = ["Some.Lib>=2", "other==1.0; python_version > \'3\'"]\n',
    "uv.lock": '[[package]]\nname = "some-lib"\nversion = "2.4"\n',
    "docs/adr/one.md": "# Use rows\n\ntext\n\n## Context\n",
}


def inline_files(spark: SparkSession) -> DataFrame:
    """The sources above in the shape of a repository scan."""
    rows = [(p, bytearray(t.encode())) for p, t in SOURCES.items()]
    extension = F.regexp_extract("path", r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in repository.LANGUAGES.items() for x in pair])
    files = spark.createDataFrame(rows, "path string, content binary")
    kind = F.when(F.col("path").startswith("tests/"), "test").otherwise("source")
    return files.select("path", F.try_element_at(table, extension).alias("language"), kind.alias("file_kind"), F.octet_length("content").cast("long").alias("size"), "content")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def extract_python_symbols(spark: SparkSession, folder: str) -> DataFrame:
    found = repository.symbols(inline_files(spark)).where(F.col("path").endswith(".py"))
    return found.select("path", "qualified_name", "kind", "start_line", "end_line", "visibility")


@query
def extract_js_imports(spark: SparkSession, folder: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [{"path": p, "module": r["module"], "names": ",".join(r["names"]), "line": r["line"], "dynamic": r["dynamic"]} for p, t in zip(b["path"], b["content"], strict=True) for r in extract_text.js_imports(bytes(t).decode())]
            yield pd.DataFrame(rows, columns=["path", "module", "names", "line", "dynamic"])

    return inline_files(spark).where("language = 'javascript'").select("path", "content").mapInPandas(run, "path string, module string, names string, line int, dynamic boolean")


@query
def extract_rust_items(spark: SparkSession, folder: str) -> DataFrame:
    return repository.symbols(inline_files(spark)).where(F.col("path").endswith(".rs")).select("path", "qualified_name", "kind", "start_line", "visibility")


@query
def repository_edges(spark: SparkSession, folder: str) -> DataFrame:
    return index.build(inline_files(spark)).edges


@query
def manifest_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return repository.dependencies(inline_files(spark))


@query
def architecture_facts(spark: SparkSession, folder: str) -> DataFrame:
    return repository.architecture_facts(inline_files(spark))


@query
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return changes.windowed_counts(Tables(spark, folder).events, "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


ORACLE["event_windows"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return changes.sessions(Tables(spark, folder).events, "ts", "user_id").select(F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "user_id", "n")


ORACLE["event_sessions"] = (
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) "
    "SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, s.n"
)
