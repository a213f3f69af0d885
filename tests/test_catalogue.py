"""Every registered query of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from repolens.plans import catalogue, extraction, lookups  # noqa: F401  lookups adds to the catalogue

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalogue.QUERIES | extraction.QUERIES
ORACLE = catalogue.ORACLE | extraction.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
