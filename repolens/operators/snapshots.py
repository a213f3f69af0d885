"""Snapshots: differences, keyed merges, edge cleanup and canonical dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """``key, status``: added, removed, changed or same; nulls compare as values."""
    a = old.select(key, F.struct(*measures).alias("was"), F.lit(True).alias("in_old"))
    b = new.select(key, F.struct(*measures).alias("now"), F.lit(True).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def merge(current: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Keyed upsert and delete on immutable files: what isn't touched, and what is new."""
    kept = current.join(changed.select(key).unionByName(removed.select(key)).distinct(), key, "left_anti")
    return kept.unionByName(changed)


def drop_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch none of the nodes that went (node), at either end."""
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return left.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON texts without surrogate ids: equal snapshots give equal sets."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("row"))


def fingerprint(name: str, version: str, settings: Column) -> Column:
    """``name@version#`` and twelve digits of the settings' digest."""
    return F.concat(F.lit(f"{name}@{version}#"), F.substring(F.sha2(settings, 256), 1, 12))
