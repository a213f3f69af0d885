"""Names in steps (exact, unique suffix, candidates, suggestions), descriptions, reach and edge priorities."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cycles import settled
from .linking import prefixes


def cascade(requests: DataFrame, names: DataFrame) -> DataFrame:
    """``request, status, found, candidates`` for each distinct request: the name itself, else the only name that
    ends in it (whole parts), else how many do, else nothing but suggestions. Suffixes are exploded (a name has
    few parts) and joined by equality."""
    ends = names.select("qualified_name", F.explode(prefixes(F.col("qualified_name"), r"\.", from_end=True)).alias("request"))
    hit = requests.select("request").distinct().join(ends, "request", "left")
    by = hit.groupBy("request").agg(F.bool_or(F.col("qualified_name") == F.col("request")).alias("exact"), F.count("qualified_name").alias("n"), F.min("qualified_name").alias("only"))
    status = F.when(F.col("exact"), "exact").when(F.col("n") == 1, "unique_suffix").when(F.col("n") > 1, "candidates").otherwise("suggestions")
    found = F.when(F.col("exact"), F.col("request")).when(F.col("n") == 1, F.col("only"))
    return by.select("request", status.alias("status"), found.alias("found"), F.col("n").alias("candidates"))


def close_matches(requests: DataFrame, names: DataFrame, most: int = 5, cutoff: float = 0.6) -> DataFrame:
    """``request, position, name``: the nearest distinct names by matching blocks. Spark has no such ratio; names
    go to each task in blocks by first sending every request to each block, then the best of all blocks count."""
    blocks = names.select("name").distinct().withColumn("block", F.pmod(F.xxhash64("name"), F.lit(16)))
    asked = requests.select("request").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    both = asked.withColumn("name", F.lit(None).cast("string")).unionByName(blocks.withColumn("request", F.lit(None).cast("string")))

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        known = sorted(rows["name"].dropna())
        found = [(r, n, difflib.SequenceMatcher(None, n, r).ratio()) for r in rows["request"].dropna() for n in difflib.get_close_matches(r, known, most, cutoff)]
        return pd.DataFrame(found, columns=["request", "name", "ratio"])

    near_rows = both.groupBy("block").applyInPandas(near, "request string, name string, ratio double")
    place = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("ratio"), F.desc("name")))
    return near_rows.withColumn("position", place).where(F.col("position") <= most).select("request", "position", "name")


def parent_name(name: Column) -> Column:
    """A qualified name without its last part; null for a name of one part."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))


def direct_members(owners: DataFrame, members: DataFrame) -> DataFrame:
    """(owner, member) for members directly below an owner: equality with the member's parent."""
    return members.select("qualified_name", parent_name(F.col("qualified_name")).alias("owner")).join(owners.select(F.col("qualified_name").alias("owner")).distinct(), "owner", "left_semi").select("owner", F.col("qualified_name").alias("member"))


def own_members(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (owner, name, caller) of a class's own members, as (caller, target)."""
    asked = calls.select("caller", F.concat_ws(".", "owner", "name").alias("qualified_name"))
    return asked.join(symbols.select("qualified_name"), "qualified_name").select("caller", F.col("qualified_name").alias("target"))


def stronger(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose keys it doesn't have."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``: all that ``roots`` (node) lead to, themselves included. Each round joins only nodes that are new,
    and is cut off from its history, so cycles end and plans stay short."""
    seen = front = settled(roots.select("node").distinct())
    step = edges.select(F.col("src").alias("node"), "dst").distinct()
    while not front.isEmpty():
        front = settled(front.join(step, "node").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = settled(seen.unionByName(front))
    return seen


def described(symbols: DataFrame, edges: DataFrame, shown: int = 5) -> DataFrame:
    """Each symbol (symbol_id, ...) with how many callers and callees it has and the first of each, by id: lists
    are cut by rank before they are collected."""

    def side(own: str, other: str, name: str) -> DataFrame:
        ranked = edges.select(F.col(own).alias("symbol_id"), F.col(other).alias("other")).withColumn("n", F.row_number().over(Window.partitionBy("symbol_id").orderBy("other")))
        first = F.sort_array(F.collect_list(F.when(F.col("n") <= shown, F.col("other"))))
        return ranked.groupBy("symbol_id").agg(F.max("n").cast("long").alias(f"{name}_count"), F.array_join(F.transform(first, lambda x: x.cast("string")), ",").alias(name))

    out = symbols.join(side("dst", "src", "callers"), "symbol_id", "left").join(side("src", "dst", "callees"), "symbol_id", "left")
    zero = F.lit(0).cast("long")
    return out.withColumn("callers_count", F.coalesce("callers_count", zero)).withColumn("callees_count", F.coalesce("callees_count", zero)).withColumn("callers", F.coalesce("callers", F.lit(""))).withColumn("callees", F.coalesce("callees", F.lit("")))
