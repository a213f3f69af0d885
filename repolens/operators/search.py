"""Symbol search: literal substring predicates, ranking, paging and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(column: Column, query: str) -> Column:
    """Case-insensitive literal substring: wildcard signs mean themselves."""
    return F.lower(column).contains(query.lower())


def rank_of(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 otherwise."""
    q = query.lower()
    return F.when(F.lower(name) == q, 0).when(F.lower(name).startswith(q), 1).otherwise(2)


def search(symbols: DataFrame, query: str, kind: str | None = None, exclude_languages: tuple[str, ...] = ()) -> DataFrame:
    """Symbols whose name or qualified name holds the query, with ``rank``. A null ``kind`` doesn't filter;
    null languages are never excluded."""
    found = symbols.where(contains(F.col("name"), query) | contains(F.col("qualified_name"), query))
    if kind is not None:
        found = found.where(F.col("kind") == kind)
    if exclude_languages:
        found = found.where(~F.coalesce(F.col("language"), F.lit("")).isin(*exclude_languages))
    return found.withColumn("rank", rank_of(F.col("name"), query))


def page(found: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page by kind (fields last), rank, qualified name and id, and whether more follows: one row beyond
    the page is fetched."""
    order = [F.col("kind") == "field", F.col("rank"), F.col("qualified_name"), F.col("symbol_id")]
    rows = found.orderBy(*order).offset(offset).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(*order))  # limit + 1 rows
    more = F.count(F.lit(1)).over(Window.partitionBy()) > limit
    rows = rows.withColumn("place", place).withColumn("has_more", more)
    return rows.where(F.col("place") <= limit).withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit).cast("long"))).drop("place")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def lookup(symbols: DataFrame, qualified_name: str) -> DataFrame:
    """The row of a qualified name with the smallest id."""
    return symbols.where(F.col("qualified_name") == qualified_name).orderBy("symbol_id").limit(1)


def resolve_entities(symbols: DataFrame, module_kind: str = "module") -> DataFrame:
    """For each name a module before any other symbol, then the smallest id."""
    return first_by(symbols, ["name"], [F.col("kind") != module_kind, F.col("symbol_id")])


def suggestions(symbols: DataFrame, query: str, limit: int = 5, most: int = 6) -> DataFrame:
    """The distinct names nearest to ``query`` by edit distance."""
    near = symbols.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(query.lower())))
    return near.where(F.col("distance") <= most).orderBy("distance", "name").limit(limit)
