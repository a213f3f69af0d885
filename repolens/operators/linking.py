"""Link joins: first-hit, unique, ambiguity-limited, prefix, nearest-scope, interval and recursive lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_candidate(requests: DataFrame, key: str, candidates: Column, targets: DataFrame) -> DataFrame:
    """The first of each request's ordered candidates that exists in ``targets`` (id): ``key, position, target``."""
    spread = requests.select(key, F.posexplode(candidates).alias("position", "id"))
    hit = spread.join(targets.select("id").distinct(), "id")
    best = hit.groupBy(key).agg(F.min(F.struct("position", "id")).alias("best"))
    return best.select(key, (F.col("best.position") + 1).cast("int").alias("position"), F.col("best.id").alias("target"))


def limited_matches(rows: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Rows whose key has at most ``most`` rows; one is sure, more are guesses of low confidence."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    found = rows.withColumn("candidates", n).where(F.col("candidates") <= most)
    return found.select(*keys, value, "candidates", F.when(F.col("candidates") > 1, "low").otherwise("high").alias("confidence"))


def prefixes(column: Column, separator: str, from_end: bool = False) -> Column:
    """All prefixes (or suffixes) of a separated name, whole parts only."""
    parts = F.split(column, separator)
    n = F.size(parts)
    if from_end:
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def longest_prefix(requests: DataFrame, key: str, parts: Column, known: DataFrame) -> DataFrame:
    """The longest of each request's prefixes that is in ``known`` (prefix): ``key, prefix, depth``."""
    spread = requests.select(key, F.posexplode(parts).alias("at", "prefix"))
    best = spread.join(known.select("prefix").distinct(), "prefix").groupBy(key).agg(F.max(F.struct("at", "prefix")).alias("best"))
    return best.select(key, "best.prefix", (F.col("best.at") + 1).cast("int").alias("depth"))


def nearest_override(levels: list[DataFrame], key: str) -> DataFrame:
    """Definitions (key, value, level) from outermost to innermost: the innermost one wins."""
    rows = levels[0].withColumn("depth", F.lit(0))
    for depth, level in enumerate(levels[1:], 1):
        rows = rows.unionByName(level.withColumn("depth", F.lit(depth)))
    best = rows.groupBy(key).agg(F.max(F.struct("depth", "level", "value")).alias("best"))
    return best.select(key, "best.level", "best.value")


def as_of(points: DataFrame, starts: DataFrame, key: str, order: list[str], tie: str) -> DataFrame:
    """For each point (key, *order[:1]) the last start of its key at or before it, by one sort of both sides
    instead of a range join: a key's intervals and points are never paired. Points before any start drop out."""
    left = starts.withColumn("_start", F.struct(tie)).withColumn("_point", F.lit(0))
    both = left.unionByName(points.withColumn("_point", F.lit(1)), allowMissingColumns=True)
    window = Window.partitionBy(key).orderBy(order[0], "_point", F.col(tie).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_hit", F.last("_start", ignorenulls=True).over(window)).where("_point = 1 and _hit is not null").drop("_start", "_point")


def ordered_evidence(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Distinct values of each key in first-seen order, joined: first sights are aggregated before they are
    collected, so a key's array has its distinct values only."""
    first = rows.groupBy(key, value).agg(F.min(F.struct(*order)).alias("seen"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seen", value))).alias("all"))
    return listed.select(key, F.array_join(F.transform("all", lambda x: x[value]), ",").alias("evidence"))


def member_of(owners: DataFrame, members: DataFrame, scope: str) -> DataFrame:
    """(owner, member) where a member's qualified name is the owner's or lies below it, within one scope: the
    equality on scope keeps the prefix condition from becoming a cross join."""
    left = owners.select(scope, F.col("qualified_name").alias("owner"))
    right = members.select(scope, F.col("qualified_name").alias("member"))
    below = (F.col("member") == F.col("owner")) | F.col("member").startswith(F.concat("owner", F.lit(".")))
    return left.join(right, scope).where(below)


def walk_up(tree: DataFrame, definitions: DataFrame, levels: int) -> DataFrame:
    """Each node with the nearest definition (node, value) on itself or its ancestors."""
    from .edges import ancestors

    own = tree.select(F.col("child").alias("node"), F.col("child").alias("ancestor"), F.lit(0).alias("depth"))
    chain = own.unionByName(ancestors(tree, levels))
    hit = chain.join(definitions.select(F.col("node").alias("ancestor"), "value"), "ancestor")
    best = hit.groupBy("node").agg(F.min(F.struct("depth", "ancestor", "value")).alias("best"))
    return best.select("node", "best.depth", "best.ancestor", "best.value")


def enclosing(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """The narrowest span [start, end] of its key around each point ``at``; the earlier start among equals."""
    hit = points.join(spans, key).where("at between start and end")
    best = hit.groupBy(key, "at").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("width"), "start", "end")).alias("best"))
    return best.select(key, "at", "best.start", "best.end")


def open_ends(spans: DataFrame, key: str, start: str) -> DataFrame:
    """Spans without an end go on to the next one's start less one; the last stays open (null)."""
    return spans.withColumn("end", F.lead(start).over(Window.partitionBy(key).orderBy(start)) - 1)
