"""The registered queries over the driver tables, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolens.functions import names
from repolens.operators import cycles, edges, history, linking, rules, search, snapshots
from repolens.sources.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NEWEST = 1000
TARGET = "part/7"


def query(sql: str | None) -> Callable:
    """Registers a function of the tables under its name."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return wrap


def newest_sql(n: int = NEWEST) -> str:
    return f"recent AS (SELECT commit_id FROM (SELECT DISTINCT commit_id, committed_at FROM changes ORDER BY committed_at DESC, commit_id DESC LIMIT {n}))"


# History


@query(with_views("changes") + " SELECT path, CAST(least(count(*), 100) AS BIGINT) AS change_count, strftime(arg_max(committed_at, commit_id), '%Y-%m-%d') AS last_changed FROM changes GROUP BY path")
def change_history(t: Tables) -> DataFrame:
    return history.change_history(t.changes())


@query(with_views("changes") + f", {newest_sql()} SELECT path, count(*) AS change_count FROM changes WHERE commit_id IN (SELECT commit_id FROM recent) GROUP BY path")
def change_history_windowed(t: Tables) -> DataFrame:
    return history.windowed_changes(t.changes(), NEWEST).groupBy("path").agg(F.count(F.lit(1)).alias("change_count"))


@query(with_views("changes") + f", {newest_sql()} SELECT path, count(*) AS change_count FROM changes WHERE commit_id IN (SELECT commit_id FROM recent) AND NOT starts_with(path, '.git') GROUP BY path HAVING count(*) >= 5")
def hotspots(t: Tables) -> DataFrame:
    return history.hotspots(t.changes(), NEWEST)


@query(with_views("changes") + f", mine AS (SELECT commit_id FROM changes WHERE path = '{TARGET}' ORDER BY committed_at DESC, commit_id DESC LIMIT 100), n AS (SELECT count(*) AS total FROM mine) SELECT path, count(*) AS co_changes, round(count(*) / any_value(total), 6) AS confidence, count(*) || ' / ' || any_value(total) || ' recent changes' AS label FROM changes, n WHERE commit_id IN (SELECT commit_id FROM mine) AND path <> '{TARGET}' GROUP BY path")
def change_coupling_target(t: Tables) -> DataFrame:
    return history.coupling(t.changes(), TARGET)


COUPLED = f"{newest_sql()}, rc AS (SELECT commit_id, path FROM changes WHERE commit_id IN (SELECT commit_id FROM recent)), coupled AS (SELECT a.path, count(DISTINCT b.path) AS coupled_file_count FROM rc a JOIN rc b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY a.path)"


@query(with_views("changes") + f", {COUPLED} SELECT path, coupled_file_count FROM coupled")
def coupled_file_count(t: Tables) -> DataFrame:
    return history.coupled_file_count(t.changes(), NEWEST)


# Search

FOUND = "found AS (SELECT *, CASE WHEN lower(name) = 'ring' THEN 0 WHEN starts_with(lower(name), 'ring') THEN 1 ELSE 2 END AS rank FROM symbols WHERE contains(lower(name), 'ring') OR contains(lower(qualified_name), 'ring'))"


@query(with_views("symbols") + ", found AS (SELECT *, CASE WHEN lower(name) = 'hot ring' THEN 0 WHEN starts_with(lower(name), 'hot ring') THEN 1 ELSE 2 END AS rank FROM symbols WHERE contains(lower(name), 'hot ring') OR contains(lower(qualified_name), 'hot ring')) SELECT rank, symbol_id, name, qualified_name FROM found ORDER BY rank, qualified_name, symbol_id LIMIT 30 OFFSET 5")
def symbol_search_ranked(t: Tables) -> DataFrame:
    found = search.search(t.symbols(), "hot ring")
    return found.orderBy("rank", "qualified_name", "symbol_id").offset(5).limit(30).select("rank", "symbol_id", "name", "qualified_name")


@query(with_views("files") + r" SELECT path FROM files WHERE path LIKE '%/doc\_1%' ESCAPE '\'")
def symbol_search_like_escape(t: Tables) -> DataFrame:
    return t.files().where(search.contains(F.col("path"), "/doc_1")).select("path")


@query(with_views("symbols") + f", {FOUND} SELECT symbol_id, qualified_name, rank FROM found WHERE kind = 'economy' AND coalesce(language, '') NOT IN ('Brand#1', 'Brand#2')")
def symbol_search_kind_filter(t: Tables) -> DataFrame:
    return search.search(t.symbols(), "ring", "economy", ("Brand#1", "Brand#2")).select("symbol_id", "qualified_name", "rank")


@query(with_views("symbols") + f", {FOUND}, fetched AS (SELECT *, row_number() OVER (ORDER BY kind = 'field', rank, qualified_name, symbol_id) AS n FROM found), page AS (SELECT * FROM fetched WHERE n > 20 AND n <= 41) SELECT symbol_id, qualified_name, (SELECT count(*) > 20 FROM page) AS has_more, CASE WHEN (SELECT count(*) > 20 FROM page) THEN CAST(40 AS BIGINT) END AS next_offset FROM page WHERE n <= 40")
def symbol_search_page(t: Tables) -> DataFrame:
    return search.page(search.search(t.symbols(), "ring"), 20, 20).select("symbol_id", "qualified_name", "has_more", "next_offset")


@query(with_views("symbols") + " SELECT symbol_id, name, qualified_name, kind FROM symbols WHERE qualified_name = 'Brand#2.ECONOMY.0' ORDER BY symbol_id LIMIT 1")
def symbol_lookup(t: Tables) -> DataFrame:
    return search.lookup(t.symbols(), "Brand#2.ECONOMY.0").select("symbol_id", "name", "qualified_name", "kind")


@query(with_views("symbols") + " SELECT name, symbol_id, kind FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY kind <> 'economy', symbol_id) = 1")
def entity_resolution_priority(t: Tables) -> DataFrame:
    return search.resolve_entities(t.symbols(), "economy").select("name", "symbol_id", "kind")


@query(with_views("symbols") + " SELECT name, CAST(levenshtein(lower(name), 'hot rign') AS INTEGER) AS distance FROM (SELECT DISTINCT name FROM symbols) WHERE levenshtein(lower(name), 'hot rign') <= 6 ORDER BY 2, 1 LIMIT 5")
def fuzzy_suggestions(t: Tables) -> DataFrame:
    return search.suggestions(t.symbols(), "hot rign")


# JSON metadata


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AND coalesce(event_type, '') NOT IN ('error')")
def json_metadata_filter(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.where((k > 50) & ~F.coalesce("event_type", F.lit("")).isin("error")).select("event_id", k.alias("k"))


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"seen\":\"1\"}' AS with_seen, '{\"seen\":\"1\"}' AS without_k FROM events")
def json_set_remove(t: Tables) -> DataFrame:
    """Objects with a key set, and with another removed, as canonical text."""
    meta = F.parse_json(F.coalesce("props", F.lit("{}")))
    k = F.variant_get(meta, "$.k", "long")
    return t.events.select("event_id", F.to_json(F.struct(k.alias("k"), F.lit("1").alias("seen"))).alias("with_seen"), F.to_json(F.struct(F.when(F.lit(False), k).alias("k"), F.lit("1").alias("seen"))).alias("without_k"))


# Edges


@query(with_views("calls", "symbols") + " SELECT c.src, c.dst, a.qualified_name AS source, b.qualified_name AS target FROM calls c JOIN symbols a ON c.src = a.symbol_id JOIN symbols b ON c.dst = b.symbol_id")
def dependencies_of(t: Tables) -> DataFrame:
    return edges.dependencies(t.calls(), t.symbols().select(F.col("symbol_id").alias("id"), F.col("qualified_name").alias("label"))).select("src", "dst", "source", "target")


@query(with_views("calls", "symbols") + " SELECT c.dst AS node, count(*) AS dependents, string_agg(a.qualified_name, ',' ORDER BY c.src) AS names FROM calls c JOIN symbols a ON c.src = a.symbol_id GROUP BY c.dst")
def dependents_of(t: Tables) -> DataFrame:
    rows = edges.dependencies(t.calls(), t.symbols().select(F.col("symbol_id").alias("id"), F.col("qualified_name").alias("label")))
    listed = F.array_sort(F.collect_list(F.struct("src", "source")))
    return rows.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"), F.array_join(F.transform(listed, lambda x: x["source"]), ",").alias("names"))


DEGREES = "degrees AS (SELECT p_partkey AS node, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM part LEFT JOIN (SELECT dst, count(*) AS i FROM calls GROUP BY dst) ON dst = p_partkey LEFT JOIN (SELECT src, count(*) AS o FROM calls GROUP BY src) ON src = p_partkey)"


@query(with_views("calls") + f", {DEGREES} SELECT node, fan_in, fan_out, fan_in > 1 AS high_fan_in, fan_out > 1 AS high_fan_out FROM degrees")
def fan_in_out(t: Tables) -> DataFrame:
    return edges.degrees(t.calls(), t.part.select(F.col("p_partkey").alias("node"))).select("*", (F.col("fan_in") > 1).alias("high_fan_in"), (F.col("fan_out") > 1).alias("high_fan_out"))


@query(with_views("calls") + " SELECT dst AS node, src AS caller FROM calls WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 = 0)")
def callers_excluding_tests(t: Tables) -> DataFrame:
    tests = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("src"))
    return t.calls().join(tests, "src", "left_anti").select(F.col("dst").alias("node"), F.col("src").alias("caller"))


@query(with_views("raw_calls") + " SELECT DISTINCT src, dst FROM raw_calls WHERE src <> dst")
def imports_dedup_no_self(t: Tables) -> DataFrame:
    return t.calls()


PATHS = "paths AS (SELECT src, dst, 1 AS depth, [src, dst] AS path FROM calls UNION ALL SELECT p.src, c.dst, p.depth + 1, list_append(p.path, c.dst) FROM paths p JOIN calls c ON c.src = p.dst WHERE p.depth < 3 AND NOT list_contains(p.path, c.dst))"


@query(with_views("calls", recursive=True) + f", {PATHS} SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM paths GROUP BY src, dst")
def indirect_reach_3hop(t: Tables) -> DataFrame:
    return edges.simple_paths(t.calls()).groupBy("src", "dst").agg(F.min("depth").alias("depth"))


@query(with_views("calls", recursive=True) + f", {PATHS}, texts AS (SELECT src, dst, depth, array_to_string(path, '>') AS path FROM paths) SELECT src, dst, CAST(depth AS INTEGER) AS depth, path FROM texts QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY depth, path) = 1")
def nearest_path_credit(t: Tables) -> DataFrame:
    return edges.nearest_paths(t.calls())


@query(with_views("calls", recursive=True) + f", {PATHS} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM paths WHERE len([x for x in path[2:len(path)-1] if x % 13 = 0]) = 0 GROUP BY depth")
def mocked_path_exclusion(t: Tables) -> DataFrame:
    kept = edges.without_interior(edges.simple_paths(t.calls()), F.col("node") % 13 == 0)
    return kept.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn_no FROM conversations")
def interleave_round_robin(t: Tables) -> DataFrame:
    return edges.round_robin(t.conversations.select("conv_id", "turn"), "conv_id", ["turn"]).orderBy("turn_no", "conv_id")


@query("SELECT conv_id, turn, CAST(rn AS INTEGER) AS turn_no, total FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE rn <= 3")
def cap_per_group_with_total(t: Tables) -> DataFrame:
    return edges.cap_per_group(t.conversations.select("conv_id", "turn"), "conv_id", ["turn"], 3)


@query(with_views("files") + " SELECT doc_id, source, running FROM (SELECT doc_id, source, CAST(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM files) WHERE running <= 20000")
def budget_prefix(t: Tables) -> DataFrame:
    return edges.budget_prefix(t.files().select("doc_id", "source", "size"), "source", ["doc_id"], "size", 20000).select("doc_id", "source", "running")


REACH = "reach AS (SELECT src, dst FROM calls UNION SELECT r.src, c.dst FROM reach r JOIN calls c ON c.src = r.dst)"


@query(with_views("calls", recursive=True) + f", {REACH} SELECT src AS node FROM reach WHERE src = dst")
def cycle_members(t: Tables) -> DataFrame:
    return cycles.components(t.calls()).select("node")


#: Breadth first from each node at once: a key (origin, here) is set when it is first seen.
WALK = "walk(origin, here, length) USING KEY (origin, here) AS (SELECT src, dst, 1 FROM calls UNION SELECT w.origin, c.dst, min(w.length) + 1 FROM walk w JOIN calls c ON c.src = w.here LEFT JOIN recurring.walk r ON r.origin = w.origin AND r.here = c.dst WHERE r.origin IS NULL GROUP BY w.origin, c.dst)"


@query(with_views("calls", recursive=True) + f", {WALK} SELECT origin AS node, CAST(length AS INTEGER) AS length FROM walk WHERE origin = here")
def shortest_cycle_length(t: Tables) -> DataFrame:
    return cycles.all_cycles(cycles.settled(t.calls())).select("node", "length")


# Rules

FILE_SQL = "SELECT path AS target, 'large_file' AS signal, 'medium' AS severity, 'high' AS confidence, line_count || ' lines > 40' AS evidence FROM files WHERE line_count > 40"
SYMBOL_SQL = "SELECT qualified_name AS target, 'large_symbol' AS signal, 'medium' AS severity, 'high' AS confidence, (end_line - start_line + 1) || ' lines > 40' AS evidence FROM symbols WHERE end_line - start_line + 1 > 40"
CHURN_SQL = "SELECT path AS target, 'high_churn' AS signal, 'medium' AS severity, 'high' AS confidence, least(count(*), 100) || ' changes > 20' AS evidence FROM changes GROUP BY path HAVING least(count(*), 100) > 20"
COUPLING_SQL = "SELECT path AS target, 'high_temporal_coupling' AS signal, 'medium' AS severity, 'high' AS confidence, coupled_file_count || ' files > 5' AS evidence FROM coupled WHERE coupled_file_count > 5"
PATHS_SQL = "SELECT path AS target, 'explicit_legacy_path' AS signal, 'high' AS severity, 'high' AS confidence, CASE WHEN starts_with(path, 'src1') THEN 'under src1' ELSE 'under src2/' END AS evidence FROM files WHERE starts_with(path, 'src1') OR starts_with(path, 'src2/')"
WEAK_SQL = "SELECT path AS target, 'weak_test_relationship' AS signal, CASE WHEN NOT known THEN 'medium' WHEN n IS NULL THEN 'high' ELSE 'medium' END AS severity, CASE WHEN NOT known THEN 'unknown' WHEN n IS NULL THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN NOT known THEN 'unknown' WHEN n IS NULL THEN 'none' ELSE 'weak' END AS evidence FROM (SELECT path, coalesce(analysis_status, '') <> 'file_failed' AS known FROM files) LEFT JOIN (SELECT target, count(*) AS n, bool_or(confidence = 'high') AS strong FROM tests GROUP BY target) ON target = path WHERE NOT known OR n IS NULL OR NOT strong"


@query(with_views("files") + " " + FILE_SQL)
def legacy_large_file(t: Tables) -> DataFrame:
    return rules.over(t.files(), "path", F.col("line_count"), 40, "large_file", "%d lines > %d")


@query(with_views("symbols") + " " + SYMBOL_SQL)
def legacy_large_symbol(t: Tables) -> DataFrame:
    return rules.over(t.symbols(), "qualified_name", F.col("end_line") - F.col("start_line") + 1, 40, "large_symbol", "%d lines > %d")


@query(with_views("changes") + " " + CHURN_SQL)
def legacy_churn(t: Tables) -> DataFrame:
    return rules.over(history.change_history(t.changes()), "path", F.col("change_count"), 20, "high_churn", "%d changes > %d")


@query(with_views("changes") + f", {COUPLED} {COUPLING_SQL}")
def legacy_coupling(t: Tables) -> DataFrame:
    return rules.over(history.coupled_file_count(t.changes(), NEWEST), "path", F.col("coupled_file_count"), 5, "high_temporal_coupling", "%d files > %d")


@query(with_views("files") + " " + PATHS_SQL)
def legacy_paths(t: Tables) -> DataFrame:
    return rules.legacy_paths(t.files(), ["src1", "src2/"])


@query(with_views("tests") + " " + WEAK_SQL)
def weak_test_relationship(t: Tables) -> DataFrame:
    """A file whose analysis failed has tests or not: that is not known."""
    return rules.weak_tests(t.files().withColumn("analyzed", F.coalesce("analysis_status", F.lit("")) != "file_failed"), t.tests())


FAN_SQL = "SELECT CAST(node AS VARCHAR) AS target, 'high_fan_in' AS signal, 'medium' AS severity, 'high' AS confidence, fan_in || ' dependents > 1' AS evidence FROM degrees WHERE fan_in > 1 UNION ALL SELECT CAST(node AS VARCHAR), 'high_fan_out', 'medium', 'high', fan_out || ' dependencies > 1' FROM degrees WHERE fan_out > 1"


@query(with_views("calls") + f", {DEGREES} {FAN_SQL}")
def legacy_fan(t: Tables) -> DataFrame:
    return fans(t, t.calls())


def fans(t: Tables, calls: DataFrame) -> DataFrame:
    d = edges.degrees(calls, t.part.select(F.col("p_partkey").alias("node"))).withColumn("node", F.col("node").cast("string"))
    return rules.over(d, "node", F.col("fan_in"), 1, "high_fan_in", "%d dependents > %d").unionByName(rules.over(d, "node", F.col("fan_out"), 1, "high_fan_out", "%d dependencies > %d"))


@query(None)
def legacy_circular_dependency(t: Tables) -> DataFrame:
    return rules.cycle_signals(cycles.all_cycles(cycles.settled(t.calls())))


CYCLE_SQL = "SELECT CAST(origin AS VARCHAR) AS target, 'circular_dependency' AS signal, 'high' AS severity, 'high' AS confidence, 'cycle of ' || length AS evidence FROM walk WHERE origin = here"
ORACLE["legacy_circular_dependency"] = with_views("calls", recursive=True) + f", {WALK} {CYCLE_SQL}"
#: Rules in the order in which they run.
RULES_SQL = [FILE_SQL, SYMBOL_SQL, PATHS_SQL, FAN_SQL, CYCLE_SQL, CHURN_SQL, COUPLING_SQL, WEAK_SQL]
ALL_SQL = with_views("files", "symbols", "changes", "tests", "calls", recursive=True) + f", {COUPLED}, {DEGREES}, {WALK}, signals AS (" + " UNION ALL ".join(f"SELECT *, {k} AS signal_order FROM ({q})" for k, q in enumerate(RULES_SQL)) + ")"


@query(ALL_SQL + " SELECT * FROM signals")
def legacy_signals_all(t: Tables) -> DataFrame:
    """All rules in their order: structure, fans, cycles, churn, coupling, tests. Fans and cycles read one call graph."""
    return signals(t, cycles.settled(t.calls()), cycles.all_cycles)


def signals(t: Tables, calls: DataFrame, on_cycles: Callable[[DataFrame], DataFrame]) -> DataFrame:
    found = None
    for order, rule in enumerate((legacy_large_file, legacy_large_symbol, legacy_paths, lambda t: fans(t, calls), lambda _: rules.cycle_signals(on_cycles(calls)), legacy_churn, legacy_coupling, weak_test_relationship)):
        rows = rule(t).withColumn("signal_order", F.lit(order))
        found = rows if found is None else found.unionByName(rows)
    return found


def signals_of(t: Tables, target: str) -> DataFrame:
    """``legacy_signals_all`` of one target: its own calls are written down, and the whole call graph only where it has any."""
    calls = t.calls()
    own = cycles.settled(calls.where((F.col("src").cast("string") == target) | (F.col("dst").cast("string") == target)))
    kind = calls.schema["src"].dataType.simpleString()
    none = lambda _: t.spark.createDataFrame([], f"node {kind}, component {kind}, length int")
    on_cycles = none if own.isEmpty() else lambda _: cycles.all_cycles(cycles.settled(calls))
    return signals(t, own, on_cycles).where(F.col("target") == target)


@query(ALL_SQL + " SELECT target, count(*) AS signal_count, string_agg(signal, ',' ORDER BY signal) AS signals FROM signals GROUP BY target ORDER BY 2 DESC, 1 LIMIT 20")
def legacy_hotspots(t: Tables) -> DataFrame:
    return rules.hotspots(legacy_signals_all(t))


@query(ALL_SQL + " SELECT * FROM signals WHERE target = 'src1/en/doc_1'")
def legacy_signals_of_target(t: Tables) -> DataFrame:
    return signals_of(t, "src1/en/doc_1")


# Tests and evidence


@query(with_views("tests") + " SELECT coalesce(confidence, 'total') AS confidence, count(*) AS n FROM tests GROUP BY ROLLUP (confidence)")
def test_summary(t: Tables) -> DataFrame:
    return t.tests().rollup("confidence").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("confidence", F.lit("total")).alias("confidence"), "n")


@query("WITH first AS (SELECT user_id, event_type, min((ts, event_id)) AS seen FROM events GROUP BY user_id, event_type), best AS (SELECT user_id, CASE WHEN bool_or(value > 50) THEN 'high' ELSE 'low' END AS confidence FROM events GROUP BY user_id) SELECT f.user_id, string_agg(event_type, ',' ORDER BY seen) AS evidence, any_value(confidence) AS confidence FROM first f JOIN best b ON f.user_id = b.user_id GROUP BY f.user_id")
def evidence_merge(t: Tables) -> DataFrame:
    best = t.events.groupBy("user_id").agg(F.when(F.bool_or(F.col("value") > 50), "high").otherwise("low").alias("confidence"))
    return linking.ordered_evidence(t.events, "user_id", "event_type", ["ts", "event_id"]).join(best, "user_id")


# Link joins


@query("SELECT p_brand, p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_name HAVING count(*) = 1")
def unique_match_join(t: Tables) -> DataFrame:
    return linking.limited_matches(t.part, ["p_brand", "p_name"], "p_partkey", 1).select("p_brand", "p_name", "p_partkey")


@query("SELECT p_brand, p_name, p_partkey, candidates, CASE WHEN candidates > 1 THEN 'low' ELSE 'high' END AS confidence FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS candidates FROM part) WHERE candidates <= 3")
def ambiguous_limit_join(t: Tables) -> DataFrame:
    return linking.limited_matches(t.part, ["p_brand", "p_name"], "p_partkey", 3)


@query("WITH r AS (SELECT DISTINCT l_partkey FROM lineitem), c AS (SELECT l_partkey, unnest([l_partkey + 1, l_partkey + 2, l_partkey]) AS id, unnest([1, 2, 3]) AS position FROM r) SELECT l_partkey, CAST(position AS INTEGER) AS position, id AS target FROM c WHERE id IN (SELECT p_partkey FROM part WHERE p_size > 40) QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY position) = 1")
def first_candidate_join(t: Tables) -> DataFrame:
    requests = t.lineitem.select("l_partkey").distinct()
    k = F.col("l_partkey")
    return linking.first_candidate(requests, "l_partkey", F.array(k + 1, k + 2, k), t.part.where("p_size > 40").select(F.col("p_partkey").alias("id")))


SUFFIXES = "hosts AS (SELECT page_id, string_split(regexp_extract(url, '://([^/]+)', 1), '.') AS p FROM pages), s AS (SELECT page_id, k AS depth, array_to_string(p[len(p)-k+1:], '.') AS prefix FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS k FROM hosts)), shared AS (SELECT prefix FROM s GROUP BY prefix HAVING count(DISTINCT page_id) >= 2)"


@query(f"WITH {SUFFIXES} SELECT page_id, prefix, CAST(depth AS INTEGER) AS depth FROM s WHERE prefix IN (SELECT prefix FROM shared) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY depth DESC) = 1")
def longest_prefix_join(t: Tables) -> DataFrame:
    parts = linking.prefixes(F.regexp_extract("url", "://([^/]+)", 1), r"\.", from_end=True)
    shared = t.pages.select("page_id", F.explode(parts).alias("prefix")).groupBy("prefix").agg(F.countDistinct("page_id").alias("n")).where("n >= 2")
    return linking.longest_prefix(t.pages, "page_id", parts, shared)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'supplier' WHEN n_nationkey % 2 = 1 THEN 'nation' ELSE 'region' END AS level, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey ELSE CASE WHEN n_nationkey % 2 = 1 THEN n_nationkey * 10 ELSE n_regionkey * 100 END END AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def nearest_ancestor_override(t: Tables) -> DataFrame:
    placed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    level = lambda name, value, cond="true": placed.where(cond).select("s_suppkey", F.lit(name).alias("level"), value.cast("long").alias("value"))
    return linking.nearest_override([level("region", F.col("n_regionkey") * 100), level("nation", F.col("n_nationkey") * 10, "n_nationkey % 2 = 1"), level("supplier", F.col("s_suppkey"), "s_suppkey % 10 = 0")], "s_suppkey")


@query("WITH iv AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders), pts AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, iv.o_orderkey AS interval_key FROM pts p JOIN iv ON p.o_custkey = iv.o_custkey AND p.l_shipdate >= iv.o_orderdate AND (iv.until IS NULL OR p.l_shipdate < iv.until)")
def line_range_join(t: Tables) -> DataFrame:
    starts = t.orders.select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey")
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    points = t.lineitem.join(owner, "l_orderkey").select("o_custkey", F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", "l_partkey")
    hit = linking.as_of(points, starts, "o_custkey", ["at"], "o_orderkey")
    return hit.select("l_orderkey", "l_linenumber", "l_partkey", F.col("_hit.o_orderkey").alias("interval_key"))


@query(with_views("tree", recursive=True) + ", up AS (SELECT child AS node, child AS ancestor, 0 AS depth FROM tree UNION ALL SELECT u.node, t.parent, u.depth + 1 FROM up u JOIN tree t ON t.child = u.ancestor), defs AS (SELECT 'n' || n_nationkey AS node, n_name AS value FROM nation WHERE n_nationkey % 2 = 1 UNION ALL SELECT 'r' || r_regionkey, r_name FROM region) SELECT u.node, CAST(u.depth AS INTEGER) AS depth, u.ancestor, d.value FROM up u JOIN defs d ON d.node = u.ancestor QUALIFY row_number() OVER (PARTITION BY u.node ORDER BY u.depth) = 1")
def inheritance_walk(t: Tables) -> DataFrame:
    nation = t.nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("value"))
    region = t.region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("value"))
    return linking.walk_up(t.tree(), nation.unionByName(region), 3)


@query("SELECT a.p_brand, a.p_type AS owner, b.p_type || '.' || b.p_size AS member, count(*) AS n FROM (SELECT DISTINCT p_brand, p_type FROM part) a JOIN part b ON a.p_brand = b.p_brand AND (b.p_type || '.' || b.p_size = a.p_type OR starts_with(b.p_type || '.' || b.p_size, a.p_type || '.')) GROUP BY ALL")
def member_prefix_join(t: Tables) -> DataFrame:
    owners = t.part.select("p_brand", F.col("p_type").alias("qualified_name")).distinct()
    members = t.part.select("p_brand", F.concat_ws(".", "p_type", "p_size").alias("qualified_name"))
    return linking.member_of(owners, members, "p_brand").groupBy("p_brand", "owner", "member").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, p_size AS at, min_by(s, (e - s, s)) AS start, min_by(e, (e - s, s)) AS \"end\" FROM (SELECT DISTINCT p_brand, p_size FROM part) JOIN (SELECT p_brand AS b, min(p_size) AS s, max(p_size) AS e FROM part GROUP BY p_brand, p_type) ON b = p_brand AND p_size BETWEEN s AND e GROUP BY p_brand, p_size")
def smallest_enclosing_span(t: Tables) -> DataFrame:
    spans = t.part.groupBy("p_brand", "p_type").agg(F.min("p_size").alias("start"), F.max("p_size").alias("end")).drop("p_type")
    return linking.enclosing(t.part.select("p_brand", F.col("p_size").alias("at")).distinct(), spans, "p_brand")


@query("SELECT p_brand, p_size, coalesce(lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) - 1, -1) AS \"end\" FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def lead_interval_ends(t: Tables) -> DataFrame:
    ends = linking.open_ends(t.part.select("p_brand", "p_size").distinct(), "p_brand", "p_size")
    return ends.withColumn("end", F.coalesce("end", F.lit(-1)))


@query("SELECT p_name, arg_min(p_type, p_partkey) AS p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def last_definition_wins(t: Tables) -> DataFrame:
    """Definitions are read by falling id and each overwrites its name's: the lowest id wins."""
    return t.part.groupBy("p_name").agg(F.min_by("p_type", "p_partkey").alias("p_type"), F.min("p_partkey").alias("p_partkey"))


@query("WITH marked AS (SELECT l_orderkey % 50 AS a, l_partkey % 50 AS b, 'high' AS c FROM lineitem WHERE l_quantity > 49 UNION ALL SELECT l_orderkey % 50, l_partkey % 50, 'low' FROM lineitem) SELECT a, b, min(c) AS confidence FROM marked GROUP BY a, b")
def union_priority_dedup(t: Tables) -> DataFrame:
    pair = [(F.col("l_orderkey") % 50).alias("a"), (F.col("l_partkey") % 50).alias("b")]
    both = t.lineitem.where("l_quantity > 49").select(*pair, F.lit("high").alias("c")).unionByName(t.lineitem.select(*pair, F.lit("low").alias("c")))
    return both.groupBy("a", "b").agg(F.when(F.bool_or(F.col("c") == "high"), "high").otherwise("low").alias("confidence"))


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS recorded FROM nation")
def exists_flag(t: Tables) -> DataFrame:
    rich = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    return t.nation.select("n_nationkey").join(rich, "n_nationkey", "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("recorded"))


# Overview, dependencies, architecture, coverage


@query(with_views("files") + " SELECT CASE WHEN line_count > 50 THEN 'docs' ELSE 'source' END AS file_kind, count(*) AS n FROM files GROUP BY 1")
def file_counts_by_kind(t: Tables) -> DataFrame:
    return t.files().groupBy(F.when(F.col("line_count") > 50, "docs").otherwise("source").alias("file_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT string_agg(lang, ',' ORDER BY lang) AS languages FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def distinct_languages(t: Tables) -> DataFrame:
    return t.documents.agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


@query(with_views("files") + " SELECT DISTINCT string_split(path, '/')[1] AS root FROM files WHERE len(string_split(path, '/')) > 1")
def inferred_roots(t: Tables) -> DataFrame:
    parts = F.split("path", "/")
    return t.files().where(F.size(parts) > 1).select(parts[0].alias("root")).distinct()


@query(with_views("deps") + " SELECT name, ecosystem, coalesce(nullif(resolved, ''), nullif(declared, '')) AS version, CASE WHEN coalesce(resolved, '') <> '' THEN 'resolved' WHEN coalesce(declared, '') <> '' THEN 'declared' ELSE 'unknown' END AS status FROM deps")
def dependency_versions(t: Tables) -> DataFrame:
    return t.dependencies().select("name", "ecosystem", names.chosen_version(F.col("resolved"), F.col("declared")).alias("version"), names.version_status(F.col("resolved"), F.col("declared")).alias("status"))


@query(with_views("deps") + " SELECT d.dep_id, lower(regexp_replace(d.name, '[-_.]+', '-', 'g')) AS key FROM deps d WHERE lower(regexp_replace(d.name, '[-_.]+', '-', 'g')) IN (SELECT lower(regexp_replace(replace(upper(p_name), ' ', '--') || '__' || p_partkey, '[-_.]+', '-', 'g')) FROM part WHERE p_partkey % 2 = 0)")
def dependency_key_match(t: Tables) -> DataFrame:
    asked = t.part.where("p_partkey % 2 = 0").select(F.concat(F.regexp_replace(F.upper("p_name"), " ", "--"), F.lit("__"), "p_partkey").alias("name"))
    keys = asked.select(names.normalized_package(F.col("name")).alias("key")).distinct()
    return t.dependencies().select("dep_id", names.normalized_package(F.col("name")).alias("key")).join(keys, "key", "left_semi").select("dep_id", "key")


@query(with_views("headings") + " SELECT page_id, subject, object FROM headings")
def doc_headings(t: Tables) -> DataFrame:
    return t.headings().select("page_id", "subject", "object")


@query(with_views("headings") + " SELECT subject, 'described_in' AS predicate, object FROM headings WHERE contains(lower(subject), 'the') OR contains(lower(object), 'the')")
def architecture_context(t: Tables) -> DataFrame:
    hit = search.contains(F.col("subject"), "the") | search.contains(F.col("object"), "the")
    return t.headings().where(hit).select("subject", F.lit("described_in").alias("predicate"), "object")


@query(with_views("files") + " SELECT language, count(*) AS files, CAST(sum(CASE WHEN analysis_status = 'file_failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CASE WHEN bool_and(coalesce(analysis_status = 'analyzed', false)) THEN 'full' WHEN bool_or(coalesce(analysis_status = 'analyzed', false)) THEN 'partial' ELSE 'none' END AS status FROM files GROUP BY language")
def coverage_by_language(t: Tables) -> DataFrame:
    done = F.coalesce(F.col("analysis_status") == "analyzed", F.lit(False))
    return t.files().groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("analysis_status") == "file_failed", 1).otherwise(0)).alias("failed"),
        F.when(F.bool_and(done), "full").when(F.bool_or(done), "partial").otherwise("none").alias("status"),
    )


@query(with_views("files") + " SELECT language, count(*) AS n FROM files WHERE language NOT IN ('en', 'de') GROUP BY language")
def uncovered_languages(t: Tables) -> DataFrame:
    covered = t.spark.createDataFrame([("en",), ("de",)], "language string")
    return t.files().join(F.broadcast(covered), "language", "left_anti").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("files") + " SELECT language, path, CAST(n AS INTEGER) AS n, running FROM (SELECT language, path, row_number() OVER (PARTITION BY language ORDER BY path) AS n, CAST(sum(length(path)) OVER (PARTITION BY language ORDER BY path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM files WHERE analysis_status = 'file_failed') WHERE n <= 20 AND running <= 200")
def coverage_error_samples(t: Tables) -> DataFrame:
    failed = t.files().where("analysis_status = 'file_failed'").select("language", "path", F.length("path").cast("long").alias("size"))
    kept = edges.budget_prefix(failed, "language", ["path"], "size", 200)
    return edges.round_robin(kept, "language", ["path"]).where("turn_no <= 20").select("language", "path", F.col("turn_no").alias("n"), "running")


# Snapshots

A_SQL = "a AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 10 <> 1)"
DIFF_SQL = "d AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.size IS NOT DISTINCT FROM b.size THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id)"


def two_snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    sized = t.documents.select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return sized.where("doc_id % 10 <> 0"), sized.where("doc_id % 10 <> 1").withColumn("size", F.col("size") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))


@query(f"WITH {A_SQL}, {DIFF_SQL} SELECT doc_id, status FROM d")
def staleness_diff(t: Tables) -> DataFrame:
    return snapshots.diff(*two_snapshots(t), "doc_id", ["size"])


@query(f"WITH {A_SQL} SELECT doc_id, size FROM b")
def incremental_merge(t: Tables) -> DataFrame:
    old, new = two_snapshots(t)
    status = snapshots.diff(old, new, "doc_id", ["size"])
    changed = new.join(status.where("status in ('added', 'changed')").select("doc_id"), "doc_id", "left_semi")
    return snapshots.merge(old, changed, status.where("status = 'removed'").select("doc_id"), "doc_id")


@query(with_views("calls") + " SELECT src, dst FROM calls WHERE src % 4 <> 0 AND dst % 4 <> 0")
def remove_file_edges(t: Tables) -> DataFrame:
    return snapshots.drop_edges(t.calls(), t.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("node")))


@query("SELECT '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS row FROM nation")
def canonical_snapshot(t: Tables) -> DataFrame:
    return snapshots.canonical(t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), ["name", "region"])


@query("SELECT source, 'docs@' || '1.0' || '#' || substr(sha256(source), 1, 12) AS fingerprint FROM (SELECT DISTINCT source FROM documents)")
def settings_fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct().select("source", snapshots.fingerprint("docs", "1.0", F.col("source")).alias("fingerprint"))


# Benchmark


@query(with_views("files") + ", s AS (SELECT source, CAST(sum(token_count) AS BIGINT) AS naive_tokens, CAST(sum(CASE WHEN doc_id % 10 = 0 THEN token_count ELSE 0 END) AS BIGINT) AS pack_tokens, CAST(sum(size) AS BIGINT) AS naive_bytes FROM files GROUP BY source) SELECT *, CASE WHEN naive_tokens = 0 THEN 0.0 ELSE round((naive_tokens - pack_tokens) * 100.0 / naive_tokens, 6) END AS reduction_pct FROM s")
def token_reduction_report(t: Tables) -> DataFrame:
    by = t.files().groupBy("source").agg(F.sum("token_count").alias("naive_tokens"), F.sum(F.when(F.col("doc_id") % 10 == 0, F.col("token_count")).otherwise(0)).alias("pack_tokens"), F.sum("size").alias("naive_bytes"))
    return by.withColumn("reduction_pct", names.reduction(F.col("naive_tokens"), F.col("pack_tokens")).cast("double"))


@query("WITH s AS (SELECT source, sum(n_chars) AS naive, sum(CASE WHEN doc_id % 10 = 0 THEN n_chars ELSE 0 END) AS pack FROM documents GROUP BY source) SELECT count(*) AS tasks, round(coalesce(avg(CASE WHEN naive = 0 THEN 0 ELSE (naive - pack) * 100.0 / naive END), 0.0), 4) AS avg_reduction FROM s")
def benchmark_summary(t: Tables) -> DataFrame:
    by = t.documents.groupBy("source").agg(F.sum("n_chars").alias("naive"), F.sum(F.when(F.col("doc_id") % 10 == 0, F.col("n_chars")).otherwise(0)).alias("pack"))
    part = F.when(F.col("naive") == 0, 0.0).otherwise((F.col("naive") - F.col("pack")) * F.lit(100.0) / F.col("naive")).cast("double")
    return by.agg(F.count(F.lit(1)).alias("tasks"), F.round(F.coalesce(F.avg(part), F.lit(0.0)), 4).alias("avg_reduction"))


@query("WITH x AS (SELECT d.doc_id, d.n_chars > 1000 AS recommended, coalesce(l.quality = 1, false) AS relevant FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), c AS (SELECT count(*) FILTER (recommended) AS r, count(*) FILTER (relevant) AS v, count(*) FILTER (recommended AND relevant) AS b FROM x) SELECT CASE WHEN r = 0 THEN 0.0 ELSE round(b / r, 6) END AS precision, CASE WHEN v = 0 THEN 0.0 ELSE round(b / v, 6) END AS recall FROM c")
def precision_recall(t: Tables) -> DataFrame:
    x = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select((F.col("n_chars") > 1000).alias("r"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("v"))
    c = x.agg(F.count_if("r").alias("r"), F.count_if("v").alias("v"), F.count_if(F.col("r") & F.col("v")).alias("b"))
    ratio = lambda n: F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.round(F.col("b") / F.col(n), 6))
    return c.select(ratio("r").alias("precision"), ratio("v").alias("recall"))


# Context packs, as flat rows of (section, item, score)


@query(with_views("calls", "symbols", "tests") + " SELECT 'dependency' AS section, CAST(dst AS VARCHAR) AS item FROM (SELECT dst FROM calls WHERE src = 100 ORDER BY dst LIMIT 10) UNION ALL SELECT 'dependent', CAST(src AS VARCHAR) FROM (SELECT src FROM calls WHERE dst = 100 ORDER BY src LIMIT 10) UNION ALL SELECT 'symbol', qualified_name FROM symbols WHERE symbol_id = 100")
def context_pack_symbol(t: Tables) -> DataFrame:
    calls, section = t.calls(), lambda df, name, item: df.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"))
    out = section(calls.where("src = 100").orderBy("dst").limit(10), "dependency", "dst")
    out = out.unionByName(section(calls.where("dst = 100").orderBy("src").limit(10), "dependent", "src"))
    return out.unionByName(section(t.symbols().where("symbol_id = 100"), "symbol", "qualified_name"))


@query(with_views("symbols", "calls") + f", {FOUND}, top AS (SELECT * FROM found ORDER BY rank, qualified_name, symbol_id LIMIT 10) SELECT 'match' AS section, qualified_name AS item FROM top UNION ALL SELECT DISTINCT 'dependency', s.qualified_name FROM calls c JOIN top ON c.src = top.symbol_id JOIN symbols s ON s.symbol_id = c.dst")
def context_pack_feature(t: Tables) -> DataFrame:
    top = search.search(t.symbols(), "ring").orderBy("rank", "qualified_name", "symbol_id").limit(10)
    hit = t.calls().join(F.broadcast(top.select(F.col("symbol_id").alias("src"))), "src", "left_semi")
    deps = hit.join(t.symbols().select(F.col("symbol_id").alias("dst"), "qualified_name"), "dst").select(F.lit("dependency").alias("section"), F.col("qualified_name").alias("item")).distinct()
    return top.select(F.lit("match").alias("section"), F.col("qualified_name").alias("item")).unionByName(deps)


@query(with_views("symbols", "changes", "calls") + f", {newest_sql()}, {FOUND}, top AS (SELECT * FROM found ORDER BY rank, qualified_name, symbol_id LIMIT 10), hot AS (SELECT path, count(*) AS n FROM changes WHERE commit_id IN (SELECT commit_id FROM recent) GROUP BY path) SELECT symbol_id, (SELECT count(*) FROM calls WHERE dst = symbol_id) AS callers, coalesce(n, 0) AS recent_changes, coalesce(n, 0) >= 5 AS high_risk FROM top LEFT JOIN hot ON path = 'part/' || symbol_id")
def context_pack_bug(t: Tables) -> DataFrame:
    top = search.search(t.symbols(), "ring").orderBy("rank", "qualified_name", "symbol_id").limit(10).select("symbol_id", F.concat(F.lit("part/"), "symbol_id").alias("path"))
    callers = t.calls().groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("callers"))
    hot = history.windowed_changes(t.changes(), NEWEST).groupBy("path").agg(F.count(F.lit(1)).alias("recent_changes"))
    n = F.coalesce("recent_changes", F.lit(0).cast("long"))
    joined = top.join(callers, "symbol_id", "left").join(hot, "path", "left")
    return joined.select("symbol_id", F.coalesce("callers", F.lit(0).cast("long")).alias("callers"), n.alias("recent_changes"), (n >= 5).alias("high_risk"))


@query(with_views("calls", "changes") + f", mine AS (SELECT commit_id FROM changes WHERE path = '{TARGET}' ORDER BY committed_at DESC, commit_id DESC LIMIT 100), together AS (SELECT path, count(*) AS n FROM changes WHERE commit_id IN (SELECT commit_id FROM mine) AND path <> '{TARGET}' GROUP BY path ORDER BY n DESC, path LIMIT 10), churn AS ({CHURN_SQL}) SELECT 'dependent' AS section, CAST(src AS VARCHAR) AS item FROM calls WHERE dst = 7 UNION ALL SELECT 'co_change', path FROM together UNION ALL SELECT 'signal', signal FROM churn WHERE target = '{TARGET}'")
def context_pack_refactor(t: Tables) -> DataFrame:
    section = lambda df, name, item: df.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"))
    out = section(t.calls().where("dst = 7"), "dependent", "src")
    out = out.unionByName(section(history.coupling(t.changes(), TARGET).orderBy(F.desc("co_changes"), "path").limit(10), "co_change", "path"))
    return out.unionByName(section(legacy_churn(t).where(F.col("target") == TARGET), "signal", "signal"))


@query(with_views("headings", "files") + " SELECT 'explicit' AS origin, subject AS item FROM headings WHERE contains(lower(subject), 'the') UNION ALL SELECT DISTINCT 'inferred', string_split(path, '/')[1] FROM files")
def context_pack_architecture(t: Tables) -> DataFrame:
    explicit = t.headings().where(search.contains(F.col("subject"), "the")).select(F.lit("explicit").alias("origin"), F.col("subject").alias("item"))
    return explicit.unionByName(inferred_roots(t).select(F.lit("inferred").alias("origin"), F.col("root").alias("item")))


@query(with_views("files") + " SELECT count(*) AS files, count(DISTINCT language) AS languages, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT source) AS roots, count(*) FILTER (analysis_status IS NULL) AS unanalyzed FROM files")
def project_overview(t: Tables) -> DataFrame:
    return t.files().agg(F.count(F.lit(1)).alias("files"), F.countDistinct("language").alias("languages"), F.sum("size").alias("bytes"), F.countDistinct("source").alias("roots"), F.count_if(F.col("analysis_status").isNull()).alias("unanalyzed"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS head, len(string_split(text, chr(10))) > 3 AS truncated, CAST(len(string_split(text, chr(10))) AS INTEGER) AS total FROM documents")
def source_slice(t: Tables) -> DataFrame:
    lines = F.split("text", "\n")
    return t.documents.select("doc_id", F.array_join(F.slice(lines, 1, 3), "\n").alias("head"), (F.size(lines) > 3).alias("truncated"), F.size(lines).alias("total"))


@query(with_views("symbols") + " SELECT language, kind, string_agg(symbol_id || ':' || end_line, ', ' ORDER BY end_line, symbol_id) AS members FROM symbols GROUP BY language, kind")
def grouped_outline(t: Tables) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("end_line", "symbol_id")))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["symbol_id"], x["end_line"])), ", ")
    return t.symbols().groupBy("language", "kind").agg(text.alias("members"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 EXCEPT SELECT doc_id FROM labels")
def set_difference(t: Tables) -> DataFrame:
    return t.documents.where("doc_id % 3 = 0").select("doc_id").subtract(t.labels.select("doc_id"))


@query("SELECT doc_id FROM documents WHERE n_chars > 500 INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersection(t: Tables) -> DataFrame:
    return t.documents.where("n_chars > 500").select("doc_id").intersect(t.labels.where("quality = 1").select("doc_id"))


# Scalar functions over whole columns


@query("SELECT page_id, replace(regexp_replace(regexp_replace(url, '^.*://[^/]+/?', ''), '\\.[^./]*$', ''), '/', '.') AS module, CASE WHEN starts_with(regexp_replace(url, '^.*://', ''), '_') THEN 'private' ELSE 'public' END AS visibility FROM pages")
def path_functions(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^.*://[^/]+/?", "")
    return t.pages.select("page_id", names.module_name(path).alias("module"), names.visibility(F.regexp_replace("url", "^.*://", "")).alias("visibility"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END AS message FROM documents")
def shortened_messages(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", names.shortened(F.col("text")).alias("message"))
