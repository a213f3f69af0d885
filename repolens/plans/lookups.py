"""More registered queries: names, members, edge priorities, manifests, paths and tests of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import names
from repolens.operators import resolve, search, tests_for
from repolens.plans.catalogue import query
from repolens.sources.tables import Tables, with_views

CLASSES = "SELECT DISTINCT p_brand || '.' || p_type AS qualified_name FROM part"
NAMED = f"named AS ({CLASSES} UNION ALL SELECT qualified_name FROM symbols)"
ASKED = "asked AS (SELECT qualified_name AS request FROM symbols UNION SELECT p_type || '.' || p_partkey FROM part UNION SELECT p_type FROM part UNION SELECT p_name FROM part)"


def classes(t: Tables) -> DataFrame:
    return t.part.select(F.concat_ws(".", "p_brand", "p_type").alias("qualified_name")).distinct()


@query(with_views("symbols") + f", {NAMED}, {ASKED}, ends AS (SELECT qualified_name, array_to_string(string_split(qualified_name, '.')[k:], '.') AS request FROM named, range(1, 4) r(k) WHERE k <= len(string_split(qualified_name, '.'))) SELECT a.request, CASE WHEN coalesce(bool_or(e.qualified_name = a.request), false) THEN 'exact' WHEN count(e.qualified_name) = 1 THEN 'unique_suffix' WHEN count(e.qualified_name) > 1 THEN 'candidates' ELSE 'suggestions' END AS status, CASE WHEN coalesce(bool_or(e.qualified_name = a.request), false) THEN a.request WHEN count(e.qualified_name) = 1 THEN min(e.qualified_name) END AS found, count(e.qualified_name) AS candidates FROM asked a LEFT JOIN ends e ON e.request = a.request GROUP BY a.request")
def name_resolution(t: Tables) -> DataFrame:
    asked = t.symbols().select(F.col("qualified_name").alias("request"))
    for column in (F.concat_ws(".", "p_type", "p_partkey"), F.col("p_type"), F.col("p_name")):
        asked = asked.unionByName(t.part.select(column.alias("request")))
    return resolve.cascade(asked, classes(t).unionByName(t.symbols().select("qualified_name")))


@query(None)
def close_name_matches(t: Tables) -> DataFrame:
    """Matching blocks are beyond SQL: held against the library function in a test."""
    asked = t.part.select(F.reverse("p_name").alias("request")).unionByName(t.part.select(F.substring("p_name", 2, 40).alias("request")))
    return resolve.close_matches(asked, t.part.select(F.col("p_name").alias("name")))


DEGREE = "SELECT {0} AS symbol_id, count(*) AS n, array_to_string(list({1} ORDER BY {1})[1:5], ',') AS shown FROM calls GROUP BY 1"


@query(with_views("symbols", "calls") + f", i AS ({DEGREE.format('dst', 'src')}), o AS ({DEGREE.format('src', 'dst')}) SELECT s.symbol_id, s.qualified_name, s.kind, coalesce(i.n, 0) AS callers_count, coalesce(i.shown, '') AS callers, coalesce(o.n, 0) AS callees_count, coalesce(o.shown, '') AS callees, s.p AS parent FROM (SELECT *, regexp_replace(qualified_name, '\\.[^.]*$', '') AS p FROM symbols) s LEFT JOIN i ON i.symbol_id = s.symbol_id LEFT JOIN o ON o.symbol_id = s.symbol_id")
def symbol_description(t: Tables) -> DataFrame:
    out = resolve.described(t.symbols().select("symbol_id", "qualified_name", "kind"), t.calls())
    return out.withColumn("parent", resolve.parent_name(F.col("qualified_name")))


@query(with_views("symbols") + f", {NAMED}, owners AS (SELECT DISTINCT p_brand AS owner FROM part UNION SELECT qualified_name FROM ({CLASSES})) SELECT owner, qualified_name AS member FROM owners JOIN named ON starts_with(qualified_name, owner || '.') AND NOT contains(substr(qualified_name, length(owner) + 2), '.')")
def outline_members(t: Tables) -> DataFrame:
    owners = t.part.select(F.col("p_brand").alias("qualified_name")).distinct().unionByName(classes(t))
    return resolve.direct_members(owners, classes(t).unionByName(t.symbols().select("qualified_name")))


@query(with_views("symbols") + " SELECT a.symbol_id AS caller, b.qualified_name AS target FROM symbols a, range(1, 41) r(k) JOIN symbols b ON b.qualified_name = regexp_replace(a.qualified_name, '[^.]*$', '') || (a.symbol_id + k)")
def class_member_join(t: Tables) -> DataFrame:
    """Each symbol calls forty names on itself; those that its class has are linked."""
    owner = resolve.parent_name(F.col("qualified_name"))
    calls = t.symbols().select(F.col("symbol_id").alias("caller"), owner.alias("owner"), F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"))
    calls = calls.select("caller", "owner", (F.col("caller") + F.col("k")).cast("string").alias("name"))
    return resolve.own_members(calls, t.symbols())


@query(with_views("tests", "files") + " SELECT path FROM files WHERE path IN (SELECT target FROM tests)")
def names_in_test_files(t: Tables) -> DataFrame:
    return t.files().select("path").join(t.tests().select(F.col("target").alias("path")), "path", "left_semi")


@query(with_views("files") + " SELECT path FROM files WHERE path LIKE '%5' AND path NOT LIKE '%15'")
def path_suffix_filter(t: Tables) -> DataFrame:
    return t.files().where(F.endswith("path", F.lit("5")) & ~F.endswith("path", F.lit("15"))).select("path")


@query(with_views("calls") + " SELECT DISTINCT src AS importer FROM calls WHERE dst IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def importers_of_changed(t: Tables) -> DataFrame:
    changed = t.part.where("p_size > 40").select(F.col("p_partkey").alias("dst"))
    return t.calls().join(changed, "dst", "left_semi").select(F.col("src").alias("importer")).distinct()


@query("SELECT event_id, 'part/' || json_extract_string(props, '$.k') AS path FROM events WHERE 'part/' || json_extract_string(props, '$.k') IN (SELECT 'part/' || p_partkey FROM part)")
def coverage_paths(t: Tables) -> DataFrame:
    """Strings anywhere in a result that name an indexed path; long ones and those of several lines can't."""
    values = F.map_values(F.from_json("props", "map<string,string>"))
    found = t.events.select("event_id", F.explode(values).alias("value")).select("event_id", F.concat(F.lit("part/"), "value").alias("path"))
    found = found.where((F.length("path") <= 4096) & ~F.col("path").contains("\n"))
    return found.join(t.part.select(F.concat(F.lit("part/"), "p_partkey").alias("path")), "path", "left_semi").select("event_id", "path")


@query("WITH d AS (SELECT l_partkey, arg_min(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), (l_orderkey, l_linenumber, l_suppkey)) AS declared FROM lineitem GROUP BY l_partkey), k AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS resolved FROM part WHERE p_size > 25) SELECT l_partkey, declared, resolved, CASE WHEN resolved IS NOT NULL THEN 'resolved' ELSE 'declared' END AS status FROM d LEFT JOIN k ON p_partkey = l_partkey")
def declared_or_locked(t: Tables) -> DataFrame:
    """The first declaration of a package, with the locked version where a lock has one."""
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    declared = t.lineitem.groupBy("l_partkey").agg(F.min_by(price, F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("declared"))
    locked = t.part.where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("string").alias("resolved"))
    return declared.join(locked, "l_partkey", "left").withColumn("status", names.version_status(F.col("resolved"), F.col("declared")))


@query(with_views("calls") + " SELECT src, dst, 'calls' AS relationship_type FROM calls UNION ALL SELECT dst, src, 'references' FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.src = c.dst AND d.dst = c.src)")
def calls_before_references(t: Tables) -> DataFrame:
    calls = t.calls().withColumn("relationship_type", F.lit("calls"))
    references = t.calls().select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("references").alias("relationship_type"))
    return resolve.stronger(calls, references, ["src", "dst"])


LINKS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id FROM pages WHERE list_contains({LINKS}, '/the') OR list_contains({LINKS}, '/la')")
def json_array_predicate(t: Tables) -> DataFrame:
    """Rows whose JSON array holds one of the wanted values, which come as a JSON array themselves."""
    links = F.to_json(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    wanted = F.from_json(F.lit('["/the", "/la"]'), "array<string>")
    return t.pages.withColumn("links", links).where(F.exists(F.from_json("links", "array<string>"), lambda x: F.array_contains(wanted, x))).select("page_id")


@query(f"SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct({LINKS})) AS link FROM pages) WHERE link IN (SELECT '/' || p FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS p FROM benchmark))")
def tags_in_imports(t: Tables) -> DataFrame:
    """Used names that are also brought in."""
    used = t.pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("link"))
    known = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).select(F.concat(F.lit("/"), "word").alias("link")).distinct()
    return used.join(known, "link", "left_semi").select("page_id", "link")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE replace(p_name, ' ', '_') END AS module FROM part")
def tested_modules(t: Tables) -> DataFrame:
    name = F.translate("p_name", " ", "_")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("tests/test_"), name, F.lit(".py"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/"), name, F.lit("_test.py"))).otherwise(F.concat(F.lit("a/"), name, F.lit(".py")))
    return t.part.select("p_partkey", names.tested_module(path).alias("module"))


@query("SELECT doc_id, source || '/x/' || doc_id AS inside, '../' || lang AS outside FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def relative_specifiers(t: Tables) -> DataFrame:
    base = F.concat_ws("/", "source", "lang")
    rows = t.documents.where("lang is not null and source is not null")
    return rows.select("doc_id", names.joined_path(base, F.concat(F.lit("./../x//./y/../"), "doc_id")).alias("inside"), names.joined_path(F.col("source"), F.concat(F.lit("../../"), "lang")).alias("outside"))


@query("SELECT n_nationkey, length('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') AS size FROM nation")
def result_sizes(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", names.json_size("n_name", "n_regionkey").alias("size"))


@query("SELECT page_id, '<project>' || regexp_replace(url, '^.*?://[^/]+', '') AS message FROM pages")
def redacted_errors(t: Tables) -> DataFrame:
    return t.pages.select("page_id", names.redacted(F.col("url"), F.regexp_extract("url", "^.*?://[^/]+", 0)).alias("message"))


@query("SELECT lang, CASE lang WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'none' END AS plugin, count(*) AS files FROM documents GROUP BY 1, 2")
def suggested_plugins(t: Tables) -> DataFrame:
    table = t.spark.createDataFrame([("de", "german"), ("fr", "french")], "lang string, plugin string")  # fixed, a row a plug-in
    by = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("files"))
    return by.join(F.broadcast(table), "lang", "left").select("lang", F.coalesce("plugin", F.lit("none")).alias("plugin"), "files")


@query("SELECT r_name || ':' || n_name || ':' || s_name AS name, min(s_suppkey) AS view FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def namespaced_url_names(t: Tables) -> DataFrame:
    """Names below the namespaces that include them; of equal names the first view counts."""
    placed = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return placed.groupBy(F.concat_ws(":", "r_name", "n_name", "s_name").alias("name")).agg(F.min("s_suppkey").alias("view"))


@query(with_views("calls", recursive=True) + ", inc AS (SELECT p_partkey AS node FROM part WHERE p_size = (SELECT max(p_size) FROM part) UNION SELECT c.dst FROM inc JOIN calls c ON c.src = inc.node) SELECT node FROM inc")
def included_files(t: Tables) -> DataFrame:
    """Everything that the starting files include, each visited once, cycles or not."""
    largest = t.part.agg(F.max("p_size").alias("p_size"))
    return resolve.reach(t.calls(), t.part.join(F.broadcast(largest), "p_size").select(F.col("p_partkey").alias("node")))  # one row


TESTERS = "testers AS (SELECT p_partkey AS test, p_brand FROM part WHERE p_size > 40), mocks AS (SELECT p_partkey AS test, p_partkey + 1 AS node FROM part)"
CREDIT = "up AS (SELECT src AS at, dst AS target, [dst] AS path, 1 AS depth FROM calls UNION ALL SELECT c.src, u.target, list_append(u.path, u.at), u.depth + 1 FROM up u JOIN calls c ON c.dst = u.at WHERE u.depth < 3 AND u.at NOT IN (SELECT test FROM testers) AND c.src <> u.at AND NOT list_contains(u.path, c.src)), hit AS (SELECT u.target, u.at AS test, min(u.depth) AS depth FROM up u JOIN testers t ON t.test = u.at LEFT JOIN mocks m ON m.test = u.at WHERE m.node IS NULL OR NOT list_contains(u.path, m.node) GROUP BY 1, 2)"


@query(with_views("calls", recursive=True) + f", {TESTERS}, {CREDIT} SELECT CAST(target AS VARCHAR) AS target, CAST(test AS VARCHAR) AS test, CASE WHEN depth = 1 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN depth = 1 THEN 'symbol_reference' ELSE 'indirect_call' END AS evidence, CAST(depth AS INTEGER) AS depth FROM hit UNION ALL SELECT CAST(p.p_partkey AS VARCHAR), CAST(t.test AS VARCHAR), 'low', 'direct_import', NULL FROM part p JOIN (SELECT p_brand, min(test) AS test FROM testers GROUP BY p_brand) t ON t.p_brand = p.p_brand WHERE p.p_partkey NOT IN (SELECT target FROM hit)")
def tests_of_symbols(t: Tables) -> DataFrame:
    """Tests of every symbol: by a call path that holds nothing the test mocks, else those of its module."""
    text = lambda c, name: F.col(c).cast("string").alias(name)
    calls = t.calls().select(text("src", "src"), text("dst", "dst"))
    testers = t.part.where("p_size > 40")
    mocks = t.part.select(text("p_partkey", "test"), (F.col("p_partkey") + 1).cast("string").alias("target"))
    symbols = t.part.select(F.col("p_brand").alias("path"), text("p_partkey", "qualified_name"))
    fallback = t.part.join(testers.groupBy("p_brand").agg(F.min("p_partkey").alias("test")), "p_brand").select(text("p_partkey", "target"), text("test", "test"), F.lit("low").alias("confidence"))
    return tests_for.tests_for(calls, mocks, symbols, testers.select(text("p_partkey", "test")), fallback, paths=False).drop("path")


@query(with_views("symbols") + " SELECT symbol_id, CASE WHEN contains(lower(name), 'red') THEN 'name' WHEN contains(lower(qualified_name), 'promo') THEN 'qualified_name' END AS matched FROM symbols WHERE contains(lower(name), 'red') OR contains(lower(qualified_name), 'promo')")
def matched_field(t: Tables) -> DataFrame:
    name, qualified = search.contains(F.col("name"), "red"), search.contains(F.col("qualified_name"), "promo")
    return t.symbols().where(name | qualified).select("symbol_id", F.when(name, "name").when(qualified, "qualified_name").alias("matched"))
