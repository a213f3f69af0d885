"""Parquet tables of a folder, and the normalised views that give them the shape of a code index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """``Tables(spark, folder).orders`` reads ``folder/orders.parquet``; views are methods."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def changes(self) -> DataFrame:
        """An exploded change log: one row for each commit and path."""
        dates = self.orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("committed_at"))
        touched = self.lineitem.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("part"))
        # numbers are dealt out once, by commit; equal rows of a commit lie together then
        return touched.join(dates, "commit_id").distinct().select("commit_id", F.concat(F.lit("part/"), "part").alias("path"), "committed_at")

    def symbols(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_type", "p_partkey").alias("qualified_name"),
            F.lower("p_type").alias("kind"), F.col("p_brand").alias("language"), F.lit(1).alias("start_line"), F.col("p_size").alias("end_line"),
        )

    def files(self) -> DataFrame:
        marks = self.labels.select("doc_id", F.when(F.col("toxic") == 1, "file_failed").otherwise("analyzed").alias("analysis_status"))
        docs = self.documents.select(
            "doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id")).alias("path"), F.col("lang").alias("language"), "source",
            F.octet_length("text").cast("long").alias("size"), F.size(F.split("text", "\n")).cast("long").alias("line_count"),
            F.size(F.filter(F.split("text", "[ \n\t]+"), lambda w: w != "")).cast("long").alias("token_count"),
        )
        return docs.join(marks, "doc_id", "left")

    def raw_calls(self) -> DataFrame:
        """The first part of each order and that of its customer's next order, repeats and self-edges included."""
        # of lines with equal numbers the least part counts, so that supplier, the last of the SQL's keys, decides nothing
        least = F.min(F.struct("l_linenumber", "l_partkey"))
        first = self.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(least["l_partkey"].alias("src"))
        order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        rows = self.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(first, "o_orderkey")
        return rows.select("src", F.lead("src").over(order).alias("dst")).where("dst is not null")

    def calls(self) -> DataFrame:
        return self.raw_calls().where("src <> dst").distinct()

    def tests(self) -> DataFrame:
        return self.labels.join(self.files().select("doc_id", "path"), "doc_id").select(F.col("doc_id").alias("test_id"), F.col("path").alias("target"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("confidence"))

    def headings(self) -> DataFrame:
        found = F.explode(F.regexp_extract_all("html", F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1)))
        return self.pages.select("page_id", F.col("url").alias("object"), found.alias("subject"))

    def dependencies(self) -> DataFrame:
        """Parts as packages: the retail price is declared, that of the newest order line is resolved."""
        lines = self.lineitem.join(self.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
        key = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
        price = F.max_by("l_extendedprice", key)
        newest = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(price.alias("resolved"))
        declared = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
        return self.part.join(newest, "p_partkey", "left").select(
            F.col("p_partkey").alias("dep_id"), F.concat_ws("_", F.translate("p_name", " ", "."), "p_partkey").alias("name"), F.lower("p_type").alias("ecosystem"),
            declared.alias("declared"), F.when(F.col("p_partkey") % 2 == 0, F.col("resolved").cast("decimal(12,2)").cast("string")).alias("resolved"),
        )

    def tree(self) -> DataFrame:
        """Suppliers and customers under nations, nations under regions."""
        edge = lambda df, c, k, p, parent: df.select(F.concat(F.lit(c), F.col(k)).alias("child"), F.concat(F.lit(p), F.col(parent)).alias("parent"))
        return edge(self.supplier, "s", "s_suppkey", "n", "s_nationkey").unionByName(edge(self.customer, "c", "c_custkey", "n", "c_nationkey")).unionByName(edge(self.nation, "n", "n_nationkey", "r", "n_regionkey"))


#: The same views for DuckDB, to be put behind WITH.
VIEWS = {
    "changes": "SELECT DISTINCT l.l_orderkey AS commit_id, o.o_orderdate AS committed_at, 'part/' || l.l_partkey AS path FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    "symbols": "SELECT p_partkey AS symbol_id, p_name AS name, p_brand || '.' || p_type || '.' || p_partkey AS qualified_name, lower(p_type) AS kind, p_brand AS language, 1 AS start_line, p_size AS end_line FROM part",
    "files": "SELECT d.doc_id, d.source || '/' || d.lang || '/doc_' || d.doc_id AS path, d.lang AS language, d.source, CAST(octet_length(encode(d.text)) AS BIGINT) AS size, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS line_count, CAST(len([w for w in regexp_split_to_array(d.text, '[ \\n\\t]+') if w <> '']) AS BIGINT) AS token_count, CASE WHEN l.toxic IS NULL THEN NULL WHEN l.toxic = 1 THEN 'file_failed' ELSE 'analyzed' END AS analysis_status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "raw_calls": "SELECT * FROM (SELECT src, lead(src) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS src FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey) WHERE dst IS NOT NULL",
    "calls": "SELECT DISTINCT src, dst FROM raw_calls WHERE src <> dst",
    "tests": "SELECT l.doc_id AS test_id, f.path AS target, CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS confidence FROM labels l JOIN files f ON l.doc_id = f.doc_id",
    "headings": "SELECT page_id, url AS object, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS subject FROM pages",
    "newest": "SELECT l_partkey, arg_max(l_extendedprice, (o_orderdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity)) AS resolved FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey",
    "deps": "SELECT p_partkey AS dep_id, replace(p_name, ' ', '.') || '_' || p_partkey AS name, lower(p_type) AS ecosystem, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS declared, CASE WHEN p_partkey % 2 = 0 THEN CAST(CAST(resolved AS DECIMAL(12,2)) AS VARCHAR) END AS resolved FROM part LEFT JOIN newest ON p_partkey = l_partkey",
    "tree": "SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation",
}
#: Views that a view needs first.
NEEDS = {"calls": ["raw_calls"], "tests": ["files"], "deps": ["newest"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` and the named views, each before those that need it; ends open for more."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
