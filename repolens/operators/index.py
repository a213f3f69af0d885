"""From files to a linked index: symbols, and import, call, inheritance and test edges between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.functions import names
from repolens.operators import linking, resolve
from repolens.operators.cycles import settled
from repolens.sources import repository

EDGE = ["src", "dst", "relationship_type", "confidence", "evidence"]


@dataclass
class Index:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame


def _edges(rows: DataFrame, kind: str, confidence: str, evidence: str) -> DataFrame:
    return rows.select("src", "dst", F.lit(kind).alias("relationship_type"), F.lit(confidence).alias("confidence"), F.lit(evidence).alias("evidence")).where("src <> dst").distinct()


def import_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """File to file: the first candidate of each import that exists, once, never to itself."""
    numbered = imports.withColumn("request", F.struct("path", "line", "module", "name"))
    hit = linking.first_candidate(numbered, "request", F.col("candidates"), files.select(F.col("path").alias("id")))
    return _edges(hit.select(F.col("request.path").alias("src"), F.col("target").alias("dst")), "imports", "high", "import")


def call_edges(symbols: DataFrame, calls: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbol to symbol: a plain name means the caller's own module first, else what it imports by that name
    (or a module's attribute); ``self.x`` in a method means its class's own member; methods of unknown receivers
    are guessed among at most three in imported files."""
    top = symbols.where("kind in ('function', 'class', 'method')")
    own = calls.join(top.select("path", F.col("name").alias("callee"), "qualified_name", "kind"), ["path", "callee"]).where("kind <> 'method'")
    same = own.select(F.col("caller").alias("src"), F.col("qualified_name").alias("dst"))
    module = imports.where("name is not null").select("path", F.col("name").alias("callee"), F.concat_ws(".", "module", "name").alias("dst"))
    known = top.select(F.col("qualified_name").alias("dst"))
    left = calls.join(own.select("path", "callee").distinct(), ["path", "callee"], "left_anti")
    from_import = left.join(module, ["path", "callee"]).join(known, "dst", "left_semi").select(F.col("caller").alias("src"), "dst")
    as_module = left.where(F.col("callee").contains(".")).join(known.withColumn("callee", F.col("dst")), "callee", "left").where("dst is not null").select(F.col("caller").alias("src"), "dst")
    holder = resolve.parent_name(F.col("caller"))
    on_self = left.where(F.col("callee").rlike(r"^self\.[^.]+$")).select("caller", holder.alias("owner"), F.substring("callee", 6, 200).alias("name"))
    members = resolve.own_members(on_self, symbols.where("kind = 'method'")).select(F.col("caller").alias("src"), F.col("target").alias("dst"))
    high = _edges(same.unionByName(from_import).unionByName(as_module).unionByName(members), "calls", "high", "name")
    method = F.element_at(F.split("callee", r"\."), -1)
    untyped = left.where(F.col("callee").contains(".") & ~F.col("callee").startswith("self.")).select("path", "caller", "line", method.alias("name"))
    reach = edges.where("relationship_type = 'imports'").select(F.col("src").alias("path"), F.col("dst").alias("target"))
    methods = symbols.where("kind = 'method'").select(F.col("path").alias("target"), "name", F.col("qualified_name").alias("dst"))
    guess = linking.limited_matches(untyped.join(reach, "path").join(methods, ["target", "name"]).select("caller", "line", "name", "dst").distinct(), ["caller", "line", "name"], "dst", 3)
    low = _edges(guess.select(F.col("caller").alias("src"), "dst"), "calls", "low", "method_name").join(high.select("src", "dst"), ["src", "dst"], "left_anti")
    return high.unionByName(low.select(*EDGE))


def inheritance_edges(symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Class to base: by name in the same file, or by an imported name."""
    bases = symbols.where("kind = 'class'").select("path", F.col("qualified_name").alias("src"), F.explode("bases").alias("base"))
    own = bases.join(symbols.where("kind = 'class'").select("path", F.col("name").alias("base"), F.col("qualified_name").alias("dst")), ["path", "base"])
    imported = bases.join(imports.where("name is not null").select("path", F.col("name").alias("base"), F.concat_ws(".", "module", "name").alias("dst")), ["path", "base"])
    known = symbols.where("kind = 'class'").select(F.col("qualified_name").alias("dst"))
    return _edges(own.select("src", "dst").unionByName(imported.join(known, "dst", "left_semi").select("src", "dst")), "inherits", "high", "base")


def test_edges(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Test file to tested file: imported directly, else by the name that its own name suggests."""
    tests = files.where("file_kind = 'test'").select(F.col("path").alias("src"))
    direct = imports.join(tests, "src", "left_semi").join(tests.select(F.col("src").alias("dst")), "dst", "left_anti")
    named = F.concat(F.regexp_extract("src", r"test_([^/]+)\.py$", 1), F.lit(".py"))
    rest = tests.join(direct.select("src"), "src", "left_anti").withColumn("file", named)
    sources = files.where("file_kind = 'source'").select(F.col("path").alias("dst"), F.element_at(F.split("path", "/"), -1).alias("file"))
    guessed = rest.join(sources, "file").select("src", "dst")
    return _edges(direct.select("src", "dst"), "tests", "high", "direct_import").unionByName(_edges(guessed, "tests", "low", "naming_convention"))


def build(files: DataFrame) -> Index:
    """Extraction once, then links in an order of their needs. ``files`` as ``scan_files`` gives them. Symbols and
    facts are cut off from the parsers that made them, so that no link parses anything again."""
    symbols = settled(repository.symbols(files))
    facts = settled(repository.python_facts(files))
    imports, files = repository.imports_of(facts), files.drop("content")
    edges = settled(import_edges(files, imports))
    calls = call_edges(symbols, repository.calls_of(facts), imports, edges)
    all_edges = edges.unionByName(calls).unionByName(inheritance_edges(symbols, imports)).unionByName(test_edges(files, edges))
    return Index(files, symbols, all_edges)


def file_names(files: DataFrame) -> DataFrame:
    """Dotted names of source files, for joins by module."""
    return files.select("path", names.module_name(F.col("path")).alias("module"))
