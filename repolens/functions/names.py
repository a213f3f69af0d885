"""Scalar functions on names, versions, paths and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized_package(name: Column) -> Column:
    """Lower case, runs of ``-_.`` as one dash."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def module_name(path: Column) -> Column:
    """Dotted name of a source path."""
    return F.translate(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")


def visibility(name: Column) -> Column:
    return F.when(name.startswith("_"), "private").otherwise("public")


def requirement(line: Column) -> tuple[Column, Column]:
    """Name and version text of a requirement line; null where it is an option, a URL or a comment. Extras and
    markers go; a single ``==`` pin is given bare."""
    text = F.trim(F.regexp_replace(F.regexp_replace(line, r"\s+#.*$", ""), r";.*$", ""))
    name = F.regexp_extract(text, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    bad = text.startswith("-") | text.startswith("#") | text.contains("@") | (name == "")
    spec = F.trim(F.regexp_replace(text, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(\[[^\]]*\])?", ""))
    version = F.when(spec.rlike(r"^==[^,*]+$"), F.trim(F.substring(spec, 3, 200))).when(spec != "", spec)
    return F.when(~bad, name), F.when(~bad, version)


def chosen_version(resolved: Column, declared: Column) -> Column:
    """The resolved version, else the declared one; empty counts as missing."""
    return F.coalesce(F.nullif(resolved, F.lit("")), F.nullif(declared, F.lit("")))


def version_status(resolved: Column, declared: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(resolved), "resolved").when(has(declared), "declared").otherwise("unknown")


def test_type(path: Column) -> Column:
    """Unit, integration or e2e by a path's parts, in this order; else unknown."""
    part = lambda *names: F.arrays_overlap(F.split(F.lower(path), "[/_.]"), F.array(*map(F.lit, names)))
    return F.when(part("unit"), "unit").when(part("integration"), "integration").when(part("e2e"), "e2e").otherwise("unknown")


def is_test_path(path: Column) -> Column:
    """Python, JavaScript and TypeScript test files by name or folder."""
    return path.rlike(r"(^|/)tests?/") | path.rlike(r"(^|/)test_[^/]*\.py$") | path.rlike(r"_test\.py$") | path.rlike(r"\.(test|spec)\.[jt]sx?$") | path.rlike(r"(^|/)__tests__/")


def words(text: Column) -> Column:
    """How many white-space separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def reduction(before: Column, after: Column) -> Column:
    """Percent saved; zero where there was nothing."""
    return F.when(before == 0, F.lit(0.0)).otherwise(F.round((before - after) * 100.0 / before, 6))


def shortened(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def excluded(path: Column, names: list[str]) -> Column:
    """A path part is on the list, or the file looks like a secret."""
    parts = F.split(path, "/")
    listed = F.arrays_overlap(parts, F.array(*map(F.lit, names))) if names else F.lit(False)
    return listed | F.exists(parts, lambda p: (p == ".env") | p.endswith(".pem") | p.endswith(".key"))


def line_count(text: Column) -> Column:
    """Lines as text editors count them: a last line end starts no new line."""
    breaks = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
    parts = F.split(text, breaks, -1)
    return F.when(text == "", 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def headings(text: Column) -> Column:
    """Titles of markdown headings."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1))


def relative_import(path: Column, module: Column, level: Column) -> Column:
    """Absolute module of a relative import ``level`` packages up; null where it leaves the root."""
    folders = F.split(path, "/")
    keep = F.size(folders) - level
    base = F.array_join(F.slice(folders, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    joined = F.concat_ws(".", F.nullif(base, F.lit("")), F.nullif(module, F.lit("")))
    return F.when(level == 0, module).when(keep >= 0, joined)


def route(path: Column) -> tuple[Column, Column]:
    """Route and its kind of a page file under ``src/pages``."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^(.*/)?src/pages", ""), r"\.[^./]+$", "")
    shown = F.regexp_replace(inner, r"/index$", "")
    kind = F.when(inner.contains("[..."), "rest").when(inner.contains("["), "dynamic").otherwise("static")
    return F.when(shown == "", "/").otherwise(shown), kind


def tested_module(path: Column) -> Column:
    """The module a test file's name points to: ``test_x.py`` or ``x_test.py`` give ``x``; null for others."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.coalesce(F.nullif(F.regexp_extract(name, r"^test_(.+)\.py$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^(.+)_test\.py$", 1), F.lit("")))
    return found


def joined_path(base: Column, specifier: Column) -> Column:
    """A relative specifier from a folder, with ``.`` and ``..`` worked off; what leaves the root keeps its ``..``."""
    parts = F.split(F.concat_ws("/", base, specifier), "/")
    up = lambda done: (F.size(done) > 0) & (F.element_at(F.when(F.size(done) > 0, done).otherwise(F.array(F.lit(""))), -1) != "..")
    step = lambda done, p: F.when(p.isin("", "."), done).when((p == "..") & up(done), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def redacted(message: Column, root: Column) -> Column:
    """A message without the folder that the project lies in."""
    return F.replace(message, root, F.lit("<project>"))


def json_size(*columns: str) -> Column:
    """Characters of a row as compact JSON."""
    return F.length(F.to_json(F.struct(*columns))).cast("long")
