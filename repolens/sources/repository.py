"""Sources of a repository: files, change log, manifests and architecture documents."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import extract_python, extract_text, names

#: Languages and kinds by extension; fixed values.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "rs": "rust", "astro": "astro", "toml": "toml", "ini": "ini", "cfg": "ini", "yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "rst": "restructuredtext",
}
CONFIG_LANGUAGES, DOC_LANGUAGES = ("toml", "ini", "yaml", "json"), ("markdown", "restructuredtext")
EXCLUDED = [".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv"]

FILE = "path string, language string, file_kind string, size long, modified timestamp, content binary"


def scan_files(spark: SparkSession, root: str, exclude: list[str] | None = None, max_bytes: int = 1 << 20) -> DataFrame:
    """Files below ``root``, without excluded folders, secrets, large and binary ones. Size is filtered before
    any content is read. Spark's reader gives no row for an empty file."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace("path", rf"^[a-z]+:/*\Q{base.lstrip('/')}\E/", "")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.try_element_at(table, extension).alias("language"))
    binary = F.decode(F.substring("content", 1, 8192), "ISO-8859-1").contains("\0")
    kind = F.when(names.is_test_path(F.col("path")), "test").when(F.col("language").isin(*CONFIG_LANGUAGES), "config").when(F.col("language").isin(*DOC_LANGUAGES), "docs").otherwise("source")
    kept = rows.where(~names.excluded(F.col("path"), EXCLUDED if exclude is None else exclude) & ~binary)
    return kept.select("path", "language", kind.alias("file_kind"), "size", "modified", "content")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``commit_id, committed_at, path`` from the text of ``git log --name-only --format=%x00%aI``: records
    are parted by NUL bytes, so a record never splits. Positions count back from the newest commit."""
    records = spark.read.option("lineSep", "\0").text(path).select(F.monotonically_increasing_id().alias("n"), F.split(F.trim("value"), "\n").alias("lines")).where(F.col("lines")[0] != "")
    rows = records.select((-F.col("n")).alias("commit_id"), F.to_timestamp(F.col("lines")[0]).alias("committed_at"), F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("path"))
    return rows.where(F.trim("path") != "").distinct()


def read_manifest(path: str, text: str) -> Iterator[dict]:
    """Dependencies one manifest or lock file names. A file that can't be read names none."""
    name = path.rsplit("/", 1)[-1]
    row = lambda eco, dep, version, status: {"ecosystem": eco, "name": dep, "version": version, "status": status}
    try:
        if name == "package.json":
            yield from (row("npm", n, v, "declared") for n, v in json.loads(text).get("dependencies", {}).items())
        elif name == "package-lock.json":
            for key, value in json.loads(text).get("packages", {}).items():
                dep = key.removeprefix("node_modules/")
                if key.startswith("node_modules/") and "node_modules/" not in dep:
                    yield row("npm", dep, value.get("version"), "resolved")
        elif name == "Cargo.toml":
            for dep, spec in tomllib.loads(text).get("dependencies", {}).items():
                yield row("rust", dep, spec if isinstance(spec, str) else spec.get("version"), "declared")
        elif name in ("Cargo.lock", "uv.lock"):
            for package in tomllib.loads(text).get("package", []):
                yield row("rust" if name == "Cargo.lock" else "python", package["name"], package.get("version"), "resolved")
        elif name == "pyproject.toml":
            for line in tomllib.loads(text).get("project", {}).get("dependencies", []):
                yield row("python", line, None, "requirement")
        elif name.startswith("requirements") and name.endswith(".txt"):
            yield from (row("python", line.strip(), None, "requirement") for line in text.splitlines() if line.strip())
    except (ValueError, AttributeError, TypeError, KeyError):
        return


def dependencies(files: DataFrame) -> DataFrame:
    """``ecosystem, name, declared, resolved``: what manifests declare, with the version that locks give. Of
    several declarations the first counts, by path and then place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{"path": path, "place": k} | r for path, content in zip(batch["path"], batch["content"], strict=True) for k, r in enumerate(read_manifest(path, bytes(content).decode("utf-8", "replace")))]
            yield pd.DataFrame(found, columns=["path", "place", "ecosystem", "name", "version", "status"])

    rows = files.select("path", "content").mapInPandas(run, "path string, place long, ecosystem string, name string, version string, status string")
    name, version = names.requirement(F.col("name"))
    asked = F.col("status") == "requirement"
    rows = rows.select("path", "place", "ecosystem", F.when(asked, name).otherwise(F.col("name")).alias("name"), F.when(asked, version).otherwise(F.col("version")).alias("version"), F.when(asked, "declared").otherwise(F.col("status")).alias("status")).where("name is not null")
    key = F.when(F.col("ecosystem") == "python", names.normalized_package(F.col("name"))).otherwise(F.col("name"))
    declared = rows.where("status = 'declared'").groupBy("ecosystem", key.alias("key")).agg(F.min_by(F.struct("name", "version"), F.struct("path", "place")).alias("first")).select("ecosystem", "key", "first.name", F.col("first.version").alias("declared"))
    resolved = rows.where("status = 'resolved'").groupBy("ecosystem", key.alias("key")).agg(F.max("version").alias("resolved"))
    return declared.join(resolved, ["ecosystem", "key"], "left").select("ecosystem", "name", "declared", "resolved")


SYMBOL = "path string, ordinal int, name string, qualified_name string, kind string, start_line int, end_line int, visibility string, bases array<string>, status string, error string"


def _symbols_of(path: str, language: str | None, text: str) -> tuple[list[dict], str | None]:
    if language == "python":
        facts = extract_python.read_python(path, text)
        return facts.symbols, facts.error
    if language in ("javascript", "typescript"):
        return extract_text.js_symbols(path, text), None
    if language == "rust":
        return extract_text.rust_symbols(path, text), None
    return [], None


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of all sources. A file whose extraction fails gives one row with the error and fails alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SYMBOL.split(", ")]
        for batch in batches:
            rows = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                try:
                    found, error = _symbols_of(path, language, bytes(content).decode("utf-8", "replace"))
                except Exception as e:  # noqa: BLE001  one file must not end the stage
                    rows.append({"path": path, "status": "file_failed", "error": f"{type(e).__name__}: {e}"})
                    continue
                rows += [{"path": path, "ordinal": i, "status": "analyzed", "error": error} | s for i, s in enumerate(found)]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("ordinal", "start_line", "end_line"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "language", "content").mapInPandas(run, SYMBOL)


FACTS = pa.schema([
    ("path", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("module", pa.string()), ("name", pa.string()), ("local", pa.string()),
    ("candidates", pa.list_(pa.string())), ("caller", pa.string()), ("callee", pa.string()), ("error", pa.string()),
])


def python_facts(files: DataFrame, roots: tuple[str, ...] = ("", "src/")) -> DataFrame:
    """Imports and calls of all Python sources from one parse, told apart by ``kind``. A file that can't be read
    gives one row with the error and fails alone."""

    def of(path: str, content: bytes) -> Iterator[dict]:
        facts = extract_python.read_python(path, bytes(content).decode("utf-8", "replace"))
        if facts.error:
            yield {"kind": "error", "error": facts.error}
        for r in facts.imports:
            yield {"kind": "import", "line": r["line"], "module": r["module"], "name": r["name"], "local": r["local"], "candidates": list(extract_python.candidates(path, r, roots))}
        for r in facts.calls:
            yield {"kind": "call", "line": r["line"], "caller": r["caller"], "callee": r["callee"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [{"path": path} | r for r in of(path, content)]
                except Exception as e:  # noqa: BLE001  one file must not end the stage
                    rows.append({"path": path, "kind": "error", "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=FACTS)

    schema = "path string, kind string, line int, module string, name string, local string, candidates array<string>, caller string, callee string, error string"
    return files.where("language = 'python'").select("path", "content").mapInArrow(run, schema)


def python_imports(files: DataFrame, roots: tuple[str, ...] = ("", "src/")) -> DataFrame:
    """``path, line, module, name, candidates``: each import with the paths it may mean, best first."""
    return imports_of(python_facts(files, roots))


def imports_of(facts: DataFrame) -> DataFrame:
    return facts.where("kind = 'import'").select("path", "line", "module", "name", "candidates")


def calls_of(facts: DataFrame) -> DataFrame:
    """``path, caller, callee, line`` of each call by name."""
    return facts.where("kind = 'call'").select("path", "caller", "callee", "line")


def architecture_facts(files: DataFrame) -> DataFrame:
    """``subject, predicate, object, origin``: headings of architecture documents and decision records."""
    where = F.col("path").rlike(r"^docs/(architecture|adr)/.*\.md$") | F.col("path").rlike(r"^ADR[^/]*\.md$") | F.col("path").rlike(r"^ARCHITECTURE\.md$") | F.col("path").rlike(r"^README\.md$")
    text = F.decode("content", "utf-8")
    found = files.where(where).select(F.col("path").alias("object"), F.explode(names.headings(text)).alias("subject"))
    return found.select("subject", F.lit("described_in").alias("predicate"), "object", F.lit("explicit").alias("origin"))
