"""Exact dedup with Patricia-trie owners.

Texts are compared as whole byte strings after white-space runs become one space. Each map task keeps a
compressed radix trie whose terminal nodes hold the smallest identifier and the number of rows; when the
trie passes its byte budget, its largest subtree is given out as partial owners and dropped. Partial owners
are dealt by length and content hash, so one key's share of a shuffle is at most one row a map task, and a
second trie per (length, hash) bucket merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, documents, id_and_text, materialize, per_slice, slices, utf8
from .near_dedup import keep_owners

TRIE_BYTES = 48 << 20
OWNER = "digest binary, n_bytes long, h long, body binary, owner long, group_size long"


def squeeze(text: bytes) -> bytes:
    """White-space runs ([\\x20\\x09-\\x0D]+) as one space each, also at both ends."""
    out = b" ".join(text.split())
    if text:
        if text[0] in b" \t\n\v\f\r":
            out = b" " + out
        if len(out) > (out == b" ") and text[-1] in b" \t\n\v\f\r":
            out += b" "
    return out


class Node:
    __slots__ = ("edges", "owner", "count")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Node]] = {}
        self.owner: int | None = None
        self.count = 0


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: slices compare in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def smaller(a: int | None, b: int | None) -> int | None:
    """The smaller identifier; null only where both are null."""
    return b if a is None else a if b is None else min(a, b)


class PatriciaTrie:
    """Byte strings on compressed edges; a terminal node has its smallest identifier and row count."""

    def __init__(self) -> None:
        self.root = Node()
        self.held: dict[int, int] = {}

    @property
    def n_bytes(self) -> int:
        return sum(self.held.values())

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at, top = self.root, 0, key[0] if key else -1
        while at < len(key):
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = Node()
                node.edges[key[at]] = (key[at:], leaf)
                self.held[top] = self.held.get(top, 0) + len(key) - at + 300
                node, at = leaf, len(key)
                break
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = common(label, key[at : at + len(label)])
            middle = Node()
            middle.edges[label[n]] = (label[n:], child)
            node.edges[key[at]] = (label[:n], middle)
            self.held[top] = self.held.get(top, 0) + 300
            node, at = middle, at + n
        node.owner = smaller(node.owner, owner) if node.count else owner
        node.count += count

    def take(self, top: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Gives out and removes all terminals, or those of the subtree that starts with byte ``top``."""
        if top is None:
            stack = [(b"", self.root)]
            self.root, self.held = Node(), {}
        else:
            label, child = self.root.edges.pop(top)
            self.held.pop(top, None)
            stack = [(label, child)]
        while stack:
            prefix, node = stack.pop()
            if node.count:
                yield prefix, node.owner, node.count
            stack.extend((prefix + label, child) for label, child in node.edges.values())

    def largest(self) -> int:
        return max((k for k in self.held if k in self.root.edges), key=self.held.__getitem__)


def _owner_batches(found: Iterator[tuple[bytes, int | None, int]]) -> Iterator[pa.RecordBatch]:
    schema, rows, size = arrow_schema(OWNER), [], 0
    for body, owner, count in found:
        rows.append((hashlib.sha256(body).digest(), len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body, owner, count))
        size += len(body)
        if size > 8 << 20 or len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def partial_owners(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """A trie per map task; its budget passed, the largest subtree goes out first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie()
        for batch in slices(batches):
            for i, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                trie.insert(squeeze(text), i)
            while trie.n_bytes > trie_bytes:
                yield from _owner_batches(trie.take(trie.largest()))
        yield from _owner_batches(trie.take())

    return id_and_text(docs).mapInArrow(run, OWNER)


def merged_owners(partial: DataFrame) -> DataFrame:
    """Partial owners dealt and sorted by length and hash; a trie of whole byte strings per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[bytes, int | None, int]]:
            trie, bucket = PatriciaTrie(), None
            for batch in slices(batches, "body"):
                cols = [batch.column(n).to_pylist() for n in ("n_bytes", "h", "body", "owner", "group_size")]
                for n, h, body, owner, count in zip(*cols, strict=True):
                    if (n, h) != bucket:
                        yield from trie.take()
                        bucket = (n, h)
                    trie.insert(body, owner, count)
            yield from trie.take()

        for batch in _owner_batches(found()):
            yield batch.set_column(3, batch.schema.field(3), pa.nulls(batch.num_rows, pa.binary()))

    return partial.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h").mapInArrow(run, OWNER)


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Null text equals empty text. Null ids are larger than all others; a group of only null ids has a null
    ``keep_id``. Of repeated rows with the smallest id exactly one is kept. An empty table gives no rows.
    Other columns are not read.
    """

    def digests(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "digest": [hashlib.sha256(squeeze(t)).digest() for t in utf8(batch.column("text"))]}

    owners = materialize(merged_owners(partial_owners(docs)).select("digest", F.col("owner").alias("keep_id"), "group_size").where("group_size > 1"), "owners")
    rows = per_slice(id_and_text(docs), digests, "doc_id long, digest binary")
    copy = F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy(F.lit(1)))
    rows = rows.withColumn("copy", copy)
    joined = rows.join(owners, "digest", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less exact copies; null handling as in ``exact_groups``."""
    owners = merged_owners(partial_owners(docs)).where("group_size > 1").select(F.lower(F.hex("digest")).alias("node"), F.col("owner").alias("keep_id"))
    owners = owners.select("node", "keep_id", F.col("node").alias("keep_node"), F.lit(True).alias("grouped"))
    squeezed = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return keep_owners(docs, F.sha2(squeezed.cast("binary"), 256), materialize(owners, "owners"))


def op7_patricia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_groups(documents(spark, sf_dir))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id,
       CAST(count(*) OVER (PARTITION BY body) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t
"""
