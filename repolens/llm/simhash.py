"""SimHash fingerprints of whole texts, and near-duplicate components by Golay-code fuzzy hashing.

Fingerprints are cut into segments of at most 23 bits. Of a fingerprint's errors against another, pigeonhole
leaves some two segments few: with three segments and four errors, two of them have two errors at most. For
each two segments the keys are (nearest codeword of one, each codeword within distance 4 of the other), both
ways round: two fingerprints with errors (0, 2), (1, 1) or (2, 0) there have a key in common. Rows are dealt
and sorted by key; a run of equal keys is verified where it lies, and only a forest of the links found goes
on, so that a group of copies makes rows in proportion to its size. Stars of links shrink to components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import arrow_schema, documents, id_and_text, materialize, per_slice, utf8

SHINGLE = 4
SEED = 42
LINKED_BITS = 4
#: Runs up to this long are compared pair by pair; longer ones are searched breadth first.
SHORT_RUN = 24

#: For a byte: its bits, one in each byte of a 64-bit word, so that 255 of them add up without carry.
_SPREAD = np.array([sum(((i >> k) & 1) << (8 * k) for k in range(8)) for i in range(256)], np.uint64)


def shingle_hashes(text: bytes, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``k`` words, repeats included; fewer words make one shingle, none make none.
    A-Z are lower-cased; words are separated by [\\x20\\x09-\\x0D]+."""
    words = text.lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = [0, *ends[:-k].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(begin, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(begin))


def bit_counts(digests: bytes, width: int) -> np.ndarray:
    """How many of the digests of ``width`` bytes have each bit set, lowest bit of the first byte first."""
    lanes = _SPREAD[np.frombuffer(digests, np.uint8).reshape(-1, width)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 8 * width).sum(axis=0, dtype=np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set where it is set in over half the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = bit_counts(hashes.astype("<u8").tobytes(), 8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def segments_of_64(columns: list[np.ndarray]) -> list[np.ndarray]:
    """22, 21 and 21 bits of a 64-bit fingerprint."""
    word = columns[0].view(np.uint64)
    return [(word & 0x3FFFFF).astype(np.int64), ((word >> 22) & 0x1FFFFF).astype(np.int64), (word >> 43).astype(np.int64)]


def golay_keys(segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all fingerprints as (row, key); a key names its two segments and two codeword indices."""
    lists = [golay.nearby(s) for s in segments]
    rows, keys = [], []
    for n, (a, b) in enumerate(combinations(range(len(segments)), 2)):
        for i in range(lists[a].shape[1]):
            for j in range(lists[b].shape[1]):
                if i and j:
                    continue
                here = np.flatnonzero((lists[a][:, i] >= 0) & (lists[b][:, j] >= 0))
                rows.append(here)
                keys.append((n << 24) | (lists[a][here, i] << 12) | lists[b][here, j])
    return np.concatenate(rows), np.concatenate(keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) as stars: each node but the smallest of its component, with that smallest one."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def links_in_runs(keys: np.ndarray, node: np.ndarray, words: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes of equal key (``keys`` sorted) whose words differ in at most ``most`` bits, as stars."""
    n, words = len(keys), [w.view(np.uint64) for w in words]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, n))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    short = (length > 1) & (length <= SHORT_RUN)
    at = np.repeat(begin[short], length[short]) + np.arange(int(length[short].sum())) - np.repeat(np.cumsum(length[short]) - length[short], length[short])
    end = np.repeat(begin[short] + length[short], length[short])
    step = 1
    while len(at):
        inside = at + step < end
        at, end = at[inside], end[inside]
        apart = sum(np.bitwise_count(w[at] ^ w[at + step]).astype(np.int64) for w in words)
        hit = at[apart <= most]
        a.append(node[hit])
        b.append(node[hit + step])
        step += 1
    for start, size in zip(begin[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist(), strict=True):
        rest = np.arange(start, start + size)
        while len(rest):
            front, rest = [int(rest[0])], rest[1:]
            while front and len(rest):
                here = front.pop()
                hit = sum(np.bitwise_count(w[rest] ^ w[here]).astype(np.int64) for w in words) <= most
                found, rest = rest[hit], rest[~hit]
                a.append(np.full(len(found), node[here]))
                b.append(node[found])
                front += found.tolist()
    return forest(np.concatenate(a), np.concatenate(b))


def golay_links(prints: DataFrame, words: list[str], segments: Callable[[list[np.ndarray]], list[np.ndarray]], most: int) -> DataFrame:
    """Stars of links ``(a, b)``, b < a, among the distinct ``node`` rows of ``prints``: all pairs that share
    a key and differ in at most ``most`` bits of ``words`` are connected by them."""
    carried = ["node", *(w for w in words if w != "node")]
    schema = "key int, " + ", ".join(f"{c} long" for c in carried)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, key = golay_keys(segments([part.column(w).to_numpy() for w in words]))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *(part.column(c).take(take) for c in carried)], schema=arrow_schema(schema))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            by = dict(zip(carried, columns[1:], strict=True))
            a, b = links_in_runs(columns[0], by["node"], [by[w] for w in words], most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from out([c[:whole] for c in columns])
            held = [c[whole:] for c in columns]
        if held is not None:
            yield from out(held)

    keyed = prints.select(*carried).mapInArrow(spread, schema)
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(verify, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each node of ``links`` (a, b) but the roots, with the smallest node of its component.

    Large and small stars in turn (Kiveris et al. 2014) until nothing changes; each round is a written table.
    A node's many links never meet in one row: minima are pre-aggregated, and only the links themselves,
    never pairs of neighbours, are joined with them.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, mark = materialize(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def text_fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``doc_id, node``: the 64-bit fingerprint of each whole text as a signed number; null text is empty."""

    def fn(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "node": [fingerprint(shingle_hashes(t, k)) for t in utf8(batch.column("text"))]}

    return per_slice(id_and_text(docs), fn, "doc_id long, node long")


def fingerprint_components(docs: DataFrame, k: int = SHINGLE, most: int = LINKED_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: fingerprints link at ``most`` (up to 4) or fewer
    differing bits, and a component is named by its smallest doc_id.

    Null text is empty; texts without words have fingerprint zero and link like others. Null ids count as
    larger than all others, and a component of null ids only has a null name. Equal rows stay as many as
    they are; an empty table gives no rows; other columns are not read.
    """
    if most > LINKED_BITS:
        raise ValueError("three segments find at most four differing bits")
    rows = materialize(text_fingerprints(docs, k), "prints")
    prints = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(golay_links(prints.select("node"), ["node"], segments_of_64, most))
    known = materialize(prints.join(roots, "node", "left").select("node", "first", "n", F.coalesce("root", "node").alias("root")), "known")
    named = known.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("size"))
    shared = known.join(named.where("size > 1"), "root").select("node", "component_id")
    joined = rows.join(shared.withColumn("shared", F.lit(True)), "node", "left")
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"),
        F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op3_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents' fingerprints."""
    return fingerprint_components(documents(spark, sf_dir))
