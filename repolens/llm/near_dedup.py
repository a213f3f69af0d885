"""Near-duplicate groups of texts: Golay-keyed SimHash candidates, verified by Jaccard similarity.

Fingerprints here are 115 bits over a text's distinct words, five segments of 23 bits, so that the few
words by which copies differ leave some two segments nearly alike. Linked fingerprints make candidate
clusters; in each cluster the sets of five-word shingles are compared exactly and texts of a similarity of
0.8 or more are linked. A cluster too large for a task is cut into blocks, and each two blocks meet in a
task of their own.

Fingerprints find most links and gather large groups, but not every link. The rest come from prefix
filtering, which loses none: with shingles in one order for all texts, two sets of the least similarity
share one of the first shingles of each. Pairs that share one, and that sizes, places and parity marks
allow, are compared unless one group has both already. Texts of a shingle that many begin with are never
written down as pairs: they meet, each once with its mark, in a task for all shingles of like texts, and
only a forest of what the marks allow goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, per_slice, slices, utf8
from .simhash import SHORT_RUN, bit_counts, components, forest, golay_links, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
SEGMENTS, SEGMENT_BITS = 5, 23
#: Of 115 bits, how many candidates may differ in.
CANDIDATE_BITS = 20
BLOCK = 2_000
#: Texts read to find common shingles, and how many of these are put last in the order; any order finds all links.
RANKED_TEXTS, RANKED = 2_000, 20_000
#: A set's mark has so many bits, each the parity of the shingles that fall on it; sets of more than
#: ``PARITY_SHINGLES`` have counts instead, at least as many.
MARK_BITS, PARITY_SHINGLES = 1_024, 2_000
#: Words of the texts that one block of a cluster holds.
BLOCK_WORDS = 1_500_000
#: Shingles are dealt out in so many shares, one after another, so that one share's rows are on disk at a time.
SHARES = 4
#: Runs of a shared shingle up to this long are written down as pairs, longer ones as their members.
PAIRED_RUN = 8
#: Pairs of long runs that are looked at together, and texts of a run beyond which it is cut into blocks for that.
HELD_PAIRS, RUN_BLOCK = 2_000_000, 1_000
#: Nodes of clusters that are sent to all tasks; more are joined.
SENT_NODES = 200_000
#: The root of a set that no cluster holds.
ALONE = -(1 << 63)

WORDS = ["f0", "f1", "f2"]


def long_fingerprint(words: set[bytes]) -> list[int]:
    """Five 23-bit segments, two to a number, of the SimHash over distinct words; no words give zeros."""
    if not words:
        return [0, 0, 0]
    counts = bit_counts(b"".join([xxhash.xxh3_128_digest(w) for w in words]), 16)
    bits = (2 * counts > len(words))[: SEGMENTS * SEGMENT_BITS].reshape(SEGMENTS, SEGMENT_BITS)
    parts = (bits @ (1 << np.arange(SEGMENT_BITS, dtype=np.int64))).tolist()
    return [parts[0] | parts[1] << SEGMENT_BITS, parts[2] | parts[3] << SEGMENT_BITS, parts[4]]


def segments_of_115(columns: list[np.ndarray]) -> list[np.ndarray]:
    mask = (1 << SEGMENT_BITS) - 1
    return [columns[0] & mask, columns[0] >> SEGMENT_BITS, columns[1] & mask, columns[1] >> SEGMENT_BITS, columns[2]]


def similar_links(node: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all texts whose shingle sets have a Jaccard similarity of ``least`` or more: a
    breadth-first search in which each text found is compared with those not yet reached. An empty set is
    like an empty set only."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.searchsorted(code[order], np.arange(code.max(initial=-1) + 2))
    own = np.concatenate([[0], np.cumsum(size)])
    a: list[np.ndarray] = [np.zeros(0, np.int64)]
    b: list[np.ndarray] = [np.zeros(0, np.int64)]
    rest = np.ones(len(sets), bool)
    left = len(sets)
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start] = False
        left -= 1
        front = [start]
        while front and left:
            here = front.pop()
            mine = code[own[here] : own[here + 1]]
            low, n = begin[mine], begin[mine + 1] - begin[mine]
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            both = np.bincount(posting[at], minlength=len(sets))
            alike = rest & (both >= least * (size + size[here] - both) - 1e-9) if size[here] else rest & (size == 0)
            found = np.flatnonzero(alike)
            rest[found] = False
            left -= len(found)
            a.append(np.full(len(found), node[here]))
            b.append(node[found])
            front += found.tolist()
    return np.concatenate(a), np.concatenate(b)


def _set_of(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


PRINT = "node long, words long, f0 long, f1 long, f2 long"


def long_prints(rows: DataFrame) -> DataFrame:
    """``node, words, f0, f1, f2`` of each row (node, text): how many words, and its fingerprint."""

    def prints(batch: pa.RecordBatch) -> dict:
        split = [t.lower().split() for t in utf8(batch.column("text"))]
        got = [long_fingerprint(set(w)) for w in split]
        return {"node": batch.column("node"), "words": [len(w) for w in split]} | {w: [g[k] for g in got] for k, w in enumerate(WORDS)}

    return per_slice(rows.select("node", "text"), prints, PRINT)


def near_links(rows: DataFrame, block: int = BLOCK, prints: DataFrame | None = None) -> DataFrame:
    """Links ``(a, b)`` that connect all nodes of ``rows`` (node, text) whose shingle sets are similar; of rows of
    one node one counts. ``prints``: a written table of ``long_prints``, where there is one."""
    if not rows.groupBy("node").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["node"])
    prints = materialize(long_prints(rows), "prints") if prints is None else prints
    found = materialize(verified_links(rows, prints, components(golay_links(prints, WORDS, segments_of_115, CANDIDATE_BITS)), block), "found")
    return found.unionByName(prefix_links(rows, prints, components(found), block))


def enough(both: np.ndarray, a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Whether sets of ``a`` and ``b`` shingles that share ``both`` are similar."""
    return both >= least * (a + b - both) - 1e-9


def prefix(shingles: np.ndarray, common: np.ndarray, count: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles of a set, those not in ``common`` (sorted) first and then by ``count``: any two
    similar sets share one of these."""
    if not len(shingles):
        return shingles
    seen = np.zeros(len(shingles), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        seen = np.where(common[at] == shingles, count[at], 0)
    return shingles[np.lexsort((shingles, seen))][: len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1]


def mark_of(shingles: np.ndarray) -> np.ndarray:
    """A small image of a set, from which ``apart`` tells how much two sets differ at least."""
    if len(shingles) <= PARITY_SHINGLES:
        odd = np.bincount((shingles % np.uint64(MARK_BITS)).astype(np.int64), minlength=MARK_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)
    bins = MARK_BITS
    while True:
        counts = np.bincount((shingles % np.uint64(bins)).astype(np.int64), minlength=bins)
        if 4 * bins >= len(shingles) and counts.max() < 256:
            return counts.astype(np.uint8).view(np.int64)
        bins *= 2


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """No more than the number of shingles that only one of two marked sets has."""
    return int(apart_rows(x[None], y[None])[0])


def apart_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``apart`` of the marks in each row."""
    if x.shape[1] > y.shape[1]:
        x, y = y, x
    parity = x.shape[1] == MARK_BITS // 64
    if y.shape[1] == MARK_BITS // 64:
        return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(axis=1, dtype=np.int64)
    bins = MARK_BITS if parity else 8 * x.shape[1]
    counts = y.view(np.uint8).reshape(len(y), -1, bins).sum(axis=1, dtype=np.int64)
    if parity:
        return (np.unpackbits(x.view(np.uint8), axis=1) != (counts & 1)).sum(axis=1)
    return np.abs(counts - x.view(np.uint8)).sum(axis=1)


def apart_in_pairs(x: np.ndarray, i: np.ndarray, m: np.ndarray, y: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``apart`` of pairs of marks, ``m`` numbers from place ``i`` of ``x`` on and ``n`` from place ``j`` of ``y``; those of
    like lengths at once."""
    differ = np.zeros(len(i), np.int64)
    for p, q in np.unique(np.stack([m, n], axis=1), axis=0).tolist():
        same = np.flatnonzero((m == p) & (n == q))
        step = max(1, (1 << 19) // max(p, q))
        for low in range(0, len(same), step):
            at = same[low : low + step]
            differ[at] = apart_rows(x[i[at, None] + np.arange(p)], y[j[at, None] + np.arange(q)])
    return differ


def pairs_in_runs(keys: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal key (``keys`` sorted) that no root joins yet and that could still be similar if
    the key is the first shingle they share."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(keys)))
    pairs = [np.zeros((2, 0), np.int64)]

    def compare(at: np.ndarray, to: np.ndarray) -> None:
        rest = np.minimum(size[at] - place[at], size[to] - place[to])
        hit = (node[at] != node[to]) & ((root[at] == ALONE) | (root[at] != root[to])) & enough(rest, size[at], size[to])
        pairs.append(np.sort(np.stack([node[at[hit]], node[to[hit]]]), axis=0))

    end = np.repeat(begin + np.where(length > SHORT_RUN, 0, length), length)
    at = np.arange(len(keys))
    step = 1
    while len(at):
        inside = at + step < end
        at, end = at[inside], end[inside]
        compare(at, at + step)
        step += 1
    for start, n in zip(begin[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist(), strict=True):
        run = np.arange(start, start + n)
        groups, members = np.unique(root[run], return_counts=True)
        members[groups == ALONE] = 0
        largest = (root[run] == groups[members.argmax()]) & (members.max() > 0)
        others = run[~largest]
        run = np.concatenate([others, run[largest]])
        for i, one in enumerate(others.tolist()):
            compare(np.full(n - i - 1, one), run[i + 1 :])
    a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return a, b


def met_in_runs(keys: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """``a, b, key, place``, in proportion to what is given (sorted by key and node): the pairs (a, b) of ``pairs_in_runs``
    with place -1 for short runs, and for each other run that no root joins its members b, with the first of them as a."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(begin, len(keys)))
    short = np.repeat(length <= PAIRED_RUN, length)
    a, b = pairs_in_runs(*(c[short] for c in (keys, node, root, size, place)))
    joined = np.maximum.reduceat(root, begin) == np.minimum.reduceat(root, begin) if len(keys) else np.zeros(0, bool)
    sent = ~short & ~np.repeat(joined & (root[begin] != ALONE), length)
    first = np.repeat(node[begin], length)
    return [np.concatenate(c) for c in ((a, first[sent]), (b, node[sent]), (np.zeros_like(a), keys[sent]), (np.full_like(a, -1), place[sent]))]


def run_pieces(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Places in ``keys`` (sorted) so that any two of an equal key are together in one piece, and none holds many pairs."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    end = begin + np.diff(np.append(begin, len(keys)))
    held, pairs = 0, 0
    for start, stop in zip(begin.tolist(), end.tolist(), strict=True):
        n = stop - start
        if n <= 2 * RUN_BLOCK and pairs + n * n // 2 <= HELD_PAIRS:
            pairs += n * n // 2
            continue
        if start > held:
            yield np.arange(held, start)
        held, pairs = start, n * n // 2
        if n > 2 * RUN_BLOCK:
            blocks = [np.arange(k, min(k + RUN_BLOCK, stop)) for k in range(start, stop, RUN_BLOCK)]
            yield from (np.concatenate([blocks[x], blocks[y]]) for x in range(len(blocks)) for y in range(x + 1, len(blocks)))
            held, pairs = stop, 0
    if len(keys) > held:
        yield np.arange(held, len(keys))


def allowed_links(keys: np.ndarray, own: np.ndarray, place: np.ndarray, root: np.ndarray, size: np.ndarray, marks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest over sets of the pairs that share a key and whose sizes, places and marks allow them to be similar;
    ``own`` is the number of the set that has ``keys`` (sorted) at ``place``, the mark of set k is marks[ends[k]:ends[k + 1]]."""
    a = b = np.zeros(0, np.int64)
    label, long = np.arange(len(size)), np.diff(ends)
    for at in run_pieces(keys):
        x, y = pairs_in_runs(keys[at], own[at], root[own[at]], size[own[at]], place[at])
        apart_yet = label[x] != label[y]
        x, y = x[apart_yet], y[apart_yet]
        differ = apart_in_pairs(marks, ends[x], long[x], marks, ends[y], long[y])
        keep = enough((size[x] + size[y] - differ) // 2, size[x], size[y])
        if keep.any():
            a, b = forest(np.concatenate([a, x[keep]]), np.concatenate([b, y[keep]]))
            label[a] = b
    return a, b


def prefix_links(rows: DataFrame, prints: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """All links ``(a, b)`` between similar nodes of ``rows`` that ``roots`` (node, root) doesn't join."""
    total = prints.count()
    part = min(1.0, RANKED_TEXTS / max(total, 1))
    some = per_slice(rows.select("text").sample(part, seed=1), lambda batch: {"shingle": np.concatenate([_set_of(t) for t in utf8(batch.column("text"))]).view(np.int64)}, "shingle long")
    ranked = some.groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(RANKED).collect()
    common = np.array([r["shingle"] for r in ranked], np.int64).view(np.uint64)
    order = np.argsort(common)
    common, count = common[order], np.array([r["count"] for r in ranked], np.int64)[order]

    def first(batch: pa.RecordBatch) -> dict:
        sets = [_set_of(t) for t in utf8(batch.column("text"))]
        return {
            "node": batch.column("node"), "size": [len(s) for s in sets],
            "keys": [prefix(s, common, count).view(np.int64) for s in sets], "mark": [mark_of(s) for s in sets],
        }

    schema = "key long, node long, root long, size long, place long"
    sets = per_slice(rows, first, "node long, size long, keys array<long>, mark array<long>")
    sets = materialize(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", F.lit(ALONE))), "prefixes")

    def spread(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """A row for each shingle of a prefix, of one share of all shingles."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, 2000):
                    piece = batch.slice(low, 2000)
                    lists = piece.column("keys")
                    n = np.diff(lists.offsets.to_numpy())
                    key, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
                    place = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                    own = np.flatnonzero(key.view(np.uint64) % np.uint64(SHARES) == share)
                    columns = [key[own], *(piece.column(c).to_numpy()[row[own]] for c in ("node", "root", "size")), place[own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=arrow_schema(schema))

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = met_in_runs(*columns)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["a", "b", "key", "place"])

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

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose marks differ no more than similar sets do."""
        for batch in batches:
            a, b, m, n = (batch.column(c).to_numpy() for c in ("a", "b", "size_a", "size_b"))
            (x, i), (y, j) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("mark_a"), batch.column("mark_b")))
            differ = apart_in_pairs(x, i[:-1], np.diff(i), y, j[:-1], np.diff(j))
            keep = enough((m + n - differ) // 2, m, n)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``allowed_links`` of the runs of one first member after another."""
        parts: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            node, root, size, at, mark = (c.chunk(0) for c in pa.Table.from_batches(parts).combine_chunks().select(["node", "root", "size", "at", "mark"]).columns)
            node, root, size, held = node.to_numpy(), root.to_numpy(), size.to_numpy(), at.flatten()
            keys, place = (held.field(c).to_numpy() for c in ("key", "place"))
            own = np.repeat(np.arange(len(node)), np.diff(at.offsets.to_numpy()))
            order = np.lexsort((own, keys))
            ends = mark.offsets.to_numpy()
            a, b = allowed_links(keys[order], own[order], place[order], root, size, mark.flatten().to_numpy(), ends - ends[0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in batches:
            first = batch.column("first").to_numpy()
            cuts = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(first)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if parts and parts[-1].column("first")[0].as_py() != first[low]:
                    yield from out()
                    parts = []
                parts.append(batch.slice(low, high - low))
        if parts:
            yield from out()

    met = []
    for share in range(SHARES):
        rows.sparkSession.sparkContext._jvm.System.gc()  # frees the shuffle files of what is done
        keyed = sets.select("node", "root", "size", "keys").mapInArrow(spread(share), schema)
        met.append(materialize(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "a long, b long, key long, place long").distinct(), "met"))
    found = reduce(DataFrame.unionByName, met)
    pairs = found.where("place < 0").select("a", "b").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("mark").alias(f"mark_{c}")), c)
    pairs = pairs.mapInArrow(allowed, "a long, b long")
    members = found.where("place >= 0").groupBy(F.col("a").alias("first"), F.col("b").alias("node")).agg(F.collect_list(F.struct("key", "place")).alias("at"))
    members = members.join(sets.select("node", "root", "size", "mark"), "node").repartition("first").sortWithinPartitions("first", "node")
    pairs = pairs.unionByName(members.mapInArrow(gathered, "a long, b long"))
    return verified_links(rows, prints, components(pairs), block)


def verified_links(rows: DataFrame, prints: DataFrame, roots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between similar nodes of ``rows`` (node, text) within the clusters ``roots`` (node, root): see
    ``similar_links``. A cluster has blocks enough that none holds many texts or many words."""
    roots = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "clusters")
    needed = F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("words") / F.lit(BLOCK_WORDS))
    size = roots.join(prints.select("node", "words"), "node").groupBy("root").agg(F.ceil(needed).cast("int").alias("blocks"))

    def sets(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column("node"), "root": batch.column("root"), "blocks": batch.column("blocks"), "shingles": [_set_of(t).view(np.int64) for t in utf8(batch.column("text"))]}

    placed = roots.join(size, "root")
    placed = F.broadcast(placed) if roots.count() <= SENT_NODES else placed
    members = rows.join(placed, "node")
    members = per_slice(members.select("node", "root", "blocks", "text"), sets, "node long, root long, blocks int, shingles array<long>")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = members.select("node", "root", "shingles", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clusters one after another, each a run of equal (root, low, high)."""
        key: tuple[int, int, int] | None = None
        nodes: list[int] = []
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = similar_links(np.array(nodes, np.int64), held)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow_schema("a long, b long"))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "low", "high", "node")]
            for i, (*now, node) in enumerate(zip(*columns, strict=True)):
                if tuple(now) != key:
                    yield from out()
                    key, nodes, held = tuple(now), [], []
                nodes.append(node)
                held.append(np.asarray(batch.column("shingles")[i].values, np.int64).view(np.uint64))
        yield from out()

    by = ["root", "low", "high"]
    return dealt.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(verify, "a long, b long")


def word_nodes(rows: DataFrame) -> DataFrame:
    """``key, same, words, f0, f1, f2`` of each row (key, text); ``same`` names the sequence of its words, A-Z
    lower-cased, by a 64-bit hash."""

    def fn(batch: pa.RecordBatch) -> dict:
        split = [t.lower().split() for t in utf8(batch.column("text"))]
        got = [long_fingerprint(set(w)) for w in split]
        same = [xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63) for w in split]
        return {"key": batch.column("key"), "same": same, "words": [len(w) for w in split]} | {w: [g[k] for g in got] for k, w in enumerate(WORDS)}

    return per_slice(rows.select("key", "text"), fn, "key long, same long, words long, f0 long, f1 long, f2 long")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, less near copies: of each group of texts connected by a Jaccard
    similarity of 0.8 or more over five-word shingles, the row with the smallest doc_id stays.

    Texts of equal words are copies; those of fewer than five words are compared as a whole; empty and null
    texts are one group. Null ids are larger than all others; of rows alike in id and words one stays. An empty
    table stays empty.
    """
    own_id = F.col("doc_id").cast("long")
    ids = docs.groupBy(own_id.alias("id")).count()
    key = "doc_id" if docs.schema["doc_id"].dataType.typeName() == "long" else None
    if key is None or not ids.where("count > 1 or id is null").isEmpty():
        # ids that don't name rows: numbers that do are written down with the rows
        key = "row_number"
        while key in docs.columns:
            key += "_"
        docs = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    keyed = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"))
    prints = materialize(word_nodes(keyed), "prints")
    order = F.struct(own_id.isNull().alias("null"), own_id.alias("id"), F.col(key).alias("key"))
    placed = prints.join(docs.select(F.col(key).alias("key"), order.alias("order")), "key") if key != "doc_id" else prints.withColumn("order", F.struct(F.lit(False).alias("null"), F.col("key").alias("id"), "key"))
    first = placed.groupBy("same").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.select("same", "first", "n", F.col("first.key").alias("node")), "first")
    others = prints.join(first.where("n > 1").select("same", "node"), "same").where("key <> node").select("key")
    rows = keyed.join(others, "key", "left_anti").select(F.col("key").alias("node"), "text")
    kept = prints.join(first.select("same", "node"), "same").where("key = node").select("node", "words", *WORDS)
    roots = components(near_links(rows, prints=materialize(kept, "kept")))
    groups = first.join(roots, "node", "left").select("same", "first", F.coalesce("root", "node").alias("root"))
    best = groups.groupBy("root").agg(F.min("first").alias("keep"))
    stays = materialize(groups.join(best, "root").select("same", F.col("keep.key").alias("keep")), "stays")
    gone = materialize(prints.join(stays, "same").where("key <> keep").select(F.col("key").alias(key)), "gone")
    left = docs.join(gone, key, "left_anti")
    return left if key == "doc_id" else left.drop(key)


def keep_owners(docs: DataFrame, key: Column, owners: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``owners`` (node, keep_id, keep_node, grouped) don't drop: those without a
    group, and in each group one with the id and node kept. Whole rows are dealt by node once; only where ids
    are repeated (seen from the ids alone) are kept rows dealt again, to leave one of each."""
    own_id = F.col("doc_id").cast("long")
    repeated = not docs.groupBy(own_id.alias("id")).count().where("count > 1").isEmpty()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own_id.alias("own_id"), key.alias("node"))
    joined = rows.join(owners, "node", "left")
    own = "grouped and own_id <=> keep_id and node = keep_node"
    if not repeated:
        return joined.where(f"grouped is null or {own}").select("row.*")
    kept = joined.where(own).select("row", "node").dropDuplicates(["node"])
    return joined.where("grouped is null").select("row").unionByName(kept.select("row")).select("row.*")
