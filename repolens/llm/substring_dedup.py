"""Removal of repeated substrings, exactly, from repeat groups of suffix arrays.

Every 50-byte string holds a k-byte anchor chosen by its content alone: the one with the smallest hash (all
of them on ties). Equal strings so have equal anchors at equal places, and only texts that share an anchor
need to meet. Anchors are dealt by hash; where all that surrounds an anchor equals a smaller document's, its
surroundings are known to be repeats without a byte being sent. The rest, mostly the borders of copied
regions, sends the bytes around the anchor to where their anchor's others go; a suffix array over them
gives all maximal repeat groups, and each occurrence that a smaller document shares is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplanes import text_bytes
from .common import arrow_schema, documents, materialize, slices, utf8
from .suffix import SuffixArray
from .tokens import flat

LEAST = 50
ANCHOR = 16
SPARE = LEAST - ANCHOR
HALF = SPARE // 2
SLICE = 2 << 20
#: Text bytes for one bucket of anchors, and context bytes for one suffix array.
BUCKET_BYTES = 10 << 20
ARRAY_BYTES = 1 << 19
LAST_ID = (1 << 63) - 1

_RANDOM = np.random.default_rng(77)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


class Anchors:
    """Anchors of the texts in ``raw``: where they are, and hashes of anchor, context and its two halves."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray) -> None:
        n = len(raw)
        self.doc = self.at = np.zeros(0, np.int64)
        self.h = self.context = self.left = self.right = np.zeros(0, np.uint64)
        if n < LEAST:
            return
        power, inverse = _power_tables(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * power[:n], out=sums[1:])

        def span(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (sums[b] - sums[a]) * inverse[a]

        size = np.diff(starts)
        end = np.repeat(starts[1:], size)
        h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        h[: n - ANCHOR + 1] = _mix((sums[ANCHOR:] - sums[: n - ANCHOR + 1]) * inverse[: n - ANCHOR + 1]) >> np.uint64(1)
        place = np.arange(n)
        inside = place + ANCHOR <= end
        h[~inside] = np.iinfo(np.uint64).max
        low = np.zeros(n, np.uint64)
        low[: n - SPARE] = _slide(h, SPARE + 1, np.minimum)
        low[place + LEAST > end] = 0
        top = _slide(np.concatenate([np.zeros(SPARE, np.uint64), low]), SPARE + 1, np.maximum)
        at = np.flatnonzero((top == h) & inside & (top > 0))
        self.doc = np.searchsorted(starts, at, "right") - 1
        begin, until = starts[self.doc], starts[self.doc + 1]
        self.at, self.h = at - begin, h[at]
        a, b = np.maximum(begin, at - SPARE), np.minimum(until, at + LEAST)
        one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        self.context = _mix(span(a, b) + (at - a).astype(np.uint64) * one + (b - at).astype(np.uint64) * two)
        a = np.maximum(begin, at - HALF)
        self.left = _mix(span(a, at) + (at - a).astype(np.uint64) * one)
        b = np.minimum(until, at + ANCHOR + HALF)
        self.right = _mix(span(at + ANCHOR, b) + (b - at).astype(np.uint64) * two)


#: An anchor that more contexts than this ask bytes for is dealt out by the halves of its contexts.
SPLIT = 4_096

#: One anchor on its way to its bucket. ``h`` only brings like anchors together; the context's hash, over the
#: anchor and all around it, has 64 bits.
RECORD = np.dtype([("h", "<u4"), ("context", "<u8"), ("left", "<u2"), ("right", "<u2"), ("at", "<u4"), ("id", "<i8"), ("tag", "<u4")])


def _columns(records: np.ndarray) -> bytes:
    """Records column by column, so that a shuffle's compression sees like by like; ids as differences."""
    out = [np.uint32(len(records)).tobytes()]
    for name in RECORD.names:
        column = records[name]
        if name == "id":
            column = np.diff(column, prepend=np.int64(0))
        out.append(np.ascontiguousarray(column).view(np.uint8).reshape(len(records), -1).T.tobytes() if name in ("id", "at", "tag") else column.tobytes())
    return b"".join(out)


def _records(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    records, at = np.zeros(n, RECORD), 4
    for name in RECORD.names:
        kind = RECORD[name]
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        if name in ("id", "at", "tag"):
            column = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel()
            records[name] = np.cumsum(column) if name == "id" else column
        else:
            records[name] = raw.view(kind)
    return records


REPLY = "id long, tag int, at int, h long"


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, tag, text``: null ids after all others; ``tag`` tells rows of equal id apart by their text. It is
    zero where no id is repeated."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"))
    repeated = not ids.groupBy("id").count().where("count > 1").isEmpty()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tag = F.hash(text) if repeated else F.lit(0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), tag.alias("tag"), text.alias("text"))


def _anchor_rows(buckets: int):
    schema = arrow_schema("bucket int, known boolean, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            raw, starts = flat(batch.column("text"))
            found = Anchors(raw, starts)
            records = np.zeros(len(found.at), RECORD)
            bucket = (found.h % np.uint64(buckets)).astype(np.int64)
            rest = found.h // np.uint64(buckets)
            records["h"], records["context"] = rest & np.uint64(0xFFFFFFFF), found.context
            records["left"], records["right"] = found.left & np.uint64(0xFFFF), found.right & np.uint64(0xFFFF)
            records["at"] = found.at
            records["id"], records["tag"] = batch.column("id").to_numpy()[found.doc], batch.column("tag").to_numpy()[found.doc].astype(np.int64) & 0xFFFFFFFF
            # of equal contexts here only the smallest document's goes on; the others are repeats already
            order = np.lexsort((records["id"], found.context, found.h))
            new = np.ones(len(order), bool)
            if len(order):
                h, c = found.h[order], found.context[order]
                new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            first = records["id"][order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else records["id"]
            known = np.zeros(len(order), bool)
            known[order] = records["id"][order] > first
            rows = []
            for flag, mask in ((False, ~known), (True, known)):
                at = np.flatnonzero(mask)
                if not len(at):
                    continue
                at = at[np.argsort(bucket[at], kind="stable")]
                edges = np.flatnonzero(np.diff(bucket[at], prepend=-1))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
                    rows.append((int(bucket[at[a]]), flag, _columns(records[at[a:b]])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _judge(records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's anchors: the records in order, which are repeats as a whole, and which need bytes as
    another context of their anchor agrees on the left half, or on the right one."""
    order = np.lexsort((records["id"], records["context"], records["h"]))
    records = records[order]
    h, context = records["h"].astype(np.uint64), records["context"]
    if not len(records):
        none = np.zeros(0, bool)
        return records, none, none, none
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    known = records["id"] > records["id"][first][group]
    needed = []
    for side in ("left", "right"):
        # contexts of one anchor that share 50 bytes agree on a half
        key = h[first] << np.uint64(16) | records[side][first]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        alike = np.zeros(len(first), bool)
        alike[by[1:][same]] = True
        alike[by[:-1][same]] = True
        needed.append(alike[group] & ~known)
    return records, known, *needed


def _asked(records: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int, split: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Records whose bytes are needed, with the key under which their contexts meet: the anchor's, or, of an
    anchor with more than ``split`` of them, one for each half that another context has too."""
    some = left | right
    key = records["h"].astype(np.int64) | bucket << 32
    _, code, count = np.unique(key[some], return_inverse=True, return_counts=True)
    hot = np.zeros(len(records), bool)
    hot[some] = count[code] > split
    plain = some & ~hot
    yield records[plain], key[plain]
    for number, (side, need) in enumerate((("left", left), ("right", right))):
        mask = need & hot
        mixed = _mix((key[mask].astype(np.uint64) << np.uint64(17)) ^ (records[side][mask].astype(np.uint64) << np.uint64(1)) ^ np.uint64(number))
        yield records[mask], mixed.view(np.int64)


def _replies(split: int):
    """Bucket by bucket (rows come sorted): anchors whose surroundings are repeats (null ``h``), and those whose
    bytes are needed."""
    schema = arrow_schema(REPLY)

    def reply(records: np.ndarray, h: pa.Array) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(records), 50_000):
            part = records[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part["id"]), pa.array(np.ascontiguousarray(part["tag"]).view(np.int32)), pa.array(part["at"].astype(np.int32)), h.slice(a, len(part))], schema=schema)

    def out(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        records, known, left, right = _judge(np.concatenate([_records(d) for d in held]))
        yield from reply(records[known], pa.nulls(int(known.sum()), pa.int64()))
        for some, key in _asked(records, left, right, bucket, split):
            yield from reply(some, pa.array(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for bucket, known, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "known", "data")), strict=True):
                if known:
                    records = _records(data)
                    yield from reply(records, pa.nulls(len(records), pa.int64()))
                    continue
                if bucket != now and held:
                    yield from out(now, held)
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield from out(now, held)

    return run


CONTEXT = "h long, id long, tag int, start int, body binary"
COVER = "id long, tag int, start int, end int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(CONTEXT)
    for batch in slices(batches):
        texts = utf8(batch.column("text"))
        rows = []
        for i, tag, asked, text in zip(batch.column("id").to_pylist(), batch.column("tag").to_pylist(), batch.column("asked").to_pylist(), texts, strict=True):
            for x in asked:
                start = max(0, x["at"] - SPARE)
                rows.append((x["h"], i, tag, start, text[start : x["at"] + LEAST]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def shared_spans(ids: np.ndarray, bodies: list[bytes], least: int = LEAST) -> np.ndarray:
    """Which bytes of ``bodies`` (in a row, each followed by one more) a document with a smaller id shares in a
    string of at least ``least`` bytes: from all maximal repeat groups."""
    array = SuffixArray(bodies, least)
    reach = np.zeros(len(array.text), np.int64)
    owner = ids[array.owner]
    for length, at in array.maximal_repeats(least):
        who = owner[at]
        low = who.min()
        later = at[who > low]
        if len(later):
            reach[later] = np.maximum(reach[later], length)
    step = np.zeros(len(reach) + 1, np.int64)
    hit = np.flatnonzero(reach)
    step[hit] += 1
    np.subtract.at(step, hit + reach[hit], 1)
    return np.cumsum(step[:-1]) > 0


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor; some anchors at a time share a suffix array."""
    schema = arrow_schema(COVER)
    held: list[tuple] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        ids = np.array([r[1] for r in held], np.int64)
        bodies = [r[4] for r in held]
        mask = shared_spans(ids, bodies)
        edge = np.diff(mask.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        begin = np.cumsum([len(b) + 1 for b in bodies]) - [len(b) + 1 for b in bodies]
        row = np.searchsorted(begin, starts, "right") - 1
        if len(row):
            shift = np.array([r[3] for r in held], np.int64)[row] - begin[row]
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(np.array([r[2] for r in held], np.int32)[row]), pa.array((starts + shift).astype(np.int32)), pa.array((ends + shift).astype(np.int32))], schema=schema)

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > ARRAY_BYTES and r[0] != held[-1][0]:
                yield from out()
                held, size = [], 0
            held.append(r)
            size += len(r[4])
    if held:
        yield from out()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema(RESULT)
    for batch in slices(batches):
        rows = []
        for doc_id, text, known, spans in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("known").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            step = np.zeros(len(text) + 1, np.int64)
            if known:
                at = np.array(known, np.int64)
                np.add.at(step, np.maximum(0, at - SPARE), 1)
                np.subtract.at(step, np.minimum(len(text), at + LEAST), 1)
            if spans:
                np.add.at(step, [s["start"] for s in spans], 1)
                np.subtract.at(step, [s["end"] for s in spans], 1)
            gone = np.cumsum(step[:-1]) > 0
            n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n_spans else text
            rows.append((doc_id, len(text), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def remove_repeats(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row: each byte within a 50-byte string
    that also starts in a document with a smaller id is removed, judged on the input.

    Null text is empty. Null ids are larger than all others and never smaller than each other; so are rows of
    one id. Texts under 50 bytes stay whole. An empty table gives no rows; other columns are not read. An anchor
    with more than ``split`` contexts to compare is dealt out by their halves, with the same result.
    """
    spark = docs.sparkSession
    rows = _keyed(docs)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // BUCKET_BYTES))
    anchors = rows.select("id", "tag", "text").mapInArrow(_anchor_rows(buckets), "bucket int, known boolean, data binary")
    replies = materialize(anchors.repartition(buckets, "bucket", "known").sortWithinPartitions("known", "bucket").mapInArrow(_replies(split), REPLY), "replies")
    _free_shuffles(spark)
    asked = replies.where("h is not null").groupBy("id", "tag").agg(F.collect_list(F.struct("at", "h")).alias("asked"))
    contexts = rows.select("id", "tag", "text").join(asked, ["id", "tag"]).select("id", "tag", "text", "asked").mapInArrow(_contexts, CONTEXT)
    covers = materialize(contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_covers, COVER), "covers")
    _free_shuffles(spark)
    known = replies.where("h is null").groupBy("id", "tag").agg(F.collect_set("at").alias("known"))
    spans = covers.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = known.join(spans, ["id", "tag"], "full_outer")
    return rows.join(found, ["id", "tag"], "left").select("doc_id", "text", "known", "spans").mapInArrow(_removed, RESULT)


def _free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's JVM collects what refers to them."""
    spark.sparkContext._jvm.System.gc()


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated substrings of all documents removed."""
    return remove_repeats(documents(spark, sf_dir))
