"""Token-id files with shuffled planes.

A file is a run of records, each followed by one newline so that Spark's own text writer, with its commit
protocol and any store it reaches, can write it; ``binaryFile`` reads it back. Records: blocks of
``BLOCK`` ids, transposed to byte or bit planes, each plane its own zstandard frame; document tables (ids
and lengths); and at the end the chunk index, which gives each block's place and planes. All numbers are
little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, id_and_text, materialize, scratch_path, slices
from .tokens import default_path, tokenizer

BLOCK = 1 << 16
END_ID = 0
MAGIC = b"RLPLANE1"
TAIL = struct.Struct("<QQ8s")
#: Text bytes for one file.
SHARD_BYTES = 32 << 20
#: Files whose totals are added up in one task; the groups' own totals, one for each, are added up by the driver.
FILES_TOGETHER = 4096


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of one block: 4 byte planes, or 32 bit planes. Planes above the highest id are empty."""
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = [np.ascontiguousarray(wide[:, k]) for k in range(4)]
    else:
        bits = np.unpackbits(wide, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, k], bitorder="little") for k in range(32)]
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        wide = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            if p:
                wide[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        wide = np.packbits(bits, axis=1, bitorder="little")
    return wide.view("<u4").ravel()


class Writer:
    """Records of one file, given out as they fill."""

    def __init__(self, shard: int, kind: str = "byte", level: int = 3) -> None:
        self.shard, self.kind = shard, kind
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = 0
        self.index: list[tuple[int, int, list[int]]] = []
        self.tables: list[tuple[int, int]] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0

    def _record(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def _block(self, ids: np.ndarray) -> bytes:
        frames = [self.pack(p) if p else b"" for p in to_planes(ids, self.kind)]
        self.index.append((self.at, len(ids), [len(f) for f in frames]))
        return self._record(b"".join(frames))

    def add(self, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> Iterator[bytes]:
        """``ids`` of whole documents in order; ``lengths`` are theirs, end ids included."""
        nulls = np.array([i is None for i in doc_ids], np.uint8)
        table = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes() + nulls.tobytes()
        self.tables.append((self.at, len(doc_ids)))
        packed = self.pack(table)
        yield self._record(struct.pack("<Q", len(packed)) + packed)
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= BLOCK:
            whole = np.concatenate(self.held)
            n = len(whole) // BLOCK * BLOCK
            for k in range(0, n, BLOCK):
                yield self._block(whole[k : k + BLOCK])
            self.held, self.n_held = [whole[n:]], len(whole) - n

    def close(self) -> Iterator[bytes]:
        if self.n_held:
            yield self._block(np.concatenate(self.held))
        start = self.at
        out = [struct.pack("<QQQQB", self.shard, self.n_ids, len(self.index), len(self.tables), 4 if self.kind == "byte" else 32)]
        out += [struct.pack(f"<QQ{len(sizes)}Q", at, n, *sizes) for at, n, sizes in self.index]
        out += [struct.pack("<QQ", *t) for t in self.tables]
        body = b"".join(out)
        yield self._record(body + TAIL.pack(start, zlib.crc32(body), MAGIC))


class Reader:
    """One file's bytes: its index, its document table, and any block by number."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        start, crc, magic = TAIL.unpack_from(data, len(data) - 1 - TAIL.size)
        body = data[start : len(data) - 1 - TAIL.size]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("not a whole token-id file")
        self.shard, self.n_ids, n_blocks, n_tables, planes = struct.unpack_from("<QQQQB", body)
        at = 33
        self.blocks = []
        for _ in range(n_blocks):
            place, n, *sizes = struct.unpack_from(f"<QQ{planes}Q", body, at)
            self.blocks.append((place, n, sizes))
            at += 16 + 8 * planes
        self.tables = [struct.unpack_from("<QQ", body, at + 16 * k) for k in range(n_tables)]
        self.unpack = zstandard.ZstdDecompressor().decompress

    def block(self, k: int) -> np.ndarray:
        place, n, sizes = self.blocks[k]
        planes = []
        for size in sizes:
            planes.append(self.unpack(self.data[place : place + size]) if size else b"")
            place += size
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Any range of the file's ids; only its blocks are unpacked."""
        first = start // BLOCK
        got = [self.block(k) for k in range(first, -(-stop // BLOCK))]
        return (np.concatenate(got) if got else np.zeros(0, "<u4"))[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        for at, n in self.tables:
            (size,) = struct.unpack_from("<Q", self.data, at)
            table = self.unpack(self.data[at + 8 : at + 8 + size])
            ids = np.frombuffer(table, "<i8", n).tolist()
            nulls = np.frombuffer(table, np.uint8, n, 16 * n)
            yield [None if z else i for i, z in zip(ids, nulls, strict=True)], np.frombuffer(table, "<i8", n, 8 * n)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts, from a scan of that column alone."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, kind: str = "byte", end_id: int = END_ID) -> None:
    """Ids of all whole texts, each with ``end_id`` behind, in ascending ``doc_id`` order over the files in
    ``path``; shard numbers ascend with the ids. Null text is empty; null ids come first; equal ids are
    ordered by text. An empty table writes no documents. Other columns are not read."""
    spark, vocabulary = docs.sparkSession, tokenizer_path or default_path()
    rows = id_and_text(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(TaskContext.get().partitionId(), kind)
        for batch in slices(batches):
            ids, at = tokenizer(vocabulary).encode(batch.column("text"))
            lengths = np.diff(at) + 1
            ids = np.insert(ids, at[1:], end_id)
            for record in writer.add(ids, batch.column("doc_id").to_pylist(), lengths):
                yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])
        for record in writer.close():
            yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], ["record"])

    made = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(content.as_buffer() or b"")  # no copy: the batch holds it
                if not len(data):
                    continue
                reader, at, left, next_block = Reader(data), 0, np.zeros(0, "<u4"), 0
                for doc_ids, lengths in reader.documents():
                    need = int(lengths.sum())
                    parts, have = [left], len(left)
                    while have < need:
                        parts.append(reader.block(next_block))
                        have += len(parts[-1])
                        next_block += 1
                    ids = np.ascontiguousarray(np.concatenate(parts), "<u4")
                    left, ids = ids[need:], memoryview(ids[:need].tobytes())
                    ends = np.cumsum(lengths)
                    starts = ends - lengths
                    crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([reader.shard] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(starts + at, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                        ["shard", "doc_id", "place", "n_tokens", "ids_crc32"],
                    )
                    at += need

    schema = "shard long, doc_id long, place long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = materialize(files.mapInArrow(run, schema), "ids")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).withColumn("together", F.floor(F.col("shard") / FILES_TOGETHER))
    upto = F.sum("total").over(Window.partitionBy("together").orderBy("shard"))
    within = totals.select("shard", "together", (upto - F.col("total")).alias("within"))
    sums = totals.groupBy("together").agg(F.sum("total").alias("total")).orderBy("together").collect()  # a row for 4096 files, that is 128 GB of text
    start, first = 0, []
    for r in sums:
        first.append((r["together"], start))
        start += r["total"]
    before = within.join(F.broadcast(spark.createDataFrame(first, "together long, first long")), "together").select("shard", (F.col("within") + F.col("first")).alias("before"))
    return rows.join(before, "shard").select("doc_id", (F.col("place") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op5_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id files in the shared folder, read back."""
    path = scratch_path(spark, "planes")
    write_ids(documents(spark, sf_dir), path)
    return read_documents(spark, path)
