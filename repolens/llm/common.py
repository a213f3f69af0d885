"""Shared pieces of the training-data operators: scratch tables, Arrow batching, hot-key helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once in a Python worker; batches that Spark hands over are cut to this.
SLICE_BYTES = 4 << 20
#: Bytes of one Arrow batch on its way between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session.

    Only where neither the session nor its context has one (tests on one machine), a temporary
    folder is made and set as the checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="repolens-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/repolens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table: lineage ends there, a lost
    executor costs a re-read, and no later job repeats the work."""
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts go by bytes, as rows differ in size by orders: where the session has not set a
    bound of its own, ``BATCH_BYTES`` takes the place of the default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators read; others, whatever their names, never reach them."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def give_back() -> None:
    """Memory that a worker's task has freed goes back to the system, as the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``limit`` bytes in each; one longer value stays whole."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if batch.num_rows else []
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    give_back()


def per_slice(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow over bounded slices; ``fn`` turns one slice into columns by name."""
    target = _arrow(schema)
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            out = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


ARROW_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
}


@lru_cache(maxsize=64)
def _arrow(schema: str) -> pa.Schema:
    """A flat ``name type, ...`` schema for Arrow; works on executors, where no session is."""
    return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in (x.split() for x in schema.split(","))])


def arrow_schema(schema: str) -> pa.Schema:
    return _arrow(schema)


def utf8(values: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text: the fold that operators hold out by."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
