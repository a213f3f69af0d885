"""Change feeds as streams: windowed counts with late data, and keyed snapshot refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from repolens.operators import snapshots


def read_feed(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _zoned(events: DataFrame, time: str) -> DataFrame:
    """Watermarks need a time with a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and window; a window ends for good when the watermark passes it, so its state is bounded
    by how late events may be. Works on batches and streams alike; a time without a zone is read in the
    session's."""
    seen = _zoned(events, time).withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(F.col("window.start").alias("window_start"), key, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    seen = _zoned(events, time).withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return seen.select(F.col("session_window.start").alias("session_start"), key, "n")


def refresh(changes: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch of ``changes`` (key, ..., deleted) into numbered snapshots below ``path``: batch n
    reads snapshot n - 1 and writes n over whatever an earlier try left, so a batch run again gives the same
    snapshot. Of a key's rows in a batch the last version (column ``version``) counts."""

    def merge(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "version").alias("row")).select(key, "row.*")
        fresh, gone = last.where("not deleted").drop("deleted", "version"), last.where("deleted")
        if number:
            fresh = snapshots.merge(batch.sparkSession.read.parquet(f"{path}/{number - 1}"), fresh, gone.select(key), key)
        fresh.write.mode("overwrite").parquet(f"{path}/{number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
