"""Snapshots on any store that Spark reaches: numbered table folders and a pointer table that names the last."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


class Store:
    """``publish`` writes all tables of a snapshot first and the pointer row last: readers see the old
    snapshot or the new one. A snapshot of another schema version counts as none."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def current(self) -> int | None:
        try:
            rows = self.spark.read.parquet(f"{self.root}/_published")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return rows.where(F.col("schema_version") == SCHEMA_VERSION).agg(F.max("number")).first()[0]

    def read(self, table: str) -> DataFrame:
        number = self.current()
        if number is None:
            raise ValueError("nothing is published")
        return self.spark.read.parquet(f"{self.root}/{number}/{table}")

    def publish(self, tables: dict[str, DataFrame], warnings: list[str] | None = None) -> int:
        number = (self.current() or 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{number}/{name}")
        row = self.spark.createDataFrame([(number, SCHEMA_VERSION, warnings or [])], "number int, schema_version int, warnings array<string>")
        row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_published")
        return number

    def status(self, files: DataFrame, key: str = "path", measures: tuple[str, ...] = ("size",)) -> str:
        """never_indexed, fresh or stale, against a new scan of the files."""
        from repolens.operators.snapshots import diff

        if self.current() is None:
            return "never_indexed"
        return "fresh" if diff(self.read("files"), files, key, list(measures)).where("status <> 'same'").isEmpty() else "stale"
