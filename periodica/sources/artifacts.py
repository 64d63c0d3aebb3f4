"""Keyed results with a date range and an expiry, kept in a small parquet table."""

from __future__ import annotations

import time
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.session import path_exists

# Life of a result and of a checkpoint, in days.
LIFE_DAYS = 4
CHECKPOINT_DAYS = 200
SCHEMA = (
    "key string, start date, end date, item string, payload string, "
    "saved_at timestamp_ntz, expires_at timestamp_ntz, save bigint"
)


class ArtifactStore:
    """Each saved result is a set of (item, payload) rows under a key and a date range.

    A save replaces what was saved before under the same key and range, also when it holds fewer
    rows or none, and also once it has expired. ``purge`` rewrites the table without replaced and
    expired saves. Keys are compared as they are; ``prefix`` asks for all keys that begin alike. Large results are written as tables of their own and saved here by their path.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def save(self, rows: DataFrame, key: str, start: date | None, end: date | None, now: datetime,
             days: int = LIFE_DAYS) -> None:
        """Save rows with the columns ``item`` and ``payload``; a row without an item marks the save itself."""
        marker = self.spark.createDataFrame([(None, None)], "item string, payload string")
        text = rows.select(F.col("item").cast("string").alias("item"), F.col("payload").cast("string").alias("payload"))
        text.where(F.col("item").isNotNull()).unionByName(marker).select(
            F.lit(key).alias("key"), F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"),
            F.col("item").cast("string").alias("item"), F.col("payload").cast("string").alias("payload"),
            F.lit(now).cast("timestamp_ntz").alias("saved_at"),
            F.lit(now + timedelta(days=days)).cast("timestamp_ntz").alias("expires_at"), F.lit(time.time_ns()).alias("save"),
        ).write.mode("append").parquet(self.path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Rows of the newest save of every key and range."""
        same = ["key", "start", "end"]
        names = [F.col(c).alias(f"_{c}") for c in same]
        last = rows.groupBy(*names).agg(F.max(F.struct("saved_at", "save")).alias("_last"))
        match = F.struct("saved_at", "save") == F.col("_last")
        for c in same:
            match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return rows.join(last, match).select(*rows.columns)

    def live(self, now: datetime, key: str | None = None, prefix: str | None = None) -> DataFrame:
        """Unexpired rows of the newest saves; the markers are among them."""
        rows = self.all()
        if key is not None:
            rows = rows.where(F.col("key") == key)
        if prefix is not None:
            rows = rows.where(F.startswith("key", F.lit(prefix)))
        return self._newest(rows).where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))

    def latest(self, now: datetime, key: str | None = None, prefix: str | None = None) -> DataFrame:
        """Items of the newest save of each key and range, unless it has expired."""
        return self.live(now, key, prefix).where(F.col("item").isNotNull()).select("key", "start", "end", "item", "payload", "saved_at")

    def ranges(self, now: datetime, key: str | None = None, prefix: str | None = None) -> DataFrame:
        """Stored keys and their date ranges."""
        return self.live(now, key, prefix).select("key", "start", "end").distinct()

    def covering(self, now: datetime, key: str, start: date, end: date) -> DataFrame:
        """One stored range of a key that contains the requested one: the earliest start, then the latest end."""
        return (
            self.ranges(now, key)
            .where((F.col("start") <= F.lit(start)) & (F.col("end") >= F.lit(end)))
            .orderBy("start", F.col("end").desc(), "key").limit(1)
        )

    def hull(self, now: datetime, key: str | None = None, prefix: str | None = None) -> tuple[date, date] | None:
        """Smallest start and largest end over the stored ranges of a key, or of the keys with a prefix."""
        row = self.ranges(now, key, prefix).agg(F.min("start"), F.max("end")).first()
        return None if row[0] is None else (row[0], row[1])

    def purge(self, now: datetime, path: str) -> "ArtifactStore":
        """A store at another path with nothing but the newest, unexpired saves."""
        self.live(now).write.parquet(path)
        return ArtifactStore(self.spark, path)
