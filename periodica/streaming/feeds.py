"""Change feeds and deduplicating sinks with Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from periodica.session import path_exists

# The columns that identify a row of each streamed table.
DEDUP_COLUMNS = {"block": ["block_number"], "transaction": ["transaction_hash"]}
STREAM, BATCH = "stream_id", "batch_id"


def change_rows(envelopes: DataFrame, schema: StructType | str) -> DataFrame:
    """Rows of a change feed: the state after each change, out of its JSON envelope.

    Deletions carry no state and are left out.
    """
    kind = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    parsed = F.from_json("value", f"struct<op:string,ts_ms:bigint,after:{kind}>")
    return envelopes.select(parsed.alias("e")).where(F.col("e.after").isNotNull()).select("e.after.*")


def change_events(envelopes: DataFrame, schema: StructType | str, deleted: str = "deleted", at: str = "changed_at") -> DataFrame:
    """Every change of a feed as a row: the state after it, or the last one before a deletion, with a mark and its time.

    Envelopes without either state, and lines that are none, carry no key and are left out.
    """
    kind = schema.simpleString() if isinstance(schema, StructType) else f"struct<{schema}>"
    parsed = F.from_json("value", f"struct<op:string,ts_ms:bigint,before:{kind},after:{kind}>")
    told = envelopes.select(parsed.alias("e")).select(
        F.coalesce("e.after", "e.before").alias("state"), F.col("e.after").isNull().alias(deleted), F.col("e.ts_ms").alias(at))
    return told.where(F.col("state").isNotNull()).select("state.*", deleted, at)


def read_json_events(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 64) -> DataFrame:
    """The changes of a folder of feed files, deletions among them."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return change_events(lines, schema)


def read_json_changes(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 64) -> DataFrame:
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(path)
    return change_rows(lines, schema)


def read_kafka_changes(spark: SparkSession, servers: str, topic: str, schema: StructType | str) -> DataFrame:
    """The same feed from a topic; needs the Kafka source on the session's class path."""
    raw = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("startingOffsets", "earliest").load()
    )
    return change_rows(raw.select(F.col("value").cast("string").alias("value")), schema)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def first_per_key(rows: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Keep the first row per key within the watermark, in the stream's own state."""
    typed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return typed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


class LastRowSink:
    """Keeps the last row per key of a stream.

    Every micro-batch is reduced to one row per key and written to its own folder, named by the
    streaming query and the batch number, so a repeated batch replaces itself and no other query's.
    Reading merges the batches; ``compact`` merges them for good. The cost of a batch does not grow
    with the table. Of equal rows by ``order`` that of the later batch number stays.

    ``deleted`` names a column that is true for a row that says its key is gone. Such a key is not read. The row itself
    is held, also by ``compact``, so that a change from before the deletion that comes in late does not bring the key back.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], deleted: str | None = None):
        self.spark, self.path, self.keys, self.order, self.deleted = spark, path.rstrip("/"), list(keys), list(order), deleted

    def _last(self, df: DataFrame, order: list[str]) -> DataFrame:
        columns = [c for c in df.columns if c not in (STREAM, BATCH)]
        place = F.struct(*[F.col(c) for c in order])
        newest = F.max_by(F.struct(*[F.col(c) for c in columns]), place).alias("_row")
        return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in self.keys]).agg(newest).select("_row.*")

    def write_batch(self, batch: DataFrame, batch_id: int, stream: str | None = None) -> None:
        stream = stream or self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        self._last(batch, self.order).write.mode("overwrite").parquet(f"{self.path}/{STREAM}={stream}/{BATCH}={batch_id}")

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return (
            rows.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )

    def _merged(self) -> DataFrame | None:
        if not path_exists(self.spark, self.path):
            return None
        batches = self.spark.read.parquet(self.path)
        return self._last(batches, [*self.order, BATCH, STREAM])

    def read(self) -> DataFrame | None:
        """Last row per key that is not gone; equal times are decided by the batch."""
        rows = self._merged()
        if rows is None or not self.deleted:
            return rows
        return rows.where(~F.coalesce(self.deleted, F.lit(False))).drop(self.deleted)

    def compact(self, target: str) -> "LastRowSink":
        """Write the merged rows as batch -1 of a new sink at ``target``; later batches go there."""
        merged = LastRowSink(self.spark, target, self.keys, self.order, self.deleted)
        self._merged().write.mode("overwrite").parquet(f"{merged.path}/{STREAM}=compacted/{BATCH}=-1")
        return merged

    def retained(self, ts: str, cutoff: datetime) -> DataFrame | None:
        """Rows not older than the cutoff."""
        rows = self.read()
        return None if rows is None else rows.where(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))
