"""Streaming queries: each drains a file source and reads its sink."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from periodica.plans import tables as t
from periodica.plans.registry import query
from periodica.session import shared_folder
from periodica.streaming import feeds

ORDER_FIELDS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


@query("stream_cdc_json", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'""")
def stream_cdc_json(spark, sf):
    folder = shared_folder(spark, "changes")
    fields = [f.split()[0] for f in ORDER_FIELDS.split(", ")]
    state = F.struct(*fields)
    removed = F.col("o_orderstatus") == "P"
    envelope = F.struct(
        F.when(removed, "d").otherwise("c").alias("op"), F.lit(1700000000000).alias("ts_ms"),
        F.when(removed, state).alias("before"), F.when(~removed, state).alias("after"))
    t.table(spark, sf, "orders").select(F.to_json(envelope).alias("value")).write.text(f"{folder}/in")
    rows = feeds.read_json_changes(spark, f"{folder}/in", ORDER_FIELDS)
    feeds.append_stream(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _feed(spark, sf, folder: str, step: int) -> None:
    """The next file of a change feed over the orders: all created, some updated, some deleted, late updates, two brought back."""
    rows = t.table(spark, sf, "orders").select(*[f.split()[0] for f in ORDER_FIELDS.split(", ")])
    gone = F.col("o_orderstatus") == "P"
    raised = (F.col("o_totalprice") + F.lit(step)).alias("o_totalprice")
    chosen = [F.lit(True), F.col("o_orderkey") % 3 == 0, gone, gone & (F.col("o_orderkey") % 2 == 0), gone & (F.col("o_orderkey") % 5 == 0)][step]
    op, moment = ["c", "u", "d", "u", "c"][step], [1, 2, 4, 3, 5][step]
    fields = [raised if c == "o_totalprice" and op != "d" and step else F.col(c) for c in rows.columns]
    state = F.struct(*fields)
    envelope = F.struct(F.lit(op).alias("op"), F.lit(1700000000000 + moment).alias("ts_ms"),
                        F.when(F.lit(op == "d"), state).alias("before"), F.when(F.lit(op != "d"), state).alias("after"))
    rows.where(chosen).select(F.to_json(envelope).alias("value")).coalesce(1).write.mode("append").text(folder)


_FED = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 4 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END
  AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 5 = 0"""


@query("stream_cdc_deletes", _FED)
def stream_cdc_deletes(spark, sf):
    """Orders after creations, updates and deletions that come in over two runs, with a merge of the sink between them."""
    folder = shared_folder(spark, "deletes")
    sink = feeds.LastRowSink(spark, f"{folder}/sink", ["o_orderkey"], ["changed_at"], "deleted")
    for run in ((0, 1, 2), (3, 4)):
        for step in run:
            _feed(spark, sf, f"{folder}/in", step)
        sink.start(feeds.read_json_events(spark, f"{folder}/in", ORDER_FIELDS, 1), f"{folder}/checkpoint").awaitTermination()
        if run[0] == 0:
            sink = sink.compact(f"{folder}/compacted")
    return sink.read().drop("changed_at")


@query("stream_cdc_offsets", """
SELECT 'false' AS deleted, 3 AS moments, CAST(count(*) + count(*) FILTER (o_orderkey % 3 = 0) + count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0)
  AS BIGINT) AS changes FROM orders UNION ALL SELECT 'true', 1, count(*) FILTER (o_orderstatus = 'P') FROM orders""")
def stream_cdc_offsets(spark, sf):
    """Each change is told once, also by a stream that is started again after every file."""
    folder = shared_folder(spark, "offsets")
    for step in (0, 1, 2, 3):
        _feed(spark, sf, f"{folder}/in", step)
        rows = feeds.read_json_events(spark, f"{folder}/in", ORDER_FIELDS)
        feeds.append_stream(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(F.col("deleted").cast("string").alias("deleted")).agg(
        F.count_distinct("changed_at").cast("int").alias("moments"), F.count("*").alias("changes"))


def _drained(spark, sf, keys: list[str], folder: str) -> feeds.LastRowSink:
    """Events in several files, one micro-batch per file."""
    source = f"{folder}/in"
    t.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").repartition(
        3, "event_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    sink = feeds.LastRowSink(spark, f"{folder}/sink", keys, ["ts", "event_id"])
    for part in (0, 0, 1):  # the second start finds nothing new, the third is a stream of its own into the same sink
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        own = rows.where(F.col("event_id") % 2 == part)
        sink.start(own, f"{folder}/checkpoint-{part}").awaitTermination()
    return sink


_LAST = """SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""


@query("stream_dedup_last", _LAST)
def stream_dedup_last(spark, sf):
    return _drained(spark, sf, ["user_id", "event_type"], shared_folder(spark, "last")).read()


@query("stream_retention", _LAST + " AND ts >= TIMESTAMP '2024-01-29 06:00:00'")
def stream_retention(spark, sf):
    folder = shared_folder(spark, "retained")
    sink = _drained(spark, sf, ["user_id", "event_type"], folder).compact(f"{folder}/compacted")
    return sink.retained("ts", datetime(2024, 1, 29, 6))


@query("stream_dedup_first", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_first(spark, sf):
    folder = shared_folder(spark, "first")
    source = f"{folder}/in"
    t.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type").repartition(
        3, "event_id").write.parquet(source)
    rows = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    first = feeds.first_per_key(rows, ["user_id", "event_type"], "ts", "60 days")
    feeds.append_stream(first.select("user_id", "event_type"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")
