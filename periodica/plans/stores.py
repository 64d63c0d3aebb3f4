"""Sinks, day-partitioned tables, stored ranges and CSV: every query writes, then reads back."""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from periodica.operators import groups, miners
from periodica.plans import tables as t
from periodica.plans.registry import query
from periodica.session import materialise, shared_folder
from periodica.sources import csvfiles, scan
from periodica.sources.artifacts import CHECKPOINT_DAYS, ArtifactStore
from periodica.sources.tables import DayTables, RangeDatasets, load_hull, load_missing

NOW = datetime(2024, 2, 1)

# Columns and types of the account activity table.
ACTIVITY_TYPES = {
    "activity": "String", "address": "String", "block_day": "UInt8", "block_hour": "UInt8", "block_month": "UInt8",
    "block_number": "UInt64", "block_timestamp": "Datetime", "block_year": "UInt16", "day_of_week": "String",
    "from_addr": "String", "to_addr": "String", "transaction_hash": "String", "value": "Float64",
}
ACCOUNT_TYPES = {
    "event_id": "UInt64", "address": "UInt64", "block_timestamp": "Datetime", "amount": "Float64", "update_type": "String",
}


def _tables(spark, sf) -> DayTables:
    return DayTables(spark, f"periodica_{uuid.uuid4().hex[:12]}")


def _result(store: DayTables, table: str):
    """The table's rows, written apart, so that neither table nor database stays in the catalog."""
    rows = materialise(store.read(table), table)
    store.drop_database()
    return rows


def _accounts(spark, sf):
    return t.accounts(spark, sf).select(*ACCOUNT_TYPES)


def _activity(spark, sf):
    ts = F.col("ts")
    return t.table(spark, sf, "events").select(
        F.col("value"), F.concat(F.lit("h"), t.text("event_id")).alias("transaction_hash"),
        F.col("event_type").alias("activity"), t.text("user_id").alias("address"), F.dayofmonth(ts).alias("block_day"),
        F.hour(ts).alias("block_hour"), F.month(ts).alias("block_month"), F.col("event_id").alias("block_number"),
        ts.alias("block_timestamp"), F.year(ts).alias("block_year"), F.date_format(ts, "EEEE").alias("day_of_week"),
        t.text("user_id").alias("from_addr"), (F.col("user_id") % 10).cast("string").alias("to_addr"),
    )


_ACTIVITY_SQL = """SELECT event_type AS activity, CAST(user_id AS VARCHAR) AS address, day(ts) AS block_day,
  hour(ts) AS block_hour, month(ts) AS block_month, event_id AS block_number, ts AS block_timestamp, year(ts) AS block_year,
  dayname(ts) AS day_of_week, CAST(user_id AS VARCHAR) AS from_addr, CAST(user_id % 10 AS VARCHAR) AS to_addr,
  'h' || event_id AS transaction_hash, value FROM events"""


@query("table_from_dict", _ACTIVITY_SQL)
def table_from_dict(spark, sf):
    store = _tables(spark, sf)
    store.create("account_activity", ACTIVITY_TYPES)
    store.create("account_activity", ACTIVITY_TYPES)  # a second time changes nothing
    store.append(_activity(spark, sf), "account_activity")
    return _result(store, "account_activity")


# Columns and types of the warehouse table, and the column that identifies its rows.
WAREHOUSE_TYPES = {
    "miner_address": "String", "block_number": "UInt64", "block_timestamp": "Datetime", "block_size": "UInt64", "block_time": "UInt64",
    "difficulty": "Float64", "total_difficulty": "Float64", "nrg_limit": "UInt64", "transaction_hash": "String",
    "nrg_reward": "Float64", "from_addr": "String", "to_addr": "String", "num_transactions": "UInt16",
    "block_nrg_consumed": "UInt64", "transaction_nrg_consumed": "UInt64", "nrg_price": "UInt64", "value": "Float64",
    "block_year": "UInt16", "block_month": "UInt8", "block_day": "UInt8",
}
WAREHOUSE_KEY = ["transaction_hash"]

_TWENTY = """ts AS block_timestamp, CAST(user_id AS {text}) AS miner_address, event_id AS block_number, user_id * 7 AS block_size,
  user_id % 60 AS block_time, value AS difficulty, value * 2 AS total_difficulty, event_id * 2 AS nrg_limit,
  concat('h', event_id) AS transaction_hash, value / 4 AS nrg_reward, CAST(user_id % 10 AS {text}) AS from_addr,
  CAST(user_id % 7 AS {text}) AS to_addr, user_id % 9 AS num_transactions, user_id AS block_nrg_consumed,
  user_id * 2 AS transaction_nrg_consumed, user_id * 3 AS nrg_price, value, year(ts) AS block_year, month(ts) AS block_month,
  day(ts) AS block_day"""


def _split_columns(text: str) -> list[str]:
    """The items of a select list; commas within brackets do not divide."""
    return [c.strip() for c in re.split(r",(?![^(]*\))", text)]


@query("warehouse_insert", f"SELECT {_TWENTY.format(text='VARCHAR')} FROM events")
def warehouse_insert(spark, sf):
    """All 20 columns; the batch holds rows a second time with an older state, of which one is inserted."""
    store = _tables(spark, sf)
    store.create("warehouse", WAREHOUSE_TYPES)
    rows = t.table(spark, sf, "events").selectExpr(*_split_columns(_TWENTY.format(text="string")))
    older = rows.withColumn("block_timestamp", F.expr("block_timestamp - INTERVAL 1 DAY")).withColumn("value", F.lit(0.0))
    store.append(rows.unionByName(older), "warehouse", WAREHOUSE_KEY)
    return _result(store, "warehouse")


@query("sink_append", """
SELECT event_id, address, block_timestamp, amount, update_type FROM $accounts
UNION ALL SELECT event_id, address, block_timestamp, amount, update_type FROM $accounts WHERE update_type = 'purchase'""")
def sink_append(spark, sf):
    store = _tables(spark, sf)
    store.create("accounts", ACCOUNT_TYPES)
    rows = _accounts(spark, sf)
    store.append(rows, "accounts")
    again = rows.where("update_type = 'purchase'").select(*reversed(rows.columns))
    store.append(again, "accounts")
    return _result(store, "accounts")


_ACCOUNT_SQL = "SELECT event_id, address, block_timestamp, amount, update_type FROM $accounts"


@query("delete_range", _ACCOUNT_SQL + """
WHERE CAST(block_timestamp AS DATE) NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-14'""")
def delete_range(spark, sf):
    store = _tables(spark, sf)
    store.create("accounts", ACCOUNT_TYPES)
    store.append(_accounts(spark, sf), "accounts")
    store.delete_days("accounts", date(2024, 1, 10), date(2024, 1, 14))
    return _result(store, "accounts")


@query("delete_value_range", _ACCOUNT_SQL + " WHERE amount NOT BETWEEN 200 AND 300")
def delete_value_range(spark, sf):
    store = _tables(spark, sf)
    store.create("accounts", ACCOUNT_TYPES)
    store.append(_accounts(spark, sf), "accounts")
    store.delete_range("accounts", "amount", 200.0, 300.0)
    return _result(store, "accounts")


@query("upsert_range", _ACCOUNT_SQL + """
WHERE CAST(block_timestamp AS DATE) NOT BETWEEN DATE '2024-01-12' AND DATE '2024-01-20'
UNION ALL SELECT event_id, address, block_timestamp, amount * 2, update_type FROM $accounts
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '2024-01-12' AND DATE '2024-01-20'
  AND CAST(block_timestamp AS DATE) <> DATE '2024-01-15'
UNION ALL SELECT event_id, address, NULL, amount, update_type FROM $accounts WHERE address % 50 = 7
UNION ALL SELECT event_id, address, NULL, amount * 2, update_type FROM $accounts WHERE address % 50 = 8""")
def upsert_range(spark, sf):
    store = _tables(spark, sf)
    store.create("accounts", ACCOUNT_TYPES)
    rows = _accounts(spark, sf)
    untimed = rows.withColumn("block_timestamp", F.lit(None).cast("timestamp_ntz"))
    store.append(rows.unionByName(untimed.where(F.col("address") % 50 == 7)), "accounts")
    day = F.to_date("block_timestamp")
    batch = rows.where(day.between("2024-01-12", "2024-01-20") & (day != "2024-01-15")).unionByName(
        untimed.where(F.col("address") % 50 == 8))
    store.upsert(batch.withColumn("amount", F.col("amount") * 2), "accounts")
    return _result(store, "accounts")


@query("parquet_range_dataset", _ACCOUNT_SQL + """
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def parquet_range_dataset(spark, sf):
    store = RangeDatasets(spark, shared_folder(spark, "ranges"))
    rows = _accounts(spark, sf)
    store.save(rows, "warehouse:models", date(2024, 1, 2), date(2024, 1, 28), NOW, "block_timestamp")
    store.save(rows.where("amount > 100"), "warehouse:models", date(2024, 1, 2), date(2024, 1, 28), NOW, "block_timestamp")
    return store.load("warehouse:models", date(2024, 1, 5), date(2024, 1, 20), NOW, "block_timestamp")


# ---------------------------------------------------------------- CSV


@query("csv_dimension", "SELECT lower(c_name) AS name, c_mktsegment AS symbol FROM customer")
def csv_dimension(spark, sf):
    path = shared_folder(spark, "names")
    names = t.table(spark, sf, "customer").select(F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("Symbol"))
    csvfiles.write_table(names, path)
    return csvfiles.read_names(spark, path)


@query("csv_pools", "SELECT address, poolname FROM $pools")
def csv_pools(spark, sf):
    path = shared_folder(spark, "pools")
    csvfiles.write_table(t.pools(spark, sf), path)
    return csvfiles.read_pools(spark, path)


@query("csv_typed_read", _ACCOUNT_SQL)
def csv_typed_read(spark, sf):
    path = shared_folder(spark, "accounts")
    rows = _accounts(spark, sf)
    csvfiles.write_table(rows, path)
    return csvfiles.read_typed(spark, path, rows.schema)


@query("sink_csv", """
SELECT address, n, percentage FROM (SELECT user_id AS address, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS percentage FROM events GROUP BY 1)
ORDER BY percentage DESC, address LIMIT 20""")
def sink_csv(spark, sf):
    shares = groups.share_of_total(t.accounts(spark, sf), "address", "event_id").withColumnRenamed("block_count", "n")
    table = groups.top_n(shares, 20, "percentage", "address")
    path = shared_folder(spark, "top")
    csvfiles.write_table(table, path, one_file=True)
    return csvfiles.read_typed(spark, path, table.schema)


# ---------------------------------------------------------------- stored results


def _totals(rows, counted: str):
    return rows.groupBy(F.col("address").alias("item")).agg(F.count(counted).cast("string").alias("payload"))


def _store(spark, sf) -> ArtifactStore:
    """Saves of per-account counts: the first under a key is replaced, the second expires, the last one counts."""
    store = ArtifactStore(spark, shared_folder(spark, "artifacts"))
    rows = t.accounts(spark, sf)
    first, last = date(2024, 1, 1), date(2024, 1, 30)
    store.save(_totals(rows, "event_id"), "counts:all", first, last, datetime(2024, 1, 30), CHECKPOINT_DAYS)
    clicks = rows.where("update_type = 'click'")
    store.save(_totals(clicks, "event_id"), "counts:all", first, last, datetime(2024, 1, 30, 12), 0)
    bought = rows.where("update_type = 'purchase'")
    store.save(_totals(bought, "event_id"), "counts:all", first, last, datetime(2024, 1, 31))
    store.save(_totals(bought, "event_id"), "counts:part", date(2024, 1, 8), date(2024, 1, 12), datetime(2024, 1, 31))
    store.save(_totals(bought, "event_id"), "counts:part", date(2024, 1, 5), date(2024, 1, 10), datetime(2024, 1, 31))
    return store


@query("artifact_store", """
SELECT 'counts:all' AS key, CAST(user_id AS VARCHAR) AS item, CAST(count(*) AS VARCHAR) AS payload
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def artifact_store(spark, sf):
    return _store(spark, sf).latest(NOW, "counts:all").select("key", "item", "payload")


@query("artifact_resave", """
SELECT 'counts:other' AS key, CAST(user_id AS VARCHAR) AS item, CAST(count(*) AS VARCHAR) AS payload
FROM events WHERE user_id % 10 = 3 GROUP BY user_id""")
def artifact_resave(spark, sf):
    """A second save with fewer items, and one without any, beside a key that differs in one sign."""
    store = ArtifactStore(spark, shared_folder(spark, "artifacts"))
    rows = t.accounts(spark, sf)
    for key in ("counts:other", "counts_other", "counts:gone"):
        store.save(_totals(rows, "event_id"), key, None, None, datetime(2024, 1, 30), CHECKPOINT_DAYS)
    few = _totals(rows.where(F.col("address") % 10 == 3), "event_id")
    store.save(few, "counts:other", None, None, datetime(2024, 1, 31), CHECKPOINT_DAYS)
    store.save(few.limit(0), "counts:gone", None, None, datetime(2024, 1, 31), CHECKPOINT_DAYS)
    kept = store.purge(NOW, shared_folder(spark, "purged"))
    return kept.latest(NOW, "counts:other").unionByName(kept.latest(NOW, "counts:gone")).select("key", "item", "payload")


@query("artifact_range_lookup", """
SELECT 'counts:part' AS key, DATE '2024-01-05' AS start, DATE '2024-01-10' AS "end"
FROM (SELECT count(*) AS n FROM events WHERE event_type = 'purchase') WHERE n > 0""")
def artifact_range_lookup(spark, sf):
    return _store(spark, sf).covering(NOW, "counts:part", date(2024, 1, 8), date(2024, 1, 10))


@query("artifact_union_load", _ACCOUNT_SQL + """
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def artifact_union_load(spark, sf):
    return load_hull(_store(spark, sf), NOW, _accounts(spark, sf), "block_timestamp", key="counts:part")


@query("incremental_range_load", _ACCOUNT_SQL + """
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '2024-01-04' AND DATE '2024-01-27'""")
def incremental_range_load(spark, sf):
    rows = _accounts(spark, sf)
    day = F.to_date("block_timestamp")
    # held from the middle of a day on, and days outside the asked range
    held = rows.where(F.col("block_timestamp").between(F.lit("2024-01-10 07:00:00").cast("timestamp_ntz"), F.lit(
        "2024-01-14 15:30:00").cast("timestamp_ntz")) | day.between("2024-01-18", "2024-01-21") | (day <= "2024-01-02"))
    return load_missing(held, rows, "block_timestamp", date(2024, 1, 4), date(2024, 1, 27))


@query("churn_dict_load", """
SELECT transaction_hash, block_timestamp, from_addr, value FROM $warehouse
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-06-30' AND from_addr IN (
  SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 1000 OR s_acctbal > 7000)""")
def churn_dict_load(spark, sf):
    store = ArtifactStore(spark, shared_folder(spark, "churn"))
    suppliers = t.table(spark, sf, "supplier").withColumn("address", t.text("s_suppkey"))
    churned, retained = suppliers.where("s_acctbal < 1000"), suppliers.where("s_acctbal > 7000")
    miners.save_churn_lists(store, churned, retained.where("s_acctbal > 9000"), "tier1_churned_dict:a", date(1996, 1, 1), date(1998, 1, 1), NOW)
    miners.save_churn_lists(store, churned, retained, "tier1_churned_dict:b", date(1997, 1, 1), date(2000, 6, 30), NOW)
    rows = t.warehouse(spark, sf).select("transaction_hash", "block_timestamp", "from_addr", "value")
    return miners.listed_rows(store, "tier1_churned_dict:", NOW, rows, "from_addr")


@query("held_or_load", _ACCOUNT_SQL + """
WHERE block_timestamp BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-09'
UNION ALL """ + _ACCOUNT_SQL + """ WHERE block_timestamp BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-28'""")
def held_or_load(spark, sf):
    source = _accounts(spark, sf)
    held = scan.scan_days(source, "2024-01-03", "2024-01-12")
    within = scan.held_or_scan(held, source, "2024-01-04", "2024-01-09")
    beyond = scan.held_or_scan(held, source, "2024-01-10", "2024-01-28")
    return within.unionByName(beyond)
