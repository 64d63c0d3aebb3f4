"""Scans, projections, filters, scalar functions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from periodica.functions import scalars as sc
from periodica.operators import filters as fl
from periodica.operators import joins as jn
from periodica.operators import miners, risk
from periodica.plans import tables as t
from periodica.plans.registry import query
from periodica.sources import scan


@query("scan_date_range", """
SELECT address, block_timestamp, amount, update_type FROM $accounts
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' AND amount >= 1""")
def scan_date_range(spark, sf):
    return scan.scan_days(
        t.accounts(spark, sf), "2024-01-03", "2024-01-28",
        cols=["address", "block_timestamp", "amount", "update_type"], where="amount >= 1", ordered=True)


@query("scan_clamped_start", """
SELECT transaction_hash, block_timestamp, nrg_consumed AS transaction_nrg_consumed FROM $transactions
WHERE CAST(block_timestamp AS DATE) = DATE '1998-06-30'""")
def scan_clamped_start(spark, sf):
    return scan.scan_days(
        t.transactions(spark, sf), "1999-01-01", "1998-06-30", table="transaction",
        cols=["transaction_hash", "block_timestamp", "nrg_consumed"])


@query("scan_ts_range", """
SELECT transaction_hash, block_timestamp, from_addr, to_addr, value FROM $transactions
WHERE block_timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-06-30'""")
def scan_ts_range(spark, sf):
    return scan.scan_moments(
        t.transactions(spark, sf), 820454400000, 962323200000,
        cols=["transaction_hash", "block_timestamp", "from_addr", "to_addr", "value"])


@query("scan_document_flatten", """
SELECT event_id, ts AS timestamp, user_id AS "user.id", user_id % 4 AS "user.account.type",
  CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS "props.k" FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29 12:00:00'""")
def scan_document_flatten(spark, sf):
    account = F.struct((F.col("user_id") % 4).alias("type"))
    documents = t.table(spark, sf, "events").select(
        F.col("event_id").alias("_id"), "event_id", F.col("ts").alias("timestamp"),
        F.struct(F.col("user_id").alias("id"), account.alias("account")).alias("user"),
        F.from_json("props", "k bigint").alias("props"))
    return scan.scan_documents(documents, "2024-01-02", "2024-01-29T12:00:00")


@query("filter_selectors", """
SELECT event_id, address, update_type, account_type, amount FROM $accounts
WHERE update_type = 'purchase' AND account_type = 2""")
def filter_selectors(spark, sf):
    chosen = {"update_type": "purchase", "account_type": 2, "address": "all"}
    return fl.by_selectors(t.accounts(spark, sf), chosen).select(
        "event_id", "address", "update_type", "account_type", "amount")


@query("filter_window", """
SELECT name, visit_start, visit_duration, item FROM $rentals
WHERE visit_start >= DATE '1996-02-01' AND visit_start <= DATE '2000-11-30'""")
def filter_window(spark, sf):
    from datetime import datetime

    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in (datetime(1996, 2, 1), datetime(2000, 11, 30)))
    return fl.in_window(t.rentals(spark, sf), "visit_start", lo, hi, ["name", "visit_start", "visit_duration", "item"])


@query("semi_membership", """
SELECT transaction_hash, from_addr, to_addr, value FROM $transactions
WHERE from_addr IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 3000)""")
def semi_membership(spark, sf):
    listed = t.table(spark, sf, "supplier").where("s_acctbal > 3000").select(t.text("s_suppkey").alias("address"))
    rows = t.transactions(spark, sf).select("transaction_hash", "from_addr", "to_addr", "value")
    return fl.members(rows, "from_addr", listed, "address")


@query("drop_cols", "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders")
def drop_cols(spark, sf):
    return fl.drop_present(t.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_totalprice", "absent"])


@query("clean_numbers", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 OR l_tax = 0 THEN 0.0 ELSE l_discount END AS ratio,
  CASE WHEN l_quantity > 25 THEN 0.0 ELSE l_quantity END AS quantity, l_returnflag FROM lineitem""")
def clean_numbers(spark, sf):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan")))
    dirty = t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ratio.otherwise(F.col("l_discount")).alias("ratio"),
        F.when(F.col("l_quantity") <= 25, F.col("l_quantity")).alias("quantity"), "l_returnflag")
    return fl.clean_numbers(dirty)


@query("fill_map", """
SELECT event_id, CASE WHEN amount > 50 THEN amount ELSE 0.0 END AS value,
  CASE WHEN update_type = 'view' THEN 'unknown' ELSE update_type END AS from_addr FROM $accounts""")
def fill_map(spark, sf):
    gaps = t.accounts(spark, sf).select(
        "event_id", F.when(F.col("amount") > 50, F.col("amount")).alias("value"),
        F.when(F.col("update_type") != "view", F.col("update_type")).alias("from_addr"))
    return fl.fill_map(gaps, {"value": 0.0, "from_addr": "unknown"})


@query("fill_mean", """
SELECT l_orderkey, l_linenumber, l_suppkey, round(coalesce(CASE WHEN l_quantity > 10 THEN l_quantity END,
  (SELECT avg(l_quantity) FROM lineitem WHERE l_quantity > 10)), 6) AS quantity FROM lineitem""")
def fill_mean(spark, sf):
    gaps = t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey",
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("quantity"))
    return fl.fill_mean(gaps, ["quantity"]).withColumn("quantity", F.round("quantity", 6))


@query("category_codes", """
SELECT name, visit_start, visit_duration, gender, status, CASE gender WHEN 'male' THEN 1 ELSE 2 END AS gender_coded,
  CASE status WHEN 'guest' THEN 1 WHEN 'member' THEN 2 END AS status_coded,
  CASE WHEN gender = 'male' THEN 1 ELSE 2 END AS two_way FROM $rentals""")
def category_codes(spark, sf):
    rows = t.rentals(spark, sf).select("name", "visit_start", "visit_duration", "gender", "status")
    return fl.add_codes(rows).withColumn("two_way", fl.code(F.col("gender"), {"male": 1}, otherwise=2))


@query("label_membership", """
SELECT transaction_hash, from_addr, CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS churned,
  CASE WHEN s_suppkey IS NULL THEN 'retained' ELSE 'churned' END AS churned_verbose
FROM $transactions LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000)
  ON from_addr = CAST(s_suppkey AS VARCHAR)""")
def label_membership(spark, sf):
    listed = t.table(spark, sf, "supplier").where("s_acctbal < 2000").select(t.text("s_suppkey").alias("address"))
    rows = t.transactions(spark, sf).select("transaction_hash", "from_addr")
    return fl.label_by_list(rows, "from_addr", listed, "address")


@query("split_label", """
SELECT part, count(*) AS n, round(avg(amount), 6) AS mean_amount FROM (
  SELECT CASE WHEN status = 'churned' THEN 'churned' ELSE 'retained' END AS part, amount FROM $accounts_status)
GROUP BY 1""")
def split_label(spark, sf):
    rows = t.accounts_status(spark, sf).withColumn("churned", (F.col("status") == "churned").cast("int"))
    parts = fl.split_by_label(rows, "churned")
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("churned", "retained"))]
    return named[0].unionByName(named[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("amount"), 6).alias("mean_amount"))


@query("rename_cols", """
SELECT c_nationkey AS nation, c_custkey AS address, c_name AS owner FROM customer""")
def rename_cols(spark, sf):
    names = {"c_custkey": "address", "c_name": "owner", "c_nationkey": "nation"}
    return fl.rename(t.table(spark, sf, "customer"), names, ["nation", "address", "owner"])


@query("cast_cols", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INTEGER) AS l_quantity,
  CAST(l_suppkey AS DOUBLE) AS l_suppkey, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem""")
def cast_cols(spark, sf):
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_shipdate")
    return fl.cast_columns(rows, {"l_quantity": "int", "l_suppkey": "double", "l_shipdate": "date"})


@query("array_first", """
SELECT project, milestone, task, round(solution * 10, 6) AS solution FROM $projects""")
def array_first(spark, sf):
    first = F.round(sc.first_scaled(F.col("solution"), 10), 6)
    return t.projects(spark, sf).select("project", "milestone", "task", first.alias("solution"))


# ---------------------------------------------------------------- joins


@query("warehouse_join", """
WITH listed AS (SELECT block_number, miner_address, difficulty,
  block_number || '-' || unnest(generate_series(1, 7)) AS hash FROM $blocks)
SELECT block_number, miner_address, difficulty, coalesce(transaction_hash, 'unknown') AS transaction_hash,
  block_timestamp, coalesce(from_addr, 'unknown') AS from_addr, coalesce(to_addr, 'unknown') AS to_addr,
  coalesce(value, 0) AS value, nrg_consumed
FROM listed LEFT JOIN $transactions ON hash = transaction_hash""")
def warehouse_join(spark, sf):
    return miners.block_warehouse(
        t.blocks(spark, sf), t.transactions(spark, sf), spread=F.monotonically_increasing_id())


@query("risk_join", "SELECT matrix, risk, severity, likelihood FROM $risk_joined")
def risk_join(spark, sf):
    r = t.risk_tables(spark, sf)
    return risk.joined_risks(r["matrices"], r["risks"], r["analyses"])


@query("risk_lookup", """
SELECT matrix, risk, severity, likelihood, severity * likelihood AS composite FROM $risk_rated""")
def risk_lookup(spark, sf):
    r = t.risk_tables(spark, sf)
    joined = risk.joined_risks(r["matrices"], r["risks"], r["analyses"])
    return risk.rated_risks(joined, r["severities"], r["likelihoods"])


def _parameters(spark, sf):
    parameters = t.table(spark, sf, "part").select(
        (F.col("p_partkey") % 5).alias("etl"), F.concat_ws("-", "p_name", "p_brand").alias("label"),
        F.col("p_partkey").alias("handle"))
    etls = t.table(spark, sf, "region").select(F.col("r_regionkey").alias("_id"), F.col("r_name").alias("etl"))
    return parameters, etls


@query("etl_params_join", """
SELECT p_partkey % 5 AS etl, p_name || '-' || p_brand AS label, p_partkey AS handle, r_name AS name
FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE r_name = 'ASIA'""")
def etl_params_join(spark, sf):
    return jn.platform_parameters(*_parameters(spark, sf), "ASIA")


@query("etl_params_changed", """
SELECT name AS platform, bool_or(p_partkey % 50 = 3) AS changed FROM (SELECT p_partkey, r_name AS name
FROM part JOIN region ON p_partkey % 5 = r_regionkey) GROUP BY 1""")
def etl_params_changed(spark, sf):
    """Whether the parameters of a platform differ from those loaded before; one row per platform."""
    parameters, etls = _parameters(spark, sf)
    later = parameters.withColumn("handle", F.when(F.col("handle") % 50 == 3, -1).otherwise(F.col("handle")))
    rows = []
    for name in [r["etl"] for r in etls.select("etl").collect()]:  # the platforms are a handful
        held, now = (jn.platform_parameters(p, etls, name) for p in (parameters, later))
        rows.append((name, jn.differs(held, now)))
    return spark.createDataFrame(rows, "platform string, changed boolean")


@query("etl_items", """
SELECT DISTINCT lower(translate(p_name || '-' || p_brand, ' -', '__')) AS item
FROM part JOIN region ON p_partkey % 5 = r_regionkey WHERE r_name = 'EUROPE'""")
def etl_items(spark, sf):
    return jn.platform_items(jn.platform_parameters(*_parameters(spark, sf), "EUROPE"))


@query("dim_fallback", """
SELECT block_number, miner_address, coalesce(poolname, miner_address) AS pool
FROM $blocks LEFT JOIN $pools ON miner_address = address""")
def dim_fallback(spark, sf):
    rows = t.blocks(spark, sf).select("block_number", "miner_address")
    return jn.dimension_name(rows, "miner_address", t.pools(spark, sf), "address", "poolname", "pool")


@query("dim_fallback_trunc", """
SELECT c_custkey, coalesce(poolname, CASE WHEN length(c_name) > 10 THEN substring(c_name, 1, 10) ELSE c_name END) AS pool
FROM customer LEFT JOIN $pools ON c_name = poolname""")
def dim_fallback_trunc(spark, sf):
    rows = t.table(spark, sf, "customer").select("c_custkey", "c_name")
    return jn.dimension_name(rows, "c_name", t.pools(spark, sf), "poolname", "poolname", "pool", longest=10).select(
        "c_custkey", "pool")


# ---------------------------------------------------------------- scalar functions


@query("list_to_rows", """
SELECT block_number, block_number || '-' || unnest(generate_series(1, 7)) AS transaction_hashes FROM $blocks
UNION ALL
SELECT block_number, '[' || array_to_string([block_number || '-' || i FOR i IN generate_series(1, 7)], ',') || ']'
FROM $blocks""")
def list_to_rows(spark, sf):
    rows = t.blocks(spark, sf).select("block_number", "transaction_hashes")
    return miners.list_to_rows(rows, "transaction_hashes", keep=True)


@query("prefix", "SELECT c_custkey, substring(c_name, 1, 10) AS addr FROM customer")
def prefix(spark, sf):
    return t.table(spark, sf, "customer").select("c_custkey", sc.prefix(F.col("c_name")).alias("addr"))


@query("normalise_label", """
SELECT p_partkey, lower(translate(p_name || '-' || p_type, ' -', '__')) AS label FROM part""")
def normalise_label(spark, sf):
    return t.table(spark, sf, "part").select(
        "p_partkey", sc.normalise_label(F.concat_ws("-", "p_name", "p_type")).alias("label"))


@query("hex_to_int", """
SELECT event_id, CAST(event_id * 31 + user_id AS DECIMAL(20, 0)) AS number, CAST(user_id AS DECIMAL(20, 0)) AS plain,
  CAST(CASE WHEN user_id % 2 = 0 THEN user_id ELSE 0 END AS DECIMAL(20, 0)) AS missing,
  CAST(CAST(18446744073709486080 AS HUGEINT) + event_id % 65536 AS DECIMAL(20, 0)) AS largest FROM events""")
def hex_to_int(spark, sf):
    rows = t.table(spark, sf, "events")
    number = F.concat(F.lit("0x"), F.lower(F.hex(F.col("event_id") * 31 + F.col("user_id"))))
    return rows.select(
        "event_id", sc.hex_to_int(number).alias("number"), sc.hex_to_int(F.hex("user_id")).alias("plain"),
        sc.hex_to_int(F.when(F.col("user_id") % 2 == 0, F.hex("user_id"))).alias("missing"),
        sc.hex_to_int(F.concat(F.lit("0xffffffffffff"), F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"))).alias("largest"))


@query("epoch_to_date", """
SELECT event_id, CAST(ts AS DATE) AS from_seconds, CAST(ts AS DATE) AS from_ms, CAST(ts AS DATE) AS from_ns
FROM events""")
def epoch_to_date(spark, sf):
    seconds = sc.to_epoch_seconds(F.col("ts"))
    return t.table(spark, sf, "events").select(
        "event_id", sc.epoch_to_date(seconds).alias("from_seconds"),
        sc.epoch_to_date(sc.to_epoch_ms(F.col("ts"))).alias("from_ms"),
        sc.epoch_ns_to_date(seconds * 1_000_000_000).alias("from_ns"))


@query("date_to_epoch", """
SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms,
  strftime(ts, '%Y-%m-%d') AS day FROM events""")
def date_to_epoch(spark, sf):
    ts = F.col("ts")
    return t.table(spark, sf, "events").select(
        "event_id", sc.to_epoch_seconds(ts).alias("seconds"), sc.to_epoch_ms(ts).alias("ms"),
        sc.day_text(ts).alias("day"))


@query("date_parse", """
SELECT event_id, date_trunc('second', ts) AS parsed, date_trunc('hour', ts) AS hour, CAST(ts AS DATE) AS day
FROM events""")
def date_parse(spark, sf):
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.table(spark, sf, "events").select(
        "event_id", sc.parse_timestamp(written).alias("parsed"), sc.drop_minutes(F.col("ts")).alias("hour"),
        F.to_date("ts").alias("day"))


@query("relative_day", """
SELECT o_orderkey, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS before,
  strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS after FROM orders""")
def relative_day(spark, sf):
    day = F.col("o_orderdate")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", sc.relative_day(day, -1).alias("before"), sc.relative_day(day, 30).alias("after"))


@query("compose_key", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag || ':' || l_suppkey || ':' ||
  strftime(o_orderdate, '%Y-%m-%d') || ':' || strftime(l_shipdate, '%Y-%m-%d') AS key
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def compose_key(spark, sf):
    rows = t.table(spark, sf, "lineitem").join(t.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    key = sc.compose_key([F.col("l_returnflag"), F.col("l_suppkey")], F.col("o_orderdate"), F.col("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", "l_shipdate", key.alias("key"))
