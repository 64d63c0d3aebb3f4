"""Lags, differences, rolling means, percent change; unions, pivots and unpivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.operators import groups, miners, ordered, reshape, resample
from periodica.plans import tables as t
from periodica.plans.registry import query


COINS = ["click", "error", "purchase", "signup", "view"]


@query("multi_lag", """
SELECT * FROM (SELECT event_id, address, amount, lag(amount, 1) OVER w AS amount_1, lag(amount, 2) OVER w AS amount_2,
  lag(amount, 3) OVER w AS amount_3 FROM $accounts WINDOW w AS (PARTITION BY address ORDER BY block_timestamp, event_id))
WHERE amount_3 IS NOT NULL""")
def multi_lag(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "address", "block_timestamp", "amount")
    lags = {f"amount_{k}": ("amount", k) for k in (1, 2, 3)}
    return ordered.lag_columns(rows, lags, "block_timestamp", "event_id", keys="address").dropna().drop("block_timestamp")


@query("multi_lag_across", """
SELECT * FROM (SELECT event_id, amount, lag(amount, 1) OVER w AS amount_1, lag(amount, 7) OVER w AS amount_7
  FROM $accounts WINDOW w AS (ORDER BY block_timestamp, event_id)) WHERE amount_7 IS NOT NULL""")
def multi_lag_across(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "block_timestamp", "amount")
    lags = {f"amount_{k}": ("amount", k) for k in (1, 7)}
    return ordered.lag_columns(rows, lags, "block_timestamp", "event_id").dropna().drop("block_timestamp")


@query("lag_features", """
SELECT * FROM (SELECT crypto, timestamp, watch, lag(fork, 2) OVER w AS fork, lag(push, 2) OVER w AS push,
  lag(volume, 2) OVER w AS volume FROM $daily WINDOW w AS (PARTITION BY crypto ORDER BY timestamp))
WHERE fork IS NOT NULL""")
def lag_features(spark, sf):
    rows = t.daily(spark, sf).select("crypto", "timestamp", "watch", "fork", "push", "volume")
    return ordered.lag_all_but(rows, "watch", 2, "timestamp", keys="crypto").dropna()


@query("lag_by_text", """
SELECT p_partkey, p_name, lag(p_retailprice) OVER (ORDER BY p_name, p_partkey) AS before FROM part""")
def lag_by_text(spark, sf):
    rows = t.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return ordered.lag_columns(rows, {"before": ("p_retailprice", 1)}, "p_name", "p_partkey").drop("p_retailprice")


@query("first_diff", """
SELECT event_id, amount, round(coalesce(amount - lag(amount) OVER (ORDER BY block_timestamp, event_id), 0), 6) AS amount_diff
FROM $accounts""")
def first_diff(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "block_timestamp", "amount")
    lagged = ordered.lag_columns(rows, {"_p": ("amount", 1)}, "block_timestamp", "event_id")
    return lagged.select("event_id", "amount", F.round(F.coalesce(F.col("amount") - F.col("_p"), F.lit(0.0)), 6).alias("amount_diff"))


@query("pct_change", """
WITH g AS (SELECT event_id, block_timestamp, CASE WHEN block_time % 7 <> 0 THEN amount END AS amount FROM $accounts),
f AS (SELECT *, last_value(amount IGNORE NULLS) OVER (ORDER BY block_timestamp, event_id) AS filled FROM g)
SELECT event_id, amount, round(coalesce((filled / nullif(lag(filled) OVER (ORDER BY block_timestamp, event_id), 0) - 1) * 100, 0), 4)
  AS amount_change FROM f""")
def pct_change(spark, sf):
    rows = t.accounts(spark, sf).select(
        "event_id", "block_timestamp", F.when(F.col("block_time") % 7 != 0, F.col("amount")).alias("amount"))
    known = ordered.previous_known(rows, ["amount"], "block_timestamp", "event_id")
    previous = F.col("amount_prev")
    change = (F.try_divide(F.coalesce("amount", previous), previous) - 1) * 100
    return known.select("event_id", "amount", F.round(F.coalesce(change, F.lit(0.0)), 4).alias("amount_change"))


@query("hashrate", """
SELECT event_id, round(rolling_mean, 6) AS rolling_mean, round(amount / nullif(rolling_mean, 0), 10) AS hashrate FROM (
  SELECT event_id, amount, avg(block_time) OVER w AS rolling_mean, count(block_time) OVER w AS n FROM $accounts
  WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")
def hashrate(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "amount", "block_time")
    out = miners.hash_rate(rows, 5, "event_id", difficulty="amount")
    return groups.rounded(groups.rounded(out.select("event_id", "rolling_mean", "hashrate"), 6, "rolling_mean"), 10, "hashrate")


# ---------------------------------------------------------------- set operations and reshaping


@query("union_distinct", """
SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_shipdate < DATE '1999-01-01'
UNION SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_shipdate >= DATE '1997-01-01'""")
def union_distinct(spark, sf):
    rows = t.table(spark, sf, "lineitem")
    cols = ["l_orderkey", "l_linenumber", "l_returnflag"]
    return reshape.union_distinct(
        rows.where("l_shipdate < DATE'1999-01-01'").select(*cols), rows.where("l_shipdate >= DATE'1997-01-01'").select(*cols))


@query("union_all", """
SELECT o_orderkey AS key, o_orderdate AS day, o_totalprice AS amount FROM orders
UNION ALL SELECT l_orderkey, l_shipdate, NULL FROM lineitem""")
def union_all(spark, sf):
    top = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"))
    bottom = t.table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("day"), F.col("l_orderkey").alias("key"))
    return reshape.union_all(top, bottom)


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return groups.distinct_rows(t.table(spark, sf, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("unpivot", """
SELECT project, milestone, 'severity' AS name, severity AS value FROM $projects
UNION ALL SELECT project, milestone, 'likelihood', likelihood FROM $projects""")
def unpivot(spark, sf):
    rows = t.projects(spark, sf).select("project", "milestone", "severity", "likelihood")
    return reshape.unpivot(rows, ["project", "milestone"], ["severity", "likelihood"], "name", "value")


@query("pivot", """
SELECT timestamp, max(volume) FILTER (crypto = 'click') AS click, max(volume) FILTER (crypto = 'purchase') AS purchase,
  max(volume) FILTER (crypto = 'view') AS view, max(volume) FILTER (crypto = 'error') AS error,
  max(volume) FILTER (crypto = 'signup') AS signup FROM $daily GROUP BY 1""")
def pivot(spark, sf):
    return reshape.pivot(t.daily(spark, sf), "timestamp", "crypto", COINS, "volume")


@query("wide_names_to_long", """
SELECT n_name AS country, """ + ", ".join(
    f"coalesce(round(avg(c_acctbal) FILTER (c_mktsegment = '{s}'), 4), 0) AS {s.lower()}"
    for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def wide_names_to_long(spark, sf):
    cells = t.table(spark, sf, "customer").join(
        t.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).groupBy("n_name", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("value"))
    wide = reshape.wide_row(cells, "n_name", "c_mktsegment", "value")
    return reshape.wide_names_to_rows(wide, "country")


@query("coin_names_to_long", """
SELECT d AS timestamp, c AS crypto, watch::DOUBLE AS watch, volume FROM (SELECT DISTINCT timestamp AS d FROM $daily)
CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS c) LEFT JOIN $daily ON timestamp = d AND crypto = c""")
def coin_names_to_long(spark, sf):
    rows = t.daily(spark, sf)
    wide = rows.groupBy("timestamp").pivot("crypto", COINS).agg(
        F.first("watch").alias("watch"), F.first("volume").alias("volume"))
    return reshape.prefixed_names_to_rows(wide, COINS, "crypto", keep=["timestamp"])


@query("coin_sums", """
SELECT CAST(date_trunc('week', timestamp) + INTERVAL 6 DAY AS DATE) AS timestamp,
""" + ", ".join(f"CAST(sum({m}) FILTER (crypto = '{c}') AS BIGINT) AS {c}_{m}" for c in COINS for m in ("watch", "fork"))
       + " FROM $daily GROUP BY 1")
def coin_sums(spark, sf):
    wide = t.daily(spark, sf).groupBy("timestamp").pivot("crypto", COINS).agg(
        F.first("watch").alias("watch"), F.first("fork").alias("fork"))
    aggs = groups.coin_aggregates(COINS, ["watch", "fork"])
    return resample.resample(wide, "timestamp", "W", {c: (fn, c) for c, fn in aggs.items()})


@query("added_columns", "SELECT unnest(['amount_1', 'amount_7']) AS name")
def added_columns(spark, sf):
    """Names of the columns that a step has added."""
    rows = t.accounts(spark, sf).select("event_id", "block_timestamp", "amount")
    lagged = ordered.lag_columns(rows, {f"amount_{k}": ("amount", k) for k in (1, 7)}, "block_timestamp", "event_id")
    return spark.createDataFrame([(c,) for c in reshape.added_columns(lagged, rows)], "name string")
