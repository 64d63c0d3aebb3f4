"""Aggregates, resampling, period-to-date cards and period-over-period tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from periodica.functions import periods as pd_
from periodica.operators import cards, comparison, groups, resample
from periodica.operators.joins import dimension_name
from periodica.plans import tables as t
from periodica.plans.registry import query

AS_OF = datetime(2001, 7, 18, 12)
AS_OF_SQL = "TIMESTAMP '2001-07-18 12:00:00'"


def spine_sql(view: str, ts: str, step: str, start: str, label: str, aggs: str, fill: str, keys: str = "", where: str = "TRUE") -> str:
    """SQL of a resample: aggregate per bucket, left join on every bucket between the first and the last."""
    k = f"{keys}, " if keys else ""
    match = " AND ".join([f"g.{c} = s.{c}" for c in keys.split(", ") if c] + ["g.b = s.b"])
    spine_keys = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    out_keys = "".join(f"s.{c}, " for c in keys.split(", ") if c)
    return f"""WITH g AS (SELECT {k}{start} AS b, {aggs} FROM {view} WHERE {where} GROUP BY ALL),
s AS (SELECT {spine_keys}unnest(generate_series(min(b), max(b), INTERVAL {step})) AS b FROM g {by})
SELECT {out_keys}{label} AS {ts}, {fill} FROM s LEFT JOIN g ON {match}"""


# ---------------------------------------------------------------- group-by aggregates


@query("group_agg_dict", """
SELECT address, round(avg(amount), 9) AS amount, CAST(sum(block_time) AS BIGINT) AS block_time,
  count(DISTINCT update_type) AS update_type, count(event_id) AS event_id FROM $accounts GROUP BY 1""")
def group_agg_dict(spark, sf):
    aggs = {"amount": "mean", "block_time": "sum", "update_type": "nunique", "event_id": "count"}
    return groups.rounded(groups.group_agg(t.accounts(spark, sf), ["address"], aggs), 9, "amount")


@query("agg_dict_by_name", """
SELECT l_suppkey, round(sum(l_quantity), 6) AS tweets, round(avg(l_discount), 6) AS positive,
  round(avg(l_extendedprice), 4) AS close, round(sum(l_tax), 6) AS replies FROM lineitem GROUP BY 1""")
def agg_dict_by_name(spark, sf):
    rows = t.table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("tweets"), F.col("l_discount").alias("positive"),
        F.col("l_extendedprice").alias("close"), F.col("l_tax").alias("replies"))
    aggs = groups.aggregates_by_name([c for c in rows.columns if c != "l_suppkey"])
    out = groups.group_agg(rows, ["l_suppkey"], aggs)
    return groups.rounded(groups.rounded(out, 6, "tweets", "positive", "replies"), 4, "close")


@query("share_of_total", """
WITH c AS (SELECT coalesce(poolname, CASE WHEN length(c_name) > 10 THEN substring(c_name, 1, 10) ELSE c_name END) AS address,
  count(*) AS block_count FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN $pools ON c_name = poolname
  GROUP BY 1)
SELECT address, block_count, round(100.0 * block_count / (SELECT count(*) FROM orders), 1) AS percentage FROM c""")
def share_of_total(spark, sf):
    named = t.table(spark, sf, "orders").join(t.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pooled = dimension_name(named, "c_name", t.pools(spark, sf), "poolname", "poolname", "address", longest=10)
    return groups.share_of_total(pooled, "address", "o_orderkey")


@query("top_n", """
SELECT address, n, percentage FROM (SELECT o_custkey AS address, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS percentage FROM orders GROUP BY 1)
ORDER BY percentage DESC, address LIMIT 10""")
def top_n(spark, sf):
    rows = t.table(spark, sf, "orders").withColumnRenamed("o_custkey", "address")
    shares = groups.share_of_total(rows, "address", "o_orderkey").withColumnRenamed("block_count", "n")
    return groups.top_n(shares, 10, "percentage", "address")


@query("share_daily", """
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows,
  round(100.0 * count(*) / (SELECT count(*) FROM orders), 6) AS percentage FROM orders GROUP BY 1""")
def share_daily(spark, sf):
    return groups.rounded(groups.share_by_day(t.table(spark, sf, "orders"), "o_orderdate"), 6, "percentage")


@query("normalize_per_day", """
WITH d AS (SELECT greatest(date_diff('day', min(CAST(block_timestamp AS DATE)), max(CAST(block_timestamp AS DATE))), 1) AS days
  FROM $accounts)
SELECT event_id, address, round(amount / days, 8) AS amount, round(block_time / days, 8) AS block_time FROM $accounts, d""")
def normalize_per_day(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "address", "block_timestamp", "amount", "block_time")
    scaled = groups.per_day(rows, "block_timestamp", skip=["event_id", "address"]).drop("block_timestamp")
    return groups.rounded(scaled, 8, "amount", "block_time")


@query("min_max", "SELECT min(l_shipdate) AS min_value, max(l_shipdate) AS max_value FROM lineitem")
def min_max(spark, sf):
    return groups.min_max(t.table(spark, sf, "lineitem"), "l_shipdate")


@query("distinct_values", """
SELECT 'type' AS menu, type AS value FROM $business UNION SELECT 'company', company FROM $business
UNION SELECT 'patron_parish', patron_parish FROM $business
UNION SELECT unnest(['type', 'company', 'patron_parish']), 'all'""")
def distinct_values(spark, sf):
    return groups.distinct_values(t.business(spark, sf), ["type", "company", "patron_parish"])


@query("distinct_profiles", "SELECT DISTINCT patron, company, patron_parish FROM $business")
def distinct_profiles(spark, sf):
    return groups.distinct_rows(t.business(spark, sf), ["patron", "company", "patron_parish"])


@query("scatter_pairs", """
SELECT visit_duration AS x, 'rental_tab' AS feature, rental_tab AS value FROM $rentals
UNION ALL SELECT visit_duration, 'discount', CASE WHEN discount = 0 THEN 0 ELSE discount END FROM $rentals""")
def scatter_pairs(spark, sf):
    rows = t.rentals(spark, sf).withColumn("discount", F.when(F.col("discount") != 0, F.col("discount")))
    return groups.scatter_pairs(rows, "visit_duration", ["visit_duration", "rental_tab", "discount"])


def _bins_sql(column: str, bins: int) -> str:
    return f"""SELECT '{column}' AS feature, CAST(least(floor(({column} - lo) / width), {bins - 1}) AS INTEGER) AS bin,
  round(lo + least(floor(({column} - lo) / width), {bins - 1}) * width, 6) AS low, count(*) AS n
FROM $rentals, (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins} AS width FROM $rentals) GROUP BY ALL"""


@query("histogram", _bins_sql("visit_duration", 25) + " UNION ALL " + _bins_sql("rental_tab", 25))
def histogram(spark, sf):
    return groups.rounded(groups.histogram(t.rentals(spark, sf), ["visit_duration", "rental_tab"]), 6, "low")


@query("histogram_odd_values", _bins_sql("visit_duration", 25).replace(
    "$rentals", "(SELECT * FROM $rentals WHERE visit_duration % 7 NOT IN (3, 4))"))
def histogram_odd_values(spark, sf):
    """NaN, infinite and null values belong to no bin; a column of nothing else has none."""
    kind = F.col("visit_duration") % 7
    odd = F.when(kind == 3, F.lit(float("nan"))).when(kind == 4, F.lit(float("-inf"))).otherwise(F.col("visit_duration").cast("double"))
    rows = t.rentals(spark, sf).withColumn("visit_duration", odd).withColumn("nothing", F.lit(None).cast("double"))
    return groups.rounded(groups.histogram(rows, ["visit_duration", "nothing"]), 6, "low")


@query("box_summary", """
SELECT status, min(amount) AS min, round(quantile_cont(amount, 0.25), 6) AS q1, round(quantile_cont(amount, 0.5), 6) AS median,
  round(quantile_cont(amount, 0.75), 6) AS q3, max(amount) AS max,
  round((SELECT min(amount) FROM $accounts) * 0.9, 6) AS axis_low,
  round((SELECT max(amount) FROM $accounts) * 1.1, 6) AS axis_high FROM $accounts_status GROUP BY 1""")
def box_summary(spark, sf):
    boxes = groups.box_summary(t.accounts_status(spark, sf), "amount", "status")
    return groups.rounded(boxes, 6, "q1", "median", "q3", "axis_low", "axis_high")


# ---------------------------------------------------------------- resampling


@query("resample_global", spine_sql(
    "$accounts", "block_timestamp", "1 HOUR", "date_trunc('hour', block_timestamp)", "s.b",
    "count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 10) AS mean, count(DISTINCT address) AS users",
    "coalesce(n, 0) AS n, coalesce(total, 0) AS total, mean, coalesce(users, 0) AS users"))
def resample_global(spark, sf):
    rows = t.accounts(spark, sf)
    out = resample.resample(rows, "block_timestamp", "H", {
        "n": ("count", "event_id"), "total": ("sum", "amount"), "mean": ("mean", "amount"), "users": ("nunique", "address")})
    return groups.rounded(groups.rounded(out, 2, "total"), 10, "mean")


def _calendar(name: str, period: str, step: str, start: str, label: str):
    sql = spine_sql("orders", "o_orderdate", step, start, label, "count(*) AS n, round(sum(o_totalprice), 2) AS total",
                    "coalesce(n, 0) AS n, coalesce(total, 0) AS total")

    @query(name, sql)
    def run(spark, sf):
        out = resample.resample(t.table(spark, sf, "orders"), "o_orderdate", period,
                                {"n": ("count", "o_orderkey"), "total": ("sum", "o_totalprice")})
        return groups.rounded(out, 2, "total")

    return run


_DAY = "CAST(o_orderdate AS DATE)"
_calendar("resample_daily", "D", "1 DAY", _DAY, "CAST(s.b AS DATE)")
_calendar("resample_weekly", "W", "7 DAY", f"date_trunc('week', {_DAY})", "CAST(s.b + INTERVAL 6 DAY AS DATE)")
_calendar("resample_monthly", "M", "1 MONTH", f"date_trunc('month', {_DAY})", "CAST(last_day(s.b) AS DATE)")
_calendar("resample_quarterly", "Q", "3 MONTH", f"date_trunc('quarter', {_DAY})",
          "CAST(last_day(s.b + INTERVAL 2 MONTH) AS DATE)")


@query("resample_grouped", spine_sql(
    "$rentals", "visit_start", "1 DAY", "CAST(visit_start AS DATE)", "CAST(s.b AS DATE)",
    "sum(visit_duration) AS visit_duration, round(avg(rental_tab), 4) AS rental_tab, count(item) AS items",
    "coalesce(visit_duration, 0) AS visit_duration, rental_tab, coalesce(items, 0) AS items", keys="name"))
def resample_grouped(spark, sf):
    out = resample.resample(t.rentals(spark, sf), "visit_start", "D", {
        "visit_duration": ("sum", "visit_duration"), "rental_tab": ("mean", "rental_tab"), "items": ("count", "item")},
        keys="name")
    return groups.rounded(out, 4, "rental_tab", "visit_duration")


@query("multiline", spine_sql(
    "$rentals", "visit_start", "7 DAY", "date_trunc('week', CAST(visit_start AS DATE))",
    "CAST(s.b + INTERVAL 6 DAY AS DATE)", "round(avg(visit_duration), 6) AS visit_duration",
    "coalesce(visit_duration, 0) AS visit_duration", keys="category"))
def multiline(spark, sf):
    lines = resample.series_by_level(t.rentals(spark, sf), "visit_start", "W", "category", "visit_duration")
    return groups.rounded(lines, 6, "visit_duration")


@query("multiline_attendance", spine_sql(
    "$business", "start_actual", "1 MONTH", "date_trunc('month', CAST(start_actual AS DATE))",
    "CAST(last_day(s.b) AS DATE)", "count(DISTINCT patron) AS patron", "coalesce(patron, 0) AS patron", keys="company"))
def multiline_attendance(spark, sf):
    return resample.series_by_level(t.business(spark, sf), "start_actual", "M", "company", "patron", "nunique")


@query("multiline_dow", """
SELECT dayname(visit_start) AS day_of_week, CAST(last_day(date_trunc('quarter', visit_start) + INTERVAL 2 MONTH) AS DATE) AS bucket,
  round(avg(visit_duration), 6) AS visit_duration FROM $rentals GROUP BY 1, 2""")
def multiline_dow(spark, sf):
    out = resample.weekday_profile(t.rentals(spark, sf), "visit_start", "Q", "visit_duration")
    return groups.rounded(out, 6, "visit_duration")


def _rate_sql(where: str, out: str, delta: str) -> str:
    inner = spine_sql("$accounts_status", "block_timestamp", "1 DAY", "CAST(block_timestamp AS DATE)", "CAST(s.b AS DATE)",
                      "count(*) AS n", f"coalesce(n, 0) AS {out}", where=where)
    return f"""SELECT block_timestamp, {out}, round(coalesce(({out} / nullif(lag({out}) OVER (ORDER BY block_timestamp), 0)
  - 1.0) * 100, 0), 6) AS {delta} FROM ({inner})"""


@query("activity_rate", _rate_sql("amount >= 0 AND update_type = 'click'", "period_activity", "activity_delta"))
def activity_rate(spark, sf):
    rows = t.accounts(spark, sf).where("amount >= 0 AND update_type = 'click'")
    out = groups.activity_rate(rows, "block_timestamp", "D", "address", "period_activity", "activity_delta")
    return groups.rounded(out, 6, "activity_delta")


@query("status_rate", _rate_sql("status = 'joined'", "status", "perc_change"))
def status_rate(spark, sf):
    rows = t.accounts_status(spark, sf).where("status = 'joined'")
    out = groups.activity_rate(rows, "block_timestamp", "D", "status", "status", "perc_change")
    return groups.rounded(out, 6, "perc_change")


@query("ratio_series", spine_sql(
    "$daily", "timestamp", "7 DAY", "date_trunc('week', CAST(timestamp AS DATE))", "CAST(s.b + INTERVAL 6 DAY AS DATE)",
    "sum(watch) AS w, sum(fork) AS f, sum(volume) AS v",
    "round(coalesce(w / nullif(f, 0), 0), 6) AS fork, round(coalesce(w / nullif(v, 0), 0), 6) AS volume"))
def ratio_series(spark, sf):
    out = resample.ratio_series(t.daily(spark, sf), "timestamp", "W", "watch", ["fork", "volume"])
    return groups.rounded(out, 6, "fork", "volume")


def _cluster_case(c: str) -> str:
    return f"CASE WHEN {c} IN ('click', 'error') THEN 'cluster_0' WHEN {c} = 'signup' THEN 'cluster_1' ELSE {c} END"


_LINES = spine_sql(
    "(SELECT *, " + _cluster_case("crypto") + " AS cluster FROM $daily)", "timestamp", "1 DAY", "CAST(timestamp AS DATE)",
    "CAST(s.b AS DATE)", "sum(watch) AS watch, sum(volume) AS volume",
    "coalesce(watch, 0) AS watch, coalesce(volume, 0) AS volume", keys="cluster")


@query("cluster_series", f"""
SELECT timestamp, CAST(sum(watch) FILTER (cluster = 'cluster_0') AS BIGINT) AS cluster_0_watch,
  round(sum(volume) FILTER (cluster = 'cluster_0'), 2) AS cluster_0_volume,
  CAST(sum(watch) FILTER (cluster = 'cluster_1') AS BIGINT) AS cluster_1_watch,
  round(sum(volume) FILTER (cluster = 'cluster_1'), 2) AS cluster_1_volume,
  CAST(sum(watch) FILTER (cluster = 'view') AS BIGINT) AS view_watch,
  round(sum(volume) FILTER (cluster = 'view'), 2) AS view_volume,
  CAST(sum(watch) FILTER (cluster = 'purchase') AS BIGINT) AS purchase_watch,
  round(sum(volume) FILTER (cluster = 'purchase'), 2) AS purchase_volume FROM ({_LINES}) GROUP BY 1""")
def cluster_series(spark, sf):
    rows = t.daily(spark, sf)
    known = rows.select("crypto").distinct().where(F.col("crypto").isin("click", "error", "signup"))
    clusters = known.withColumn("cluster", F.when(F.col("crypto") == "signup", "cluster_1").otherwise("cluster_0"))
    out = resample.cluster_series(
        rows, clusters, "crypto", "timestamp", "D", ["watch", "volume"], ["cluster_0", "cluster_1", "view", "purchase"])
    return groups.rounded(out, 2, *[c for c in out.columns if c.endswith("_volume")])


# ---------------------------------------------------------------- cards


def _start_sql(period: str, ts: str = AS_OF_SQL) -> str:
    return f"date_trunc('{period}', {ts})"


def _cards_sql(measure: str, view: str, ts: str, as_of: str, out: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{p}' AS period, {measure} AS {out} FROM {view} WHERE {ts} >= {_start_sql(p, as_of)} AND {ts} <= {as_of}"
        for p in pd_.PERIODS)


@query("ptd_cards", _cards_sql(
    "coalesce(trunc(CAST(sum(DISTINCT CAST(rate AS DECIMAL(18,2))) AS DECIMAL(38,2))), 0)::DOUBLE",
    "$business", "start_actual", AS_OF_SQL, "value"))
def ptd_cards(spark, sf):
    rows = t.business(spark, sf).withColumn("rate", t.money("rate"))
    return cards.value_cards(rows, "start_actual", AS_OF, "rate", "sum")


@query("ptd_cards_mean", _cards_sql(
    "round(avg(DISTINCT remuneration), 3)", "$business", "start_actual", AS_OF_SQL, "value"))
def ptd_cards_mean(spark, sf):
    return cards.value_cards(t.business(spark, sf), "start_actual", AS_OF, "remuneration", "mean")


@query("ptd_cards_count", _cards_sql(
    "count(DISTINCT patron)::DOUBLE", "$business", "start_actual", AS_OF_SQL, "value"))
def ptd_cards_count(spark, sf):
    return cards.value_cards(t.business(spark, sf), "start_actual", AS_OF, "patron", "nunique")


@query("ptd_cards_rows", _cards_sql("count(patron)::DOUBLE", "$business", "start_actual", AS_OF_SQL, "value"))
def ptd_cards_rows(spark, sf):
    return cards.value_cards(t.business(spark, sf), "start_actual", AS_OF, "patron", "count", distinct=False)


EVENT_DAY = datetime(2024, 1, 3, 18)
EVENT_DAY_SQL = "TIMESTAMP '2024-01-03 18:00:00'"


@query("ptd_entities", _cards_sql(
    "count(DISTINCT address)", "$accounts_status", "timestamp_of_first_event", EVENT_DAY_SQL, "entities"))
def ptd_entities(spark, sf):
    return cards.entity_cards(t.accounts_status(spark, sf), "timestamp_of_first_event", EVENT_DAY, "address")


_PAY = {p: s for p, s in (
    ("week", "round(48000.0 * (isodow({d}) - 1) / 7.0, 2)"),
    ("month", "round(48000.0 * (day({d}) // 7 + 1), 2)"),
    ("quarter", "round(48000.0 * ((date_diff('day', CAST(date_trunc('quarter', {d}) AS DATE), CAST({d} AS DATE)) + 1) // 7 + 1), 2)"),
    ("year", "round(48000.0 * week({d}), 2)"))}


@query("ptd_cost_ratio", " UNION ALL ".join(f"""
SELECT '{p}' AS period, count(*) AS rows, CAST(coalesce(sum(watch), 0) AS BIGINT) AS watch,
  round({_PAY[p].format(d="TIMESTAMP '2024-01-24 00:00:00'")} / nullif(sum(watch), 0), 2) AS payroll_per_unit,
  CAST(CAST(round(sum(watch) / nullif(sum(fork), 0), 3) AS DECIMAL(28,3)) AS VARCHAR) AS watch_per_fork,
  CAST(CAST(round(sum(watch) / nullif(sum(push), 0), 3) AS DECIMAL(28,3)) AS VARCHAR) AS watch_per_push
FROM (SELECT DISTINCT timestamp, watch, fork, push FROM $daily)
WHERE timestamp >= {_start_sql(p, "TIMESTAMP '2024-01-24 00:00:00'")} AND timestamp <= TIMESTAMP '2024-01-24 00:00:00'"""
                                     for p in pd_.PERIODS))
def ptd_cost_ratio(spark, sf):
    return cards.cost_cards(t.daily(spark, sf), "timestamp", datetime(2024, 1, 24), "watch", ["fork", "push"])


@query("payroll_to_date", f"""
SELECT o_orderkey, {_PAY['week'].format(d='o_orderdate')} AS week, {_PAY['month'].format(d='o_orderdate')} AS month,
  {_PAY['quarter'].format(d='o_orderdate')} AS quarter, {_PAY['year'].format(d='o_orderdate')} AS year FROM orders""")
def payroll_to_date(spark, sf):
    return t.table(spark, sf, "orders").select(
        "o_orderkey", *[pd_.payroll_to_date(F.col("o_orderdate"), p).alias(p) for p in pd_.PERIODS])


@query("ptd_hierarchy", " UNION ALL ".join(f"""
SELECT '{p}' AS period, (SELECT count(DISTINCT project) FROM w) AS projects,
  (SELECT count(DISTINCT (project, milestone)) FROM w) AS milestones, (SELECT count(task) FROM w) AS tasks,
  (SELECT round(sum(m), 2) FROM (SELECT avg(task_duration) AS m FROM w GROUP BY project)) AS project_days,
  (SELECT round(sum(m), 2) FROM (SELECT avg(task_duration) AS m FROM w GROUP BY project, milestone)) AS task_hours,
  (SELECT CAST(sum(remuneration) AS DOUBLE) FROM w) AS remuneration
FROM (SELECT 1), (SELECT 1) WHERE TRUE""".replace("FROM w", f"FROM (SELECT DISTINCT * FROM $projects WHERE start >= {_start_sql(p)} AND start <= {AS_OF_SQL})")
                                     for p in pd_.PERIODS))
def ptd_hierarchy(spark, sf):
    rows = t.projects(spark, sf).withColumn("solution", F.element_at("solution", 1))
    return cards.hierarchy_cards(rows, "start", AS_OF)


# ---------------------------------------------------------------- periods


@query("period_start", """
SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month,
  CAST(date_trunc('quarter', ts) AS DATE) AS quarter, CAST(date_trunc('year', ts) AS DATE) AS year FROM events""")
def period_start(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", *[pd_.period_start(F.col("ts"), p).alias(p) for p in pd_.PERIODS])


@query("shift_range", """
SELECT o_orderkey, l_linenumber, o_orderdate - INTERVAL 7 DAY AS week_start, l_shipdate - INTERVAL 7 DAY AS week_end,
  o_orderdate - INTERVAL 1 MONTH AS month_start, l_shipdate - INTERVAL 1 MONTH AS month_end,
  o_orderdate - INTERVAL 3 MONTH AS quarter_start, l_shipdate - INTERVAL 3 MONTH AS quarter_end,
  o_orderdate - INTERVAL 1 YEAR AS year_start, l_shipdate - INTERVAL 1 YEAR AS year_end
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def shift_range(spark, sf):
    rows = t.table(spark, sf, "lineitem").join(t.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", "l_linenumber", *[
        pd_.shift(F.col(c), p).alias(f"{p}_{end}")
        for p in pd_.PERIODS for c, end in (("o_orderdate", "start"), ("l_shipdate", "end"))])


@query("dayset", """
SELECT event_id, isodow(ts) - 1 AS week, day(ts) AS month, dayofyear(ts) AS year,
  CAST(ceil(epoch(ts - date_trunc('quarter', ts)) / 86400) AS BIGINT) AS quarter FROM events""")
def dayset(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", *[pd_.day_label(F.col("ts"), p).alias(p) for p in ("week", "month", "year", "quarter")])


# ---------------------------------------------------------------- period over period

WEEK = (date(2024, 1, 22), date(2024, 1, 28))


def _week_rows(columns: str, dayset: str) -> str:
    parts = []
    for k in range(4):
        label = pd_.window_label("week", k)
        parts.append(f"""SELECT {columns}, '{label}' AS period, {dayset} AS dayset FROM $accounts
WHERE CAST(block_timestamp AS DATE) BETWEEN DATE '2024-01-22' - {7 * k} AND DATE '2024-01-28' - {7 * k}""")
    return " UNION ALL ".join(parts)


@query("period_over_period", f"""
WITH r AS ({_week_rows('event_id, address, block_timestamp, amount', 'isodow(block_timestamp) - 1')})
SELECT * FROM r WHERE period LIKE '0 %' OR period IN (SELECT period FROM r GROUP BY 1 HAVING count(*) > 1)""")
def period_over_period(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "address", "block_timestamp", "amount")
    return comparison.period_over_period(rows, "block_timestamp", "week", *WEEK, 4)


_POP = f"""(SELECT dayset, period, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM ({_week_rows('amount', 'isodow(block_timestamp) - 1')}) GROUP BY 1, 2)"""


def _weeks(spark, sf):
    rows = t.accounts(spark, sf).withColumn("amount", t.money("amount"))
    return comparison.compare(rows, "block_timestamp", "week", *WEEK, 4, "amount", "sum").withColumn(
        "amount", F.col("amount").cast("double"))


@query("pop_aggregate", f"SELECT * FROM {_POP}")
def pop_aggregate(spark, sf):
    return _weeks(spark, sf)


@query("pop_distinct", f"""
SELECT dayset, period, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT DISTINCT * FROM (
  {_week_rows("date_trunc('day', block_timestamp) AS moment, address % 7 AS amount", 'isodow(block_timestamp) - 1')})) GROUP BY 1, 2""")
def pop_distinct(spark, sf):
    """Equal rows of a window count once."""
    rows = t.accounts(spark, sf).select(
        F.date_trunc("day", "block_timestamp").cast("timestamp_ntz").alias("moment"), (F.col("address") % 7).alias("amount"))
    return comparison.compare(rows, "moment", "week", *WEEK, 4, "amount", "sum", dedup=True)


@query("period_columns", "SELECT dayset, " + ", ".join(
    f"coalesce(sum(amount) FILTER (period = '{p}'), 0) AS \"{p}\"" for p in comparison.period_labels("week", 5))
    + f" FROM {_POP} GROUP BY 1")
def period_columns(spark, sf):
    return comparison.period_columns(_weeks(spark, sf), "week", 5, "amount")


@query("period_columns_unmerged", "SELECT dayset, period, amount, " + ", ".join(
    f"CASE WHEN period = '{p}' THEN amount ELSE 0 END AS \"{p}\"" for p in comparison.period_labels("week", 4))
    + f" FROM {_POP}")
def period_columns_unmerged(spark, sf):
    return comparison.period_columns(_weeks(spark, sf), "week", 4, "amount", merged=False)


def _quarter_rows() -> str:
    parts = []
    for k in range(4):
        lo, hi = f"DATE '2000-10-02' - INTERVAL {3 * k} MONTH", f"DATE '2000-12-28' - INTERVAL {3 * k} MONTH"
        parts.append(f"""SELECT event, '{pd_.window_label('quarter', k)}' AS period,
  date_diff('day', CAST(date_trunc('quarter', start_actual) AS DATE), CAST(start_actual AS DATE)) AS dayset
  FROM $business WHERE start_actual >= {lo} AND start_actual < {hi} + INTERVAL 1 DAY""")
    return " UNION ALL ".join(parts)


@query("pop_guarded", f"""
WITH g AS (SELECT dayset, period, count(event) AS event FROM ({_quarter_rows()}) GROUP BY 1, 2)
SELECT dayset, """ + ", ".join(
    f"coalesce(sum(event) FILTER (period = '{p}'), 0)::BIGINT AS \"{p}\"" for p in comparison.period_labels("quarter", 4))
    + " FROM g WHERE dayset > (SELECT min(dayset) FROM g) GROUP BY 1")
def pop_guarded(spark, sf):
    return comparison.guarded_comparison(
        t.business(spark, sf), "start_actual", "quarter", date(2000, 10, 2), date(2000, 12, 28), 4, "event", "count",
        initial=date(1995, 1, 1))


@query("card_texts", """
SELECT update_type, '$' || format('{:,.2f}', CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)) AS money,
  CAST(round(100.0 * count(*) / (SELECT count(*) FROM events), 3) AS DOUBLE) || '%' AS percent,
  CAST(round(CAST(count(*) AS DOUBLE) / 24, 2) AS DOUBLE) || ' days' AS days, count(DISTINCT address) || ' accounts' AS counted
FROM $accounts GROUP BY 1""")
def card_texts(spark, sf):
    rows = t.accounts(spark, sf)
    total = rows.agg(F.count(F.lit(1))).scalar()
    sums = rows.groupBy("update_type").agg(
        F.sum(t.money("amount")).cast("double").alias("money"), F.count(F.lit(1)).cast("double").alias("n"),
        F.count_distinct("address").alias("accounts"))
    return sums.select(
        "update_type", cards.card_text("money", F.col("money")).alias("money"),
        cards.card_text("percent", 100 * F.col("n") / total).alias("percent"),
        cards.card_text("days", F.col("n") / 24).alias("days"), cards.card_text("account", F.col("accounts")).alias("counted"))
