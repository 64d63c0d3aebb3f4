"""The business tables, presented from the star-schema files: as frames and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDLE_DAYS = 1  # an account without events for this long, at the end of the data, has churned


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(name: str):
    return F.col(name).cast("string")


def money(name: str):
    return F.col(name).cast("decimal(18,2)")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Account activity without the status, which needs a look at each whole account."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("address"), F.col("ts").alias("block_timestamp"),
        F.col("value").alias("amount"), F.col("event_type").alias("update_type"),
        (F.col("user_id") % 4).alias("account_type"),
        F.get_json_object("props", "$.k").cast("long").alias("block_time"),
    )


def accounts_status(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts with first event and status. Each account's span is one aggregated row joined back."""
    rows = accounts(spark, sf)
    span = rows.groupBy(F.col("address").alias("_a")).agg(
        F.min("block_timestamp").alias("timestamp_of_first_event"), F.max("block_timestamp").alias("_last"))
    newest = rows.agg(F.max("block_timestamp")).scalar()
    first_day = F.to_date("block_timestamp") == F.to_date("timestamp_of_first_event")
    idle = F.col("_last") < newest - F.make_dt_interval(F.lit(IDLE_DAYS))
    status = F.when(first_day, "joined").when(idle, "churned").otherwise("active")
    return rows.join(span, F.col("address") == F.col("_a")).withColumn("status", status).drop("_a", "_last")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    group = F.col("user_id") % 3
    return rows.groupBy(
        F.to_date("ts").cast("timestamp_ntz").alias("timestamp"), F.col("event_type").alias("crypto")
    ).agg(
        F.count_if(group == 0).alias("watch"), F.count_if(group == 1).alias("fork"),
        F.count_if(group == 2).alias("push"), F.avg("value").alias("close"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("volume"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each block lists seven hashes, not all of which were sent."""
    key = F.col("o_orderkey").cast("string")
    hashes = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat_ws("-", key, i.cast("string")))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("block_number"), F.col("o_orderdate").alias("block_timestamp"),
        text("o_custkey").alias("miner_address"), F.col("o_totalprice").alias("difficulty"),
        F.concat(F.lit("["), F.array_join(hashes, ","), F.lit("]")).alias("transaction_hashes"),
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("transaction_hash"),
        F.col("l_shipdate").alias("block_timestamp"), text("l_suppkey").alias("from_addr"),
        text("l_partkey").alias("to_addr"), F.col("l_extendedprice").alias("value"),
        (F.round("l_quantity") * 21).cast("long").alias("nrg_consumed"),
    )


def warehouse(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks joined to the transactions that were sent, with the model features."""
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("block_number"), F.col("l_shipdate").alias("block_timestamp"),
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("transaction_hash"),
        text("o_custkey").alias("miner_address"), text("l_suppkey").alias("from_addr"),
        text("l_partkey").alias("to_addr"), F.col("l_extendedprice").alias("value"),
        (F.round("l_quantity") * 21).cast("long").alias("transaction_nrg_consumed"),
        (F.col("o_custkey") + 1000).alias("block_nrg_consumed"), F.col("o_totalprice").alias("difficulty"),
        (F.col("o_custkey") % 100 + 10000).alias("nrg_limit"), (F.col("o_orderkey") % 1000 + 500).alias("block_size"),
        (F.col("o_orderkey") % 17 + 1).alias("block_time"), (F.col("o_totalprice") / 1000).alias("nrg_reward"),
    )


def pools(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == "MACHINERY").select(
        text("c_custkey").alias("address"), F.col("c_name").alias("poolname"))


def business(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    nations = table(spark, sf, "nation")
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("type"),
            F.col("o_totalprice").alias("rate"), F.col("o_orderdate").alias("start_actual"),
            F.col("o_orderstatus").alias("status"), F.col("c_custkey").alias("patron"),
            F.col("c_acctbal").alias("remuneration"), F.col("c_mktsegment").alias("company"),
            F.col("n_name").alias("patron_parish"),
        )
    )


def rentals(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    gender = F.when(F.col("l_linestatus") == "O", "male").otherwise("female")
    status = F.when(F.col("l_returnflag") == "A", "guest").when(F.col("l_returnflag") == "R", "member").otherwise("none")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("name"), F.col("l_shipdate").alias("visit_start"),
        F.col("l_quantity").alias("visit_duration"), F.col("l_extendedprice").alias("rental_tab"),
        F.col("p_brand").alias("item"), F.col("p_type").alias("category"), F.col("l_returnflag").alias("area"),
        gender.alias("gender"), status.alias("status"), F.col("l_discount").alias("discount"),
        F.col("p_retailprice").alias("price"),
    )


def projects(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("milestone"),
        F.col("l_linenumber").alias("task"), F.col("l_quantity").alias("task_duration"),
        F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("end"),
        money("l_extendedprice").alias("remuneration"), F.array("l_discount", "l_tax").alias("solution"),
        (F.col("l_suppkey") % 5 + 1).alias("severity"),
        (F.floor(F.col("l_suppkey") / 5) % 5 + 1).alias("likelihood"),
        F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("status"),
    )


def risk_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    analyses = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("risk_id"), (F.col("s_suppkey") % 6 + 1).alias("severity"),
        (F.floor(F.col("s_suppkey") / 5) % 6 + 1).alias("likelihood"))
    levels = table(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("_id"), (F.col("r_regionkey") + 1).alias("value"))
    return {
        "matrices": table(spark, sf, "region").select(F.col("r_regionkey").alias("matrix_key"), F.col("r_name").alias("matrix")),
        "risks": table(spark, sf, "nation").select(
            F.col("n_nationkey").alias("risk_key"), F.col("n_name").alias("risk"), F.col("n_regionkey").alias("matrix_id")),
        "analyses": analyses, "severities": levels, "likelihoods": levels,
    }


_RISK_JOINED = """(SELECT r_name AS matrix, n_name AS risk, s_suppkey % 6 + 1 AS severity,
  CAST(floor(s_suppkey / 5) AS BIGINT) % 6 + 1 AS likelihood
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

VIEW_SQL = {
    "accounts_status": f"""(SELECT a.*, f.first_ts AS timestamp_of_first_event,
      CASE WHEN CAST(a.block_timestamp AS DATE) = CAST(f.first_ts AS DATE) THEN 'joined'
           WHEN f.last_ts < (SELECT max(ts) FROM events) - INTERVAL {IDLE_DAYS} DAY THEN 'churned'
           ELSE 'active' END AS status
      FROM $accounts a JOIN (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1) f
      ON a.address = f.user_id)""",
    "accounts": """(SELECT event_id, user_id AS address, ts AS block_timestamp, value AS amount,
      event_type AS update_type, user_id % 4 AS account_type,
      CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS block_time FROM events)""",
    "daily": """(SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS timestamp, event_type AS crypto,
      count(*) FILTER (user_id % 3 = 0) AS watch, count(*) FILTER (user_id % 3 = 1) AS fork,
      count(*) FILTER (user_id % 3 = 2) AS push, avg(value) AS close, max(value) AS high, min(value) AS low,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)""",
    "blocks": """(SELECT o_orderkey AS block_number, o_orderdate AS block_timestamp,
      CAST(o_custkey AS VARCHAR) AS miner_address, o_totalprice AS difficulty FROM orders)""",
    "transactions": """(SELECT l_orderkey || '-' || l_linenumber AS transaction_hash, l_shipdate AS block_timestamp,
      CAST(l_suppkey AS VARCHAR) AS from_addr, CAST(l_partkey AS VARCHAR) AS to_addr, l_extendedprice AS value,
      CAST(round(l_quantity) * 21 AS BIGINT) AS nrg_consumed FROM lineitem)""",
    "warehouse": """(SELECT o_orderkey AS block_number, l_shipdate AS block_timestamp,
      l_orderkey || '-' || l_linenumber AS transaction_hash, CAST(o_custkey AS VARCHAR) AS miner_address,
      CAST(l_suppkey AS VARCHAR) AS from_addr, CAST(l_partkey AS VARCHAR) AS to_addr, l_extendedprice AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "pools": """(SELECT CAST(c_custkey AS VARCHAR) AS address, c_name AS poolname FROM customer
      WHERE c_mktsegment = 'MACHINERY')""",
    "business": """(SELECT o_orderkey AS event, o_orderpriority AS type, o_totalprice AS rate,
      o_orderdate AS start_actual, o_orderstatus AS status, c_custkey AS patron, c_acctbal AS remuneration,
      c_mktsegment AS company, n_name AS patron_parish
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "rentals": """(SELECT l_suppkey AS name, l_shipdate AS visit_start, l_quantity AS visit_duration,
      l_extendedprice AS rental_tab, p_brand AS item, p_type AS category, l_returnflag AS area,
      CASE WHEN l_linestatus = 'O' THEN 'male' ELSE 'female' END AS gender,
      CASE l_returnflag WHEN 'A' THEN 'guest' WHEN 'R' THEN 'member' ELSE 'none' END AS status,
      l_discount AS discount, p_retailprice AS price
      FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "projects": """(SELECT o_custkey AS project, o_orderkey AS milestone, l_linenumber AS task,
      l_quantity AS task_duration, o_orderdate AS start, l_shipdate AS end_,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS remuneration, l_discount AS solution,
      l_suppkey % 5 + 1 AS severity, CAST(floor(l_suppkey / 5) AS BIGINT) % 5 + 1 AS likelihood,
      o_orderpriority AS type, o_orderstatus AS status
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "risk_joined": _RISK_JOINED,
    "risk_rated": f"""(SELECT matrix, risk, CASE WHEN severity > 5 THEN 0 ELSE severity END AS severity,
      CASE WHEN likelihood > 5 THEN 0 ELSE likelihood END AS likelihood FROM {_RISK_JOINED})""",
}
