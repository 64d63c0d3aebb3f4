"""Association tests, miners, projects and risk."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from periodica.operators import association, groups, miners, ordered, projects, risk
from periodica.plans import tables as t
from periodica.plans.registry import query
from periodica.session import shared_folder
from periodica.sources.artifacts import ArtifactStore


def _t_cut(free: str) -> str:
    """The 95 percent quantile of Student's t by its expansion around the normal quantile."""
    z = 1.6448536269514722
    a, b = (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    return f"({z} + {a} / ({free}) + {b} / (({free}) * ({free})))"


def _label_sql(r: str, n: str) -> str:
    return f"""CASE WHEN {r} IS NULL OR isnan({r}) OR abs({r}) * sqrt(({n} - 2) / greatest(1 - {r} * {r}, 1e-300)) <= {_t_cut(f'{n} - 2.0')} THEN 'Not significant'
  WHEN abs({r}) <= 0.25 THEN 'none'
  ELSE (CASE WHEN abs({r}) > 0.65 THEN 'strong' WHEN abs({r}) > 0.4 THEN 'moderate' ELSE 'weak' END) ||
       (CASE WHEN {r} > 0 THEN ' positive' ELSE ' negative' END) END"""


def _pairs_sql(view: str, target: str, features: list[str], where: str = "TRUE") -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{target}' AS variable_1, '{f}' AS variable_2, regr_slope({f}, {target}) AS slope,
  regr_intercept({f}, {target}) AS intercept, corr({f}, {target}) AS r, regr_count({f}, {target}) AS n
  FROM {view} WHERE {where}""" for f in features)
    return f"""SELECT variable_1, variable_2, round(slope, 6) AS slope, round(intercept, 4) AS intercept,
  round(r, 6) AS r, n, {_label_sql('r', 'n')} AS relationship FROM ({parts})"""


def _checked(table):
    return groups.rounded(groups.rounded(table.drop("p_value"), 6, "slope", "r"), 4, "intercept")


RENTAL_FEATURES = ["rental_tab", "discount", "price"]


@query("linear_relationship", _pairs_sql("$rentals", "visit_duration", RENTAL_FEATURES))
def linear_relationship(spark, sf):
    return _checked(association.linear_relationships(t.rentals(spark, sf), "visit_duration", RENTAL_FEATURES))


@query("linear_relationship_p")
def linear_relationship_p(spark, sf):
    """The same with p-values, which SQL cannot state."""
    return association.linear_relationships(t.rentals(spark, sf), "visit_duration", RENTAL_FEATURES)


_DAILY_FEATURES = ["fork", "push", "close", "high", "low", "volume"]


@query("correlation_table", "SELECT variable_1, variable_2, relationship, round(r, 4) AS r FROM ("
       + _pairs_sql("$daily", "watch", _DAILY_FEATURES) + ")")
def correlation_table(spark, sf):
    table = association.linear_relationships(t.daily(spark, sf), "watch", _DAILY_FEATURES)
    return groups.rounded(groups.rounded(table.select("variable_1", "variable_2", "relationship", "r"), 6, "r"), 4, "r")


_LAGGED = """(SELECT amount, block_time, block_time_1, block_time_2 FROM (SELECT amount, block_time,
  lag(block_time, 1) OVER w AS block_time_1, lag(block_time, 2) OVER w AS block_time_2 FROM $accounts
  WINDOW w AS (PARTITION BY address ORDER BY block_timestamp, event_id))
  WHERE block_time_1 IS NOT NULL AND block_time_2 IS NOT NULL)"""


@query("lag_correlation", "SELECT variable_1, variable_2, coalesce(nullif(regexp_extract(variable_2, '_([0-9]+)$', 1), ''), 'None') AS lag, "
       "relationship, r FROM (" + _pairs_sql(_LAGGED, "amount", ["block_time", "block_time_1", "block_time_2"]) + ")")
def lag_correlation(spark, sf):
    rows = t.accounts(spark, sf).select("event_id", "address", "block_timestamp", "amount", "block_time")
    lags = {f"block_time_{k}": ("block_time", k) for k in (1, 2)}
    lagged = ordered.lag_columns(rows, lags, "block_timestamp", "event_id", keys="address")
    table = association.lag_relationships(lagged, "amount", ["block_time", *lags])
    return groups.rounded(table.select("variable_1", "variable_2", "lag", "relationship", "r"), 6, "r")


@query("significant_features", "SELECT variable_1, variable_2, relationship FROM ("
       + _pairs_sql("$daily", "watch", _DAILY_FEATURES)
       + ") WHERE relationship LIKE 'weak%' OR relationship LIKE 'moderate%' OR relationship LIKE 'strong%'")
def significant_features(spark, sf):
    table = association.linear_relationships(t.daily(spark, sf), "watch", _DAILY_FEATURES)
    return association.significant_features(table).select("variable_1", "variable_2", "relationship")


@query("significant_columns", "SELECT coin || '_' || variable_2 AS name, variable_2 AS feature FROM (" + _pairs_sql("$daily", "watch", _DAILY_FEATURES)
       + "), (SELECT DISTINCT crypto AS coin FROM $daily) WHERE relationship <> 'none' AND relationship <> 'Not significant'")
def significant_columns(spark, sf):
    """Saved features of one target, matched by name to the columns of a table with one column per coin and measure."""
    rows = t.daily(spark, sf)
    store, now = ArtifactStore(spark, shared_folder(spark, "features")), datetime(2024, 2, 1)
    key = "adoption_features:developer-watch"
    association.save_significant(store, association.linear_relationships(rows, "watch", _DAILY_FEATURES), key, now)
    features = association.load_significant(store, key, now)
    wide = rows.groupBy("timestamp").pivot("crypto").agg(*[F.first(c).alias(c) for c in ["watch", *_DAILY_FEATURES]])
    found = [(c, f) for f in features for c in association.matching_columns(wide.columns, [f])]
    return spark.createDataFrame(found, "name string, feature string")


def _u_sql(view: str, target: str, features: list[str]) -> str:
    parts = []
    for f in features:
        parts.append(f"""SELECT '{target}' AS variable_1, '{f}' AS variable_2, stat,
  CASE WHEN greatest((greatest(stat, n1 * n2 - stat) - n1 * n2 / 2.0 - 0.5) /
    sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) > 1.6448536269514722 THEN 'No' ELSE 'Yes' END AS relationship
FROM (SELECT sum(rnk) FILTER (a = 1) - n1 * (n1 + 1) / 2 AS stat, n1, n2, sum(CAST(c AS DOUBLE) * c - 1) AS ties
  FROM (SELECT a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rnk,
          count(*) OVER (PARTITION BY v) AS c, CAST(sum(a) OVER () AS DOUBLE) AS n1,
          CAST(sum(1 - a) OVER () AS DOUBLE) AS n2
        FROM (SELECT CAST({target} AS DOUBLE) AS v, 1 AS a FROM {view} UNION ALL SELECT CAST({f} AS DOUBLE), 0 FROM {view}))
  GROUP BY n1, n2)""")
    return " UNION ALL ".join(parts)


@query("mann_whitney", _u_sql("$rentals", "rental_tab", ["price", "visit_duration"]))
def mann_whitney(spark, sf):
    table = association.mann_whitney(t.rentals(spark, sf), "rental_tab", ["price", "visit_duration"])
    return table.select("variable_1", "variable_2", "stat", "relationship")


@query("mann_whitney_daily", _u_sql("$daily", "watch", ["fork", "push", "close"]))
def mann_whitney_daily(spark, sf):
    table = association.mann_whitney(t.daily(spark, sf), "watch", ["fork", "push", "close"])
    return table.select("variable_1", "variable_2", "stat", "relationship")


_SMALL = "SELECT n_regionkey AS g, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_regionkey"


@query("mann_whitney_small", f"""
WITH s AS ({_SMALL}), p AS (
  SELECT b.g, count(*) FILTER (WHERE a.v > b.v) AS u, count(DISTINCT a.v) AS n1, count(DISTINCT b.v) AS n2 FROM s a, s b WHERE a.g = 0 AND b.g > 0 GROUP BY b.g),
w AS (SELECT n1, n2, g, u, list_sum(list_transform(range(n1 + n2), lambda k: (m >> k & 1) * k)) - n1 * (n1 - 1) // 2 AS x
  FROM p, range(1 << 16) AS r(m) WHERE m < 1 << (n1 + n2) AND bit_count(m) = n1)
SELECT 'region_0' AS variable_1, 'region_' || g AS variable_2, CAST(u AS DOUBLE) AS stat, 'exact' AS method,
  round(least(1.0, 2.0 * count(*) FILTER (WHERE x >= greatest(u, n1 * n2 - u)) / count(*)), 9) AS p_value FROM w GROUP BY g, u, n1, n2""")
def mann_whitney_small(spark, sf):
    """Mean balances of the nations of a region against those of another one: five values a side, without ties."""
    rows = t.table(spark, sf, "customer").join(t.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "n_nationkey", "n_regionkey").agg(F.avg("c_acctbal").alias("v"))
    wide = rows.select(*(F.when(F.col("n_regionkey") == g, F.col("v")).alias(f"region_{g}") for g in range(5)))
    table = association.mann_whitney(wide, "region_0", [f"region_{g}" for g in range(1, 5)])
    return groups.rounded(table.select("variable_1", "variable_2", "stat", "method", "p_value"), 9, "p_value")


# 95 percent quantiles of chi-square by degrees of freedom.
_CHI2 = "CASE levels - 1 WHEN 1 THEN 3.8414588 WHEN 2 THEN 5.9914645 WHEN 4 THEN 9.4877290 WHEN 24 THEN 36.4150285 END"


def _h_sql(pairs: list[tuple[str, str, str, str]]) -> str:
    parts = []
    for outcome, treatment, v, source in pairs:
        parts.append(f"""SELECT '{outcome}' AS variable_1, '{treatment}' AS variable_2,
  (12.0 / (n * (n + 1)) * sum(r * r / c) - 3 * (n + 1)) / (1 - sum(ties) / (n * n * n - n)) AS stat, count(*) AS levels
FROM (SELECT level, sum(rnk) AS r, CAST(count(*) AS DOUBLE) AS c, n, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM (
  SELECT level, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rnk, count(*) OVER (PARTITION BY v) AS t,
    CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT {treatment} AS level, {v} AS v FROM {source})) GROUP BY level, n) GROUP BY n""")
    return f"""SELECT variable_1, variable_2, round(stat, 4) AS stat,
  CASE WHEN stat >= {_CHI2} THEN 'Yes' ELSE 'No' END AS relationship FROM ({' UNION ALL '.join(parts)})"""


_TREATMENTS = ["type", "company", "patron_parish", "status"]


@query("kruskal", _h_sql(
    [(o, tr, o, "$business") for o in ("rate", "remuneration") for tr in _TREATMENTS]
    + [("patron", tr, "v", f"(SELECT {tr}, count(DISTINCT patron) AS v FROM $business GROUP BY 1)") for tr in _TREATMENTS]))
def kruskal(spark, sf):
    table = association.kruskal(
        t.business(spark, sf), ["rate", "remuneration", "patron"], _TREATMENTS, counted=["patron"])
    return groups.rounded(table.select("variable_1", "variable_2", "stat", "relationship"), 4, "stat")


@query("kruskal_missing_levels", _h_sql([
    (o, tr, "v", f"(SELECT CASE WHEN rate > 1000 * (patron % 97 + 1) THEN {tr} END AS {tr}, {o} AS v FROM $business "
     f"WHERE rate > 1000 * (patron % 97 + 1) AND {o} IS NOT NULL)") for o in ("rate", "remuneration") for tr in ("type", "company")]))
def kruskal_missing_levels(spark, sf):
    """Levels are missing in a part of the rows; those take no part in the ranks."""
    known = F.col("rate") > 1000 * (F.col("patron") % 97 + 1)
    rows = t.business(spark, sf).withColumns({c: F.when(known, F.col(c)) for c in ("type", "company")})
    table = association.kruskal(rows, ["rate", "remuneration"], ["type", "company"])
    return groups.rounded(table.select("variable_1", "variable_2", "stat", "relationship"), 4, "stat")


def _bin(c: str) -> str:
    return f"""CAST(least(floor(({c} - (SELECT min({c}) FROM $rentals)) /
  (SELECT (max({c}) - min({c})) / 10 FROM $rentals)), 9) AS INTEGER)"""


def _mi_sql(target: str, feature: str) -> str:
    return f"""SELECT '{target}' AS variable_1, '{feature}' AS variable_2, sum(c / n * ln(c * n / (nx * ny))) AS stat FROM (
  SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY x) AS nx, sum(c) OVER (PARTITION BY y) AS ny FROM (
    SELECT {_bin(target)} AS x, {_bin(feature)} AS y, CAST(count(*) AS DOUBLE) AS c FROM $rentals GROUP BY 1, 2))"""


@query("mutual_information", "SELECT variable_1, variable_2, round(stat, 6) AS stat, CASE WHEN abs(stat) > 0.65 THEN 'strong' "
       "WHEN abs(stat) > 0.4 THEN 'moderate' WHEN abs(stat) > 0.25 THEN 'weak' ELSE 'None' END AS relationship FROM ("
       + " UNION ALL ".join(_mi_sql("visit_duration", f) for f in ("rental_tab", "price")) + ")")
def mutual_information(spark, sf):
    table = association.mutual_information(t.rentals(spark, sf), "visit_duration", ["rental_tab", "price"])
    return groups.rounded(table, 6, "stat")


@query("mutual_information_odd_values", """
WITH r AS (SELECT visit_duration, rental_tab FROM $rentals WHERE visit_duration % 7 <> 3 AND visit_duration % 7 <> 4)
SELECT variable_1, variable_2, round(stat, 6) AS stat, CASE WHEN abs(stat) > 0.65 THEN 'strong' WHEN abs(stat) > 0.4 THEN 'moderate'
  WHEN abs(stat) > 0.25 THEN 'weak' ELSE 'None' END AS relationship FROM (""" + _mi_sql("visit_duration", "rental_tab").replace(
    _bin("visit_duration"), _bin("visit_duration").replace("$rentals", "r")).replace("FROM $rentals GROUP", "FROM r GROUP") + ")")
def mutual_information_odd_values(spark, sf):
    """A NaN, an infinity or a null in a pair leaves the other pairs as they are."""
    table = association.mutual_information(_odd_rentals(spark, sf), "visit_duration", ["rental_tab"])
    return groups.rounded(table, 6, "stat")


def _odd_rentals(spark, sf):
    rows, kind = t.rentals(spark, sf), F.col("visit_duration") % 7
    odd = F.when(kind == 3, F.lit(float("nan"))).when(kind == 4, F.lit(float("inf"))).otherwise(F.col("visit_duration").cast("double"))
    return rows.withColumn("visit_duration", odd).withColumn("rental_tab", F.col("rental_tab").cast("double")).withColumn(
        "nothing", F.lit(None).cast("double"))


# ---------------------------------------------------------------- miners

SPAN = (date(1995, 1, 1), date(1995, 4, 11))  # 100 days of thresholds


@query("tier1_paid_out", """
SELECT from_addr AS address, count(to_addr) AS n FROM $warehouse GROUP BY 1 HAVING count(to_addr) >= 6 * 100""")
def tier1_paid_out(spark, sf):
    return miners.paid_out(t.warehouse(spark, sf), miners.span_days(*SPAN), 6)


@query("tier1_blocks", """
SELECT miner_address AS address, count(block_number) AS n FROM $warehouse GROUP BY 1
HAVING count(block_number) >= 0.005 * 100 * 8640 / 100""")
def tier1_blocks(spark, sf):
    return miners.blocks_mined(t.warehouse(spark, sf), miners.span_days(*SPAN), 0.005)


_TIER1 = """(SELECT from_addr AS address FROM $warehouse GROUP BY 1 HAVING count(to_addr) >= 6 * 100
UNION SELECT miner_address FROM $warehouse GROUP BY 1 HAVING count(block_number) >= 0.006 * 100 * 8640 / 100)"""


@query("tier1", f"SELECT address FROM {_TIER1}")
def tier1(spark, sf):
    return miners.tier1(t.warehouse(spark, sf), *SPAN, paid=6, mined=0.006)


@query("tier2", f"""
SELECT to_addr AS address FROM $warehouse WHERE from_addr IN (SELECT address FROM {_TIER1})
GROUP BY 1 HAVING count(from_addr) >= 0.2 * 100""")
def tier2(spark, sf):
    rows = t.warehouse(spark, sf)
    return miners.tier2(rows, miners.tier1(rows, *SPAN, paid=6, mined=0.006), *SPAN, received=0.2)


# ---------------------------------------------------------------- projects

_LINKS = """(SELECT source, target, CAST(greatest(floor(v / total * 1000), 1) AS BIGINT) AS value FROM (
  SELECT patron_parish AS source, company AS target, CAST(sum(CAST(rate AS DECIMAL(18,2))) AS DOUBLE) AS v FROM $business GROUP BY 1, 2),
  (SELECT CAST(sum(CAST(rate AS DECIMAL(18,2))) AS DOUBLE) AS total FROM $business))"""


@query("flow_links", f"SELECT * FROM {_LINKS} WHERE value >= (SELECT quantile_cont(value, 0.75) FROM {_LINKS})")
def flow_links(spark, sf):
    rows = t.business(spark, sf).withColumn("rate", t.money("rate"))
    return projects.flow_links(rows, "patron_parish", "company", "rate")


@query("flow_nodes", """
SELECT patron, type, row_number() OVER (ORDER BY md5(CAST(patron AS VARCHAR)), patron) - 1 AS index
FROM (SELECT patron, min(company) AS type FROM $business GROUP BY 1)""")
def flow_nodes(spark, sf):
    return projects.flow_nodes(t.business(spark, sf), "patron", "company")


@query("timeline_spans", """
SELECT project, item, start, end_ AS "end", round(rn - 0.4, 1) AS low, round(rn + 0.4, 1) AS high FROM (
  SELECT project, milestone AS item, min(start) AS start, max(end_) AS end_,
    row_number() OVER (PARTITION BY project ORDER BY milestone) AS rn FROM $projects GROUP BY 1, 2)""")
def timeline_spans(spark, sf):
    out = projects.timeline(t.projects(spark, sf), ["project"], "milestone", "start", "end")
    return groups.rounded(out, 1, "low", "high")


@query("timeline_all", """
WITH b AS (SELECT project, milestone AS item, min(start) AS start, max(end_) AS end_, 'milestone' AS type FROM $projects GROUP BY 1, 2
  UNION ALL SELECT project, CAST(task AS BIGINT), min(start), max(end_), 'task' FROM $projects GROUP BY 1, 2)
SELECT project, item, start, end_ AS "end", type, CASE WHEN type = 'milestone' THEN 'black' ELSE 'green' END AS color,
  round(rn - 0.4, 1) AS low, round(rn + 0.4, 1) AS high FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY start, item * 2 + CASE WHEN type = 'task' THEN 1 ELSE 0 END) AS rn FROM b)""")
def timeline_all(spark, sf):
    out = projects.timeline_all(t.projects(spark, sf), ["project"], "milestone", "task", "start", "end", "start", "end")
    return groups.rounded(out, 1, "low", "high")


_NAMED = "(SELECT *, type || ' ' || milestone AS name, status || task AS step FROM $projects)"


def _named(spark, sf):
    return t.projects(spark, sf).withColumn("name", F.concat_ws(" ", "type", "milestone")).withColumn("step", F.concat("status", "task"))


@query("timeline_names", f"""
SELECT project, item, start, end_ AS "end", round(rn - 0.4, 1) AS low, round(rn + 0.4, 1) AS high FROM (
  SELECT project, name AS item, min(start) AS start, max(end_) AS end_,
    row_number() OVER (PARTITION BY project ORDER BY name) AS rn FROM {_NAMED} GROUP BY 1, 2)""")
def timeline_names(spark, sf):
    return groups.rounded(projects.timeline(_named(spark, sf), ["project"], "name", "start", "end"), 1, "low", "high")


@query("timeline_all_names", f"""
WITH b AS (SELECT project, name AS item, min(start) AS start, max(end_) AS end_, 'milestone' AS type FROM {_NAMED} GROUP BY 1, 2
  UNION ALL SELECT project, step, min(start), max(end_), 'task' FROM {_NAMED} GROUP BY 1, 2)
SELECT project, item, start, end_ AS "end", type, CASE WHEN type = 'milestone' THEN 'black' ELSE 'green' END AS color,
  round(rn - 0.4, 1) AS low, round(rn + 0.4, 1) AS high FROM (
  SELECT *, row_number() OVER (PARTITION BY project ORDER BY start, item, type) AS rn FROM b)""")
def timeline_all_names(spark, sf):
    out = projects.timeline_all(_named(spark, sf), ["project"], "name", "step", "start", "end", "start", "end")
    return groups.rounded(out, 1, "low", "high")


# ---------------------------------------------------------------- risk


def _rated(spark, sf):
    r = t.risk_tables(spark, sf)
    joined = risk.joined_risks(r["matrices"], r["risks"], r["analyses"])
    return risk.rated_risks(joined, r["severities"], r["likelihoods"])


@query("risk_action", """
SELECT matrix, risk, round(avg(severity), 6) AS severity, round(avg(likelihood), 6) AS likelihood,
  round(avg(severity) * avg(likelihood), 6) AS composite,
  CASE WHEN avg(severity) * avg(likelihood) < 8 THEN 'Proceed (risk is acceptable)'
       WHEN avg(severity) * avg(likelihood) < 15 THEN 'Proceed, if no other options are available'
       ELSE 'Do no proceed (Risk unacceptable)' END AS action
FROM $risk_rated GROUP BY 1, 2""")
def risk_action(spark, sf):
    return groups.rounded(risk.risk_actions(_rated(spark, sf)), 6, "severity", "likelihood", "composite")


@query("risk_matrix", """
SELECT matrix, risk, ['Insignificant', 'Minor', 'Moderate', 'Critical', 'Catastrophic'][p] AS severity, """ + ", ".join(
    f"CASE WHEN s = p AND l = {j} THEN 'BINGO ' || (p * {j}) ELSE CAST(p * {j} AS VARCHAR) END AS {name.lower()}"
    for j, name in enumerate(risk.LIKELIHOODS, start=1)) + """
FROM (SELECT matrix, risk, floor(avg(severity)) AS s, floor(avg(likelihood)) AS l, unnest([1, 2, 3, 4, 5]) AS p
  FROM $risk_rated GROUP BY 1, 2)""")
def risk_matrix(spark, sf):
    return risk.risk_grid(_rated(spark, sf))


@query("project_means", """
SELECT project, round(avg(severity), 6) AS severity, round(avg(likelihood), 6) AS likelihood,
  round(avg(solution * 10), 6) AS solution, round(avg(likelihood) * avg(severity), 6) AS composite FROM $projects GROUP BY 1""")
def project_means(spark, sf):
    return groups.rounded(risk.project_ratings(t.projects(spark, sf)), 6, "severity", "likelihood", "solution", "composite")


@query("risk_correlation", "SELECT variable_1, variable_2, round(r, 5) AS r, n FROM (" + _pairs_sql(
    "(SELECT avg(severity) AS severity, avg(likelihood) AS likelihood, avg(solution * 10) AS solution, "
    "avg(likelihood) * avg(severity) AS composite FROM $projects GROUP BY project)",
    "solution", ["composite", "severity", "likelihood"]) + ")")
def risk_correlation(spark, sf):
    table = risk.solution_relationships(t.projects(spark, sf))
    return groups.rounded(groups.rounded(table.select("variable_1", "variable_2", "r", "n"), 6, "r"), 5, "r")
