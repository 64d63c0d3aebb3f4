"""Churn models, clusters and forecasts; what SQL can know of them has queries of its own."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from periodica.operators import clusters as cl
from periodica.operators import forecast as fc
from periodica.operators import forest, groups, miners, models, svm
from periodica.operators.filters import label_by_list
from periodica.operators.resample import cluster_series
from periodica.plans import tables as t
from periodica.plans.registry import query
from periodica.plans.relations import SPAN
from periodica.session import file_state, materialise, shared_folder
from periodica.sources.artifacts import ArtifactStore

# Trees of the miner forest grow until their leaves are pure.
MINER_DEPTH = 30
ACCOUNT_FEATURES = {"amount": "mean", "block_time": "mean", "account_type": "mean"}
# The features of the miner forest.
MINER_FEATURES = {
    c: "mean" for c in ("value", "block_nrg_consumed", "transaction_nrg_consumed", "difficulty", "nrg_limit",
                        "block_size", "block_time", "nrg_reward")
}


def _account_rows(spark, sf):
    """Mean features per account and status, without the first day of each account; label 1 is churned."""
    rows = t.accounts_status(spark, sf).where("status <> 'joined'")
    rows = rows.withColumn("amount", F.col("amount").cast("double"))
    features = models.entity_features(rows, ["address", "status"], ACCOUNT_FEATURES)
    labelled = features.withColumn("churned", (F.col("status") == "churned").cast("int"))
    return materialise(labelled, "accounts")  # both parts, and every look at them, read these rows again


_FITTED: dict[tuple, tuple] = {}


def _account_model(spark, sf):
    """(forest, training rows, test rows). The forest of a table is trained once in an application, unless its files change."""
    keys = ["address", "status"]
    train, test = models.split_rows(_account_rows(spark, sf), keys, "churned")
    name = (spark.sparkContext.applicationId, file_state(spark, f"{sf}/events.parquet"))
    if name not in _FITTED:
        features = models.usable_features(train, list(ACCOUNT_FEATURES))
        _FITTED[name] = forest.fit(train, keys, features, "churned")
    return _FITTED[name], train, test


_ACCOUNT_PARTS = """(SELECT *, d < 7000 OR row_number() OVER (PARTITION BY churned ORDER BY d, address, status) = 1 AS train FROM (
  SELECT address, status, CASE WHEN status = 'churned' THEN 1 ELSE 0 END AS churned,
    CAST('0x' || substr(md5(concat_ws('|', address, status)), 1, 8) AS BIGINT) % 10000 AS d
  FROM $accounts_status WHERE status <> 'joined' GROUP BY 1, 2))"""


@query("churn_split", f"""
SELECT churned, train, count(*) AS n, min(address) AS first, max(address) AS last FROM {_ACCOUNT_PARTS} GROUP BY 1, 2""")
def churn_split(spark, sf):
    """Class sizes of the training and the test part."""
    parts = models.split_rows(_account_rows(spark, sf), ["address", "status"], "churned")
    both = parts[0].withColumn("train", F.lit(True)).unionByName(parts[1].withColumn("train", F.lit(False)))
    return both.groupBy("churned", "train").agg(
        F.count("*").alias("n"), F.min("address").alias("first"), F.max("address").alias("last"))


@query("churn_support", f"SELECT churned AS class, count(*) AS support FROM {_ACCOUNT_PARTS} WHERE NOT train GROUP BY 1")
def churn_support(spark, sf):
    """Rows of each class that the forest is judged by; every test row has one prediction."""
    model, _, test = _account_model(spark, sf)
    return models.class_report(forest.score(test, model), "churned").where("support > 0").select(
        "class", F.col("support").cast("long").alias("support"))


_USED = f"""(SELECT f FROM (
  SELECT unnest(['amount', 'block_time', 'account_type']) AS f, unnest([max(a), max(b), max(c)]) AS used FROM (
    SELECT avg(amount) <> 0 AS a, avg(block_time) <> 0 AS b, avg(account_type) <> 0 AS c FROM $accounts_status s
    JOIN {_ACCOUNT_PARTS} p ON s.address = p.address AND s.status = p.status WHERE p.train GROUP BY s.address, s.status)) WHERE used)"""


@query("importance_total", f"SELECT 'churned' AS outcome, count(*) AS features, CAST(1 AS DOUBLE) AS total FROM {_USED}")
def importance_total(spark, sf):
    """Importances of the used features add up to one."""
    model, _, _ = _account_model(spark, sf)
    table = spark.createDataFrame(list(zip(model.features, forest.importances(model))), "feature string, importance double")
    return table.agg(F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total")).withColumn("outcome", F.lit("churned"))


@query("feature_rank_order", f"SELECT count(*) AS features, count(*) AS ranks, CAST(0 AS BIGINT) AS out_of_order FROM {_USED}")
def feature_rank_order(spark, sf):
    """Ranks are 1 to n, each once, and no feature stands behind one that matters less."""
    model, _, _ = _account_model(spark, sf)
    table = models.importance_table(spark, model, "churned")
    order = Window.partitionBy("outcome").orderBy("rank_within_outcome")
    later = table.withColumn("before", F.lag("importance").over(order))
    inside = F.col("rank_within_outcome").between(1, len(model.features))
    return later.agg(
        F.count("*").alias("features"), F.count_distinct(F.when(inside, F.col("rank_within_outcome"))).alias("ranks"),
        F.count_if(F.col("importance") > F.col("before")).alias("out_of_order"))


# The bag of a tree holds a row as often as a Poisson draw says: the draw is the row's own number times a factor of the tree.
_BAG = f"""(SELECT churned, tree, list_sum(list_transform({forest.poisson_steps()}, lambda c: CASE WHEN u >= c THEN 1 ELSE 0 END)) AS w FROM (
  SELECT churned, tree, x * factor % {forest.PRIME} / {forest.PRIME}.0 AS u FROM (
    SELECT churned, CAST('0x' || substr(md5(concat_ws('|', address, status)), 9, 8) AS BIGINT) % {forest.PRIME - 1} + 1 AS x FROM {_ACCOUNT_PARTS} WHERE train),
    (SELECT unnest(range(100)) AS tree, unnest({forest.tree_factors(100)}) AS factor)))"""


@query("forest_bags", f"""
WITH b AS (SELECT tree, churned, CAST(sum(w) AS BIGINT) AS n FROM {_BAG} GROUP BY 1, 2),
c AS (SELECT churned, count(*) AS c FROM {_ACCOUNT_PARTS} WHERE train GROUP BY 1),
s AS (SELECT tree, sum(n) AS rows, sum(n * t / (k * c)) AS total, sum(power(n * t / (k * c), 2)) AS squares
  FROM b JOIN c USING (churned), (SELECT CAST(sum(c) AS DOUBLE) AS t, count(*) AS k FROM c) GROUP BY tree)
SELECT CAST(tree AS INTEGER) AS tree, CAST(rows AS BIGINT) AS rows, round(1 - squares / (total * total), 9) AS impurity FROM s""")
def forest_bags(spark, sf):
    """Each tree's root: the rows in its bag, and their Gini impurity with balanced classes before the first split."""
    model, _, _ = _account_model(spark, sf)
    return groups.rounded(forest.nodes_table(spark, model).where("node = 1").select("tree", "rows", "impurity"), 9, "impurity")


@query("forest_agreement", f"SELECT count(*) AS tested, CAST(0 AS BIGINT) AS different FROM {_ACCOUNT_PARTS} WHERE NOT train")
def forest_agreement(spark, sf):
    """Test rows for which the forest as columns and the walk through its nodes give different votes or classes."""
    model, _, test = _account_model(spark, sf)
    both = forest.score_columns(forest.score(test, model).withColumnsRenamed({"votes": "walked", "prediction": "told"}), model)
    return both.agg(F.count("*").alias("tested"), F.count_if((F.col("walked") != F.col("votes")) | (F.col("told") != F.col("prediction"))).alias("different"))


@query("churn_forest")
def churn_forest(spark, sf):
    model, _, test = _account_model(spark, sf)
    return models.confusion(forest.score(test, model), "churned")


@query("accuracy_table")
def accuracy_table(spark, sf):
    model, _, test = _account_model(spark, sf)
    return models.accuracy_table(forest.score(test, model), "churned", "churned")


@query("accuracy_cells", f"SELECT 'churned' AS outcome, count(*) AS tested, true AS same FROM {_ACCOUNT_PARTS} WHERE NOT train")
def accuracy_cells(spark, sf):
    """The accuracy is the share of the two cells of the confusion table on its diagonal, which cover all test rows."""
    model, _, test = _account_model(spark, sf)
    scored = forest.score(test, model)
    cells = models.confusion(scored, "churned").agg(
        F.sum("n").alias("tested"), F.round(100 * F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("share"))
    told = models.accuracy_table(scored, "churned", "churned")
    return told.select("outcome", F.lit(cells.select("tested").scalar()).alias("tested"), (F.col("accuracy") == cells.select("share").scalar()).alias("same"))


@query("churn_score")
def churn_score(spark, sf):
    model, _, _ = _account_model(spark, sf)
    window = t.accounts(spark, sf).where("block_timestamp >= TIMESTAMP_NTZ'2024-01-20'")
    features = models.entity_features(window, ["address"], ACCOUNT_FEATURES)
    labelled, share = models.score_entities(model, features, "address")
    return labelled.withColumn("percent_to_churn", share.scalar())


@query("churn_score_rows", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS accounts, true AS same FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def churn_score_rows(spark, sf):
    """One action per account of the window; the percentage is the share of accounts told to churn."""
    table = churn_score(spark, sf)
    share = F.round(100 * F.count_if(F.col("likely_action") == "churn") / F.count("*"), 1)
    return table.agg(F.count_distinct("address").alias("accounts"), (
        (share == F.max("percent_to_churn")) & (F.count("*") == F.count_distinct("address"))).alias("same"))


@query("feature_importance")
def feature_importance(spark, sf):
    model, _, _ = _account_model(spark, sf)
    return models.importance_table(spark, model, "churned")


@query("feature_rank")
def feature_rank(spark, sf):
    model, _, _ = _account_model(spark, sf)
    return models.importance_table(spark, model, "churned").select("feature", "rank_within_outcome")


@query("tree_rules")
def tree_rules(spark, sf):
    model, _, _ = _account_model(spark, sf)
    return forest.rules(spark, model)


@query("forest_nodes", f"SELECT CAST(100 AS BIGINT) AS trees, CAST(100 AS BIGINT) AS extra_leaves, CAST(0 AS BIGINT) AS wrong_rows FROM (SELECT count(*) AS n FROM {_USED}) WHERE n > 0")
def forest_nodes(spark, sf):
    """The table of nodes is a forest: a tree has one leaf more than splits, and the rows of a node are those of its children."""
    model, _, _ = _account_model(spark, sf)
    nodes = forest.nodes_table(spark, model)
    below = nodes.select("tree", F.floor(F.col("node") / 2).alias("node"), F.col("rows").alias("r")).groupBy("tree", "node").agg(F.sum("r").alias("below"))
    joined = nodes.join(below, ["tree", "node"], "left")
    return joined.agg(
        F.count_distinct("tree").alias("trees"), (F.count_if(F.col("feature").isNull()) - F.count_if(F.col("feature").isNotNull())).alias("extra_leaves"),
        F.count_if(F.col("feature").isNotNull() & (F.col("rows") != F.coalesce("below", F.lit(0)))).alias("wrong_rows"))


def _miner_rows(spark, sf):
    """Mean features per paying address; tier 1 addresses with little value at the end count as churned."""
    rows = t.warehouse(spark, sf)
    late = rows.groupBy("from_addr").agg(
        F.avg(F.when(F.col("block_timestamp") >= F.lit("2000-01-01").cast("timestamp_ntz"), F.col("value"))).alias("late"),
        F.avg("value").alias("all"))
    churned = late.where(F.col("late").isNull() | (F.col("late") < F.col("all"))).select("from_addr")
    names = miners.tier1(rows, *SPAN, paid=0.1, mined=1.0).select(F.col("address").alias("_m"))
    kept = rows.join(names, F.col("from_addr") == F.col("_m"), "left_semi")
    features = models.entity_features(kept, ["from_addr"], MINER_FEATURES)
    return label_by_list(features, "from_addr", churned, "from_addr")


def _miner_split(spark, sf):
    rows = materialise(_miner_rows(spark, sf), "miners")  # one row per address, read for both parts and every round
    return models.split_rows(rows, ["from_addr"], "churned")


def _miner_forest(spark, sf):
    train, test = _miner_split(spark, sf)
    return forest.score(test, forest.fit(train, ["from_addr"], list(MINER_FEATURES), "churned", trees=200, depth=MINER_DEPTH, impute=False))


_MINER_PARTS = """(SELECT *, d < 7000 OR row_number() OVER (PARTITION BY churned ORDER BY d, from_addr) = 1 AS train FROM (
  SELECT from_addr, CAST('0x' || substr(md5(from_addr), 1, 8) AS BIGINT) % 10000 AS d,
    CASE WHEN late IS NULL OR late < everything THEN 1 ELSE 0 END AS churned FROM (
    SELECT from_addr, avg(value) FILTER (WHERE block_timestamp >= TIMESTAMP '2000-01-01') AS late, avg(value) AS everything FROM $warehouse GROUP BY 1)
  WHERE from_addr IN (SELECT from_addr FROM $warehouse GROUP BY 1 HAVING count(to_addr) >= 0.1 * 100
    UNION SELECT miner_address FROM $warehouse GROUP BY 1 HAVING count(block_number) >= 100 * 8640 / 100.0)))"""


@query("churn_forest_miner")
def churn_forest_miner(spark, sf):
    return models.confusion(_miner_forest(spark, sf), "churned")


@query("churn_support_miner", f"SELECT churned AS class, count(*) AS support FROM {_MINER_PARTS} WHERE NOT train GROUP BY 1")
def churn_support_miner(spark, sf):
    """Rows of each class that the forest of the miners is judged by."""
    return models.class_report(_miner_forest(spark, sf), "churned").where("support > 0").select("class", F.col("support").cast("long").alias("support"))


@query("churn_report_miner")
def churn_report_miner(spark, sf):
    """Precision, recall, F1 and support of each class, with the accuracy in percent."""
    scored = _miner_forest(spark, sf)
    accuracy = models.accuracy_table(scored, "churned", "churned").select("accuracy")
    return models.class_report(scored, "churned").withColumn("accuracy", accuracy.scalar())


def _miner_svm(spark, sf):
    train, test = _miner_split(spark, sf)
    return svm.fit(train, list(MINER_FEATURES), "churned"), test


@query("churn_svm")
def churn_svm(spark, sf):
    model, test = _miner_svm(spark, sf)
    return models.class_report(svm.score(test, model), "churned")


@query("churn_svm_gap", f"SELECT churned AS class, count(*) AS support, true AS certified FROM {_MINER_PARTS} WHERE NOT train GROUP BY 1")
def churn_svm_gap(spark, sf):
    """The class sizes of the test rows, and whether the gap between the two costs is at most a millionth."""
    model, test = _miner_svm(spark, sf)
    report = models.class_report(svm.score(test, model), "churned").where("support > 0")
    return report.select("class", F.col("support").cast("long").alias("support"), F.lit(0 <= model.gap + 1e-9 and model.gap <= 1e-6 * max(1.0, model.primal)).alias("certified"))


CLUSTER_FEATURES = {"amount": "sum", "block_time": "mean", "event_id": "count"}


def _members(spark, sf):
    features = models.entity_features(t.accounts(spark, sf), ["address"], CLUSTER_FEATURES)
    return cl.standardised(features, list(CLUSTER_FEATURES))


@query("kmeans_gap")
def kmeans_gap(spark, sf):
    gaps = cl.gap_statistic(_members(spark, sf), "address", len(CLUSTER_FEATURES))
    best = cl.best_k(gaps)
    table = spark.createDataFrame(gaps, "clusters int, gap double")
    return table.withColumn("best", F.col("clusters") == best)


@query("kmeans_single_cost", """
WITH f AS (SELECT user_id, CAST(sum(value) AS DOUBLE) AS a, avg(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS b, count(event_id) AS c FROM events GROUP BY 1)
SELECT CAST(1 AS INTEGER) AS clusters, round(sum(power((a - ma) / sa, 2) + power((b - mb) / sb, 2) + power((c - mc) / sc, 2)), 3) AS cost
FROM f, (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, avg(c) AS mc, stddev_samp(c) AS sc FROM f)""")
def kmeans_single_cost(spark, sf):
    """The cost of a single cluster, by the rounds that all fits go through."""
    _, cost = cl.fit_all(_members(spark, sf), "address", len(CLUSTER_FEATURES), [1])[0, 1]
    return groups.rounded(spark.createDataFrame([(1, cost)], "clusters int, cost double"), 3, "cost")


@query("cluster_names")
def cluster_names(spark, sf):
    assigned = cl.assign_clusters(_members(spark, sf), "address", 4)
    return cl.name_clusters(assigned, "address", 1, "own_cluster")


@query("cluster_members", """
SELECT user_id AS address, 1 AS clusters, CAST(4 AS BIGINT) AS used FROM events GROUP BY 1""")
def cluster_members(spark, sf):
    """Every account is in one cluster, and no cluster is empty."""
    assigned = cl.assign_clusters(_members(spark, sf), "address", 4)
    used = assigned.agg(F.count_distinct("prediction")).scalar()
    return assigned.groupBy("address").agg(F.count_distinct("prediction").cast("int").alias("clusters")).withColumn("used", used)


@query("forecast_days", """
SELECT s AS company, CAST(d AS DATE) AS ds FROM (SELECT company AS s, CAST(min(start_actual) AS DATE) AS a,
  CAST(max(start_actual) AS DATE) + 30 AS b FROM $business GROUP BY 1), generate_series(a, b, INTERVAL 1 DAY) AS g(d)""")
def forecast_days(spark, sf):
    """One row for every day of a series and for the 30 days after it, with bounds around the estimate."""
    rows = fc.forecast(t.business(spark, sf), "start_actual", "rate", "sum", 30, keys="company")
    return rows.where("yhat_lower <= yhat and yhat <= yhat_upper").select("company", "ds")


@query("forecast_additive")
def forecast_additive(spark, sf):
    """Daily mean amount, and daily distinct accounts, 14 days ahead."""
    rows = t.accounts(spark, sf)
    amount = fc.forecast(rows, "block_timestamp", "amount", "mean", 14).withColumn("series", F.lit("amount"))
    users = fc.forecast(rows, "block_timestamp", "address", "nunique", 14).withColumn("series", F.lit("accounts"))
    return amount.unionByName(users)


@query("forecast_by_key")
def forecast_by_key(spark, sf):
    return fc.forecast(t.business(spark, sf), "start_actual", "rate", "sum", 30, keys="company")


@query("cluster_artifact")
def cluster_artifact(spark, sf):
    """Clusters of the accounts, saved, read back and used for the sum of each cluster per day."""
    assigned = cl.assign_clusters(_members(spark, sf), "address", 4)
    named = cl.name_clusters(assigned, "address", 1, "own_cluster")
    store, now = ArtifactStore(spark, shared_folder(spark, "clusters")), datetime(2024, 2, 1)
    cl.save_clusters(store, named, "address", "clusters:accounts", now)
    clusters = cl.load_clusters(store, "clusters:accounts", now, "address")
    names = sorted(r["cluster"] for r in clusters.select("cluster").distinct().collect())  # one per cluster
    rows = t.accounts(spark, sf).withColumn("address", t.text("address"))
    return cluster_series(rows, clusters, "address", "block_timestamp", "D", ["amount"], names)
