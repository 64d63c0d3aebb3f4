"""Churn models: what goes in, what is told of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from periodica.operators import forest
from periodica.operators.forest import Forest
from periodica.operators.resample import aggregate


def entity_features(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    """One row of aggregated features per entity; nulls become 0."""
    grouped = df.groupBy(*keys).agg(*[aggregate(fn, c).cast("double").alias(c) for c, fn in aggs.items()])
    return grouped.fillna(0.0, list(aggs))


def draw(keys: list[str]) -> Column:
    """A number from 0 to 9,999 from the key's MD5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000).cast("int")


def split_rows(df: DataFrame, keys: list[str], label: str, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key, the same ones on every attempt and layout.

    The row of each class with the smallest draw is always in the training part, so that no class
    is missing there; the parts never overlap.
    """
    place = F.struct(draw(keys), *[F.col(k) for k in keys])
    first = df.groupBy(F.col(label).alias("_label")).agg(F.min(place).alias("_first"))  # one row per class
    marked = df.join(first, F.col(label).eqNullSafe(F.col("_label")), "left").withColumn(
        "_train", (draw(keys) < int(share * 10_000)) | (place == F.col("_first")))
    return marked.where("_train").select(*df.columns), marked.where(~F.col("_train")).select(*df.columns)


def usable_features(df: DataFrame, features: list[str]) -> list[str]:
    """Features with at least one value other than 0; a median of none cannot be taken."""
    row = df.agg(*[F.max(F.coalesce(F.col(f) != 0, F.lit(False))).alias(f) for f in features]).first()
    return [f for f in features if row[f]]


def confusion(scored: DataFrame, label: str) -> DataFrame:
    return scored.groupBy(
        F.col(label).cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def class_report(scored: DataFrame, label: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the four cells of the confusion table."""
    cells = confusion(scored, label)
    classes = cells.select(F.explode(F.array("label", "prediction")).alias("class"), "label", "prediction", "n").distinct()
    hit = (F.col("label") == F.col("class")) & (F.col("prediction") == F.col("class"))
    sums = classes.groupBy("class").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("prediction") == F.col("class"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("label") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    precision = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def accuracy_table(scored: DataFrame, label: str, outcome: str) -> DataFrame:
    hit = (F.col(label).cast("double") == F.col("prediction")).cast("double")
    return scored.agg(F.round(F.avg(hit) * 100, 2).alias("accuracy")).select(F.lit(outcome).alias("outcome"), "accuracy")


def score_entities(model: Forest, features: DataFrame, entity: str, churned: str = "churn",
                   stays: str = "remain") -> tuple[DataFrame, DataFrame]:
    """(entity, likely action) and the percentage likely to churn."""
    scored = forest.score(features, model)
    labelled = scored.select(entity, F.when(F.col("prediction") == 1, churned).otherwise(stays).alias("likely_action"))
    share = scored.agg(F.round(F.avg(F.col("prediction")) * 100, 1).alias("percent_to_churn"))
    return labelled, share


def importance_table(spark: SparkSession, model: Forest, outcome: str) -> DataFrame:
    """Feature importances with their rank, 1 for the largest; one row per feature."""
    rows = [(outcome, f, v) for f, v in zip(model.features, forest.importances(model))]
    table = spark.createDataFrame(rows, "outcome string, feature string, importance double")
    order = Window.partitionBy("outcome").orderBy(F.col("importance").desc(), "feature")
    return (
        table.withColumn("rank_within_outcome", F.row_number().over(order))
        .withColumn("importance", F.round("importance", 4))
    )
