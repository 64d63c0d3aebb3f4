"""Risk tables: joined ratings, recommended actions, the rating grid and links with solutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.scalars import first_scaled
from periodica.operators.association import linear_relationships
from periodica.operators.filters import band
from periodica.operators.joins import lookup_value

# Rating names in ascending order, score limits and action texts.
SEVERITIES = ["Insignificant", "Minor", "Moderate", "Critical", "Catastrophic"]
LIKELIHOODS = ["Unlikely", "Seldom", "Occaisional", "Likely", "Definite"]
ACCEPTABLE, DOUBTFUL = 8, 15
ACTIONS = [
    "Proceed (risk is acceptable)",
    "Proceed, if no other options are available",
    "Do no proceed (Risk unacceptable)",
]


def joined_risks(matrices: DataFrame, risks: DataFrame, analyses: DataFrame) -> DataFrame:
    """(matrix, risk, severity, likelihood) with the ids of the ratings."""
    analysed = risks.join(analyses, F.col("risk_key") == F.col("risk_id"))
    return matrices.join(analysed, F.col("matrix_key") == F.col("matrix_id")).select(
        "matrix", "risk", "severity", "likelihood")


def rated_risks(joined: DataFrame, severities: DataFrame, likelihoods: DataFrame) -> DataFrame:
    """Rating ids become values (0 when unknown); composite is their product."""
    rated = joined
    for name, table in (("severity", severities), ("likelihood", likelihoods)):
        rated = lookup_value(rated, name, table, "_id", "value", name)
    return rated.withColumn("composite", F.col("severity") * F.col("likelihood"))


def action(score: Column) -> Column:
    return band(score, [(ACCEPTABLE, ACTIONS[0]), (DOUBTFUL, ACTIONS[1])], ACTIONS[2])


def mean_ratings(rated: DataFrame, keys: list[str], more: list[str] = ()) -> DataFrame:
    means = rated.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("severity", "likelihood", *more)])
    return means.withColumn("composite", F.col("likelihood") * F.col("severity"))


def risk_actions(rated: DataFrame) -> DataFrame:
    return mean_ratings(rated, ["matrix", "risk"]).withColumn("action", action(F.col("composite")))


def risk_grid(rated: DataFrame) -> DataFrame:
    """The 5 x 5 grid of products for each risk: severities down, likelihoods across.

    The cell of the risk's own mean ratings is marked.
    """
    own = rated.groupBy("matrix", "risk").agg(
        F.floor(F.avg("severity")).alias("_s"), F.floor(F.avg("likelihood")).alias("_l"))
    rows = own.select("matrix", "risk", "_s", "_l", F.posexplode(F.array(*[F.lit(s) for s in SEVERITIES])).alias("_p", "severity"))
    cells = {}
    for j, name in enumerate(LIKELIHOODS, start=1):
        product = ((F.col("_p") + 1) * j).cast("string")
        marked = (F.col("_s") == F.col("_p") + 1) & (F.col("_l") == j)
        cells[name.lower()] = F.when(marked, F.concat(F.lit("BINGO "), product)).otherwise(product)
    return rows.withColumns(cells).drop("_p", "_s", "_l")


def project_ratings(projects: DataFrame) -> DataFrame:
    """Mean ratings and ten times the first solution per project."""
    scaled = projects.withColumn("solution", first_scaled(F.col("solution")))
    return mean_ratings(scaled, ["project"], ["solution"])


def solution_relationships(projects: DataFrame) -> DataFrame:
    return linear_relationships(project_ratings(projects), "solution", ["composite", "severity", "likelihood"])
