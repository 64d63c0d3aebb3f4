"""Tests of association: linear relationship, rank tests, mutual information.

The data is reduced to a few rows per tested pair by Spark aggregates; only those rows
reach the tail-probability functions.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.tails import chi2_p, normal_p, student_p, u_exact_p
from periodica.operators.groups import finite
from periodica.operators.ranks import rank_sums
from periodica.sources.artifacts import CHECKPOINT_DAYS, ArtifactStore

# Limits of |r| and the significance level.
STRONG, MODERATE, WEAK = 0.65, 0.4, 0.25
ALPHA = 0.1
# A sample of at most this many values is small, if both together are not more than the second number.
EXACT, EXACT_TOTAL = 8, 400  # no more than u_exact_p takes
SIGNIFICANT_WORDS = ("weak", "moderate", "strong")


def relationship(r: Column, p: Column, alpha: float = ALPHA) -> Column:
    size = F.abs(r)
    strength = F.when(size > STRONG, "strong").when(size > MODERATE, "moderate").otherwise("weak")
    direction = F.when(r > 0, "positive").otherwise("negative")
    significant = p.isNotNull() & ~F.isnan(p) & (p < alpha)
    return (
        F.when(~significant, "Not significant").when(size <= WEAK, "none")
        .otherwise(F.concat_ws(" ", strength, direction))
    )


def _correlation(y: Column, x: Column) -> Column:
    """Pearson's r; null, and no division error, when one side is constant."""
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    r = F.try_divide(F.regr_sxy(y, x), spread)
    return F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r)


def linear_relationships(df: DataFrame, target: str, features: list[str], alpha: float = ALPHA) -> DataFrame:
    """Least squares of every feature on the target: all pairs in one aggregate over one scan."""
    others = [f for f in features if f != target]
    x = F.col(target).cast("double")
    measures = []
    for i, f in enumerate(others):
        y = F.col(f"`{f}`").cast("double")
        measures += [
            F.regr_slope(y, x).alias(f"_s{i}"), F.regr_intercept(y, x).alias(f"_i{i}"),
            _correlation(y, x).alias(f"_r{i}"), F.regr_count(y, x).alias(f"_n{i}"),
        ]
    rows = [
        F.struct(
            F.lit(target).alias("variable_1"), F.lit(f).alias("variable_2"), F.col(f"_s{i}").alias("slope"),
            F.col(f"_i{i}").alias("intercept"), F.col(f"_r{i}").alias("r"), F.col(f"_n{i}").alias("n"),
        )
        for i, f in enumerate(others)
    ]
    table = df.agg(*measures).select(F.inline(F.array(*rows)))
    r, free = F.col("r"), (F.col("n") - 2).cast("double")
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(free / (1 - r * r)))
    return (
        table.withColumn("p_value", student_p(t, free))
        .withColumn("relationship", relationship(r, F.col("p_value"), alpha))
    )


def lag_relationships(lagged: DataFrame, target: str, lag_columns: list[str], alpha: float = ALPHA) -> DataFrame:
    """Relationship of the target with each lag column, over rows that have all of them.

    The lag is the number at the end of the column name; the unlagged column has none.
    """
    complete = lagged.dropna(subset=[target, *lag_columns])
    number = F.regexp_extract("variable_2", r"_(\d+)$", 1)
    table = linear_relationships(complete, target, lag_columns, alpha)
    return table.withColumn("lag", F.when(number != "", number).otherwise("None"))


def mann_whitney(df: DataFrame, target: str, features: list[str], alpha: float = ALPHA) -> DataFrame:
    """U of the target against each feature, two-sided.

    Equal values of a column are counted together; all pairs are ranked in one sort of the counts. ``method`` names the
    distribution of U behind the p-value: exact where one of the samples has at most ``EXACT`` values and no two
    values are equal, else the normal one with tie and continuity correction. 'No' means the two samples differ.
    """
    others = [f for f in features if f != target]
    cells = [
        F.struct(F.lit(c).alias("_c"), F.col(f"`{c}`").cast("double").alias("_v")) for c in dict.fromkeys([target, *others])
    ]
    long = df.select(F.inline(F.array(*cells))).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = long.groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    sides = counts.select(
        F.lit("").alias("_o"), "_v", "_n", *(F.when(F.col("_c").isin(target, f), F.col("_c")).alias(f) for f in others))
    sums = rank_sums(sides, "_o", "_v", "_n", others).where(F.col("level") == target)
    n1, n = F.col("n").cast("double"), F.col("total").cast("double")
    n2 = n - n1
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.greatest((F.abs("centred") - 0.5) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
    small = (F.col("ties") == 0) & (F.least(n1, n2) <= EXACT) & (F.least(n1, n2) > 0) & (n <= EXACT_TOTAL)
    u = F.col("centred") + n1 * n2 / 2
    return (
        sums.select(
            F.lit(target).alias("variable_1"), F.col("test").alias("variable_2"), u.alias("stat"),
            F.when(small, u_exact_p(u, n1, n2)).otherwise(normal_p(z)).alias("p_value"),
            F.when(small, "exact").otherwise("normal").alias("method"))
        .withColumn("different", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
        .withColumn("relationship", F.when(F.col("different"), "No").otherwise("Yes"))
    )


def kruskal(df: DataFrame, outcomes: list[str], treatments: list[str], counted: list[str] = (),
            alpha: float = 0.05) -> DataFrame:
    """Kruskal-Wallis H of each outcome over the levels of each treatment, tie corrected.

    Outcomes in ``counted`` are first reduced to their number of distinct values per level.
    'No' means not significant, 'na' fewer than two levels. Rows without a level of a treatment
    take no part in its test. All tests are ranked in one sort of the counted cells.
    """
    measured = [o for o in outcomes if o not in counted]
    tables = []
    if measured:
        tables.append(_measured_cells(df, measured, treatments))
    if counted:
        tables.append(_counted_cells(df, list(counted), treatments))
    levels = rank_sums(reduce(DataFrame.unionByName, tables), "_o", "_v", "_c", treatments).where("outcome <> test")
    n = F.col("total").cast("double")
    sums = levels.groupBy(F.col("outcome").alias("variable_1"), F.col("test").alias("variable_2")).agg(
        F.sum(F.col("centred") * F.col("centred") / F.col("n")).alias("_q"), F.first("total").alias("total"),
        F.first("ties").alias("ties"), F.count(F.lit(1)).alias("_levels"))
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("_q"), 1 - F.try_divide(F.col("ties"), n * n * n - n))
    enough = F.col("_levels") > 1
    p = chi2_p(h, (F.col("_levels") - 1).cast("double"))
    return (
        sums.select("variable_1", "variable_2", F.when(enough, h).alias("stat"), F.when(enough, p).alias("p_value"), "_levels")
        .withColumn("significant", F.coalesce(F.col("p_value") <= alpha, F.lit(False)))
        .withColumn("relationship", F.when(~enough, "na").when(F.col("significant"), "Yes").otherwise("No"))
        .drop("_levels")
    )


def _measured_cells(df: DataFrame, outcomes: list[str], treatments: list[str]) -> DataFrame:
    """(outcome, value, count, levels): equal rows are counted first."""
    cells = [F.struct(F.lit(o).alias("_o"), F.col(f"`{o}`").cast("double").alias("_v")) for o in outcomes]
    rows = df.select(*[F.col(f"`{x}`").cast("string").alias(x) for x in treatments], F.inline(F.array(*cells)))
    known = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return known.groupBy("_o", "_v", *treatments).agg(F.count(F.lit(1)).alias("_c"))


def _counted_cells(df: DataFrame, outcomes: list[str], treatments: list[str]) -> DataFrame:
    """The same where each level of a treatment has one value, its number of distinct outcome values."""
    pairs = [F.struct(F.lit(o).alias("_o"), F.col(f"`{o}`").cast("string").alias("_e"), F.lit(x).alias("_t"), F.col(f"`{x}`").cast("string").alias("_l"))
             for o in outcomes for x in treatments]
    seen = df.select(F.inline(F.array(*pairs))).where(F.col("_l").isNotNull()).distinct()
    values = seen.groupBy("_o", "_t", "_l").agg(F.count("_e").cast("double").alias("_v"))
    return values.select("_o", "_v", F.lit(1).alias("_c"), *(F.when(F.col("_t") == x, F.col("_l")).alias(x) for x in treatments))


def mutual_information(df: DataFrame, target: str, features: list[str], bins: int = 10) -> DataFrame:
    """Mutual information, in nats, of equal-width bins of the target and each feature, with a strength.

    Rows whose value is null, NaN or infinite take no part in a pair. Only the bins-by-bins table of
    counts is ever ordered or totalled.
    """
    others = [f for f in features if f != target]
    both = [target, *others]
    ends = df.agg(
        *[F.min(finite(c)).alias(f"lo_{i}") for i, c in enumerate(both)],
        *[F.max(finite(c)).alias(f"hi_{i}") for i, c in enumerate(both)],
    ).first()

    def bin_of(i: int, c: str) -> Column:
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        if lo is None:
            return F.lit(None).cast("int")
        width = (hi - lo) / bins or 1.0
        # least() passes over nulls, so a missing value must not reach it
        return F.when(finite(c).isNotNull(), F.least(F.floor((finite(c) - lo) / width), F.lit(bins - 1)).cast("int"))

    cells = [
        F.struct(F.lit(f).alias("variable_2"), bin_of(0, target).alias("_x"), bin_of(i + 1, f).alias("_y"))
        for i, f in enumerate(others)
    ]
    counts = (
        df.select(F.inline(F.array(*cells))).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
        .groupBy("variable_2", "_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_c"))
    )
    total = F.sum("_c").over(Window.partitionBy("variable_2"))
    x_total = F.sum("_c").over(Window.partitionBy("variable_2", "_x"))
    y_total = F.sum("_c").over(Window.partitionBy("variable_2", "_y"))
    parts = counts.withColumns({"_n": total, "_nx": x_total, "_ny": y_total})
    c, n = F.col("_c"), F.col("_n")
    information = F.sum(c / n * F.log(c * n / (F.col("_nx") * F.col("_ny"))))
    table = parts.groupBy("variable_2").agg(information.alias("stat"))
    size = F.abs("stat")
    strength = (
        F.when(size > STRONG, "strong").when(size > MODERATE, "moderate").when(size > WEAK, "weak").otherwise("None")
    )
    return table.select(F.lit(target).alias("variable_1"), "variable_2", "stat", strength.alias("relationship"))


def significant_features(relationships: DataFrame) -> DataFrame:
    """Pairs whose relationship is weak, moderate or strong."""
    hit = reduce(lambda a, b: a | b, [F.col("relationship").contains(w) for w in SIGNIFICANT_WORDS])
    return relationships.where(hit)


def save_significant(store: ArtifactStore, relationships: DataFrame, key: str, now: datetime) -> None:
    """Keep the significant features of a target as a checkpoint: one row per feature."""
    rows = significant_features(relationships).select(
        F.col("variable_2").alias("item"), F.col("relationship").alias("payload"))
    store.save(rows, key, None, None, now, CHECKPOINT_DAYS)


def load_significant(store: ArtifactStore, key: str, now: datetime) -> list[str]:
    """Names of the saved features; at most one per column of the tested table."""
    return sorted(r["item"] for r in store.latest(now, key).select("item").distinct().collect())


def matching_columns(columns: list[str], features: list[str]) -> list[str]:
    """Columns whose name holds the name of a significant feature."""
    return [c for c in columns if any(f in c for f in features)]
