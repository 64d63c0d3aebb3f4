"""Grouped measures: aggregate dictionaries, shares, histograms, summaries and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from periodica.operators.ordered import exact_quantiles
from periodica.operators.resample import aggregate, resample

# Words in a column name that mean its values are counts to be summed.
COUNT_WORDS = ["mention", "hashtags", "tweets", "replies", "favorites"]
# The measures summed per coin.
COIN_SUMS = [
    "twr_emojis", "twr_favorites", "twr_retweets", "twr_hashtags", "twr_replies", "twr_tweets",
    "twu_emojis", "twu_favorites", "twu_retweets", "twu_hashtags", "twu_replies", "twu_tweets",
    "watch", "fork", "issue", "release", "push",
]


def group_agg(df: DataFrame, keys: list[str], aggs: dict[str, str]) -> DataFrame:
    """{column: aggregate}; results keep the column's name and nulls become 0."""
    return df.groupBy(*keys).agg(*[aggregate(fn, c).alias(c) for c, fn in aggs.items()]).fillna(0, list(aggs))


def aggregates_by_name(columns: list[str], known: dict[str, str] | None = None,
                       words: list[str] = COUNT_WORDS) -> dict[str, str]:
    """'sum' for columns whose name holds a counting word, else 'mean'; known entries win."""
    chosen = dict(known or {})
    for c in columns:
        chosen.setdefault(c, "sum" if any(w in c for w in words) else "mean")
    return chosen


def coin_aggregates(coins: list[str], measures: list[str] = COIN_SUMS) -> dict[str, str]:
    return {f"{coin.replace('-', '_')}_{m}": "sum" for coin in coins for m in measures}


def share_of_total(df: DataFrame, key: str, counted: str, digits: int = 1) -> DataFrame:
    """Counted rows per key and their percentage.

    The total is a scalar subquery over the counts, which reuses their shuffle; a window
    over all keys would bring them into one task.
    """
    counts = df.groupBy(key).agg(F.count(counted).alias("block_count"))
    total = counts.agg(F.sum("block_count")).scalar()
    return counts.withColumn("percentage", F.round(F.try_divide(100 * F.col("block_count"), total), digits))


def share_by_day(df: DataFrame, ts: str) -> DataFrame:
    counts = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(ts).alias("rows"))
    return counts.withColumn("percentage", 100 * F.col("rows") / counts.agg(F.sum("rows")).scalar())


def per_day(df: DataFrame, ts: str, skip: list[str] = ()) -> DataFrame:
    """Divide the numeric columns by the days the table spans (at least 1)."""
    days = df.agg(F.greatest(F.datediff(F.max(ts), F.min(ts)), F.lit(1))).scalar()
    numeric = [
        f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip
    ]
    return df.withColumns({c: F.col(c).cast("double") / days for c in numeric})


def change_in_percent(series: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """(x / previous - 1) * 100 over an aggregated series; no previous value or a zero one gives 0.

    Meant for resampled series, which hold one row per bucket; ``previous_known`` does the
    same for raw rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(order)
    filled = series.withColumn("_f", F.last(value, ignorenulls=True).over(w))
    previous = F.lag("_f").over(w)
    change = F.try_divide(F.col("_f").cast("double"), previous.cast("double")) - 1
    return filled.withColumn(out, F.coalesce(change * 100, F.lit(0.0))).drop("_f")


def activity_rate(df: DataFrame, ts: str, period: str, counted: str, out: str, delta: str) -> DataFrame:
    """Rows per bucket with the change to the bucket before."""
    return change_in_percent(resample(df, ts, period, {out: ("count", counted)}), ts, out, delta)


def finite(name: str) -> Column:
    """The column as a double; null for NaN and infinite values."""
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def histogram(df: DataFrame, columns: list[str], bins: int = 25) -> DataFrame:
    """Equal-width counts per column: (feature, bin, low, n). The last bin includes its upper end.

    Null, NaN and infinite values are left out; a column with no other values has no rows.
    One pass finds all ranges (a row of two numbers per column), one pass counts.
    """
    ends = df.agg(*[f(finite(c)).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)])
    row = ends.first()
    entries = []
    for c in columns:
        lo, hi = row[f"min_{c}"], row[f"max_{c}"]
        if lo is None:
            continue
        width = (hi - lo) / bins or 1.0
        number = F.least(F.floor((finite(c) - lo) / width), F.lit(bins - 1)).cast("int")
        entries.append(F.when(finite(c).isNotNull(), F.struct(
            F.lit(c).alias("feature"), number.alias("bin"), (F.lit(lo) + number * width).alias("low"))))
    if not entries:
        return df.sparkSession.createDataFrame([], "feature string, bin int, low double, n bigint")
    return (
        df.select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("feature", "bin").agg(F.first("low").alias("low"), F.count(F.lit(1)).alias("n"))
    )


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Minimum, exact quartiles and maximum by group, with the axis limits over all groups."""
    boxes = exact_quantiles(df, value, [0.25, 0.5, 0.75], keys=by)
    low, high = boxes.agg(F.min("min")).scalar(), boxes.agg(F.max("max")).scalar()
    return boxes.select(
        by, "min", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "max",
        (low * 0.9).alias("axis_low"), (high * 1.1).alias("axis_high"),
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every value of every column, and 'all' once per column, for a selection list."""
    pairs = [F.struct(F.lit(c).alias("menu"), F.col(c).cast("string").alias("value")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull()).distinct()
    every = df.sparkSession.createDataFrame([(c, "all") for c in columns], "menu string, value string")
    return values.unionByName(every)


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def scatter_pairs(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """The target against every other feature, null counted as 0: (x, feature, value)."""
    others = [f for f in features if f != target]
    pairs = [
        F.struct(
            F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("x"), F.lit(f).alias("feature"),
            F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value"),
        )
        for f in others
    ]
    return df.select(F.inline(F.array(*pairs)))


def top_n(df: DataFrame, n: int, by: str, tiebreak: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tiebreak)).limit(n)


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def money(c: Column) -> Column:
    """Amounts as exact decimals, so that sums do not depend on the order of the rows."""
    return c.cast("decimal(18,2)")
