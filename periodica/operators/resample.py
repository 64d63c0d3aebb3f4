"""Time buckets: labels, resampling with empty buckets kept, profiles and ratio series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an empty bucket holds; other aggregates stay null.
EMPTY = {"sum": 0, "count": 0, "nunique": 0}


def aggregate(name: str, column: str) -> Column:
    c = F.col(f"`{column}`")
    return {
        "sum": F.sum, "mean": F.avg, "count": F.count, "nunique": F.count_distinct, "min": F.min, "max": F.max,
    }[name.strip()](c)


def bucket_start(ts: Column, period: str) -> Column:
    if period == "H":
        return F.date_trunc("hour", ts).cast("timestamp_ntz")
    unit = {"D": None, "W": "week", "M": "month", "Q": "quarter", "Y": "year"}[period]
    day = F.to_date(ts)
    return F.trunc(day, unit) if unit else day


def bucket_label(start: Column, period: str) -> Column:
    """Weeks are named by their Sunday; months, quarters and years by their last day."""
    if period == "W":
        return F.date_add(start, 6)
    if period in ("M", "Q", "Y"):
        return F.last_day(F.add_months(start, {"M": 0, "Q": 2, "Y": 11}[period]))
    return start


def _span(start: Column, following: Column, period: str) -> Column:
    """The bucket itself and the empty ones before the next bucket that has rows."""
    if period == "H":
        step = F.expr("INTERVAL 1 HOUR")
        every = F.sequence(start, following - step, step)
    elif period in ("D", "W"):
        days = 1 if period == "D" else 7
        every = F.sequence(start, F.date_sub(following, days), F.make_dt_interval(F.lit(days)))
    else:
        months = {"M": 1, "Q": 3, "Y": 12}[period]
        every = F.sequence(start, F.add_months(following, -months), F.make_ym_interval(F.lit(0), F.lit(months)))
    return F.when(following.isNull(), F.array(start)).otherwise(every)


def resample(df: DataFrame, ts: str, period: str, aggs: dict[str, tuple[str, str]], keys=(), label: str | None = None,
             fill: bool = False) -> DataFrame:
    """Aggregate per bucket, keeping the empty buckets between the first and last one of each key.

    ``aggs`` maps an output name to (aggregate, column). Rows are aggregated before they
    are ordered, so a key holds at most one row per bucket when gaps are filled and no
    join with a calendar is needed. ``fill`` sets every remaining null to 0.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    label = label or ts
    grouped = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, bucket_start(F.col(ts), period).alias("_b"))
        .agg(*[aggregate(fn, c).alias(out) for out, (fn, c) in aggs.items()])
    )
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b")
    spread = grouped.withColumn("_next", F.lead("_b").over(w)).select(
        *keys, *aggs, F.posexplode(_span(F.col("_b"), F.col("_next"), period)).alias("_i", "_at")
    )
    values = []
    for out, (fn, _) in aggs.items():
        empty = EMPTY.get(fn.strip(), 0 if fill else None)
        value = F.when(F.col("_i") == 0, F.col(out)).otherwise(F.lit(empty))
        values.append((F.coalesce(value, F.lit(0)) if fill else value).alias(out))
    return spread.select(*keys, bucket_label(F.col("_at"), period).alias(label), *values)


def series_by_level(df: DataFrame, ts: str, period: str, level: str, value: str, how: str = "mean") -> DataFrame:
    """One line per level of a category; buckets without rows count as 0."""
    return resample(df, ts, period, {value: (how, value)}, keys=level, fill=True)


def weekday_profile(df: DataFrame, ts: str, period: str, value: str) -> DataFrame:
    """Mean value by weekday name inside each week, month, quarter or year."""
    return df.groupBy(
        F.date_format(ts, "EEEE").alias("day_of_week"),
        bucket_label(bucket_start(F.col(ts), period), period).alias("bucket"),
    ).agg(F.avg(value).alias(value))


def ratio_series(df: DataFrame, ts: str, period: str, target: str, features: list[str]) -> DataFrame:
    """Summed target over each summed feature per bucket, named by the last word of the feature."""
    sums = resample(df, ts, period, {c: ("sum", c) for c in [target, *features]})
    ratios = [
        F.coalesce(F.try_divide(F.col(target).cast("double"), F.col(f).cast("double")), F.lit(0.0))
        .alias(f.split("_")[-1])
        for f in features
    ]
    return sums.select(ts, *ratios)


def cluster_series(df: DataFrame, clusters: DataFrame, member: str, ts: str, period: str, features: list[str],
                   names: list[str]) -> DataFrame:
    """Summed features per cluster and bucket, one column per cluster and feature.

    Members without a cluster keep their own name as label; only ``names`` become columns.
    """
    named = clusters.select(F.col(member).alias("_m"), F.col("cluster").alias("_c"))
    labelled = df.join(named, F.col(member) == F.col("_m"), "left").withColumn(
        "cluster", F.coalesce(F.col("_c"), F.col(member).cast("string"))
    )
    lines = resample(labelled, ts, period, {f: ("sum", f) for f in features}, keys="cluster")
    return lines.groupBy(ts).pivot("cluster", names).agg(*[F.first(f).alias(f) for f in features])
