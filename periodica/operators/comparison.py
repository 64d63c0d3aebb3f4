"""Period over period: the same days of the current and earlier periods side by side."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.functions.periods import SPAN_LIMIT, comparison_windows, day_label, window_label
from periodica.operators.resample import aggregate

# The date before which no comparison window may start, unless the caller names another.
INITIAL = date(2018, 4, 25)


def too_long(period: str, start: date, end: date) -> bool:
    """Whether a window is longer than the period it would be compared by."""
    return period in SPAN_LIMIT and abs((start - end).days) > SPAN_LIMIT[period]


def tag_periods(df: DataFrame, ts: str, period: str, start: date, end: date, history: int,
                initial: date = INITIAL) -> DataFrame:
    """Rows of the current and the earlier windows with their ``period`` and ``dayset``.

    One scan serves all windows; a row lying in two of them appears twice. The window
    bounds reach the scan as filters.
    """
    windows = comparison_windows(period, start, end, history, initial)
    c = F.col(ts)
    inside = reduce(lambda a, b: a | b, [w.holds(c) for w in windows])
    labels = F.array_compact(F.array(*[F.when(w.holds(c), F.lit(w.label)) for w in windows]))
    return (
        df.where(inside)
        .withColumn("period", F.explode(labels))
        .withColumn("dayset", day_label(c, period))
    )


def _kept(label, rows):
    """An earlier window counts only when it has more than one row."""
    return (rows > 1) | label.endswith("(current)")


def period_over_period(df: DataFrame, ts: str, period: str, start: date, end: date, history: int,
                       initial: date = INITIAL, dedup: bool = False) -> DataFrame:
    tagged = tag_periods(df, ts, period, start, end, history, initial)
    if dedup:
        tagged = tagged.dropDuplicates()
    sizes = tagged.groupBy("period").agg(F.count(F.lit(1)).alias("_rows"))
    kept = sizes.where(_kept(F.col("period"), F.col("_rows"))).select(F.col("period").alias("_p"))
    # One row per window, at most ``history`` of them.
    return tagged.join(F.broadcast(kept), F.col("period") == F.col("_p"), "left_semi")


def compare(df: DataFrame, ts: str, period: str, start: date, end: date, history: int, variable: str, how: str,
            initial: date = INITIAL, dedup: bool = False) -> DataFrame:
    """(dayset, period) with the aggregated variable; ``dedup`` counts equal rows of a window once.

    Row counts are taken along, so short windows are dropped from the small result and the
    rows themselves are neither counted apart nor joined.
    """
    tagged = tag_periods(df, ts, period, start, end, history, initial)
    if dedup:
        tagged = tagged.dropDuplicates()
    grouped = tagged.groupBy("dayset", "period").agg(
        aggregate(how, variable).alias(variable), F.count(F.lit(1)).alias("_rows")
    )
    rows = F.sum("_rows").over(Window.partitionBy("period"))
    return (
        grouped.withColumn("_rows", rows)
        .where(_kept(F.col("period"), F.col("_rows")))
        .drop("_rows")
    )


def period_labels(period: str, history: int) -> list[str]:
    return [window_label(period, k) for k in range(int(history))]


def period_columns(compared: DataFrame, period: str, history: int, variable: str, merged: bool = True) -> DataFrame:
    """One column per period, 0 where a period has no value for a day; missing periods are all 0.

    ``merged=False`` keeps one row per (dayset, period) with the other columns at 0.
    """
    labels = sorted(period_labels(period, history))
    if merged:
        return compared.groupBy("dayset").pivot("period", labels).agg(F.first(variable)).fillna(0, labels)
    spread = {
        name: F.when(F.col("period") == name, F.col(variable)).otherwise(F.lit(0)) for name in labels
    }
    return compared.withColumns(spread)


def drop_first_day(compared: DataFrame) -> DataFrame:
    """Without the smallest day label, as quarters are shown."""
    first = compared.agg(F.min("dayset")).scalar()
    return compared.where(F.col("dayset") > first)


def guarded_comparison(df: DataFrame, ts: str, period: str, start: date, end: date, history: int, variable: str,
                       how: str, initial: date = INITIAL, trim_quarter: bool = True) -> DataFrame | None:
    """Period columns, or None when the window is longer than the period."""
    if too_long(period, start, end):
        return None
    compared = compare(df, ts, period, start, end, history, variable, how, initial)
    if period == "quarter" and trim_quarter:
        compared = drop_first_day(compared)
    return period_columns(compared, period, history, variable)
