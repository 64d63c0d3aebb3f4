"""Project measures: money flows between people, and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from periodica.operators.ordered import dense_index, running_totals


def flow_nodes(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Distinct names with a dense index from 0 and one type each."""
    return dense_index(df.groupBy(name).agg(F.min(kind).alias("type")), name, "index")


def flow_links(df: DataFrame, source: str, target: str, value: str, percentile: float = 0.75) -> DataFrame:
    """Summed flows in thousandths of the total (at least 1), from the given percentile upwards.

    The thousandths are at most 1000 different numbers, so the percentile needs no ordering
    of the links.
    """
    sums = df.groupBy(source, target).agg(F.sum(value).alias("_v"))
    total = sums.agg(F.sum("_v").cast("double")).scalar()
    links = sums.select(
        F.col(source).alias("source"), F.col(target).alias("target"),
        F.greatest(F.floor(F.try_divide(F.col("_v").cast("double"), total) * 1000), F.lit(1)).cast("long").alias("value"),
    )
    floor = links.agg(F.percentile("value", percentile)).scalar()
    return links.where(F.col("value") >= floor)


def timeline(df: DataFrame, keys: list[str], item: str, start: str, end: str) -> DataFrame:
    """Earliest start and latest end per item, with bar bounds around the item's position in its group."""
    spans = df.groupBy(*keys, F.col(item).alias("item")).agg(F.min(start).alias("start"), F.max(end).alias("end"))
    return _with_bounds(spans, "item", None, keys)


def timeline_all(df: DataFrame, keys: list[str], milestone: str, task: str, start: str, end: str,
                 task_start: str, task_end: str) -> DataFrame:
    """Milestones and tasks together, one row each, placed by their start.

    Items are numbers or names; equal starts go by item, a milestone before a task. Items of both
    kinds become names if either kind has names.
    """
    text = any(isinstance(df.schema[c].dataType, StringType) for c in (milestone, task))
    # Both kinds of a row in one aggregate, so that the input is read once.
    kinds = F.array(*(
        F.struct(F.lit(kind).alias("_kind"), F.col(column).cast("string" if text else "long").alias("item"), F.col(lo).alias("start"), F.col(hi).alias("end"))
        for kind, column, lo, hi in ((0, milestone, start, end), (1, task, task_start, task_end))))
    both = df.select(*keys, F.inline(kinds)).groupBy(*keys, "item", "_kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    first = F.col("_kind") == 0
    colored = both.select(
        *keys, "item", "start", "end", F.when(first, "milestone").otherwise("task").alias("type"), F.when(first, "black").otherwise("green").alias("color"))
    # Item and type in one value, so that equal starts have one order.
    second = F.when(F.col("type") == "task", 1).otherwise(0)
    tie = F.concat("item", F.lit("\0"), second.cast("string")) if text else F.col("item") * 2 + second
    ties = colored.withColumn("_tie", tie)
    return _with_bounds(ties, "start", "_tie", keys).drop("_tie")


def _with_bounds(spans: DataFrame, order: str, tiebreak: str | None, keys: list[str]) -> DataFrame:
    placed = running_totals(spans.withColumn("_one", F.lit(1)), {"_at": "_one"}, order, tiebreak, keys)
    return (
        placed.withColumn("low", F.round(F.col("_at") + 0.6, 1)).withColumn("high", F.round(F.col("_at") + 1.4, 1))
        .drop("_one", "_at")
    )
