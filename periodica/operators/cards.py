"""Period-to-date measures: one pass over the year to date serves all four periods."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.periods import PERIODS, payroll_to_date, period_start_of


def _ntz(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def _to_date(ts: str, as_of: datetime, period: str) -> Column:
    return (F.col(ts) >= _ntz(period_start_of(as_of, period))) & (F.col(ts) <= _ntz(as_of))


def _any_period(df: DataFrame, ts: str, as_of: datetime) -> DataFrame:
    """Rows of the longest period; a week may begin in the year before."""
    first = min(period_start_of(as_of, p) for p in PERIODS)
    return df.where((F.col(ts) >= _ntz(first)) & (F.col(ts) <= _ntz(as_of)))


def _flagged(df: DataFrame, ts: str, as_of: datetime, keys: list[str]) -> DataFrame:
    """Distinct keys with a flag per period in which they occur."""
    flags = [F.bool_or(_to_date(ts, as_of, p)).alias(f"_{p}") for p in PERIODS]
    return _any_period(df, ts, as_of).groupBy(*keys).agg(*flags)


def _stack(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per period out of columns ``<column>_<period>``."""
    rows = [
        F.struct(F.lit(p).alias("period"), *[F.col(f"{c}_{p}").alias(out) for out, c in columns.items()])
        for p in PERIODS
    ]
    return df.select(F.inline(F.array(*rows)))


def value_cards(df: DataFrame, ts: str, as_of: datetime, variable: str, how: str, distinct: bool = True) -> DataFrame:
    """Per period to date: sum (whole number), mean (3 digits) or count of the **distinct** values.

    ``distinct=False`` counts every row instead.
    """
    if distinct:
        base = _flagged(df, ts, as_of, [variable])
        held = {p: F.when(F.col(f"_{p}"), F.col(variable)) for p in PERIODS}
    else:
        base = _any_period(df, ts, as_of)
        held = {p: F.when(_to_date(ts, as_of, p), F.col(variable)) for p in PERIODS}
    if how.strip() == "sum":
        measure = lambda c: F.coalesce(F.sum(c).cast("long"), F.lit(0)).cast("double")
    elif how.strip() == "mean":
        measure = lambda c: F.round(F.avg(c), 3)
    else:
        measure = lambda c: F.count(c).cast("double")
    return _stack(base.agg(*[measure(held[p]).alias(f"v_{p}") for p in PERIODS]), {"value": "v"})


def entity_cards(df: DataFrame, ts: str, as_of: datetime, entity: str) -> DataFrame:
    """Distinct entities per period to date."""
    flags = _flagged(df, ts, as_of, [entity])
    return _stack(flags.agg(*[F.count_if(F.col(f"_{p}")).alias(f"n_{p}") for p in PERIODS]), {"entities": "n"})


def cost_cards(df: DataFrame, ts: str, as_of: datetime, outcome: str, features: list[str]) -> DataFrame:
    """Per period to date, over distinct rows: row count, summed outcome, payroll per unit of outcome,
    and outcome per unit of each feature ('*' where a feature sums to 0, '0' where the outcome does)."""
    held = [ts, outcome, *features]
    rows = _any_period(df, ts, as_of).select(*dict.fromkeys(held)).distinct()
    measures = []
    for p in PERIODS:
        inside = _to_date(ts, as_of, p)
        measures.append(F.count_if(inside).alias(f"n_{p}"))
        for c in dict.fromkeys([outcome, *features]):
            measures.append(F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).alias(f"{c}_{p}"))
    sums = rows.agg(*measures)
    out = {"rows": "n", outcome: outcome, **{f"_f_{f}": f for f in features}}
    stacked = _stack(sums, out)
    payroll = None
    for p in PERIODS:
        pay = payroll_to_date(_ntz(as_of), p)
        payroll = F.when(F.col("period") == p, pay) if payroll is None else payroll.when(F.col("period") == p, pay)
    total = F.col(outcome).cast("double")
    cost = F.round(F.try_divide(payroll, total), 2)
    ratios = {}
    for f in features:
        denominator = F.col(f"_f_{f}").cast("double")
        ratios[f"{outcome}_per_{f}"] = (
            F.when(total == 0, F.lit("0")).when(denominator == 0, F.lit("*"))
            .otherwise(F.round(total / denominator, 3).cast("decimal(28,3)").cast("string"))
        )
    return stacked.withColumns({"payroll_per_unit": cost, **ratios}).drop(*[f"_f_{f}" for f in features])


def hierarchy_cards(df: DataFrame, ts: str, as_of: datetime, group: str = "project") -> DataFrame:
    """Project, milestone and task measures per period to date, over distinct rows.

    project: distinct projects; milestone: distinct per project, summed; task: rows per project
    and milestone, summed; durations and delays: means per group, summed; remuneration: sum.
    The task measures count the distinct rows of the table, so equal rows are merged first.
    """
    rows = _any_period(df, ts, as_of).distinct()
    flags = {p: _to_date(ts, as_of, p) for p in PERIODS}
    milestone = rows.groupBy(group, "milestone").agg(
        *[F.count(F.when(flags[p], F.col("task"))).alias(f"_tasks_{p}") for p in PERIODS],
        *[F.bool_or(flags[p]).alias(f"_any_{p}") for p in PERIODS],
        *[F.sum(F.when(flags[p], F.col("task_duration"))).alias(f"_sum_{p}") for p in PERIODS],
        *[F.count(F.when(flags[p], F.col("task_duration"))).alias(f"_cnt_{p}") for p in PERIODS],
        *[F.sum(F.when(flags[p], F.col("remuneration"))).alias(f"_pay_{p}") for p in PERIODS],
    )
    project = milestone.groupBy(group).agg(
        *[F.count_if(F.col(f"_any_{p}") & F.col("milestone").isNotNull()).alias(f"_milestones_{p}") for p in PERIODS],
        *[F.bool_or(F.col(f"_any_{p}")).alias(f"_any_{p}") for p in PERIODS],
        *[F.sum(f"_tasks_{p}").alias(f"_tasks_{p}") for p in PERIODS],
        *[F.sum(F.try_divide(f"_sum_{p}", f"_cnt_{p}")).alias(f"_hours_{p}") for p in PERIODS],
        *[F.try_divide(F.sum(f"_sum_{p}"), F.sum(f"_cnt_{p}")).alias(f"_mean_{p}") for p in PERIODS],
        *[F.sum(f"_pay_{p}").alias(f"_pay_{p}") for p in PERIODS],
    )
    total = project.agg(
        *[F.count_if(F.col(f"_any_{p}")).alias(f"project_{p}") for p in PERIODS],
        *[F.sum(f"_milestones_{p}").alias(f"milestone_{p}") for p in PERIODS],
        *[F.sum(f"_tasks_{p}").alias(f"task_{p}") for p in PERIODS],
        *[F.coalesce(F.round(F.sum(f"_mean_{p}"), 2), F.lit(0.0)).alias(f"days_{p}") for p in PERIODS],
        *[F.coalesce(F.round(F.sum(f"_hours_{p}"), 2), F.lit(0.0)).alias(f"hours_{p}") for p in PERIODS],
        *[F.coalesce(F.sum(f"_pay_{p}"), F.lit(0)).cast("double").alias(f"pay_{p}") for p in PERIODS],
    )
    return _stack(total, {
        "projects": "project", "milestones": "milestone", "tasks": "task",
        "project_days": "days", "task_hours": "hours", "remuneration": "pay",
    })


def card_text(kind: str, value: Column) -> Column:
    """Display text of a card value."""
    if kind == "money":
        return F.concat(F.lit("$"), F.format_number(value, 2))
    if kind == "percent":
        return F.concat(F.round(value, 3).cast("string"), F.lit("%"))
    if kind in ("days", "hours"):
        return F.concat(F.round(value, 2).cast("string"), F.lit(f" {kind}"))
    return F.concat(value.cast("long").cast("string"), F.lit(f" {kind}s"))
