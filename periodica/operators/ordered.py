"""Order-dependent work over any number of rows: lags, rolling means, running totals, ranks.

A window without a partition, or with one dominant key, would put its rows into one task.
Here the order column is cut into slices that hold about equal shares of all rows, each
slice is handled by its own task, and what a slice needs from earlier ones is carried in:
a sum for running totals, the last k rows for lags and rolling frames. Only keys that can
hold a large share of the rows are sliced; the others keep one ordinary window.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from periodica.operators.joins import hot_keys
from periodica.session import materialise, shuffle_width

SLICE = "_slice"
# A slice is meant to hold this many rows; there are at least as many slices as shuffle partitions.
ROWS_PER_SLICE = 2_000_000
# Rows that a task sorts by key for running totals; a key with more is divided.
ROWS_PER_SORT = 500_000
# Borders that one quantile sketch gives. More are found in a second step, within each of the first ones.
BORDERS = 4_096
WHOLE = -1  # slice number of the keys that are not sliced
INF = float("inf")


def as_number(df: DataFrame, name: str, skip: int = 0) -> Column:
    """A number that never falls while the column grows; slices need no more than that.

    A text is represented by six of its bytes, from place ``skip`` on: those after what all texts share.
    """
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(kind, StringType):
        six = F.hex(F.substring(c.cast("binary"), skip + 1, 6))
        return F.when(c.isNotNull(), F.conv(F.rpad(six, 12, "0"), 16, 10).cast("double"))
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (TimestampNTZType, TimestampType)):
        n = c.cast("timestamp_ntz")
        seconds = F.unix_date(F.to_date(n)) * 86400.0 + F.hour(n) * 3600 + F.minute(n) * 60
        return seconds + F.date_part(F.lit("SECOND"), n).cast("double")
    return c.cast("double")


@dataclass(frozen=True)
class Cuts:
    """Slice borders of an order column; a value holding more than a slice gets a slice of its own,
    divided again by the tie-break column."""

    edges: list[float] = field(default_factory=list)
    heavy: list[float] = field(default_factory=list)
    inner: list[float] = field(default_factory=list)
    skip: int = 0  # leading bytes that all texts of the order column share, if it holds texts
    low: int = 0  # the same of the tie-break


def _marks(numbers: DataFrame, column: str, slices: int | None) -> list[float]:
    """Quantiles of a column, as many as its rows call for; there is no largest number of them."""
    width = shuffle_width(numbers.sparkSession)
    rows = numbers.where(F.col(column).isNotNull() & ~F.isnan(column))
    n = slices or max(width, math.ceil(rows.count() / ROWS_PER_SLICE))
    if n <= BORDERS:
        return _quantiles(rows, column, n)
    coarse = _quantiles(rows, column, BORDERS)
    parts = math.ceil(n / BORDERS)
    grouped = _bucket(rows, column, sorted(set(coarse)), "_part").groupBy("_part").agg(_sketch(column, parts).alias("q"))
    fine = [v for r in grouped.collect() for v in r["q"] or []]  # the borders themselves, sorted below
    return sorted(coarse + fine)


def _sketch(column: str, parts: int) -> Column:
    probs = F.expr("array(" + ", ".join(f"{i / parts!r}D" for i in range(1, parts)) + ")")
    return F.percentile_approx(column, probs, F.lit(max(100, 4 * parts)))


def _quantiles(rows: DataFrame, column: str, parts: int) -> list[float]:
    return list(rows.agg(_sketch(column, parts).alias("q")).first()["q"] or []) if parts > 1 else []


def _shared_bytes(df: DataFrame, name: str) -> int:
    """Leading bytes that the smallest and the largest text have in common; all texts in between share them."""
    if not isinstance(df.schema[name].dataType, StringType):
        return 0
    low, high = df.agg(F.min(f"`{name}`"), F.max(f"`{name}`")).first()
    if low is None or low == high:
        return 0
    a, b = low.encode(), high.encode()
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def find_cuts(df: DataFrame, order: str, tiebreak: str | None = None, slices: int | None = None) -> Cuts:
    """One pass for the count and one for quantiles; further ones, over heavy values only, when there are any.

    Equal values can only be divided by a tie-break. Texts with equal representing bytes need not be
    equal, so a heavy one stays in one slice: order by a shorter or a numeric column where that matters.
    """
    skip = _shared_bytes(df, order)
    ties = tiebreak if tiebreak and not isinstance(df.schema[order].dataType, StringType) else None
    low = _shared_bytes(df, ties) if ties else 0
    numbers = df.select(
        as_number(df, order, skip).alias("_x"), *([as_number(df, ties, low).alias("_t")] if ties else [])
    )
    marks = _marks(numbers, "_x", slices)
    heavy = sorted(v for v, seen in Counter(marks).items() if seen > 1)
    edges = sorted(set(marks) | {math.nextafter(v, INF) for v in heavy})
    inner: list[float] = []
    if heavy and ties:
        inner = sorted(set(_marks(numbers.where(F.col("_x").isin(heavy)), "_t", slices)))
    return Cuts(edges, heavy, inner, skip, low)


def _bucket(df: DataFrame, name: str, edges: list[float], out: str) -> DataFrame:
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [-INF, *[e for e in edges if math.isfinite(e)], INF]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=name, outputCol=out, handleInvalid="keep").transform(df)


def add_slice(df: DataFrame, order: str, cuts: Cuts, tiebreak: str | None = None, out: str = SLICE) -> DataFrame:
    sliced = _bucket(df.withColumn("_sl_x", as_number(df, order, cuts.skip)), "_sl_x", cuts.edges, "_sl_o")
    number = F.col("_sl_o").cast("long")
    if cuts.inner and tiebreak:
        sliced = _bucket(sliced.withColumn("_sl_t", as_number(df, tiebreak, cuts.low)), "_sl_t", cuts.inner, "_sl_i")
        inside = F.when(F.col("_sl_x").isin(cuts.heavy), F.col("_sl_i").cast("long")).otherwise(F.lit(0))
        number = number * (len(cuts.inner) + 2) + inside
    return sliced.withColumn(out, number).drop("_sl_x", "_sl_o", "_sl_t", "_sl_i")


def _names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _ordering(order: str, tiebreak: str | None, descending: bool = False) -> list[Column]:
    cols = [F.col(f"`{c}`") for c in (order, tiebreak) if c]
    return [c.desc_nulls_first() if descending else c.asc_nulls_last() for c in cols]


def slice_for_keys(
    df: DataFrame, order: str, tiebreak: str | None = None, keys=(), slices: int | None = None,
    cuts: Cuts | None = None, limit: int | None = None, share: float | None = None,
) -> DataFrame:
    """Add the slice number: everywhere without keys, and only for hot keys with them.

    Other keys get -1, are left whole and take no part in carrying. A key is hot if it has more rows than a slice should
    (``limit``), or more than a ``share`` of all of them; the hot keys are a table that is joined in, however many there are.
    """
    keys = _names(keys)
    if not keys:
        return add_slice(df, order, cuts or find_cuts(df, order, tiebreak, slices), tiebreak)
    share = share or 1.0 / (slices or 4 * shuffle_width(df.sparkSession))
    marked = df.withColumn("_sl_k", F.xxhash64(*[F.col(f"`{k}`") for k in keys]))
    hot = hot_keys(marked, F.col("_sl_k"), share, limit or ROWS_PER_SLICE)
    if not hot.limit(1).count():
        return df.withColumn(SLICE, F.lit(WHOLE).cast("long"))
    if limit and not (cuts or slices):
        slices = max(4 * shuffle_width(df.sparkSession), math.ceil(df.count() / limit))
    cuts = cuts or find_cuts(df, order, tiebreak, slices)
    sliced = add_slice(marked, order, cuts, tiebreak).join(hot.select(F.col("k").alias("_sl_k"), F.lit(True).alias("_sl_h")), "_sl_k", "left")
    number = F.when(F.col("_sl_h"), F.col(SLICE)).otherwise(F.lit(WHOLE).cast("long"))
    return sliced.withColumn(SLICE, number).select(*df.columns, SLICE)


def carry_rows(sliced: DataFrame, k: int, order: str, tiebreak: str | None = None, keys=()) -> DataFrame:
    """Put the k rows before each slice in front of it, marked ``_carried``."""
    keys = _names(keys)
    per_slice = Window.partitionBy(*keys, SLICE)
    tails = (
        sliced.where(F.col(SLICE) > WHOLE)
        .withColumn("_r", F.row_number().over(per_slice.orderBy(*_ordering(order, tiebreak, True))))
        .where(F.col("_r") <= k)
    )
    # At most k rows of each slice: a bounded list per key.
    by_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(SLICE), F.col("_r").desc())
    # Written once: a few rows per slice, which the rest of the plan reads instead of the input again.
    tails = materialise(tails.withColumn("_p", F.row_number().over(by_key)).drop("_r"), "tails")
    starts = tails.groupBy(*keys, SLICE).agg(F.min("_p").alias("_first"))
    wanted = (
        starts.where(F.col("_first") > 1)
        .withColumn("_p", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_first") - k), F.col("_first") - 1)))
        .select(*[F.col(c).alias(f"_w_{c}") for c in keys], F.col(SLICE).alias("_to"), F.col("_p").alias("_wp"))
    )
    match = F.col("_p") == F.col("_wp")
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    carried = (
        tails.join(wanted, match)
        .withColumn(SLICE, F.col("_to"))
        .select(*sliced.columns)
        .withColumn("_carried", F.lit(True))
    )
    return sliced.withColumn("_carried", F.lit(False)).unionByName(carried)


def lag_columns(
    df: DataFrame, lags: dict[str, tuple[str, int]], order: str, tiebreak: str | None = None, keys=(),
    slices: int | None = None,
) -> DataFrame:
    """Add ``name`` = ``column`` k rows earlier, for every name: (column, k)."""
    depth = max(k for _, k in lags.values())
    ready = carry_rows(slice_for_keys(df, order, tiebreak, keys, slices), depth, order, tiebreak, keys)
    w = Window.partitionBy(*_names(keys), SLICE).orderBy(F.col("_carried").desc(), *_ordering(order, tiebreak))
    shifted = {name: F.lag(F.col(f"`{c}`"), k).over(w) for name, (c, k) in lags.items()}
    return ready.withColumns(shifted).where(~F.col("_carried")).drop("_carried", SLICE)


def lag_all_but(df: DataFrame, target: str, k: int, order: str, tiebreak: str | None = None, keys=(),
                slices: int | None = None) -> DataFrame:
    """Every column but the target, the keys and the order is replaced by its value k rows earlier."""
    kept = {target, order, tiebreak, *_names(keys)}
    moved = [c for c in df.columns if c not in kept]
    lagged = lag_columns(df, {f"_lag_{c}": (c, k) for c in moved}, order, tiebreak, keys, slices)
    return lagged.select(*[F.col(f"`_lag_{c}`").alias(c) if c in moved else F.col(f"`{c}`") for c in df.columns])


def rolling_mean(
    df: DataFrame, column: str, n: int, out: str, order: str, tiebreak: str | None = None, keys=(),
    slices: int | None = None,
) -> DataFrame:
    """Mean of the last n rows; null until there are n values."""
    ready = carry_rows(slice_for_keys(df, order, tiebreak, keys, slices), n - 1, order, tiebreak, keys) \
        if n > 1 else slice_for_keys(df, order, tiebreak, keys, slices).withColumn("_carried", F.lit(False))
    w = (
        Window.partitionBy(*_names(keys), SLICE)
        .orderBy(F.col("_carried").desc(), *_ordering(order, tiebreak))
        .rowsBetween(-(n - 1), 0)
    )
    mean = F.when(F.count(column).over(w) == n, F.avg(column).over(w))
    return ready.withColumn(out, mean).where(~F.col("_carried")).drop("_carried", SLICE)


def previous_known(
    df: DataFrame, columns: list[str], order: str, tiebreak: str | None = None, keys=(), slices: int | None = None,
    outs: dict[str, str] | None = None,
) -> DataFrame:
    """For each column add the last non-null value before the row, as ``<column>_prev``."""
    keys = _names(keys)
    outs = outs or {c: f"{c}_prev" for c in columns}
    sliced = slice_for_keys(df, order, tiebreak, keys, slices)
    place = F.struct(*[F.col(f"`{c}`") for c in (order, tiebreak) if c])
    known = sliced.where(F.col(SLICE) > WHOLE).groupBy(*keys, SLICE).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"_k_{c}") for c in columns]
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    base = known.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], F.col(SLICE).alias("_bs"),
        *[F.last(f"_k_{c}", ignorenulls=True).over(before).alias(f"_base_{c}") for c in columns],
    )
    match = F.col(SLICE) == F.col("_bs")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    w = (
        Window.partitionBy(*keys, SLICE).orderBy(*_ordering(order, tiebreak))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = sliced.join(base, match, "left")
    found = {
        outs[c]: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_base_{c}")) for c in columns
    }
    return joined.withColumns(found).select(*df.columns, *outs.values())


def running_totals(
    df: DataFrame, values: dict[str, str], order: str, tiebreak: str | None = None, keys=(),
    slices: int | None = None, cuts: Cuts | None = None, totals: bool = False,
) -> DataFrame:
    """For every out: column, add the sum of the column over all earlier rows of the key.

    ``totals`` also adds ``<out>_total``, the sum over the whole key. Given ``cuts`` or ``slices`` divide every key;
    otherwise the rows are written once, since counts and sums read them again, and only a key of many rows is divided.
    Rows without an order value count as earlier than the others and are left out, unless no row has one.
    """
    keys = _names(keys)
    extra = [f"{o}_total" for o in values if totals]
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    if keys and not (cuts or slices):
        df = materialise(df, "running")
        known = F.col(f"`{order}`").isNotNull()
        placed = known if df.where(known).limit(1).count() else F.lit(True)
        sliced = slice_for_keys(df, order, tiebreak, keys, limit=ROWS_PER_SORT, share=1.0)
        if not sliced.where(F.col(SLICE) > WHOLE).limit(1).count():
            tasks = math.ceil(df.count() / ROWS_PER_SORT)
            earlier = part.orderBy(F.col(f"`{order}`").isNotNull(), *_ordering(order, tiebreak)).rowsBetween(Window.unboundedPreceding, -1)
            found = {o: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for o, c in values.items()}
            whole = {f"{o}_total": F.sum(c).over(part) for o, c in values.items() if totals}
            dealt = df.repartition(tasks, *keys) if tasks > 1 else df
            return dealt.withColumns({**found, **whole}).where(placed).select(*df.columns, *values, *extra)
        sliced = sliced.withColumn(SLICE, F.when(placed, F.col(SLICE)))
    else:
        sliced = add_slice(df, order, cuts or find_cuts(df, order, tiebreak, slices), tiebreak)
    before = part.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in values.items()])
    base = sums.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys], F.col(SLICE).alias("_bs"),
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_base_{o}") for o in values],
        *[F.sum(f"_s_{o}").over(part).alias(f"{o}_total") for o in values if totals],
    )
    match = F.col(SLICE) == F.col("_bs")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    inside = (
        Window.partitionBy(*keys, SLICE).orderBy(*_ordering(order, tiebreak))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = sliced.join(base, match)
    found = {
        o: F.col(f"_base_{o}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in values.items()
    }
    return joined.withColumns(found).select(*df.columns, *values, *extra)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], keys=(), slices: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key, as ``q0``, ``q1``, ...

    Equal values are counted together first, so the work is a distributed running count
    and not one sorted list per key.
    """
    keys = _names(keys)
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cuts = find_cuts(present, value, slices=slices)
    counts = present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counts, {"_before": "_n"}, "_v", keys=keys, cuts=cuts, totals=True)
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_before_total") - 1)
        for tag, position in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{tag}{i}"))
    found = placed.groupBy(*keys).agg(
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.sum("_n").alias("n"), *picks
    )
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        found = found.withColumn(f"q{i}", lo + (hi - lo) * (at - F.floor(at)))
    return found.drop(*[f"_{t}{i}" for i in range(len(probs)) for t in ("lo", "hi")])


def mid_ranks(counts: DataFrame, value: str, count: str, keys=(), cuts: Cuts | None = None, out: str = "rank") -> DataFrame:
    """Mean rank of each distinct value, given how often it occurs."""
    placed = running_totals(counts, {"_before": count}, value, keys=keys, cuts=cuts)
    return placed.withColumn(out, F.col("_before") + (F.col(count) + 1) / 2.0).drop("_before")


def dense_index(df: DataFrame, key: str, out: str, rows_per_group: int = ROWS_PER_SLICE) -> DataFrame:
    """Number the distinct rows 0, 1, 2, ... in the order of the key's MD5 text.

    The hash spreads any set of names evenly, so each group of equal first digits is numbered by its own
    task and starts where the groups before it end. The count gives the number of digits, and the numbers
    do not depend on it.
    """
    width = shuffle_width(df.sparkSession)
    wanted = max(4 * width, df.count() / rows_per_group)
    digits = max(1, math.ceil(math.log(wanted, 16)))
    hashed = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_g", F.substring("_h", 1, digits))
    base = hashed.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    # one row per group, of which each stands for up to rows_per_group rows
    before = Window.partitionBy(F.lit(0)).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select(F.col("_g").alias("_bg"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_g").orderBy("_h", F.col(key))
    return (
        hashed.join(base, F.col("_g") == F.col("_bg"))
        .withColumn(out, (F.col("_base") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_g", "_h", "_bg", "_base")
    )
