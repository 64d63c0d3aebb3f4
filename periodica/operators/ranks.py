"""Rank sums of many tests in one sort.

Rank tests need, for every group of a sample, the sum of the ranks of its values. The distinct cells (outcome, value,
groups, count) are sorted once, by ranges over all partitions. Each partition carries a vector of running counts, one
for each test, along its values and reports sums relative to its own start. Sums are linear in what came before, so
the reports, a few rows a partition, are put together afterwards, and nothing is sorted or read a second time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periodica.session import shuffle_width

# Send these functions along with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_REPORT = "outcome string, v double, edge boolean, test int, level string, n long, twice decimal(38,0), ties double"


class _Sums:
    """Counts and doubled rank sums by test and level, relative to where the stretch of values starts."""

    def __init__(self, outcome: str, v: float, tests: int):
        self.outcome, self.v = outcome, v
        self.cells: list[dict[str, list[int]]] = [{} for _ in range(tests)]
        self.before, self.ties = [0] * tests, [0.0] * tests

    def add(self, test: int, level: str, n: int, twice: int) -> None:
        cell = self.cells[test].setdefault(level, [0, 0])
        cell[0] += n
        cell[1] += twice

    def absorb(self, group: _Sums) -> None:
        """Take in the counts of one value, which is larger than all so far."""
        for test, cells in enumerate(group.cells):
            equal = sum(n for n, _ in cells.values())
            for level, (n, _) in cells.items():
                self.add(test, level, n, n * (2 * self.before[test] + equal + 1))
            self.before[test] += equal
            self.ties[test] += float(equal) ** 3 - equal

    def rows(self, edge: bool) -> list[tuple]:
        return [
            (self.outcome, self.v, edge, test, level, n, twice, self.ties[test] if not k else 0.0)
            for test, cells in enumerate(self.cells) for k, (level, (n, twice)) in enumerate(cells.items())
        ]


def _report(tests: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        inner: _Sums | None = None  # the values between the partition's first and last one, of one outcome
        group: _Sums | None = None  # the value that may go on in the next batch
        first = True

        def close() -> None:
            """The open value is complete: the first one of the partition may go on in an earlier partition."""
            nonlocal inner, group, first
            if first:
                rows.extend(group.rows(True))
                first = False
            else:
                if inner is None or inner.outcome != group.outcome:
                    if inner is not None:
                        rows.extend(inner.rows(False))
                    inner = _Sums(group.outcome, group.v, tests)
                inner.absorb(group)
            group = None

        for batch in batches:
            if not batch.num_rows:
                continue
            outcome = batch.column(0).dictionary_encode()
            o, v, c = outcome.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            names = outcome.dictionary.to_pylist()
            coded = [batch.column(3 + t).dictionary_encode() for t in range(tests)]
            codes = [a.indices.fill_null(-1).to_numpy() for a in coded]
            levels = [a.dictionary.to_pylist() for a in coded]
            starts = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))
            ends = np.append(starts[1:], len(v))

            def counted(at: int) -> None:
                """Add the rows of one value of this batch to the open value."""
                nonlocal group
                here = slice(starts[at], ends[at])
                if group is not None and (group.outcome, group.v) != (names[o[starts[at]]], v[starts[at]]):
                    close()
                if group is None:
                    group = _Sums(names[o[starts[at]]], float(v[starts[at]]), tests)
                for t in range(tests):
                    known = codes[t][here] >= 0
                    sums = np.bincount(codes[t][here][known], c[here][known], len(levels[t]))
                    for k in np.flatnonzero(sums):
                        group.add(t, levels[t][k], int(sums[k]), 0)

            counted(0)
            last = len(starts) - 1
            if last > 0:
                close()
                inside = o[starts[1:last]]
                for run_of in np.split(np.arange(1, last), np.flatnonzero(inside[1:] != inside[:-1]) + 1):
                    if not len(run_of):
                        continue
                    name = names[o[starts[run_of[0]]]]
                    if inner is None or inner.outcome != name:
                        if inner is not None:
                            rows.extend(inner.rows(False))
                        inner = _Sums(name, float(v[starts[run_of[0]]]), tests)
                    low, high = starts[run_of[0]], ends[run_of[-1]]
                    of = np.repeat(np.arange(len(run_of)), ends[run_of] - starts[run_of])
                    for t in range(tests):
                        code = codes[t][low:high]
                        known = code >= 0
                        part = np.where(known, c[low:high], 0)
                        equal = np.bincount(of, part, len(run_of)).astype(np.int64)
                        twice = 2 * (np.cumsum(equal) - equal) + equal + 1
                        n = np.bincount(code[known], part[known], len(levels[t]))
                        r = np.bincount(code[known], part[known] * twice[of[known]].astype(float), len(levels[t]))
                        for k in np.flatnonzero(n):
                            inner.add(t, levels[t][k], int(n[k]), int(r[k]) + 2 * inner.before[t] * int(n[k]))
                        inner.before[t] += int(equal.sum())
                        inner.ties[t] += float((equal.astype(float) ** 3 - equal).sum())
                counted(last)
        if group is not None:
            rows.extend(group.rows(True))
        if inner is not None:
            rows.extend(inner.rows(False))
        kinds = [pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.string(), pa.int64(), pa.decimal128(38, 0), pa.float64()]
        columns = list(zip(*rows)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(map(int, x)) if k == 6 else x, kind) for k, (x, kind) in enumerate(zip(columns, kinds))],
            names=[f.split()[0] for f in _REPORT.split(", ")])

    return run


def rank_sums(cells: DataFrame, outcome: str, value: str, count: str, levels: list[str], parts: int | None = None) -> DataFrame:
    """Rows (outcome, test, level, n, centred, total, ties) for each outcome and each test of ``levels``.

    A cell stands for ``count`` equal rows; ``levels`` names a column for each test, with the group of the rows, or null
    if they take no part. n rows of the group have a rank sum of n (total + 1) / 2 + ``centred``, where total is the size
    of all groups of the test together; ties is the sum of t^3 - t over their equal values. Cells need not be distinct,
    but should be: cells of one value are cut between partitions by their levels alone. The value must be a number.
    """
    told = cells.select(
        F.col(outcome).cast("string").alias("outcome"), F.col(value).cast("double").alias("v"), F.col(count).cast("long").alias("c"),
        *(F.col(f"`{x}`").cast("string").alias(f"l{t}") for t, x in enumerate(levels))).where("v is not null and not isnan(v) and c > 0")
    by = ["outcome", "v", *(f"l{t}" for t in range(min(len(levels), 8)))]  # what divides equal values; the rest need not
    dealt = told.repartitionByRange(parts or shuffle_width(cells.sparkSession), *by).sortWithinPartitions("outcome", "v")
    found = dealt.mapInArrow(_report(len(levels)), _REPORT)
    # from here on, a few rows for each partition, test and level; a value cut by a border is put together first
    whole = found.groupBy("outcome", "v", "edge", "test", "level").agg(F.sum("n").alias("n"), F.sum("twice").alias("twice"), F.sum("ties").alias("ties"))
    same = Window.partitionBy("outcome", "test", "v")
    upto = Window.partitionBy("outcome", "test").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    n, equal = F.col("n").cast("decimal(20,0)"), F.col("equal")
    placed = whole.withColumn("equal", F.sum("n").over(same)).withColumn("before", F.sum("n").over(upto) - equal)
    t = equal.cast("double")
    first = F.row_number().over(same.orderBy("level")) == 1
    sums = placed.select(
        "outcome", "test", "level", "n", F.when(F.col("edge"), F.when(first, t * t * t - t).otherwise(0.0)).otherwise(F.col("ties")).alias("ties"),
        (F.coalesce(F.when(F.col("edge"), n * (equal + 1)).otherwise(F.col("twice")).cast("decimal(38,0)"), F.lit(0))
         + (n * (2 * F.col("before")).cast("decimal(18,0)")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("twice"),
    ).groupBy("outcome", "test", "level").agg(F.sum("n").alias("n"), F.sum("twice").cast("decimal(38,0)").alias("twice"), F.sum("ties").alias("ties"))
    each = Window.partitionBy("outcome", "test")
    full = sums.withColumn("total", F.sum("n").over(each)).withColumn("ties", F.sum("ties").over(each))
    middle = (n * (F.col("total") + 1).cast("decimal(18,0)")).cast("decimal(38,0)")
    names = F.array(*(F.lit(x) for x in levels))
    return full.select(
        "outcome", F.element_at(names, F.col("test") + 1).alias("test"), "level", "n",
        ((F.col("twice") - middle).cast("double") / 2).alias("centred"), "total", "ties")
