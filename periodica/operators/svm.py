"""A linear support vector machine with a certificate.

The squared hinge loss has a gradient and a generalised Hessian that are sums over the rows, so a Newton step is one scan
and a small linear system. The rows' multipliers at the end give a feasible point of the dual problem; the gap
between the two costs bounds how far the result can be from the best one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Send these functions along with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Svm:
    features: list[str]
    means: list[float]
    spreads: list[float]  # 0 for a constant feature
    weights: list[float]  # the last one belongs to a constant 1
    primal: float
    gap: float
    rounds: int


def _sums(weights: np.ndarray, width: int):
    """Sums over the rows for the shortfalls 1 - y w x above zero: themselves, their squares, times y x, and x x of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + width + width * width)
        for batch in batches:
            x = np.column_stack([batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width - 1), np.ones(batch.num_rows)])
            y = batch.column(1).to_numpy()
            short = np.maximum(0.0, 1.0 - y * (x @ weights))
            near = x[short > 0]
            total += np.concatenate([[short.sum(), (short ** 2).sum()], x.T @ (short * y), (near.T @ near).ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "v": pa.array(total, pa.float64())})

    return run


def fit(train: DataFrame, features: list[str], label: str, cost: float = 1.0, tol: float = 1e-6, most: int = 100) -> Svm:
    """Minimise half the squared weights plus ``cost`` times the squared shortfalls, over standardised features.

    Rounds go on until the duality gap is at most ``tol`` of the cost; raises if ``most`` rounds are not enough. Labels
    are 1 and anything else; rows without a label take no part. The driver holds one Hessian.
    """
    known = train.where(F.col(label).isNotNull())
    row = known.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_samp)]).first()
    means = [row[f"avg{i}"] or 0.0 for i in range(len(features))]
    spreads = [row[f"stddev_samp{i}"] or 0.0 for i in range(len(features))]
    rows = known.select(_scaled(features, means, spreads).alias("x"), F.when(F.col(label) == 1, 1.0).otherwise(-1.0).alias("y")).persist()
    try:
        width = len(features) + 1
        weights, step, value = np.zeros(width), np.zeros(width), np.inf
        for n in range(1, most + 1):
            found = {r["at"]: r["v"] for r in rows.mapInArrow(_sums(weights, width), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
            sums = np.array([found.get(k, 0.0) for k in range(2 + width + width * width)])
            short, squares, pull, curve = sums[0], sums[1], sums[2:2 + width], sums[2 + width:].reshape(width, width)
            primal = 0.5 * float(weights @ weights) + cost * squares
            if primal > value + 1e-12 * abs(value):  # the last step went too far
                step = step / 2
                weights = weights - step
                continue
            value = primal
            dual = 2 * cost * short - 2 * cost ** 2 * float(pull @ pull) - cost * squares
            if primal - dual <= tol * max(1.0, primal):
                return Svm(features, means, spreads, weights.tolist(), primal, primal - dual, n)
            step = np.linalg.solve(np.eye(width) + 2 * cost * curve, 2 * cost * pull - weights)
            weights = weights + step
        raise ArithmeticError(f"the SVM has not converged after {most} rounds")
    finally:
        rows.unpersist()


def _scaled(features: list[str], means: list[float], spreads: list[float]) -> Column:
    return F.array(*(
        (F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(m)) - m) / s if s else F.lit(0.0) for f, m, s in zip(features, means, spreads)))


def score(df: DataFrame, model: Svm) -> DataFrame:
    """Adds ``margin`` and ``prediction`` (1 above zero), without Python in the tasks."""
    x = _scaled(model.features, model.means, model.spreads)
    margin = F.aggregate(F.zip_with(x, F.array(*map(F.lit, model.weights[:-1])), lambda a, b: a * b), F.lit(model.weights[-1]), lambda a, b: a + b)
    return df.withColumn("margin", margin).withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(0.0))
