"""Additive daily forecasts: a trend with slope changes plus a weekly pattern.

The shape of the result is ds, yhat, yhat_lower, yhat_upper, trend and weekly. Each series
has been resampled to one row per day before it is fitted, so a series is a few thousand
rows at most however many raw rows its key has; series are spread over tasks by key.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.operators.resample import resample

# Send these functions along with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = 8        # slope changes, spread over the first four fifths of the history
WEEK_TERMS = 3     # sine and cosine pairs
CHANGE_DAYS, WEEK_DAYS = 32, 14  # days from which a series has slope changes and a weekly pattern
RIDGE = 0.05       # shrinkage of the slope changes
Z_80 = 1.2815515655446004  # half width of an 80 percent interval
FORECAST = "ds date, yhat double, yhat_lower double, yhat_upper double, trend double, weekly double"


def fit_and_extend(days: np.ndarray, y: np.ndarray, ahead: int, change_days: int = CHANGE_DAYS,
                   week_days: int = WEEK_DAYS) -> dict[str, np.ndarray]:
    """Ridge regression of one daily series; ``days`` are whole day numbers.

    The trend's slope may change in series of more than ``change_days`` days, and series of at least
    ``week_days`` days have a weekly pattern; shorter ones do not hold enough to tell.
    """
    every = np.concatenate([days, days[-1] + 1 + np.arange(ahead)])
    span = max(float(days[-1] - days[0]), 1.0)
    t = (every - days[0]) / span
    changes = np.linspace(0.0, 0.8, CHANGES + 2)[1:-1] if len(days) > change_days else np.empty(0)
    trend = np.column_stack([np.ones_like(t), t, *[np.maximum(t - c, 0.0) for c in changes]])
    pairs = range(1, WEEK_TERMS + 1) if len(days) >= week_days else range(0)
    turns = [2 * np.pi * k * every / 7.0 for k in pairs]
    weekly = np.column_stack([f(a) for a in turns for f in (np.sin, np.cos)]) if turns else np.zeros((len(t), 0))
    x = np.hstack([trend, weekly])
    n = len(days)
    penalty = np.concatenate([[0.0, 0.0], np.full(len(changes), RIDGE), np.full(weekly.shape[1], 1e-8)])
    gram = x[:n].T @ x[:n] + np.diag(penalty)
    beta = np.linalg.lstsq(gram, x[:n].T @ y, rcond=None)[0]
    yhat = x @ beta
    spare = max(n - x.shape[1], 1)
    deviation = float(np.sqrt(np.sum((y - yhat[:n]) ** 2) / spare))
    cut = trend.shape[1]
    return {
        "day": every, "yhat": yhat, "yhat_lower": yhat - Z_80 * deviation, "yhat_upper": yhat + Z_80 * deviation,
        "trend": trend @ beta[:cut], "weekly": weekly @ beta[cut:],
    }


def forecast(df: DataFrame, ts: str, value: str, how: str, ahead: int, keys=(), change_days: int = CHANGE_DAYS,
             week_days: int = WEEK_DAYS) -> DataFrame:
    """Daily series per key, null days as 0, extended by ``ahead`` days.

    A series is one group of one row per day, also when there are no keys; finer steps are not offered.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    daily = resample(df, ts, "D", {"y": (how, value)}, keys=keys, label="ds", fill=True)
    series = daily.select(*keys, F.unix_date("ds").alias("day"), F.col("y").cast("double").alias("y"))
    out = ", ".join([*[f"{k} {series.schema[k].dataType.simpleString()}" for k in keys], FORECAST])

    def extend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        fitted = fit_and_extend(pdf["day"].to_numpy(), pdf["y"].to_numpy(), ahead, change_days, week_days)
        result = pd.DataFrame({k: v for k, v in fitted.items() if k != "day"})
        result.insert(0, "ds", [d.date() for d in pd.to_datetime(fitted["day"].astype("int64"), unit="D")])
        for i, k in enumerate(keys):
            result.insert(i, k, pdf[k].iloc[0])
        return result

    return series.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(extend, out)
