"""k-means for many numbers of clusters and many reference sets at once, and the gap statistic.

A round of Lloyd's method is one scan for all fits together: every task sends the partial sums of its points for each
centre of each fit that still moves. Coordinates and costs are added up as whole multiples of 2**-24, and starts follow
from a hash of the keys, so a result does not depend on files, partitions or the order of the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.session import materialise
from periodica.sources.artifacts import CHECKPOINT_DAYS, ArtifactStore

# Send these functions along with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
UNIT = float(1 << 24)
# Points with the smallest hashes that the starts are chosen from, tries for a start, and rounds of each try.
START_POINTS, START_TRIES, START_ROUNDS = 4_000, 3, 40
# A fit rests when the squared steps of its centres add up to no more than this share of a coordinate's mean variance.
TOLERANCE = 1e-4

Fit = tuple[int, int]  # set (0 the own points, then the reference sets) and number of clusters


def standardised(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds ``features``, an array of the columns with mean 0 and sample deviation 1; constant columns are 0, nulls too."""
    row = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{f.__name__}{i}") for i, c in enumerate(features) for f in (F.avg, F.stddev_samp)]).first()
    cells = []
    for i, c in enumerate(features):
        mean, spread = row[f"avg{i}"], row[f"stddev_samp{i}"]
        cells.append(F.coalesce((F.col(f"`{c}`").cast("double") - mean) / spread, F.lit(0.0)) if spread else F.lit(0.0))
    return df.withColumn("features", F.array(*cells))


def uniform(names: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A point of the unit cube for each 64-bit name, the same in every process (splitmix64 of name, seed and place)."""
    with np.errstate(over="ignore"):
        x = names.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1 + seed * width, 1 + (seed + 1) * width, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _set(points: np.ndarray, names: np.ndarray, number: int) -> np.ndarray:
    """The points of a set as whole multiples of 1 / UNIT."""
    return np.rint((points if number == 0 else uniform(names, points.shape[1], number - 1)) * UNIT)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, ties to the smaller number, and its squared distance."""
    square = np.zeros((len(points), len(centres)))
    for j in range(points.shape[1]):  # one coordinate at a time, so that the sum has one order everywhere
        square += (points[:, j, None] - centres[None, :, j]) ** 2
    best = square.argmin(axis=1)
    return best, square[np.arange(len(points)), best]


def _partial_sums(fits: dict[Fit, np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {fit: np.zeros((len(c), width + 2), object) for fit, c in fits.items()}
        for batch in batches:
            names = batch.column(0).to_numpy()
            own = batch.column(1).flatten().to_numpy().reshape(len(names), width)
            for number in {s for s, _ in fits}:
                points = _set(own, names, number)
                for fit in (f for f in fits if f[0] == number):
                    best, square = nearest(points, fits[fit])
                    told = np.column_stack([points, np.ones(len(points)), np.rint(square / UNIT)]).astype(np.int64)
                    held = np.zeros((len(fits[fit]), width + 2), np.int64)
                    np.add.at(held, best, told)
                    sums[fit] += held
        rows = [(s, k, c, *map(int, row)) for (s, k), held in sums.items() for c, row in enumerate(held) if row[width]]
        columns = list(zip(*rows)) or [[]] * (width + 5)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int32() if n < 3 else pa.decimal128(38, 0)) for n, x in enumerate(columns)], names=_names(width))

    return run


def _names(width: int) -> list[str]:
    return ["set", "k", "centre", *(f"s{j}" for j in range(width)), "n", "cost"]


def _round(points: DataFrame, fits: dict[Fit, np.ndarray], width: int) -> dict[Fit, tuple[np.ndarray, float]]:
    """One scan: for each fit the mean of the points of each centre (the centre itself if it has none) and the cost."""
    names = _names(width)
    schema = ", ".join(f"{n} int" if i < 3 else f"{n} decimal(38,0)" for i, n in enumerate(names))
    found = points.mapInArrow(_partial_sums(fits, width), schema).groupBy(*names[:3]).agg(
        *(F.sum(n).alias(n) for n in names[3:])).collect()  # a row per centre
    means, costs = {fit: c.copy() for fit, c in fits.items()}, dict.fromkeys(fits, 0)
    for r in found:
        fit = r["set"], r["k"]
        means[fit][r["centre"]] = [float(r[f"s{j}"]) / float(r["n"]) for j in range(width)]
        costs[fit] += int(r["cost"])
    return {fit: (means[fit], costs[fit] / UNIT) for fit in fits}


def _start(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres to start from: the cheapest of a few tries, by squared distances and some rounds, on a small sample."""
    best, lowest = points[:1].repeat(k, axis=0), math.inf
    for attempt in range(START_TRIES):
        rng = np.random.default_rng([seed, k, attempt])
        chosen = points[rng.integers(len(points))][None]
        while len(chosen) < k:
            weight = nearest(points, chosen)[1]
            chosen = np.vstack([chosen, points[np.searchsorted(np.cumsum(weight), rng.random() * weight.sum()) if weight.any() else 0]])
        for _ in range(START_ROUNDS):
            at, square = nearest(points, chosen)
            size = np.bincount(at, minlength=k)
            means = np.column_stack([np.bincount(at, points[:, j], k) for j in range(points.shape[1])]) / np.maximum(size, 1)[:, None]
            before, chosen = chosen, np.where(size[:, None] > 0, means, chosen)
            if (before == chosen).all():
                break
        cost = nearest(points, chosen)[1].sum()
        if cost < lowest:
            best, lowest = chosen, cost
    return best


def fit_all(scaled: DataFrame, key: str, width: int, counts: list[int], references: int = 0, seed: int = SEED,
            most: int = 1000) -> dict[Fit, tuple[list[list[float]], float]]:
    """Centres and cost of every number of clusters in ``counts``, for the own points and each reference set.

    ``scaled`` has the key, without two rows alike, and ``features``. Raises if ``most`` rounds are not enough. What the
    driver holds is the sample of the starts and the centres. Without rows there are no fits.
    """
    points = materialise(scaled.select(F.xxhash64(F.col(key), F.lit(seed)).alias("name"), "features"), "points").persist()
    try:
        sample = points.orderBy("name").limit(START_POINTS).toPandas()
        if sample.empty:
            return {}
        names, own = sample["name"].to_numpy(), np.array(sample["features"].tolist(), float).reshape(len(sample), width)
        moving = {(s, k): _start(_set(own, names, s), k, seed) for s in range(references + 1) for k in counts}
        allowed = [TOLERANCE * float(_set(own, names, s).var(axis=0).mean()) for s in range(references + 1)]
        resting: dict[Fit, np.ndarray] = {}
        for _ in range(most):
            if not moving:
                break
            for fit, (means, _) in _round(points, moving, width).items():
                step = float(((means - moving[fit]) ** 2).sum())
                moving[fit] = means
                if step <= allowed[fit[0]]:
                    resting[fit] = moving.pop(fit)
        if moving:
            raise ArithmeticError(f"k-means has not converged after {most} rounds")
        return {fit: ((resting[fit] / UNIT).tolist(), cost) for fit, (_, cost) in _round(points, resting, width).items()}
    finally:
        points.unpersist()


def gap_statistic(scaled: DataFrame, key: str, width: int, most: int = 10, references: int = 3,
                  kept: dict[int, list[list[float]]] | None = None) -> list[tuple[int, float]]:
    """(clusters, gap) for 1..most: log of the mean cost on uniform rows minus log of the own cost.

    ``kept`` receives the centres of the own data, so the best ones need not be fitted again.
    """
    fits = fit_all(scaled, key, width, list(range(1, most + 1)), references)
    gaps = []
    for k in range(1, most + 1):
        own = fits[0, k][1] if fits else 0.0
        mean = sum(fits[s, k][1] for s in range(1, references + 1)) / references if fits else 0.0
        gaps.append((k, math.log(mean) - math.log(own) if own > 0 and mean > 0 else float("nan")))
        if kept is not None and fits:
            kept[k] = fits[0, k][0]
    return gaps


def best_k(gaps: list[tuple[int, float]]) -> int:
    return max((g for g in gaps if not math.isnan(g[1])), key=lambda g: g[1])[0]


def assign_clusters(scaled: DataFrame, key: str, k: int, centres: list[list[float]] | None = None) -> DataFrame:
    """Adds ``prediction``, the nearest of the given centres, or of those fitted here; without Python in the tasks."""
    if centres is None:
        width = len(scaled.select("features").first()["features"])
        centres = fit_all(scaled, key, width, [k])[0, k][0]
    x = F.col("features")
    square = lambda c: sum(((x[j] - v) * (x[j] - v) for j, v in enumerate(c)), F.lit(0.0))
    return scaled.withColumn("prediction", F.array_min(F.array(*(
        F.struct(square(c).alias("square"), F.lit(n).alias("cluster")) for n, c in enumerate(centres))))["cluster"])


def name_clusters(assigned: DataFrame, member: str, named, name: str) -> DataFrame:
    """cluster_<i>, and ``name`` for the cluster that holds one given member.

    The cluster of that member is a scalar subquery, so no cluster is gathered into one task.
    """
    own = assigned.where(F.col(member) == F.lit(named)).agg(F.min("prediction")).scalar()
    number: Column = F.col("prediction")
    label = F.when(number == own, name).otherwise(F.concat(F.lit("cluster_"), number.cast("string")))
    return assigned.select(member, label.alias("cluster"))


def save_clusters(store: ArtifactStore, named: DataFrame, member: str, key: str, now: datetime) -> None:
    """Keep the cluster of every member as a checkpoint."""
    store.save(named.select(F.col(member).alias("item"), F.col("cluster").alias("payload")), key, None, None, now, CHECKPOINT_DAYS)


def load_clusters(store: ArtifactStore, key: str, now: datetime, member: str) -> DataFrame:
    return store.latest(now, key).select(F.col("item").alias(member), F.col("payload").alias("cluster"))
