"""Random forests grown level by level from histograms, and forests as tables and as columns.

A row's weight in a tree's bag is a Poisson draw that follows from the row's key and the tree. One round is one scan:
tasks route their rows through the trees so far and count them by (node, feature, bin, class); the counts of a node
meet in one task, which finds its best split. All counts are whole numbers and all choices follow from keys, so the
forest does not depend on files, partitions or the order of the rows, and the tasks of a round grow with the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from periodica.operators.ordered import exact_quantiles
from periodica.session import materialise, shuffle_width

# Send these functions along with the tasks, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A key's draws, one for each tree, are its run of the minimal standard generator with this modulus and factor.
PRIME, FACTOR = (1 << 31) - 1, 48271
# Candidate thresholds of a feature, and the rows (those with the smallest draws) that they are taken from.
BINS, SAMPLE = 32, 10_000
# Histogram cells that a task holds at a time; nodes beyond that are split in another scan of the same level.
CELLS = 8_000_000
# Nodes that the driver holds at most, by the depth. Deeper forests are scanned down to nodes of so many rows in the bag;
# each of these goes to one task, and the trees below them stay in a table.
HELD, TAIL = 1_000_000, 65_536
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


@dataclass
class Forest:
    """Nodes of all trees in arrays; children are places in them, 0 at a leaf. ``counts`` holds the bag's rows by class."""

    features: list[str]
    classes: list
    weights: list[float]  # of the classes
    fills: dict[str, float] = field(default_factory=dict)  # what replaces a zero of a feature
    tree: list[int] = field(default_factory=list)
    node: list[int] = field(default_factory=list)  # 1 is a tree's root, 2 n and 2 n + 1 are the children of n
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    deep: DataFrame | None = None  # rows of the trees below some of the nodes, where their number follows the rows

    def add(self, tree: int, node: int, counts: list[int]) -> int:
        for held, value in ((self.tree, tree), (self.node, node), (self.feature, -1), (self.threshold, 0.0),
                            (self.left, 0), (self.right, 0), (self.counts, counts), (self.gain, 0.0)):
            held.append(value)
        return len(self.tree) - 1


def key_draw(keys: list[str]) -> Column:
    """A number from 1 to PRIME - 1 from the key's MD5; another part of it than the one that splits off test rows."""
    text = F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 9, 8), 16, 10).cast("long") % (PRIME - 1) + 1).alias("_draw")


def tree_factors(trees: int) -> list[int]:
    return [pow(FACTOR, t + 1, PRIME) for t in range(trees)]


def poisson_steps() -> list[float]:
    """A draw u from 0 to 1 is as many rows as there are steps up to u."""
    return _POISSON.tolist()


def bag_weights(draws: np.ndarray, factor: int) -> np.ndarray:
    """How often each row is in a tree's bag: Poisson with mean 1."""
    return np.searchsorted(_POISSON, (draws * factor % PRIME) / PRIME, side="right")


def _filled(features: list[str], fills: dict[str, float]) -> Column:
    cells = []
    for f in features:
        c = F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0))
        cells.append(F.when(c == 0, F.lit(fills[f])).otherwise(c) if f in fills else c)
    return F.array(*cells)


def medians(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Exact medians of the values other than 0, for the features that have any."""
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("double").alias("v")) for f in features]))
    found = exact_quantiles(df.select(cells).where("v <> 0"), "v", [0.5], keys="f")
    return {r["f"]: r["q0"] for r in found.collect()}


def _leaves(root: int, x: np.ndarray, arrays: tuple) -> np.ndarray:
    feature, threshold, left, right = arrays
    at = np.full(len(x), root)
    while True:
        split = feature[at]
        inner = np.flatnonzero(split >= 0)
        if not len(inner):
            return at
        here = at[inner]
        at[inner] = np.where(x[inner, split[inner]] <= threshold[here], left[here], right[here])


def _arrays(forest: Forest) -> tuple:
    return np.array(forest.feature), np.array(forest.threshold), np.array(forest.left), np.array(forest.right)


def _roots(forest: Forest) -> dict[int, int]:
    return {t: p for p, (t, n) in enumerate(zip(forest.tree, forest.node)) if n == 1}


def _count(forest: Forest, asked: list[int], edges: list[np.ndarray]):
    """Rows (node, cell, n): the bag's rows of the asked nodes (places) by feature, bin and class."""
    arrays, roots = _arrays(forest), _roots(forest)
    wide, classes = len(edges), len(forest.classes)
    number = np.full(len(forest.tree), -1)
    number[asked] = np.arange(len(asked))
    trees = sorted({forest.tree[p] for p in asked})
    factors = dict(enumerate(tree_factors(max(trees) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(asked) * wide * BINS * classes, np.int64)
        for batch in batches:
            draws, label = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(draws), wide)
            cells = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
            cells = (np.arange(wide) * BINS + cells) * classes + label[:, None]
            for t in trees:
                weight = bag_weights(draws, factors[t])
                place = number[_leaves(roots[t], x, arrays)]
                rows = np.flatnonzero((weight > 0) & (place >= 0))
                at = place[rows, None] * (wide * BINS * classes) + cells[rows]
                np.add.at(held, at.ravel(), np.repeat(weight[rows], wide))
        found = np.flatnonzero(held)
        size = wide * BINS * classes
        for low in range(0, max(len(found), 1), 100_000):
            part = found[low:low + 100_000]
            yield pa.RecordBatch.from_pydict({
                "place": pa.array(part // size, pa.int32()), "cell": pa.array(part % size, pa.int32()), "n": pa.array(held[part], pa.int64())})

    return run


def _orders(trees: np.ndarray, nodes: np.ndarray, wide: int) -> np.ndarray:
    """The order in which each node tries its features."""
    x = (trees * 1_000_003 + nodes % PRIME)[:, None] * 257 + np.arange(1, wide + 1)
    for _ in range(3):
        x = x % PRIME * FACTOR % PRIME
    return x.argsort(axis=1, kind="stable")


def _choose(counts: np.ndarray, trees: np.ndarray, nodes: np.ndarray, weight: np.ndarray) -> tuple:
    """Of nodes with counts (node, feature, bin, class): feature or -1, bin, first and last bin that split alike, low and whole counts, gain."""
    wide = counts.shape[1]
    some = max(1, round(wide ** 0.5))

    def impurity(part: np.ndarray) -> np.ndarray:
        """Weighted size times Gini impurity."""
        total = part.sum(axis=-1)
        return total - np.divide((part ** 2).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)

    whole = counts[:, 0].sum(axis=1)
    upto = counts.cumsum(axis=2)[:, :, :-1]
    rest = whole[:, None, None] - upto
    gain = impurity(whole * weight)[:, None, None] - impurity(upto * weight) - impurity(rest * weight)
    gain[(upto.sum(axis=3) == 0) | (rest.sum(axis=3) == 0)] = -1.0
    row = np.arange(len(counts))
    bins, order = gain.argmax(axis=2), _orders(trees, nodes, wide)
    tried = np.take_along_axis(gain.max(axis=2), order, 1)
    at = tried[:, :some].argmax(axis=1)
    none = tried[row, at] <= 1e-9
    at[none] = some + (tried[none, some:] > 1e-9).argmax(axis=1) if wide > some else at[none]
    best = tried[row, at]
    feature = np.where(best > 1e-9, order[row, at], -1)
    cut = bins[row, feature]
    low = np.where(feature[:, None] >= 0, upto[row, feature, cut], 0)
    alike = (upto[row, feature] == upto[row, feature, cut][:, None]).all(axis=2)
    return feature, cut, alike.argmax(axis=1), BINS - 2 - alike[:, ::-1].argmax(axis=1), low, whole, np.where(feature >= 0, best, 0.0)


def _levels(edges: list[np.ndarray], feature: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Thresholds without rows in between do the same; their middle is the farthest from the rows."""
    return np.array([float(edges[f][a] + edges[f][b]) / 2 if f >= 0 else 0.0 for f, a, b in zip(feature.tolist(), first.tolist(), last.tolist())])


def _best_splits(forest: Forest, asked: list[int], edges: list[np.ndarray]):
    """The best split of each node: rows (place, feature or -1, threshold, left counts, all counts, gain)."""
    wide, classes = len(edges), len(forest.classes)
    weight = np.array(forest.weights)
    trees, nodes = np.array([forest.tree[p] for p in asked]), np.array([forest.node[p] for p in asked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("place", pa.int32()), ("cell", pa.int32()), ("n", pa.int64())]))
        places, at = np.unique(held.column("place").to_numpy(), return_inverse=True)
        counts = np.zeros((len(places), wide * BINS * classes), np.int64)
        np.add.at(counts, (at, held.column("cell").to_numpy()), held.column("n").to_numpy())
        feature, _, first, last, low, whole, gain = _choose(counts.reshape(len(places), wide, BINS, classes), trees[places], nodes[places], weight)
        columns = [places, feature, _levels(edges, feature, first, last), low.tolist(), whole.tolist(), gain]
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["place", "feature", "threshold", "low", "whole", "gain"])

    return run


def _bagged(forest: Forest, tails: list[int], edges: list[np.ndarray]):
    """Rows (place, bins of the features, class, weight): the bag's rows at the given nodes."""
    arrays, roots = _arrays(forest), _roots(forest)
    wanted = np.zeros(len(forest.tree), bool)
    wanted[tails] = True
    factors = tree_factors(max(forest.tree) + 1)
    trees = sorted({forest.tree[p] for p in tails})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws, label = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(draws), len(edges))
            cells = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)
            for t in trees:
                weight = bag_weights(draws, factors[t])
                place = _leaves(roots[t], x, arrays)
                rows = np.flatnonzero((weight > 0) & wanted[place])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[rows], pa.int32()), _binary(cells[rows]), pa.array(label[rows], pa.int32()), pa.array(weight[rows], pa.int32())],
                    names=["place", "cells", "y", "w"])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as one value each."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _subtree(tree: int, node: int, cells: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, class_weights: np.ndarray,
             edges: list[np.ndarray], depth: int) -> dict[str, np.ndarray]:
    """All nodes below one, from the bag's rows there; the same splits as by scans, level by level."""
    wide = len(edges)
    size = wide * BINS * classes
    base = (np.arange(wide) * BINS + cells.astype(np.int64)) * classes + label[:, None]
    nodes, held = [np.array([node])], {c: [] for c in ("feature", "threshold", "left", "right", "gain")}
    counts = [np.bincount(label, weight, classes).astype(np.int64)[None]]
    at = np.zeros(len(label), np.int64)  # a row's node among the open ones, -1 at a leaf
    known = 1
    opened = np.zeros(1, np.int64)  # the open ones among the nodes of the last level
    for level in range(node.bit_length() - 1, depth + 1):
        here = len(nodes[-1])
        feature, threshold, gain = np.full(here, -1), np.zeros(here), np.zeros(here)
        left, right = np.zeros(here, np.int64), np.zeros(here, np.int64)
        below, below_counts, next_open = [], [], []
        moved = np.full(len(at), -1)
        if level < depth and len(opened):
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(opened) + 1))
            step = max(1, CELLS // 8 // size)
            new = 0
            for low in range(0, len(opened), step):
                some = opened[low:low + step]
                rows = order[starts[low]:starts[min(low + step, len(opened))]]
                cell = (at[rows] - low)[:, None] * size + base[rows]
                table = np.bincount(cell.ravel(), np.repeat(weight[rows], wide), len(some) * size).astype(np.int64)
                f, cut, first, last, lows, whole, g = _choose(
                    table.reshape(len(some), wide, BINS, classes), np.full(len(some), tree), nodes[-1][some], class_weights)
                split = np.flatnonzero(f >= 0)
                feature[some], gain[some], threshold[some] = f, g, _levels(edges, f, first, last)
                child = np.full(len(some), -1)
                child[split] = new + 2 * np.arange(len(split))
                left[some[split]] = known + child[split]
                right[some[split]] = known + child[split] + 1
                numbers = nodes[-1][some[split]]
                below.append(np.column_stack([2 * numbers, 2 * numbers + 1]).ravel())
                below_counts.append(np.stack([lows[split], whole[split] - lows[split]], axis=1).reshape(-1, classes))
                here_at = at[rows] - low
                moved[rows] = np.where(f[here_at] >= 0, child[here_at] + (cells[rows, f[here_at]] > cut[here_at]), -1)
                new += 2 * len(split)
            below_counts = np.concatenate(below_counts)
            next_open = np.flatnonzero((below_counts > 0).sum(axis=1) > 1)
        for c, v in (("feature", feature), ("threshold", threshold), ("left", left), ("right", right), ("gain", gain)):
            held[c].append(v)
        if not len(below) or not len(below_counts):
            break
        nodes.append(np.concatenate(below))
        counts.append(below_counts)
        known += len(nodes[-1])
        opened = next_open
        place = np.full(len(nodes[-1]) + 1, -1)
        place[opened] = np.arange(len(opened))
        at = place[moved]
        kept = at >= 0
        at, base, cells, weight = at[kept], base[kept], cells[kept], weight[kept]
    return {"node": np.concatenate(nodes), **{c: np.concatenate(v) for c, v in held.items()}, "counts": np.concatenate(counts).ravel()}


_TAILS = "place int, tree int, node array<long>, feature array<int>, threshold array<double>, left array<int>, right array<int>, gain array<double>, counts array<long>"


def _finish(rows: DataFrame, forest: Forest, tails: list[int], edges: list[np.ndarray], depth: int) -> DataFrame:
    """One row for each of the given nodes: the tree below it, grown by the task that gets the bag's rows there."""
    wide, classes, weights = len(edges), len(forest.classes), np.array(forest.weights)
    known = {p: (forest.tree[p], forest.node[p]) for p in tails}
    kinds = {"node": pa.int64(), "feature": pa.int32(), "threshold": pa.float64(), "left": pa.int32(), "right": pa.int32(), "gain": pa.float64(), "counts": pa.int64()}

    def run(part: pa.Table) -> pa.Table:
        place = part.column("place")[0].as_py()
        tree, node = known[place]
        cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(part.num_rows, wide)
        grown = _subtree(tree, node, cells, part.column("y").to_numpy(), part.column("w").to_numpy(), classes, weights, edges, depth)
        return pa.table({"place": pa.array([place], pa.int32()), "tree": pa.array([tree], pa.int32()),
                         **{c: pa.array([grown[c]], pa.list_(k)) for c, k in kinds.items()}})

    bagged = rows.mapInArrow(_bagged(forest, tails, edges), "place int, cells binary, y int, w int")
    dealt = bagged.repartition(max(shuffle_width(rows.sparkSession), math.ceil(len(tails) / 16)), "place")
    return materialise(dealt.groupBy("place").applyInArrow(run, _TAILS), "trees")


def _edges(sample: pd.DataFrame, wide: int) -> list[np.ndarray]:
    """Thresholds of each feature, half way between neighbours among the values, at most BINS - 1."""
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), wide)
    found = []
    for j in range(wide):
        values = np.unique(x[:, j])
        if len(values) > BINS:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS), method="inverted_cdf"))
        found.append((values[1:] + values[:-1]) / 2)
    return found


def fit(train: DataFrame, keys: list[str], features: list[str], label: str, trees: int = 100, depth: int = 4,
        impute: bool = True) -> Forest:
    """A balanced forest; with ``impute``, zeros are replaced by the exact median of the other values first.

    A node tries the root of the number of features, more if none of these splits it. The driver holds a sample for the
    thresholds and the nodes, of deep forests those of more than TAIL rows. Rows with a null label take no part.
    """
    known = materialise(train.where(F.col(label).isNotNull()).select(
        key_draw(keys), F.col(label), *(F.col(f"`{f}`").cast("double").alias(f) for f in features)), "train")
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # one row per class
    classes, total = sorted(sizes), sum(sizes.values())
    forest = Forest(features, classes, [total / (len(classes) * sizes[c]) for c in classes], medians(known, features) if impute else {})
    code = F.coalesce(*(F.when(F.col(label) == c, n) for n, c in enumerate(classes))) if classes else F.lit(0)
    rows = known.select("_draw", _filled(features, forest.fills).alias("x"), code.cast("int").alias("y")).persist()
    try:
        edges = _edges(rows.orderBy("_draw", "x", "y").limit(SAMPLE).toPandas(), len(features))
        open_nodes = [forest.add(t, 1, [0] * len(classes)) for t in range(trees if total else 0)]
        deep = trees << (depth + 1) > HELD
        tails: list[int] = []
        for level in range(depth + 1):
            if deep:
                small = [(sum(forest.counts[p]) or total) <= TAIL for p in open_nodes]
                tails += [p for p, s in zip(open_nodes, small) if s]
                open_nodes = [p for p, s in zip(open_nodes, small) if not s]
            grown: list[int] = []
            most = max(1, CELLS // (len(features) * BINS * len(classes))) if classes else 1
            for low in range(0, len(open_nodes), most):
                grown += _grow(rows, forest, open_nodes[low:low + most], edges, level < depth)
            open_nodes = grown
            if not open_nodes:
                break
        if tails:
            forest.deep = _finish(rows, forest, tails, edges, depth)
        return forest
    finally:
        rows.unpersist()


def _grow(rows: DataFrame, forest: Forest, asked: list[int], edges: list[np.ndarray], more: bool) -> list[int]:
    """Split the asked nodes in one scan; the places of their children that can be split again."""
    if not more and forest.node[asked[0]] > 1:
        return []  # the counts of these leaves came with their parents' splits
    counted = rows.mapInArrow(_count(forest, asked, edges), "place int, cell int, n long")
    splits = counted.repartition(shuffle_width(rows.sparkSession), "place").mapInArrow(
        _best_splits(forest, asked, edges), "place int, feature int, threshold double, low array<long>, whole array<long>, gain double")
    children = []
    for r in sorted(splits.collect(), key=lambda r: r["place"]):  # one row per node
        p = asked[r["place"]]
        forest.counts[p] = list(r["whole"])
        if r["feature"] < 0 or not more:
            continue
        forest.feature[p], forest.threshold[p], forest.gain[p] = r["feature"], r["threshold"], r["gain"]
        high = [a - b for a, b in zip(r["whole"], r["low"])]
        forest.left[p] = forest.add(forest.tree[p], 2 * forest.node[p], list(r["low"]))
        forest.right[p] = forest.add(forest.tree[p], 2 * forest.node[p] + 1, high)
        children += [c for c in (forest.left[p], forest.right[p]) if sum(n > 0 for n in forest.counts[c]) > 1]
    return children


def _shares(counts: np.ndarray, weights: list[float]) -> np.ndarray:
    counts = counts * np.array(weights)
    total = counts.sum(axis=1, keepdims=True)
    return np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)


def leaf_shares(forest: Forest) -> np.ndarray:
    """The weighted share of each class at each node."""
    return _shares(np.array(forest.counts, float).reshape(len(forest.tree), len(forest.classes)), forest.weights)


def score(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``votes``, the sum of the class shares over the trees, and ``prediction``, the class with most, ties to the first."""
    if forest.deep is not None:
        return _predicted(_deep_votes(df, forest), forest)
    shares, arrays, roots, wide = leaf_shares(forest), _arrays(forest), _roots(forest), len(forest.features)

    @F.pandas_udf(ArrayType(DoubleType()))
    def votes(x: pd.Series) -> pd.Series:
        cells = np.array(x.tolist(), float).reshape(len(x), wide)
        total = np.zeros((len(x), shares.shape[1]))
        for tree, root in roots.items():
            total += shares[_leaves(root, cells, arrays)]
        return pd.Series(total.tolist())

    return _predicted(df.withColumn("votes", votes(_filled(forest.features, forest.fills))), forest)


def _deep_votes(df: DataFrame, forest: Forest) -> DataFrame:
    """The rows go to the trees: each is led to the node that a task went on from, and walks the rest where that tree is.

    A node that more than TAIL rows come to has its tree sent to several tasks.
    """
    wide, classes = len(forest.features), len(forest.classes)
    shares, arrays, roots, weights = leaf_shares(forest), _arrays(forest), _roots(forest), forest.weights
    trees = np.array(forest.tree)
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "scored")

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, wide)
            for tree, root in roots.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_leaves(root, x, arrays), pa.int32()), *batch.columns], names=["place", "_row", "x"])

    def walked(trees_here: pa.Table, part: pa.Table) -> pa.Table:
        place = part.column("place").to_numpy()
        if trees_here.num_rows and len(place):
            below = {c: trees_here.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "threshold", "left", "right", "counts")}
            x = part.column("x").combine_chunks().flatten().to_numpy().reshape(len(place), wide)
            at = _leaves(0, x, (below["feature"], below["threshold"], below["left"], below["right"]))
            found = _shares(below["counts"].reshape(-1, classes).astype(float), weights)[at]
        else:
            found = shares[place]
        return pa.table({"_row": part.column("_row"), "tree": pa.array(trees[place], pa.int32()), "share": pa.array(list(found), pa.list_(pa.float64()))})

    routed = rows.select("_row", _filled(forest.features, forest.fills).alias("x")).mapInArrow(led, "place int, _row long, x array<double>")
    parts = materialise(routed.groupBy("place").agg(F.ceil(F.count("*") / TAIL).cast("int").alias("parts")), "parts")
    salted = routed.join(parts, "place").withColumn("part", F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int")).drop("parts")
    sent = forest.deep.join(parts, "place").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    told = sent.groupBy("place", "part").cogroup(salted.groupBy("place", "part")).applyInArrow(walked, "_row long, tree int, share array<double>")
    none = F.array(*(F.lit(0.0) for _ in forest.classes))
    by_tree = F.array_sort(F.collect_list(F.struct("tree", "share")))
    votes = told.groupBy("_row").agg(F.aggregate(by_tree, none, lambda held, s: F.zip_with(held, s["share"], lambda a, b: a + b)).alias("votes"))
    return rows.join(votes, "_row").drop("_row")


def score_columns(df: DataFrame, forest: Forest) -> DataFrame:
    """The same by nested conditions alone, which run without Python and can be kept as SQL text; for shallow trees."""
    if forest.deep is not None:
        raise ValueError("the trees are too deep to be conditions")
    x = _filled(forest.features, forest.fills)
    shares = leaf_shares(forest)

    def leaf(p: int) -> Column:
        if forest.feature[p] < 0:
            return F.lit(p)
        return F.when(F.col("_x")[forest.feature[p]] <= forest.threshold[p], leaf(forest.left[p])).otherwise(leaf(forest.right[p]))

    places = F.array(*(leaf(p) for p in _roots(forest).values()))
    known = F.array(*(F.array(*map(F.lit, row)) for row in shares.tolist()))
    none = F.array(*(F.lit(0.0) for _ in forest.classes))
    votes = F.aggregate("_places", none, lambda held, p: F.zip_with(held, F.get(known, p), lambda a, b: a + b))
    return _predicted(df.withColumn("_x", x).withColumn("_places", places).withColumn("votes", votes).drop("_x", "_places"), forest)


def _predicted(voted: DataFrame, forest: Forest) -> DataFrame:
    place = F.array_position("votes", F.array_max("votes")).cast("int")
    return voted.withColumn("prediction", F.element_at(F.array(*(F.lit(float(c)) for c in forest.classes)), place))


def nodes_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """The forest as data: (tree, node, feature, threshold, left, right, value, rows, impurity, gain), nulls at leaves.

    ``value`` is the class with the largest weighted share, ``rows`` the size of the bag there, impurity Gini's.
    """
    shares = leaf_shares(forest)
    rows = []
    for p in sorted(set(range(len(forest.tree))) - _grown_on(forest)):
        inner = forest.feature[p] >= 0
        rows.append((
            forest.tree[p], forest.node[p], forest.features[forest.feature[p]] if inner else None, forest.threshold[p] if inner else None,
            2 * forest.node[p] if inner else None, 2 * forest.node[p] + 1 if inner else None, float(forest.classes[int(shares[p].argmax())]),
            sum(forest.counts[p]), float(1 - (shares[p] ** 2).sum()), forest.gain[p] if inner else None))
    kinds = "tree int, node long, feature string, threshold double, left long, right long, value double, rows long, impurity double, gain double"
    table = spark.createDataFrame(rows, kinds)
    if forest.deep is None:
        return table
    features, names, weights, k = forest.features, [float(c) for c in forest.classes], forest.weights, len(forest.classes)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r].values.to_numpy() for c in ("node", "feature", "threshold", "gain", "counts")}
                counts = one["counts"].reshape(-1, k)
                share, leaf = _shares(counts.astype(float), weights), one["feature"] < 0
                cells = {
                    "tree": (np.full(len(leaf), batch.column("tree")[r].as_py()), pa.int32()), "node": (one["node"], pa.int64()),
                    "feature": (np.array(features, object)[one["feature"]], pa.string()), "threshold": (one["threshold"], pa.float64()),
                    "left": (2 * one["node"], pa.int64()), "right": (2 * one["node"] + 1, pa.int64()), "value": (np.array(names)[share.argmax(axis=1)], pa.float64()),
                    "rows": (counts.sum(axis=1), pa.int64()), "impurity": (1 - (share ** 2).sum(axis=1), pa.float64()), "gain": (one["gain"], pa.float64())}
                inner = ("feature", "threshold", "left", "right", "gain")
                yield pa.RecordBatch.from_pydict({c: pa.array(v, t, mask=leaf if c in inner else None) for c, (v, t) in cells.items()})

    return table.unionByName(forest.deep.mapInArrow(below, kinds))


def _grown_on(forest: Forest) -> set[int]:
    """Places of the nodes that a row of ``deep`` goes on from."""
    return {r[0] for r in forest.deep.select("place").collect()} if forest.deep is not None else set()


def importances(forest: Forest) -> list[float]:
    """What the splits on each feature take off the impurity, as shares of their tree, averaged; they add up to 1."""
    trees = len(_roots(forest))
    sums = np.zeros((trees, len(forest.features)))
    for tree, feature, gain in zip(forest.tree, forest.feature, forest.gain):
        if feature >= 0:
            sums[tree, feature] += gain
    if forest.deep is not None:
        cells = forest.deep.select("tree", F.inline(F.arrays_zip("feature", "gain"))).where("feature >= 0").groupBy("tree", "feature")
        for r in cells.agg(F.sum("gain").alias("gain")).collect():  # one row per tree and feature
            sums[r["tree"], r["feature"]] += r["gain"]
    total = sums.sum(axis=1, keepdims=True)
    shares = np.divide(sums, total, out=np.zeros_like(sums), where=total > 0)
    grand = shares.sum()
    return (shares.sum(axis=0) / grand if grand else shares.sum(axis=0)).tolist()


def _one_tree(forest: Forest, tree: int) -> Forest:
    """The forest with all nodes of one tree in the arrays."""
    held = ("tree", "node", "feature", "threshold", "left", "right", "counts", "gain")
    out, k = replace(forest, deep=None, **{c: list(getattr(forest, c)) for c in held}), len(forest.classes)
    for r in forest.deep.where(F.col("tree") == tree).collect():  # the size of the tree
        start, n = len(out.tree), len(r["node"])
        counts = [r["counts"][at:at + k] for at in range(0, n * k, k)]
        for c, values in (("tree", [tree] * n), ("node", r["node"]), ("feature", r["feature"]), ("threshold", r["threshold"]), ("gain", r["gain"]),
                          ("left", [start + v for v in r["left"]]), ("right", [start + v for v in r["right"]]), ("counts", counts)):
            getattr(out, c).extend(values)
        for c in held:
            getattr(out, c)[r["place"]] = getattr(out, c)[start]
    return out


def rules(spark: SparkSession, forest: Forest, tree: int = 5) -> DataFrame:
    """The rules of one tree in reading order: (node, kind, rule, depth)."""
    rows: list[tuple] = []
    if forest.deep is not None:
        forest = _one_tree(forest, tree)
    waiting = [(_roots(forest)[tree], 0, None)] if tree in _roots(forest) else []
    shares = leaf_shares(forest)
    while waiting:
        p, depth, rule = waiting.pop()
        if rule:
            rows.append((len(rows), rule[0], rule[1], depth - 1))
        if forest.feature[p] < 0:
            rows.append((len(rows), "predict", str(float(forest.classes[int(shares[p].argmax())])), depth))
            continue
        name, cut = forest.features[forest.feature[p]], forest.threshold[p]
        waiting += [(forest.right[p], depth + 1, ("else", f"({name} > {cut})")), (forest.left[p], depth + 1, ("if", f"({name} <= {cut})"))]
    return spark.createDataFrame(rows, "node int, kind string, rule string, depth int")
