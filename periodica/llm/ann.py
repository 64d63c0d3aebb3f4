"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

A shard is a bounded part of the vectors, dealt by a class of the norm and a hash of the id. Its graph is built in one task: levels are drawn
as in the usual construction, and on each level a node keeps up to ``M`` (bottom: 2 ``M``) neighbours that the
diversity rule picks from its nearest ones, with the reverse edges. Neighbours lie in flat arrays, one row per node.
Queries are searched in blocks: all queries of a block descend the levels and expand their candidates together.

Equal vectors are one node that lists its ids, so copies neither cut the graph nor crowd out the beam. Inner products
are turned into angles by one more coordinate that makes all norms equal. Beside a far longer vector all others would
become one point, so a shard's norms differ by a bounded factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.session import materialise

#: Vectors per shard and queries per block.
SHARD, BLOCK = 16_384, 2_048
M, NEAREST, BEAM = 16, 48, 96
LEVELS = 8
#: Norms of a shard lie within a factor of two to this power.
NORM_BITS = 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and a vector that has a component other than 0 and none that is null or not finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0))


def _norm_class(v: Column) -> Column:
    """The number of the vector's norm class; 1 is in the middle of class 0. Scaled, so that no square overflows."""
    top = F.array_max(F.transform(v, F.abs))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / top) * (x / top))
    return F.floor((F.log2(top) + F.log2(square) / 2) / NORM_BITS + 0.5).cast("long")


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the k rows of largest inner product, nearest first, in blocks of rows."""
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 1024):
        near = x[at:at + 1024] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(-near, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
        out[at:at + 1024] = np.take_along_axis(top, order, 1)
    return out


def _diverse(x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """The diversity rule for all nodes at once: a neighbour is kept if none kept before is nearer to it than the node.

    Free places are filled with the nearest ones left. -1 marks an empty place.
    """
    n, k = near.shape
    out = np.full((n, most), -1, np.int32)
    for at in range(0, n, 512):
        some = near[at:at + 512]
        vectors = x[some]
        own = np.einsum("nkd,nd->nk", vectors, x[at:at + 512])
        mutual = np.einsum("nkd,nld->nkl", vectors, vectors)
        kept = np.zeros(some.shape, bool)
        for j in range(k):
            kept[:, j] = ~(kept[:, :j] & (mutual[:, j, :j] > own[:, j, None])).any(axis=1)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :most]
        out[at:at + 512, :order.shape[1]] = np.take_along_axis(some, order, 1)
    return out


def _with_reverse(links: np.ndarray, most: int) -> np.ndarray:
    """Adds edges back, so that a node can be reached from those it names; up to ``most`` per node."""
    n = len(links)
    source, place = np.nonzero(links >= 0)
    target = links[source, place]
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    rank = np.concatenate([place, place + links.shape[1]])
    order = np.lexsort((rank, a))
    a, b = a[order], b[order]
    pair = a.astype(np.int64) * n + b
    _, first = np.unique(pair, return_index=True)
    first.sort()
    a, b = a[first], b[first]
    at = np.arange(len(a)) - np.searchsorted(a, a, "left")
    out = np.full((n, most), -1, np.int32)
    out[a[at < most], at[at < most]] = b[at < most]
    return out


def build(x: np.ndarray, m: int = M, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the bottom: (nodes, neighbours) with neighbours as rows of node numbers, -1 where empty."""
    rng = np.random.default_rng(seed)
    top = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(m)).astype(int), LEVELS - 1)
    levels = []
    for level in range(int(top.max()) + 1):
        nodes = np.flatnonzero(top >= level)
        sub, most = x[nodes], 2 * m if level == 0 else m
        if len(nodes) == 1:
            links = np.full((1, 1), -1, np.int32)
        else:
            near = _nearest(sub, min(NEAREST, len(nodes) - 1))
            links = _with_reverse(_diverse(sub, near, most), 2 * most)
        levels.append((nodes.astype(np.int32), np.where(links >= 0, nodes[links], -1).astype(np.int32)))
    return levels


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """For each query the nodes of its beam (-1 where fewer were found), by best-first search from the top level."""
    n = len(queries)
    best = np.full(n, levels[-1][0][0], np.int64)
    score = np.einsum("qd,qd->q", queries, x[best])
    for nodes, links in levels[:0:-1]:
        moving = np.arange(n)
        while len(moving):
            near = links[np.searchsorted(nodes, best[moving])]
            value = np.where(near >= 0, np.einsum("qkd,qd->qk", x[near], queries[moving]), -np.inf)
            pick = value.argmax(axis=1)
            gain = value[np.arange(len(moving)), pick]
            better = gain > score[moving]
            moving, pick, gain, near = moving[better], pick[better], gain[better], near[better]
            best[moving], score[moving] = near[np.arange(len(moving)), pick], gain
    links = levels[0][1]
    found = np.full((n, beam), -1, np.int64)
    value = np.full((n, beam), -np.inf, x.dtype)
    open_ = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    found[:, 0], value[:, 0], open_[:, 0] = best, score, True
    seen[np.arange(n), best] = True
    live = np.arange(n)
    while len(live):
        waiting = np.where(open_[live], value[live], -np.inf)
        width = min(4, beam)  # the best open nodes of each query are expanded together
        pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
        usable_ = np.take_along_axis(waiting, pick, 1) > -np.inf
        open_[live[:, None], pick] = False
        near = links[np.where(usable_, found[live[:, None], pick], 0)]
        near = np.where(usable_[:, :, None], near, -1).reshape(len(live), -1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        seen[live[row], near[row, col]] = True
        # a node that two expanded nodes name is taken once
        key = row * len(x) + near[row, col]
        _, first = np.unique(key, return_index=True)
        row, col = row[first], col[first]
        new = np.full(near.shape, -np.inf, x.dtype)
        new[row, col] = np.einsum("rd,rd->r", x[near[row, col]], queries[live[row]])
        both_v = np.concatenate([value[live], new], axis=1)
        both_n = np.concatenate([found[live], near], axis=1)
        both_o = np.concatenate([open_[live], new > -np.inf], axis=1)
        keep = np.argpartition(-both_v, beam - 1, axis=1)[:, :beam]
        value[live] = np.take_along_axis(both_v, keep, 1)
        found[live] = np.where(value[live] > -np.inf, np.take_along_axis(both_n, keep, 1), -1)
        open_[live] = np.take_along_axis(both_o, keep, 1)
        live = live[open_[live].any(axis=1)]
    return found


def _pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """One row per (shard, dimension): flat arrays of the ids, the vectors and the levels' neighbours.

    All usable rows are indexed. Vectors of another length form shards of their own and are found by queries of that
    length alone. The number of shards follows the number of rows of a norm class, their size does not.
    """
    rows = usable(vectors, id_col, vector_col).withColumn("class", _norm_class(F.col("v")))
    counts = rows.groupBy("class").count().collect()  # some hundred classes hold all doubles
    shards = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["class"], -(-r["count"] // shard))]), F.col("class")) if counts else F.lit(1)
    number = F.shiftleft("class", 40) + F.pmod(F.xxhash64("id", F.lit(1)), shards)
    dealt = rows.select(number.alias("shard"), F.size("v").alias("dim"), "id", "v")

    def make(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        ids = table["id"].to_numpy()
        flat = table["v"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(ids), dim)
        order = np.argsort(ids, kind="stable")
        ids, flat = ids[order], flat[order]
        raw = np.ascontiguousarray(flat + 0.0)
        names = raw.view(np.dtype((np.void, raw.dtype.itemsize * dim))).ravel()
        _, first, group = np.unique(names, return_index=True, return_inverse=True)
        nodes = flat[first]
        members = np.argsort(group, kind="stable")  # ids ascend within a node
        starts = np.searchsorted(group[members], np.arange(len(first) + 1), "left")
        scaled = nodes / np.abs(nodes).max()
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        top = norm.max()
        unit = np.concatenate([scaled / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))[:, None]], axis=1).astype("f4")
        levels = build(unit)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()),
            "ids": [_pack(ids[members])], "starts": [_pack(starts.astype("i8"))], "nodes": [_pack(nodes)], "unit": [_pack(unit)],
            "level_nodes": [[_pack(n) for n, _ in levels]], "level_links": [[_pack(k) for _, k in levels]]})

    return dealt.groupBy("shard", "dim").applyInArrow(
        make, "shard long, dim int, ids binary, starts binary, nodes binary, unit binary, level_nodes array<binary>, level_links array<binary>")


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows by inner product, without the rows of its own id.

    Scores are products of the original vectors in double precision; ties go to the smaller id. Each block of queries
    meets each shard of its dimension once. Queries that repeat an id count once, with one of their vectors.
    """
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"])
    asked = materialise(asked.select("id", F.size("v").alias("dim"), "v"), "queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)))
    places = index.select(F.col("shard").alias("to"), F.col("dim").alias("size"))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    routed = asked.join(places, F.col("dim") == F.col("size"))  # a query goes to every shard: the stated queries against all rows

    def find(key: tuple, table: pa.Table, held: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if table.num_rows and held.num_rows:
            dim = key[1].as_py()
            row = held.slice(0, 1).to_pylist()[0]
            ids, starts = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["starts"], "i8")
            nodes = np.frombuffer(row["nodes"], "f8").reshape(-1, dim)
            unit = np.frombuffer(row["unit"], "f4").reshape(-1, dim + 1)
            levels = [(n := np.frombuffer(a, "i4"), np.frombuffer(b, "i4").reshape(len(n), -1))
                      for a, b in zip(row["level_nodes"], row["level_links"], strict=True)]
            names = table["id"].to_numpy()
            vectors = table["v"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(len(names), dim)
            for at in range(0, len(names), 256):
                some = vectors[at:at + 256]
                scaled = some / np.sqrt((some * some).sum(axis=1, keepdims=True))
                asked_ = np.concatenate([scaled, np.zeros((len(some), 1))], axis=1).astype("f4")
                for q, hit in enumerate(search(unit, levels, asked_, max(BEAM, 2 * k))):
                    out.append(_best(names[at + q], some[q], hit[hit >= 0], ids, starts, nodes, k))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "f8")]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    hits = routed.groupBy("to", "size", "block").cogroup(spread.groupBy("shard", "dim", "block")).applyInArrow(
        find, "query_id long, vec_id long, score double")
    from pyspark.sql import Window as W

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(query: int, vector: np.ndarray, hit: np.ndarray, ids: np.ndarray, starts: np.ndarray, nodes: np.ndarray, k: int):
    """Up to k rows (query, id, score) of the nodes found; a node of equal vectors gives its smallest ids."""
    score = (nodes[hit] * vector).sum(axis=1)
    parts = [ids[starts[h]:min(starts[h + 1], starts[h] + k + 1)] for h in hit]
    every, values = np.concatenate(parts), np.repeat(score, [len(p) for p in parts])
    other = every != query
    every, values = every[other], values[other]
    order = np.lexsort((every, -values))[:k]
    return np.full(len(order), query), every[order], values[order]
