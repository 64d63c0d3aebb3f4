"""Chat formatting: reply trees become conversations in a marked-up template, and are read back from it.

Everything is DataFrame code. A tree is a set of (tree, node, parent, score) rows; paths are enumerated by
self-joins that double the distance to an ancestor, so a chain of n replies takes log2(n) joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from periodica.session import materialise

#: The template's control strings and the codes that stand for them inside texts.
ESCAPES = [("\\", "\\0"), ("<s>", "\\1"), ("</s>", "\\2"), ("[INST]", "\\3"), ("[/INST]", "\\4")]
OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """No control string is left in the result: a backslash is followed by the number of what it stands for."""
    return reduce(lambda c, e: _replace(c, *e), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: _replace(c, e[1], e[0]), ESCAPES[::-1], text)


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """The ``branches`` best root-to-leaf paths of each tree: rows (tree, path, node, depth), depth 0 at the root.

    ``nodes`` has tree, node (unique over all trees), parent (null at a root) and score (null: 0). A path's score is
    the sum of its nodes' scores; ties go to the smaller leaf. A parent that is not there makes its child a root;
    nodes on a cycle have no root and give no path. A path is named by its leaf.
    """
    known = nodes.select(F.col("node").alias("parent")).filter(F.col("parent").isNotNull()).distinct()
    rooted = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    roots = rooted.filter(F.col("parent").isNull())  # kept out of the join, where they would all meet in one task
    placed = rooted.filter(F.col("parent").isNotNull()).join(known.withColumn("there", F.lit(True)), "parent", "left")
    jumps = materialise(placed.withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there").unionByName(roots).select(
        "tree", "node", F.col("parent").alias("up"), F.lit(1).alias("hops"), "score"), "jumps")
    total = jumps.count()
    levels = [jumps]
    while (waiting := levels[-1].filter(F.col("up").isNotNull())).limit(1).count() and 2 ** (len(levels) - 1) <= total:
        now = levels[-1]
        above = now.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"),
                           F.col("score").alias("plus"))
        further = waiting.join(above, "up").select(
            "tree", "node", F.col("further").alias("up"), (F.col("hops") + F.col("more")).alias("hops"),
            (F.col("score") + F.col("plus")).alias("score"))
        levels.append(materialise(now.filter(F.col("up").isNull()).unionByName(further), "jumps"))
    parents = jumps.filter(F.col("up").isNotNull()).select(F.col("up").alias("node")).distinct()
    leaves = levels[-1].filter(F.col("up").isNull()).join(parents, "node", "left_anti")
    best = W.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    chosen = leaves.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= branches)
    paths = chosen.select("tree", F.col("node").alias("path"), "node", (F.col("hops") - 1).alias("depth"))
    for k in range(len(levels) - 2, -1, -1):  # each path is extended by its nodes' 2**k-th ancestors
        step = levels[k].filter(F.col("up").isNotNull()).select("node", "up")
        above = paths.join(step, "node").select("tree", "path", F.col("up").alias("node"), (F.col("depth") - 2 ** k).alias("depth"))
        paths = materialise(paths.unionByName(above), "paths")
    return paths


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees of one branch each: tree, node, parent, score, role, text.

    Rows go by turn, ties by role and text; a null turn comes first, a null role or text is empty. Rows with a null
    conversation form one conversation. Other columns are left out.
    """
    held = materialise(rows.select(
        F.col(conv).alias("tree"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("node")), "turns")
    order = W.partitionBy("tree").orderBy("_turn", "role", "text", "node")
    parents = held.select("tree", "_turn", "role", "text", "node").select("node", F.lag("node").over(order).alias("parent"))
    return held.join(parents, "node").select("tree", "node", "parent", F.lit(0.0).alias("score"), "role", "text")


def format_paths(nodes: DataFrame, paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per path: tree, path, formatted, loss: the (start, length) of each text of role ``learn``, from 0.

    Starts and lengths count code points of ``formatted``.
    """
    turns = paths.join(nodes.select("node", "role", "text"), "node").select(
        "tree", "path", "depth", "role", escape(F.col("role")).alias("head"), escape(F.col("text")).alias("body"))
    before = F.length("head") + len(OPEN) + len(MIDDLE)
    held = turns.select(
        "tree", "path", F.struct(
            "depth", F.concat(F.lit(OPEN), "head", F.lit(MIDDLE), "body", F.lit(CLOSE)).alias("shown"),
            (F.col("role") == learn).alias("learn"), before.alias("before"), F.length("body").alias("size")).alias("turn"))
    whole = held.groupBy("tree", "path").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.aggregate(
        "turns", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + t["before"] + t["size"] + len(CLOSE)).alias("at"),
            F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + t["before"]).alias("start"), t["size"].alias("length"))))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return whole.select("tree", "path", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text), and ``learned``, the text under the loss mask, from the format alone."""
    turns = F.transform(
        F.split("formatted", CLOSE, -1),
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
            unescape(F.substring_index(t, MIDDLE, -1)).alias("text")))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.slice(turns, F.lit(1), F.size(turns) - 1)).withColumn("learned", F.array_join(learned, ""))
