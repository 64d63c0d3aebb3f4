"""Line dedup by a suffix array over line names, built by distributed prefix doubling. DataFrame code only.

A corpus is a sequence of line names, with a stop after each document. Round k gives every suffix the rank of its
first 2**k lines; the next round sorts suffixes by the pair of their own rank and that of the suffix 2**k lines on.
Suffixes that are alone in their class are settled and leave, so the rounds shrink to the copied stretches and end
with the longest one. A class is an interval of the suffix array with a common prefix of at least 2**k lines; its
members after the first are later copies, and the stretches that they cover are the maximal repeated runs.

No class is gathered anywhere: ranks come from a sort of the distinct pairs, members meet their class by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from periodica.llm.common import text_key
from periodica.session import materialise

#: Lines of a run that is removed whatever its length, and characters of a shorter one that is long enough.
LEAST_LINES, LEAST_CHARS = 3, 150
AT = ["doc", "key"]


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2 ** 63 - 1))


def _named_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, at, a, b, size): the names (a, b) and characters of the lines that are not blank, numbered within their document."""
    full = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: x.rlike(r"\S"))
    rows = docs.select(_doc(id_col).alias("doc"), text_key(text_col).alias("key"), F.posexplode(full).alias("at", "line"))
    return rows.select("doc", "key", "at", F.xxhash64("line").alias("a"), F.hash("line").cast("long").alias("b"), F.length("line").cast("long").alias("size")).dropDuplicates([*AT, "at"])


def _ranked(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The classes of more than one member, with ranks in the order of ``by``; and their members."""
    place = F.struct("doc", "key", "at")
    classes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    # sorted by range, so that ids grow with partition and place: they are ranks in the sort order
    ranks = materialise(classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    members = rows.join(ranks, by).select("doc", "key", "at", "size", "rank", (place != F.col("first")).alias("later"), "first")
    return ranks, materialise(members, "suffixes")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LINES, chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, key, start, stop, first): maximal stretches [start, stop] of later copies of runs of ``least`` or more lines.

    Runs of 1, 2, 4, .. lines below ``least`` count too if their lines have at least ``chars`` characters together. Lines are numbered without blank ones; ``first`` is the place where the longest class at the stretch's start
    stands first. The earliest copy is the one in the smallest document (id, null last; then text), at the first place.
    """
    _, members = _ranked(materialise(_named_lines(docs, id_col, text_col), "lines"), ["a", "b"])
    length, later = 1, None
    while members.limit(1).count():
        enough = F.lit(True) if length >= least else F.col("size") >= chars
        copies = members.filter("later").filter(enough).select("doc", "key", "at", F.lit(length).alias("lines"), "first")
        later = copies if later is None else later.unionByName(copies)
        onward = members.select("doc", "key", (F.col("at") - length).alias("at"), F.col("rank").alias("next"), F.col("size").alias("more"))
        if length < least < 2 * length:  # runs of just ``least`` lines: two overlapping halves
            half = members.select("doc", "key", (F.col("at") - (least - length)).alias("at"), F.col("rank").alias("next"))
            _, exact = _ranked(members.select("doc", "key", "at", "size", "rank").join(half, [*AT, "at"]).withColumnRenamed("rank", "own"), ["own", "next"])
            later = later.unionByName(exact.filter("later").select("doc", "key", "at", F.lit(least).alias("lines"), "first"))
        pairs = members.select("doc", "key", "at", "size", F.col("rank").alias("own")).join(onward, [*AT, "at"]).withColumn(
            "size", F.col("size") + F.col("more")).drop("more")
        _, members = _ranked(pairs, ["own", "next"])
        length *= 2
    if later is None:
        later = members.select("doc", "key", "at", F.lit(0).alias("lines"), "first").limit(0)
    longest = later.groupBy(*AT, "at").agg(F.max("lines").alias("lines"), F.max_by("first", "lines").alias("first"))
    order = W.partitionBy(*AT).orderBy("at")
    stop = F.col("at") + F.col("lines") - 1
    reach = F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("at") > reach + 1), 1).otherwise(0)
    marked = longest.withColumn("stop", stop).withColumn("opens", opens).withColumn("run", F.sum("opens").over(order))
    return marked.groupBy(*AT, "run").agg(
        F.min("at").alias("start"), F.max("stop").alias("stop"), F.min_by("first", "at").alias("first")).drop("run")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LINES, chars: int = LEAST_CHARS) -> DataFrame:
    """All documents with the later copies of repeated line runs removed from the text; adds n_lines, n_removed.

    Runs are those of ``repeated_runs``: ``least`` lines, or fewer with ``chars`` characters. Blank lines are not part of runs; those inside a removed stretch go with it. A null text stays null and has no
    lines, an empty one has one. Rows that repeat id and text are one document and get the same result. Columns of
    the input that are named like the results are replaced.
    """
    runs = repeated_runs(docs, id_col, text_col, least, chars).groupBy(*AT).agg(F.collect_list(F.struct("start", "stop")).alias("_runs"))
    kept = docs.drop("n_lines", "n_removed")
    rows = kept.withColumns({"_doc": _doc(id_col), "_key": text_key(text_col)}).join(
        runs.withColumnsRenamed({"doc": "_doc", "key": "_key"}), ["_doc", "_key"], "left")
    lines = F.split(F.col(text_col), "\n", -1)
    full = F.filter(F.transform(F.col("_lines"), lambda x, i: F.when(x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    spans = F.transform("_runs", lambda r: F.struct(F.get("_full", r["start"]).alias("start"), F.get("_full", r["stop"]).alias("stop")))
    left = F.filter("_lines", lambda x, i: ~F.exists("_spans", lambda r: (i >= r["start"]) & (i <= r["stop"])))
    touched = F.col("_runs").isNotNull()
    rows = rows.withColumn("_lines", F.when(touched, lines)).withColumn("_full", F.when(touched, full)).withColumn(
        "_spans", F.when(touched, spans)).withColumn("_left", F.when(touched, left))
    many = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return rows.select(
        *[F.when(touched, F.array_join("_left", "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns],
        many.alias("n_lines"), F.when(touched, F.size("_lines") - F.size("_left")).otherwise(0).cast("long").alias("n_removed"))
