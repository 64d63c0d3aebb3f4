"""Filter interaction audit: what each of five filters removes, in every order they can be applied in.

A document that fails the filters in the set f survives a set of filters s if s and f have nothing in common. All of
this for one document is one 32-bit word: bit s is set if the document survives the filters of s. Adding the words up
bit by bit gives the survivors of each of the 32 sets, and every figure of every order is a difference of those.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from periodica.session import materialise

#: Letters of the filters, in the order of their bits; the last one is the filter on repeated texts.
LETTERS = "ABCDE"
SETS = 1 << len(LETTERS)
REPEATED = SETS >> 1
_SPACE = r"[\x20\x09-\x0D]+"
#: SURVIVAL[f] is the word of a document that fails the filters in the set f.
SURVIVAL = np.array([sum(1 << s for s in range(SETS) if not s & f) for f in range(SETS)], np.uint32)


def text_tests(text: str | Column) -> list[Column]:
    """Failure conditions A to D of a text: few words, few different words, many capitals, odd signs."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.array_remove(F.split(c, _SPACE), "")
    capitals = F.length(c) - F.length(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 3 * F.length(c).cast("long"),
        c.rlike("[#$%&*|]"),
    ]


def classes(docs: DataFrame, tests: Sequence[Column], doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents counted by what they fail: rows (doc_id, part, fails, docs, firsts).

    ``fails`` holds the bits of ``tests`` (at most four); ``firsts`` counts the documents whose text no smaller id has.
    Every document is one row by then, save for rows that share an id. A null part is the empty one, a null text the
    empty one; a document without an id repeats no text and no document repeats it.

    The first holder of a text is a minimum of (id, row) that is taken where the rows are, so copies of one text never
    meet in one task; it is not joined back to the documents, but counted beside them.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(text, F.lit("")).alias("text"))
    bits = sum((F.when(t, 1 << n).otherwise(0) for n, t in enumerate(tests)), F.lit(0))
    told = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("name"), bits.cast("int").alias("fails"))
    same = materialise(told.groupBy("name", "part", "fails", "doc_id").agg(F.count(F.lit(1)).alias("n")), "fails")
    least = same.filter(F.col("doc_id").isNotNull()).groupBy("name", "part", "fails").agg(F.min(F.struct("doc_id", "n")).alias("least"))
    found = least.groupBy("name").agg(F.collect_list(F.struct("least", "part", "fails")).alias("held"))  # a row per part
    lowest = F.array_min(F.transform("held", lambda h: h["least"]["doc_id"]))
    firsts = found.withColumn("lowest", lowest).select(F.inline(F.filter("held", lambda h: h["least"]["doc_id"] == F.col("lowest"))))
    counted = same.select("doc_id", "part", "fails", F.col("n").alias("docs"), F.when(
        F.col("doc_id").isNull(), F.col("n")).otherwise(0).alias("firsts"))
    return counted.unionByName(firsts.select(
        F.col("least.doc_id").alias("doc_id"), "part", "fails", F.lit(0).cast("long").alias("docs"), F.col("least.n").alias("firsts"),
    )).groupBy("doc_id", "part", "fails").agg(F.sum("docs").alias("docs"), F.sum("firsts").alias("firsts"))


def positional_popcount(words: np.ndarray, times: np.ndarray) -> list[int]:
    """How often each bit is set in 32-bit words of which each counts a number of times.

    A carry-save adder takes three words of one weight to one of that weight and one of twice the weight, so the words
    of a weight shrink by a third each step; bits are only counted in the one or two words that are left of a weight.
    """
    totals, weight = [0] * SETS, 0
    carried: list[np.ndarray] = []
    while len(times) or carried:
        odd = (times & 1).astype(bool)
        level = np.concatenate([words[odd], *carried])
        carried = []
        while len(level) > 2:
            third = len(level) // 3
            a, b, c, rest = level[:third], level[third:2 * third], level[2 * third:3 * third], level[3 * third:]
            half = a ^ b
            carried.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, rest])
        for word in level.tolist():
            for s in range(SETS):
                totals[s] += (word >> s & 1) << weight
        more = times > 1
        words, times, weight = words[more], times[more] >> 1, weight + 1
    return totals


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str], list[int]] = {}
    for batch in batches:
        part = batch.column("part").to_numpy(zero_copy_only=False)
        fails, docs, firsts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fails", "docs", "firsts"))
        groups = {"all": np.ones(len(part), bool), **{c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic")}}
        names, place = np.unique(part.astype(str), return_inverse=True)
        for n, name in enumerate(names.tolist()):
            for label, member in groups.items():
                at = (place == n) & member
                words = np.concatenate([SURVIVAL[fails[at] | REPEATED], SURVIVAL[fails[at]]])
                counted = positional_popcount(words, np.concatenate([docs[at] - firsts[at], firsts[at]]))
                held = sums.setdefault((name, label), [0] * SETS)
                sums[name, label] = [a + b for a, b in zip(held, counted)]
    yield pa.RecordBatch.from_pydict({
        "part": pa.array([p for p, _ in sums], pa.string()), "label": pa.array([g for _, g in sums], pa.string()),
        "survivors": pa.array(list(sums.values()), pa.list_(pa.int64()))})


def survivors(counted: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Survivors of each set of filters: rows (part, label, subset, docs), label all, good or toxic.

    ``counted`` is the result of ``classes``. A document is good (toxic) if any of its rows in ``labels`` has quality
    (toxic) 1; labels of documents that are not there, and labels without an id, count nothing.
    """
    told = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = counted.filter(F.col("doc_id").isNotNull()).join(told, "doc_id", "left").select(
        "part", "fails", "docs", "firsts", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    unnamed = counted.filter(F.col("doc_id").isNull()).select("part", "fails", "docs", "firsts", *(F.lit(False).alias(c) for c in ("good", "toxic")))
    sums = named.unionByName(unnamed).mapInArrow(_survivors, "part string, label string, survivors array<long>")
    return sums.select("part", "label", F.posexplode("survivors").alias("subset", "docs")).groupBy("part", "label", "subset").agg(
        F.sum("docs").alias("docs"))


def orders(found: DataFrame) -> DataFrame:
    """The report: a row per part, order of the filters and step, from the result of ``survivors``.

    kept and removed count documents after and at the step; redundant fail the step's filter but were gone before;
    unique_fails fail no other filter; good_lost and toxic_lost are among the removed; shapley is what the filter
    removes summed over all orders. An empty table has no parts and gives no rows.
    """
    wide = found.groupBy("part", "label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("subset", "docs"))), lambda s: s["docs"]).alias("left")).groupBy("part").pivot(
        "label", ["all", "good", "toxic"]).agg(F.first("left"))
    names = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = wide.select("*", F.explode(names).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))

    def subset(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(x)), 1 << n).otherwise(0) for n, x in enumerate(LETTERS)), F.lit(0))

    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = subset(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    placed = steps.select("*", letter.alias("letter"), before.alias("before"), subset(letter).alias("bit"))
    left = lambda label, s: F.element_at(label, (s + 1).cast("int"))
    after, whole = F.col("before") + F.col("bit"), F.lit(SETS - 1)
    lost = lambda label: left(label, F.col("before")) - left(label, after)
    told = placed.select(
        "part", "filter_order", "step", "letter", left("all", after).alias("kept"), lost("all").alias("removed"),
        (left("all", F.lit(0)) - left("all", F.col("bit")) - lost("all")).alias("redundant"),
        (left("all", whole - F.col("bit")) - left("all", whole)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    return told.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "letter"))).drop("letter")
