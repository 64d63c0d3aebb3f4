"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

SuperMinHash gives every element of a set its ranks from one random permutation of the signature's places, so the
places of a signature are correlated and its estimate varies less than with independent hashes. Places are served
level by level; the walk stops early, once every place holds a value below the next level.

Documents with equal shingle sets form a class, and one member stands for it. Classes that share a band are
candidates; a link counts only if the full sets confirm it. Inside a bucket no pairs are listed: a leader is compared
with the others, linked classes merge, and only buckets that still hold more than one component get new leaders
(from all components but the largest) until none does. A class that has led a bucket has met all of it, so every
candidate link between different components is looked at.

Shingles that only one candidate class holds are in no intersection. Their number bounds the similarity of a pair from
above, so most unlinked pairs need no sets; and the class with the smallest share of them leads first, since it is the
one most of its bucket derives from.

That first leader is the pivot of its bucket in later rounds. What two classes share is at most the smaller of their
shares with the pivot, and what they share outside it. So a later leader meets only classes that hold one of its
shingles outside the pivot, and those whose shares with the pivot are enough by themselves, which are found by size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodica.llm.common import forget_words, mix, text_key, word_hashes
from periodica.llm.graph import stars
from periodica.session import materialise

ROWS = 5
#: A pair at the threshold shares no band with at most this probability.
MISS = 1e-6
#: Classes that lead a bucket in the second round; each round after it has GROWTH times as many.
LEADERS, GROWTH = 8, 64
#: Classes of sizes within about one part in so many are sought together.
SIZES = 50
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    share = (percent / 100) ** rows
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))


def shingle_set(text: str | bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of k words, A-Z in lower case.

    Fewer words are one shingle, no words are an empty set.
    """
    data = text.encode("utf-8", "replace") if isinstance(text, str) else text
    words = word_hashes(data.lower().split()) if data else np.empty(0, np.uint64)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < k:
            value = np.uint64(len(words))
            for w in words:
                value = mix(np.array([value * ODD + w], np.uint64))[0]
            return np.array([value], np.uint64)
        n = len(words) - k + 1
        total = words[:n].copy()
        for i in range(1, k):
            total = mix(total) * ODD + words[i:i + n]
        return np.unique(mix(total + np.uint64(k)))


def superminhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (set, place) of non-empty sets, computed together."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.full((len(sets), size), np.inf)
    places = out.reshape(-1)
    order = np.tile(np.arange(size, dtype=np.int16 if size > 255 else np.uint8), (len(flat), 1))
    with np.errstate(over="ignore"):
        for level in range(size):
            random = mix(flat + ODD * np.uint64(level + 1))
            swap = level + (mix(random ^ ODD) % np.uint64(size - level)).astype(np.int64)
            rows = np.arange(len(flat))
            place = order[rows, swap]
            order[rows, swap] = order[:, level]
            np.minimum.at(places, owner * size + place, level + (random >> np.uint64(11)) * 2.0 ** -53)
            open_ = out.max(axis=1) >= level + 1  # a later level cannot lower the others
            if not open_.any():
                break
            keep = open_[owner]
            if not keep.all():
                flat, owner, order = flat[keep], owner[keep], order[keep]
    return out


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of a signature; keys of different bands differ."""
    parts = signatures.view(np.uint64).reshape(len(signatures), -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2])
        for i in range(rows):
            key = mix(key * ODD + parts[:, :, i])
    return key


def _sketch(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """(_id, _text key) with n, class (128-bit name of the shingle set) and band keys; null where the set is empty."""
    schema = T.StructType([docs.schema["_id"], T.StructField("key", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("class", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            sizes, names, keys = [], [], []
            waiting: list[np.ndarray] = []

            def flush() -> None:
                full = [s for s in waiting if len(s)]
                got = iter(band_keys(superminhash(full, bands * ROWS)).view(np.int64)) if full else iter(())
                keys.extend(next(got) if len(s) else None for s in waiting)
                waiting.clear()

            for value in texts:
                found = shingle_set(value.as_py(), k)
                sizes.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                waiting.append(found)
                if sum(map(len, waiting[-256:])) > 100_000 or len(waiting) >= 256:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=schema.names)
        forget_words()

    return docs.select("_id", "_key", "_text").mapInArrow(run, schema)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(class, shingles, no) of the given texts, one row for each class; ``no`` is a number that holds once written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingle_set(t.as_py(), k) for t in batch.column(0).slice(at, 512).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                     pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["class", "shingles"])
        forget_words()

    return docs.select("_text").mapInArrow(run, "class binary, shingles array<long>").dropDuplicates(["class"]).withColumn("no", F.monotonically_increasing_id())


def _alone(sets: DataFrame) -> DataFrame:
    """(class, alone): how many of a class's shingles no other class holds."""
    held = sets.select("no", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("holders"), F.min("no").alias("no"))
    own = held.filter("holders = 1").groupBy("no").agg(F.count("*").alias("alone"))
    return sets.select("class", "no").join(own, "no", "left").select("class", F.coalesce("alone", F.lit(0)).alias("alone"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return pairs.join(left, "a").join(right, "b").filter(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _similar(most: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can be linked if they share at most so many."""
    return 100 * most >= percent * (n + m - most)


def _pair() -> list[Column]:
    return [F.least("class", "c").alias("a"), F.greatest("class", "c").alias("b")]


def _first_leaders(left: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes, with the class that leads its bucket first: its pivot.

    The columns m and lone are the pivot's n and alone.
    """
    central = (F.col("alone") / F.col("n")).alias("share")
    first = left.groupBy("bucket").agg(F.min(F.struct(central, "class", "n", "alone")).alias("lead"), F.count("*").alias("parts")).filter("parts > 1")
    return left.join(first, "bucket").select(
        "bucket", "class", "n", "alone", F.col("lead.class").alias("pivot"), F.col("lead.n").alias("m"), F.col("lead.alone").alias("lone"))


def _compare_pivots(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: classes and pivots of their buckets that may be similar.

    An intersection holds none of the shingles that either class has alone.
    """
    most = F.least(F.col("n") - F.col("alone"), F.col("m") - F.col("lone"))
    return members.withColumn("c", F.col("pivot")).filter((F.col("class") != F.col("c")) & _similar(most, F.col("n"), F.col("m"), percent)).select(
        *_pair()).distinct()


def _around(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the classes of buckets hold inside and outside of the buckets' pivots.

    (pivot, class, n, inside) and (pivot, class, n, inside, shingle, place, outside); outside of a pivot only shingles
    count that two of its classes hold, and a class has them in places from the rarest on.
    """
    met = members.select("pivot", "class").distinct()
    rest = F.array_except("shingles", "p")
    split = materialise(met.join(sets.select("class", "shingles"), "class").join(
        sets.select(F.col("class").alias("pivot"), F.col("shingles").alias("p")), "pivot").select(
        "pivot", "class", F.size("shingles").cast("long").alias("n"), rest.alias("rest")).withColumn(
        "inside", F.col("n") - F.size("rest")), "outside")
    each = split.select("pivot", "class", "n", "inside", F.explode("rest").alias("shingle"))
    held = each.groupBy("pivot", "shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
    own = W.partitionBy("pivot", "class")
    shared = each.join(held, ["pivot", "shingle"]).select(
        "pivot", "class", "n", "inside", "shingle", F.row_number().over(own.orderBy("holders", "shingle")).alias("place"), F.count("*").over(own).alias("outside"))
    return split.drop("rest"), materialise(shared, "rare")


def _compare_around(leaders: DataFrame, members: DataFrame, inside: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: leaders and members of a bucket that belong to different components, have met its pivot and may be similar.

    A pair shares at most the smaller of both parts inside the pivot. If that is not enough, so many of the shingles
    outside have to be shared that the rarest of these is not among the last in either class.
    """
    now = members.select("class", "component").distinct()
    led = leaders.select("pivot", "class", F.col("component").alias("other")).distinct()
    own = [F.col("class").alias("c"), "other", F.col("n").alias("m"), F.col("inside").alias("within")]
    apart = F.col("component") != F.col("other")
    in_both = F.least("inside", "within")
    scale = lambda size: F.floor(F.log(size.cast("double")) * SIZES)
    least = F.greatest(F.lit(1), F.floor(F.col("m") * percent / 100))
    most = F.floor(F.col("within") * (100 + percent) / percent) - F.col("m") + 1
    sized = inside.join(led, ["pivot", "class"]).select("pivot", *own).filter(most >= least).withColumn("size", F.explode(F.sequence(scale(least), scale(most))))
    alike = inside.join(now, "class").withColumn("size", scale(F.col("n"))).join(sized, ["pivot", "size"]).filter(
        apart & _similar(in_both, F.col("n"), F.col("m"), percent))
    missing = lambda least, held: F.greatest(F.lit(1), F.ceil(least - F.lit(1e-6)) - held)
    rare = shared.join(led, ["pivot", "class"]).select("pivot", "shingle", *own, F.col("place").alias("at"), F.col("outside").alias("beyond")).filter(
        F.col("at") + missing(F.col("m") * percent / 100, F.col("within")) <= F.col("beyond") + 1)
    needed = missing((F.col("n") + F.col("m")) * percent / (100 + percent), in_both)
    joint = shared.join(now, "class").join(rare, ["pivot", "shingle"]).filter(
        apart & (F.col("at") + needed <= F.col("beyond") + 1) & (F.col("place") + needed <= F.col("outside") + 1))
    return alike.select(*_pair()).union(joint.select(*_pair())).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Words are runs of anything but ASCII white space; A-Z are lower-cased. Two documents are linked if their sets of
    k-word shingles have 100 * intersection >= percent * union. The component's id is the smallest id in it; a
    document is kept if it has that id, so rows that repeat an id are kept together. Null ids sort after all others
    and their rows are kept only in a component without any id. Null, empty and blank texts are linked to nothing.
    """
    bands = bands_for(percent)
    source = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"), F.col(text_col).cast("string").alias("_text"))
    sketch = materialise(_sketch(source, k, bands), "sketches")
    classes = sketch.filter("class is not null").groupBy("class").agg(
        F.min("_id").alias("first"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    held = materialise(classes, "classes")
    rows = held.select(F.explode("bands").alias("bucket"), "class", "n")
    shared = rows.groupBy("bucket").count().filter("count > 1").select("bucket")
    left = materialise(rows.join(shared, "bucket"), "buckets")
    wanted = held.join(left.select("class").distinct(), "class", "left_semi").select(F.col("key").alias("_key"))
    sets = materialise(_sets(source.join(wanted, "_key", "left_semi").dropDuplicates(["_key"]), k), "shingles")
    # a class with too many shingles of its own is linked to none
    left = materialise(left.join(_alone(sets), "class").filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")), "bounded")
    known = materialise(_first_leaders(left), "open")
    merged = stars(_confirm(_compare_pivots(known, percent), sets, percent)).toDF("class", "component")
    left = known.filter("class <> pivot").drop("m", "lone")
    inside, most = None, LEADERS
    while True:
        known = left.join(merged, "class", "left").withColumn("component", F.coalesce("component", "class"))
        sizes = known.groupBy("bucket", "component").agg(F.count("*").alias("size"))
        tops = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts"))
        open_ = tops.filter("parts > 1").select("bucket", F.col("top.component").alias("top"))
        known = materialise(known.join(open_, "bucket"), "open")
        if not known.limit(1).count():
            break
        place = F.row_number().over(W.partitionBy("bucket").orderBy(F.col("alone") / F.col("n"), "class"))
        leaders = materialise(known.filter("component <> top").withColumn("place", place).filter(F.col("place") <= most).select(
            "bucket", "pivot", "class", "component"), "leaders")
        most *= GROWTH  # so that a bucket of many unlinked classes takes few rounds
        if inside is None:
            inside, shared = _around(known, sets)
        confirmed = _confirm(_compare_around(leaders, known, inside, shared, percent), sets, percent)
        # components so far are stars already, and go on from there
        merged = stars(confirmed.union(merged.toDF("a", "b"))).toDF("class", "component")
        left = known.select("bucket", "pivot", "class", "n", "alone").join(leaders.select("bucket", "class"), ["bucket", "class"], "left_anti")
    named = held.select("class", "first").join(merged, "class", "left").withColumn("component", F.coalesce("component", "class"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = named.join(firsts, "component").select("class", "component_id")
    out = sketch.select("_id", "n", "class").join(label, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without near-duplicates: of each component the row with the smallest id stays.

    Ties go to one text of that id, and of rows that repeat id and text one stays. A null id comes last.
    """
    keyed = docs.withColumn("_key", text_key(text_col)).withColumn(
        "_name", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_key").alias("key")))
    named = materialise(near_duplicates(keyed, k, percent, "_name", text_col), "named")
    kept = named.filter("kept").select(F.col("_name.id").alias("_kept"), F.col("_name.key").alias("_key2"))
    same = F.col(id_col).eqNullSafe(F.col("_kept")) & (F.col("_key") == F.col("_key2"))
    out = keyed.drop("_name").join(kept, same, "left_semi")
    if kept.groupBy("_kept", "_key2").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, "_key"])
    return out.drop("_key")
