"""Connected components of an edge list by alternating stars; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); the component is its smallest node."""
    pairs = stars(edges)
    hubs = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(hubs)


def stars(edges: DataFrame) -> DataFrame:
    """(a, b), written: for every end a of an edge that is not the smallest node b of its component.

    Union-find over a distributed edge list: the large star hangs each node's larger neighbours on its smallest
    one, the small star does so with the smaller neighbours; both keep the components and end in one star for each.
    Hubs are met by aggregates with a partial step and by joins whose larger side Spark can split. Edges with a null
    end and loops are left out.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    pairs = materialise(ends.distinct(), "edges")
    while not _are_stars(pairs):
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        tops = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(tops, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            tops.select("a", F.col("m").alias("b"))).distinct()
        pairs = materialise(small, "stars")
    return pairs


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every larger end has one smaller end, and is not itself the smaller end of an edge."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).union(
        pairs.select("b", F.lit(0), F.lit(1)))
    met = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return not met.filter("above + below > 1 and above > 0").limit(1).count()
