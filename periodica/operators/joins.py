"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.scalars import normalise_label
from periodica.session import materialise, shuffle_width

# Rows of a frequent key that one task should join.
ROWS_PER_SALT = 2_000_000


def hot_keys(df: DataFrame, key: Column, share: float, limit: int) -> DataFrame:
    """(k, n): the keys that hold more than ``limit`` rows, or at least a share of all rows, whichever is less.

    One aggregate with a partial step counts all keys. The hot ones are a written table, of which there are at most as
    many rows as the limit goes into all rows; none of them passes through the driver. Nulls are never hot.
    """
    least = max(1.0, min(limit + 1.0, share * df.count()))
    counts = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return materialise(counts.where(F.col("k").isNotNull() & (F.col("n") >= least)), "hot")


def left_join_spread(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                     spread: Column | None = None, salts: int | None = None, limit: int = ROWS_PER_SALT) -> DataFrame:
    """Left join whose right side may repeat a key very often.

    Spark splits a skewed left side by itself, but not the right side of a left join. The rows of every right key
    with more than ``limit`` rows, or with more than a task's share of them, are therefore dealt over as many salts as
    bring it below that, and its left rows are copied once per salt. Such a key does occur on the right, so a
    copy that met no row is dropped and nothing else changes. ``salts`` sets the share to one in that many.

    ``spread`` numbers the right rows and must give the same number again when a task is
    repeated. The default hashes the row; a side that comes straight from a scan can use
    ``monotonically_increasing_id``, which also divides equal copies of one row.
    """
    width = salts or shuffle_width(left.sparkSession)
    hot = hot_keys(right, F.col(right_key), 1.0 / width, limit)
    if not hot.limit(1).count():
        return left.join(right, F.col(left_key) == F.col(right_key), "left")
    # a key of n rows is dealt over n / limit salts, and never over fewer than there are tasks
    table = hot.select(F.col("k").alias("_hk"), F.greatest(F.lit(width), F.ceil(F.col("n") / limit)).cast("int").alias("_salts"))
    if spread is None:
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in right.columns])
    numbered = right.withColumn("_n", spread)
    salted = numbered.join(table, F.col(right_key) == F.col("_hk"), "left").withColumn(
        "_rs", F.coalesce(F.pmod(F.col("_n"), F.col("_salts").cast("long")), F.lit(0)).cast("int")).drop("_n", "_hk", "_salts")
    copied = left.join(table, F.col(left_key) == F.col("_hk"), "left").withColumn("_hot", F.col("_hk").isNotNull()).withColumn(
        "_ls", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hk", "_salts")
    joined = copied.join(
        salted, (F.col(left_key) == F.col(right_key)) & (F.col("_ls") == F.col("_rs")), "left"
    )
    return joined.where(~F.col("_hot") | F.col("_rs").isNotNull()).drop("_ls", "_rs", "_hot")


def dimension_name(df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_name: str, out: str,
                   longest: int | None = None) -> DataFrame:
    """The name a dimension gives to a key, else the key itself, cut to ``longest`` characters.

    The join carries no hint: Spark broadcasts the dimension when its size allows it and
    otherwise splits frequent keys of the large side.
    """
    own = F.col(key).cast("string")
    fallback = own if longest is None else F.when(F.length(own) > longest, F.substring(own, 1, longest)).otherwise(own)
    names = dim.select(F.col(dim_key).alias("_dk"), F.col(dim_name).alias("_dn"))
    return df.join(names, F.col(key) == F.col("_dk"), "left").withColumn(
        out, F.coalesce(F.col("_dn"), fallback)
    ).drop("_dk", "_dn")


def lookup_value(df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_value: str, out: str,
                 missing=0) -> DataFrame:
    """Replace an id by the value a lookup table gives to it; ids not listed get ``missing``."""
    values = dim.select(F.col(dim_key).alias("_dk"), F.col(dim_value).alias("_dv"))
    joined = df.join(values, F.col(key) == F.col("_dk"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_dv"), F.lit(missing))).drop("_dk", "_dv")


def platform_parameters(parameters: DataFrame, etls: DataFrame, platform: str) -> DataFrame:
    """Load parameters of one platform: (etl, label, handle) joined to (_id, etl)."""
    names = etls.select(F.col("_id").alias("_eid"), F.col("etl").alias("name"))
    return (
        parameters.join(names, F.col("etl") == F.col("_eid"), "left").where(F.col("name") == platform).drop("_eid")
    )


def platform_items(parameters: DataFrame, label: str = "label") -> DataFrame:
    return parameters.select(normalise_label(F.col(label)).alias("item")).distinct()


def differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold different rows, counted with repeats."""
    ordered = b.select(*a.columns)
    return bool(a.exceptAll(ordered).take(1)) or bool(ordered.exceptAll(a).take(1))
