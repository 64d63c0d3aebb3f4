"""CSV: dimensions, typed reads and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


# Timestamps keep their microseconds.
TIME_FORMATS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Name and symbol rows with the names in lower case, sorted."""
    rows = spark.read.schema("Name string, Symbol string").csv(path, header=True)
    return rows.select(F.lower("Name").alias("name"), F.col("Symbol").alias("symbol")).orderBy("name")


def read_pools(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("address string, poolname string").csv(path, header=True)


def read_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read with the types of an existing table; nothing is guessed."""
    return spark.read.options(**TIME_FORMATS).schema(schema).csv(path, header=True)


def write_table(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Header line and one line per row. ``one_file`` is for result tables of display size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**TIME_FORMATS).csv(path, header=True)
