"""Day-partitioned tables: create from a type dictionary, append, delete and replace by range, load what is missing."""

from __future__ import annotations

import hashlib
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from periodica.session import shared_folder
from periodica.sources.artifacts import ArtifactStore
from periodica.sources.scan import scan_days

# Type names of the table dictionaries. Spark has no unsigned types.
TYPES = {
    "String": "string", "UInt64": "bigint", "UInt16": "int", "UInt8": "smallint", "Float64": "double",
    "Datetime": "timestamp_ntz", "Date": "date",
}
DAY = "part_day"


def schema_of(types: dict[str, str], order: list[str] | None = None) -> StructType:
    return StructType([StructField(c, _parse_datatype_string(TYPES[types[c]])) for c in (order or types)])


class DayTables:
    """Tables of one database in a shared folder, partitioned by the day of their time column.

    Deletes and replacements only touch the days they name: whole days are dropped as
    partitions, written days replace their own partition.
    """

    def __init__(self, spark: SparkSession, database: str, folder: str | None = None):
        self.spark, self.database = spark, database
        place = folder or shared_folder(spark, database)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{place}'")

    def name(self, table: str) -> str:
        return f"{self.database}.{table}"

    def create(self, table: str, types: dict[str, str], order: list[str] | None = None,
               ts_col: str = "block_timestamp") -> None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema_of(types, order).fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name(table)} ({fields}, {DAY} date) USING parquet "
            f"PARTITIONED BY ({DAY}) TBLPROPERTIES ('ts_col'='{ts_col}')")

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")

    def drop_database(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def ts_col(self, table: str) -> str:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.name(table)} ('ts_col')").collect()
        return rows[0]["value"]

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table)).drop(DAY)

    def _rows(self, df: DataFrame, table: str) -> DataFrame:
        columns = [c for c in self.spark.table(self.name(table)).columns if c != DAY]
        ts = self.ts_col(table)
        # One task per day writes one sorted file; a day too large for that is divided by AQE.
        return (
            df.select(*columns, F.to_date(ts).alias(DAY)).hint("rebalance", DAY).sortWithinPartitions(DAY, ts)
        )

    def append(self, df: DataFrame, table: str, dedup: list[str] | None = None) -> None:
        """Columns in table order, whatever their order in the frame.

        With ``dedup`` one row of the batch is kept for each value of these columns, the newest by time, then the
        largest in the order of the columns.
        """
        if dedup:
            row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
            newest = F.max_by(row, F.struct(F.col(self.ts_col(table)), row)).alias("_row")
            df = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in dedup]).agg(newest).select("_row.*")
        self._rows(df, table).write.mode("append").insertInto(self.name(table))

    def _replace_days(self, df: DataFrame, table: str) -> None:
        # insertInto takes the mode from the session only.
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "dynamic")
        try:
            self._rows(df, table).write.mode("overwrite").insertInto(self.name(table))
        finally:
            self.spark.conf.set(setting, before)

    def _drop_days(self, table: str, low: date, high: date, keep: set[date] = frozenset()) -> None:
        held = self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect()
        days = [r[0].split("=")[1] for r in held]
        gone = [d for d in days if d[:2].isdigit() and low <= date.fromisoformat(d) <= high
                and date.fromisoformat(d) not in keep]
        if gone:
            specs = ", ".join(f"PARTITION ({DAY}=DATE'{d}')" for d in gone)
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS {specs}")

    def delete_days(self, table: str, start: date, end: date) -> None:
        """Delete the rows of the days from start to end, both included."""
        self._drop_days(table, start, end)

    def delete_range(self, table: str, column: str, start, end) -> None:
        """Delete rows with start <= column <= end; only the days that hold such rows are rewritten."""
        full = self.spark.table(self.name(table))
        hit = F.col(column).between(F.lit(start), F.lit(end))
        days = [r[0] for r in full.where(hit).select(DAY).distinct().collect()]  # one row per day at most
        dated = [d for d in days if d is not None]
        touched = F.col(DAY).isin(dated) | F.col(DAY).isNull() if None in days else F.col(DAY).isin(dated)
        if not days:
            return
        kept = full.where(touched).where(~F.coalesce(hit, F.lit(False))).drop(DAY)
        path = shared_folder(self.spark, "kept")
        kept.write.parquet(path)
        staged = self.spark.read.schema(kept.schema).parquet(path)
        remaining = {r[0] for r in staged.select(F.to_date(self.ts_col(table))).distinct().collect()}
        self._replace_days(staged, table)
        emptied = [d for d in days if d not in remaining]
        for d in emptied:
            spec = f"DATE'{d}'" if d is not None else "null"
            self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION ({DAY}={spec})")

    def upsert(self, df: DataFrame, table: str) -> None:
        """Replace the days from the first to the last day of the batch by the batch.

        Days inside that span without a row in the batch are emptied first, so a run that breaks off
        leaves days to be written again and none that are out of date. Rows of the batch without a
        time are appended; stored ones lie in no span and stay.
        """
        ts = self.ts_col(table)
        days = {r[0] for r in df.select(F.to_date(ts)).distinct().collect()} - {None}  # one row per day at most
        if days:
            self._drop_days(table, min(days), max(days), keep=days)
            self._replace_days(df.where(F.col(ts).isNotNull()), table)
        self.append(df.where(F.col(ts).isNull()), table)


class RangeDatasets:
    """Datasets stored by key and date range, gzip parquet partitioned by day, listed in an artifact store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.index = ArtifactStore(spark, f"{self.folder}/index")

    def save(self, df: DataFrame, key: str, start: date, end: date, now: datetime, ts_col: str) -> bool:
        """Write unless the same key and range is stored already."""
        same = self.index.ranges(now, key).where((F.col("start") == F.lit(start)) & (F.col("end") == F.lit(end)))
        if same.take(1):
            return False
        name = hashlib.sha1(f"{start} {end} {key}".encode()).hexdigest()
        path = f"{self.folder}/data/{name}"
        day = F.to_date(ts_col)
        df.withColumn(DAY, day).hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).option(
            "compression", "gzip").parquet(path)
        entry = self.spark.createDataFrame([("path", path)], "item string, payload string")
        self.index.save(entry, key, start, end, now, days=36500)
        return True

    def load(self, key: str, start: date, end: date, now: datetime, ts_col: str, whole: bool = False) -> DataFrame | None:
        """The first stored range that contains the requested one, without rows that lack a time.

        ``whole`` gives the entire stored range instead of the requested days.
        """
        found = self.index.covering(now, key, start, end).take(1)
        if not found:
            return None
        entry = self.index.latest(now, key).where(
            (F.col("start") == F.lit(found[0]["start"])) & (F.col("end") == F.lit(found[0]["end"]))).first()
        stored = self.spark.read.parquet(entry["payload"]).dropna(subset=[ts_col])
        if not whole:
            stored = stored.where(F.col(DAY).between(F.lit(start), F.lit(end)))
        return stored.drop(DAY)


def missing_ranges(held: DataFrame, ts_col: str, start: date, end: date) -> list[tuple[date, date]]:
    """Runs of days between start and end of which nothing is held; at most one entry per day."""
    spine = held.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    days = held.select(F.to_date(ts_col).alias("day")).distinct()
    absent = [r[0] for r in spine.join(days, "day", "left_anti").orderBy("day").collect()]
    runs: list[tuple[date, date]] = []
    for d in absent:
        if runs and runs[-1][1] + timedelta(days=1) == d:
            runs[-1] = (runs[-1][0], d)
        else:
            runs.append((d, d))
    return runs


def load_missing(held: DataFrame, source: DataFrame, ts_col: str, start: date, end: date) -> DataFrame:
    """Held rows and the rows of the missing days, from start to end, each distinct row once.

    Only the missing ranges are read from the source, as filters of one scan. The first and the last
    day of a held stretch may be held in part and are read again.
    """
    held = scan_days(held, start, end, ts_col)
    runs = missing_ranges(held, ts_col, start, end)
    edges = [(d, d) for d in _edge_days(runs, start, end)]
    wanted = F.lit(False)
    for low, high in runs + edges:
        piece = (F.col(ts_col) >= F.lit(datetime(low.year, low.month, low.day)).cast("timestamp_ntz")) & (
            F.col(ts_col) < F.lit(datetime(high.year, high.month, high.day) + timedelta(days=1)).cast("timestamp_ntz"))
        wanted = wanted | piece
    return held.unionByName(source.where(wanted)).dropDuplicates()


def _edge_days(runs: list[tuple[date, date]], start: date, end: date) -> list[date]:
    """First and last day of every stretch between the missing runs."""
    one = timedelta(days=1)
    lows = [start, *[high + one for _, high in runs]]
    highs = [*[low - one for low, _ in runs], end]
    return sorted({d for low, high in zip(lows, highs) if low <= high for d in (low, high)})


def load_hull(store: ArtifactStore, now: datetime, source: DataFrame, ts_col: str, key: str | None = None,
              prefix: str | None = None) -> DataFrame | None:
    """The source rows of the span that covers all stored ranges of a key, or of the keys with a prefix."""
    span = store.hull(now, key, prefix)
    return None if span is None else scan_days(source, *span, ts_col)
