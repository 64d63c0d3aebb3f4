"""Range scans over tables, change feeds and nested documents."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: this column is named after its table when read from one of these tables.
TABLE_NAMED = {"nrg_consumed": ("transaction", "block")}


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None,
               **options: str) -> DataFrame:
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def _moment(value) -> datetime:
    """A date, datetime, ISO text or epoch milliseconds as a datetime."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, int):
        return datetime.fromtimestamp(value / 1000, timezone.utc).replace(tzinfo=None)
    return datetime.fromisoformat(value)


def _bound(df: DataFrame, ts_col: str, moment: datetime) -> Column:
    """A literal of the column's own type: a cast on the column would keep the filter from the scan."""
    return F.lit(moment).cast("timestamp_ntz").cast(df.schema[ts_col].dataType)


def _finish(df: DataFrame, cols: list[str] | None, ts_col: str, ordered: bool, table: str | None) -> DataFrame:
    kept = df.select(*[f"`{c}`" for c in cols]) if cols else df
    for name, tables in TABLE_NAMED.items():
        if table in tables and name in kept.columns:
            kept = kept.withColumnRenamed(name, f"{table}_{name}")
    return kept.orderBy(ts_col) if ordered else kept


def scan_days(df: DataFrame, start, end, ts_col: str = "block_timestamp", cols: list[str] | None = None,
              where: str | None = None, extra_days: int = 0, ordered: bool = False, table: str | None = None) -> DataFrame:
    """Rows whose calendar day lies between two days, both included.

    A start after the end is set to the end. ``ordered`` sorts the whole result and is
    meant for output, not for further work.
    """
    last = _moment(end)
    first = min(_moment(start), last)
    low = datetime(first.year, first.month, first.day)
    high = datetime(last.year, last.month, last.day) + timedelta(days=1 + extra_days)
    kept = df.where((F.col(ts_col) >= _bound(df, ts_col, low)) & (F.col(ts_col) < _bound(df, ts_col, high)))
    if where:
        kept = kept.where(F.expr(where))
    return _finish(kept, cols, ts_col, ordered, table)


def scan_moments(df: DataFrame, start, end, ts_col: str = "block_timestamp", cols: list[str] | None = None,
                 ordered: bool = False, table: str | None = None) -> DataFrame:
    """Rows between two moments, both included."""
    last = _moment(end)
    first = min(_moment(start), last)
    kept = df.where(
        (F.col(ts_col) >= _bound(df, ts_col, first)) & (F.col(ts_col) <= _bound(df, ts_col, last)))
    return _finish(kept, cols, ts_col, ordered, table)


def held_or_scan(held: DataFrame | None, source: DataFrame, start, end, ts_col: str = "block_timestamp",
                 cols: list[str] | None = None) -> DataFrame:
    """The range out of a held table when that covers it, else out of the source.

    The test reads one row, the ends of the held table; nothing is loaded by it.
    """
    if held is not None:
        low, high = held.agg(F.min(ts_col), F.max(ts_col)).first()
        if low is not None and low <= _moment(start) and high >= _moment(end):
            return scan_moments(held, start, end, ts_col, cols)
    return scan_moments(source, start, end, ts_col, cols)


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields as columns with dotted names."""

    def walk(kind: StructType, path: list[str]) -> list[Column]:
        found: list[Column] = []
        for f in kind.fields:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                found += walk(f.dataType, here)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return found

    return df.select(*walk(df.schema, []))


def scan_documents(df: DataFrame, start=None, end=None, ts_col: str = "timestamp", cols: list[str] | None = None) -> DataFrame:
    """Nested documents of a time range, flattened; without a range the whole collection.

    An empty projection means every field but ``_id``.
    """
    ranged = df if start is None else scan_moments(df, start, end, ts_col)
    kept = ranged.select(*cols) if cols else ranged.drop("_id")
    return flatten(kept)
