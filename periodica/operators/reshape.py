"""Unions, pivots, unpivots and wide names turned into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.functions.scalars import normalise_label


def union_distinct(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.unionByName(bottom).dropDuplicates()


def union_all(top: DataFrame, bottom: DataFrame) -> DataFrame:
    return top.unionByName(bottom, allowMissingColumns=True)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def pivot(df: DataFrame, row: str, column: str, names: list, value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, names).agg(F.first(value))


def wide_names_to_rows(df: DataFrame, entity: str, skip: list[str] = (), sep: str = ".") -> DataFrame:
    """Columns named ``entity...measure`` become one row per entity and one column per measure.

    A wide table has few rows and many columns; the column names are known without reading it.
    A measure an entity lacks is 0.
    """
    named = [c for c in df.columns if c not in skip]
    measures = sorted({c.split(sep)[-1].replace("-", "_") for c in named})
    cells = [
        F.struct(
            F.lit(c.split(sep)[0]).alias(entity), F.lit(c.split(sep)[-1].replace("-", "_")).alias("_m"),
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias("_v"),
        )
        for c in named
    ]
    long = df.select(*skip, F.inline(F.array(*cells)))
    return long.groupBy(*skip, entity).pivot("_m", measures).agg(F.first("_v")).fillna(0.0, measures)


def prefixed_names_to_rows(df: DataFrame, entities: list[str], entity: str, keep: list[str] = ()) -> DataFrame:
    """Columns named ``<entity>_<measure>`` become one row per kept row and entity.

    A measure an entity lacks is null.
    """
    by_entity = {e: {c[len(e) + 1:]: c for c in df.columns if c.startswith(f"{e}_")} for e in entities}
    measures = sorted({m for found in by_entity.values() for m in found})
    rows = [
        F.struct(
            F.lit(e).alias(entity),
            *[(F.col(f"`{found[m]}`") if m in found else F.lit(None)).cast("double").alias(m) for m in measures],
        )
        for e, found in by_entity.items()
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def added_columns(after: DataFrame, before: DataFrame) -> list[str]:
    return sorted(set(after.columns) - set(before.columns))


def wide_row(df: DataFrame, entity: str, measure: str, value: str) -> DataFrame:
    """One row with a column ``entity.x.measure`` per cell; the cells are a small dimension product."""
    named = df.select(F.concat_ws(".", F.col(entity), F.lit("x"), normalise_label(F.col(measure))).alias("_n"), value)
    return named.groupBy().pivot("_n").agg(F.first(value))
