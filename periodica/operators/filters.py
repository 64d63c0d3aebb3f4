"""Row filters, fills, codes, labels and casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from periodica.functions.scalars import finite_or_zero

ALL = "all"
# The codes of the coded columns.
GENDER_CODES = {"male": 1, "female": 2, "other": 3}
STATUS_CODES = {"guest": 1, "member": 2}


def by_selectors(df: DataFrame, chosen: dict[str, object]) -> DataFrame:
    """Equality on every selector that is not 'all'."""
    tests = [F.col(c) == F.lit(v) for c, v in chosen.items() if v != ALL]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def in_window(df: DataFrame, ts: str, start, end, cols: list[str] | None = None) -> DataFrame:
    """Rows with start <= ts <= end."""
    kept = df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end)))
    return kept.select(*cols) if cols else kept


def members(df: DataFrame, column: str, listed: DataFrame, listed_column: str) -> DataFrame:
    """Rows whose value is in a list table of any length."""
    names = listed.select(F.col(listed_column).alias("_m"))
    return df.join(names, F.col(column) == F.col("_m"), "left_semi")


def drop_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def clean_numbers(df: DataFrame) -> DataFrame:
    """Null, NaN and infinite numbers become 0; other columns are untouched."""
    fixed = {}
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            fixed[f.name] = finite_or_zero(F.col(f"`{f.name}`"))
        elif isinstance(f.dataType, NumericType):
            fixed[f.name] = F.coalesce(F.col(f"`{f.name}`"), F.lit(0))
    return df.withColumns(fixed) if fixed else df


def fill_map(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def fill_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null becomes the mean of its column, read once as scalar subqueries."""
    return df.withColumns({c: F.coalesce(F.col(c), df.agg(F.avg(c)).scalar()) for c in cols})


def code(c: Column, codes: dict[str, int], otherwise: int | None = None) -> Column:
    chain = reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), codes.items(), F.when(F.lit(False), F.lit(0)))
    return chain.otherwise(F.lit(otherwise).cast("int"))


def add_codes(df: DataFrame) -> DataFrame:
    """``<name>_coded`` for every column whose name holds 'gender', and for ``status``."""
    coded = {}
    for name in df.columns:
        if "gender" in name:
            coded[f"{name}_coded"] = code(F.col(name), GENDER_CODES)
        elif name == "status":
            coded[f"{name}_coded"] = code(F.col(name), STATUS_CODES)
    return df.withColumns(coded) if coded else df


def label_by_list(df: DataFrame, column: str, listed: DataFrame, listed_column: str,
                  out: str = "churned", words: tuple[str, str] = ("churned", "retained")) -> DataFrame:
    """1 or 0, and a word, by membership in a list table."""
    names = listed.select(F.col(listed_column).alias("_m")).distinct()
    found = df.join(names, F.col(column) == F.col("_m"), "left")
    hit = F.col("_m").isNotNull()
    return found.withColumns(
        {out: hit.cast("int"), f"{out}_verbose": F.when(hit, words[0]).otherwise(words[1])}
    ).drop("_m")


def split_by_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label) == 1), df.where(F.col(label) == 0)


def band(c: Column, limits: list[tuple[float, str]], rest: str) -> Column:
    """The first band whose upper limit lies above the value."""
    chain = None
    for limit, text in limits:
        chain = F.when(c < limit, text) if chain is None else chain.when(c < limit, text)
    return chain.otherwise(rest)


def rename(df: DataFrame, names: dict[str, str], order: list[str] | None = None) -> DataFrame:
    renamed = df.withColumnsRenamed(names)
    return renamed.select(*order) if order else renamed


def cast_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
