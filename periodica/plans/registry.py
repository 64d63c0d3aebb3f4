"""Named queries and, where SQL can state them, the same query as SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from periodica.plans.tables import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEW = re.compile(r"\$([a-z_]+)")


def expand(text: str) -> str:
    """Replace ``$view`` by the view's own SELECT, inside out."""
    while VIEW.search(text):
        text = VIEW.sub(lambda m: VIEW_SQL[m.group(1)], text)
    return text


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return register
