"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return v


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf)
    names = sorted(df.columns)
    mine = Counter(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in names]).collect())
    cur = con.execute(sql)
    heads = [d[0] for d in cur.description]
    if sorted(heads) != names:
        return f"columns {names} / {sorted(heads)}"
    order = [heads.index(c) for c in names]
    theirs = Counter(tuple(cell(r[i]) for i in order) for r in cur.fetchall())
    if mine == theirs:
        return None
    a, b = mine - theirs, theirs - mine
    return (
        f"rows {sum(mine.values())} / {sum(theirs.values())}; {names}; only here {sum(a.values())}: "
        f"{sorted(map(str, a))[:3]}; only SQL {sum(b.values())}: {sorted(map(str, b))[:3]}"
    )


def main() -> int:
    from periodica.plans import QUERIES, SQL
    from periodica.session import build_session

    args = sys.argv[1:]
    sf = f"/root/testdata/{args[0] if args else 'sf0.01'}"
    wanted = args[1:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in wanted:
        began = time.time()
        try:
            if name in SQL:
                found = compare(spark, con, QUERIES[name], SQL[name], sf)
            else:
                found = None if QUERIES[name](spark, sf).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        tag = "sql" if name in SQL else "rows"
        print(f"{'ok  ' if found is None else 'FAIL'} {tag:4} {time.time() - began:6.2f}s {name}"
              + (f"\n     {found}" if found else ""), flush=True)
        bad += found is not None
    print(f"{len(wanted) - bad} of {len(wanted)} equal")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
