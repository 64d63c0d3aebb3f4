"""Blocks and transactions: the joined warehouse, paid-out and mined lists, tiers, hash rate."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodica.functions.scalars import split_bracketed
from periodica.operators.filters import members
from periodica.operators.joins import left_join_spread
from periodica.operators.ordered import rolling_mean
from periodica.sources.artifacts import ArtifactStore
from periodica.sources.tables import load_hull

# Fixed value: blocks mined per day on the whole chain.
BLOCKS_PER_DAY = 8640
# What an unmatched block row holds.
UNMATCHED = {"transaction_hash": "unknown", "value": 0.0, "from_addr": "unknown", "to_addr": "unknown", "block_number": 0}


def list_to_rows(df: DataFrame, column: str, sep: str = ",", keep: bool = False) -> DataFrame:
    """One row per value of a bracketed list text; rows without a text are left out."""
    present = df.where(F.col(column).isNotNull())
    return present.withColumn(column, F.explode(split_bracketed(F.col(column), sep, keep)))


def block_warehouse(blocks: DataFrame, transactions: DataFrame, spread: Column | None = None) -> DataFrame:
    """Every listed hash of a block with its transaction, or with the fill values when there is none."""
    listed = list_to_rows(blocks.drop("block_timestamp"), "transaction_hashes")
    shared = [c for c in transactions.columns if c in listed.columns]
    joined = left_join_spread(
        listed, transactions.drop(*shared), "transaction_hashes", "transaction_hash", spread)
    return joined.drop("transaction_hashes").fillna({c: v for c, v in UNMATCHED.items() if c in joined.columns})


def span_days(start: date, end: date) -> int:
    return max((end - start).days, 1)


def paid_out(df: DataFrame, days: int, threshold: float = 5) -> DataFrame:
    """Addresses that paid out at least ``threshold`` times a day."""
    counts = df.where(F.col("from_addr").isNotNull()).groupBy("from_addr").agg(F.count("to_addr").alias("n"))
    return counts.where(F.col("n") >= threshold * days).select(F.col("from_addr").alias("address"), "n")


def blocks_mined(df: DataFrame, days: int, threshold: float = 1) -> DataFrame:
    """Miners with at least ``threshold`` percent of the blocks of the span."""
    counts = df.where(F.col("miner_address").isNotNull()).groupBy("miner_address").agg(
        F.count("block_number").alias("n"))
    return counts.where(F.col("n") >= threshold * days * BLOCKS_PER_DAY / 100).select(
        F.col("miner_address").alias("address"), "n")


def tier1(df: DataFrame, start: date, end: date, paid: float = 5, mined: float = 0.5) -> DataFrame:
    days = span_days(start, end)
    texts = [t.select(F.col("address").cast("string")) for t in (paid_out(df, days, paid), blocks_mined(df, days, mined))]
    return texts[0].union(texts[1]).distinct()


def tier2(df: DataFrame, first_tier: DataFrame, start: date, end: date, received: float = 1) -> DataFrame:
    """Addresses paid by tier 1 at least ``received`` times a day."""
    names = first_tier.select(F.col("address").alias("_m"))
    paid = df.join(names, F.col("from_addr").cast("string") == F.col("_m"), "left_semi")
    counts = paid.where(F.col("to_addr").isNotNull()).groupBy("to_addr").agg(F.count("from_addr").alias("n"))
    return counts.where(F.col("n") >= received * span_days(start, end)).select(
        F.col("to_addr").cast("string").alias("address"))


def save_churn_lists(store: ArtifactStore, churned: DataFrame, retained: DataFrame, key: str, start: date, end: date,
                     now: datetime) -> None:
    """Keep the churned and retained addresses of a reference span: one row per address."""
    rows = churned.select(F.col("address").alias("item"), F.lit("churned").alias("payload")).unionByName(
        retained.select(F.col("address").alias("item"), F.lit("retained").alias("payload")))
    store.save(rows, key, start, end, now)


def listed_rows(store: ArtifactStore, prefix: str, now: datetime, df: DataFrame, column: str,
                ts_col: str = "block_timestamp") -> DataFrame | None:
    """Rows of the span of all lists whose key has the prefix whose address is on one of them."""
    ranged = load_hull(store, now, df, ts_col, prefix=prefix)
    if ranged is None:
        return None
    names = store.latest(now, prefix=prefix).select("item").distinct()
    return members(ranged, column, names, "item")


def hash_rate(df: DataFrame, n: int, order: str, tiebreak: str | None = None, time: str = "block_time",
              difficulty: str = "difficulty") -> DataFrame:
    """Difficulty over the mean time of the last n blocks; blocks without n predecessors are left out."""
    rolled = rolling_mean(df, time, n, "rolling_mean", order, tiebreak)
    kept = rolled.where(F.col("rolling_mean").isNotNull())
    return kept.withColumn("hashrate", F.try_divide(F.col(difficulty).cast("double"), F.col("rolling_mean")))
