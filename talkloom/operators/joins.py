"""Joins that hot keys don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Keys with more rows than this, and than the HEAVY_KEYS-th part of all rows, are joined by a broadcast.
HEAVY_ROWS, HEAVY_KEYS = 256, 100_000


def join_by_key(
    rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, how: str = "inner"
) -> DataFrame:
    """rows joined with per_key, which has a row for each key and, in column n, how many of rows have it.

    Keys of many rows would each be the work of one task. Those with more than HEAVY_ROWS rows and more than a
    HEAVY_KEYS-th of all (total) are broadcast, at most HEAVY_KEYS of them therefore; only the others are shuffled.
    Both tables are read twice, so they should be checkpointed or plain scans. n isn't returned. how is inner or left.
    """
    most = max(HEAVY_ROWS, total // HEAVY_KEYS)
    heavy = F.coalesce(F.col(n) > most, F.lit(False))
    few = F.broadcast(per_key.where(heavy).drop(n).withColumn("__heavy", F.lit(True)))
    others = per_key.where(~heavy).drop(n)
    added = [c for c in others.columns if c not in keys]
    met = rows.join(few, keys, "left")
    hot = met.where("__heavy").drop("__heavy")
    cool = met.where("__heavy is null").drop("__heavy", *added).join(others, keys, how)
    return hot.select(*cool.columns).union(cool)
