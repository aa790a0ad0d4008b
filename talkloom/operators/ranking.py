"""Patterns that several operators share: best rows of a group, first rows, global numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from talkloom.session import checkpointed


def top_k(
    df: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rank", salts: int = 0
) -> DataFrame:
    """The first k rows of each group in the order, with their rank. With few, large groups, salts (a number of
    sub-groups) has each sub-group give its first k before the groups are ranked."""
    if salts:
        spread = Window.partitionBy(*partition, "__salt").orderBy(*order)
        df = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
        df = df.withColumn("__r", F.row_number().over(spread)).where(F.col("__r") <= k).drop("__r", "__salt")
    return df.withColumn(
        rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    ).where(F.col(rank) <= k)


def first_seen(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, partition, order, 1, "__first").drop("__first")


def number_rows(df: DataFrame, order: list[str | Column], name: str = "index") -> DataFrame:
    """df with its rows' places from 1 in the order: range partitions, and offsets from their row counts.

    Rows that tie in the order are dealt over partitions, too, by a number of their own.
    """
    spread = [*order, "__spread"]
    ranged = df.withColumn("__spread", F.monotonically_increasing_id()).repartitionByRange(*spread)
    ordered = checkpointed(ranged.sortWithinPartitions(*spread).drop("__spread"))
    placed = ordered.withColumn("__part", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):  # a row per partition
        starts.append((part, total + 1))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 1)], "__part int, __start long")
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__start")).drop("__part", "__at", "__start")
