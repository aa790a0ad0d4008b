"""Reproducible shuffle into shards: a Feistel permutation of global row numbers (native expressions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.llm.support import cut, table

ROUNDS = 8
UNROLLED_WALK = 8


def _sides(n_rows: int) -> tuple[int, int]:
    left = max(1, math.isqrt(max(n_rows, 1) - 1) + 1)
    return left, -(-max(n_rows, 1) // left)


def feistel(x: Column, n_rows: int, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of [0, left * right), the least such grid that holds n_rows numbers.

    x is written as (l, r) with l < left and r < right; even rounds add a hash of r to l, odd rounds a hash of l to
    r. Each round can be undone, so the whole is one-to-one whatever the hash is.
    """
    left, right = _sides(n_rows)

    def turn(state: Column, i: Column) -> Column:
        noise = F.xxhash64(F.lit(seed).cast("long"), i, F.when(i % 2 == 0, state.r).otherwise(state.l))
        return F.struct(
            F.when(i % 2 == 0, F.pmod(state.l + F.pmod(noise, F.lit(left)), F.lit(left))).otherwise(state.l).alias("l"),
            F.when(i % 2 == 0, state.r).otherwise(
                F.pmod(state.r + F.pmod(noise, F.lit(right)), F.lit(right))
            ).alias("r"),
        )

    start = F.struct(F.floor(x / right).cast("long").alias("l"), F.pmod(x, F.lit(right)).cast("long").alias("r"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda i: i.cast("long"))
    return F.aggregate(steps, start, turn, lambda s: s.l * F.lit(right).cast("long") + s.r)


def permuted(x: Column, n_rows: int, seed: int, rounds: int = ROUNDS) -> Column:
    """feistel() restricted to [0, n_rows) by cycle walking: numbers outside are permuted again until one is inside.

    At most left numbers lie outside, so a walk ends after that many steps; nearly all end within UNROLLED_WALK,
    and only the rest pay for the long one.
    """
    left, right = _sides(n_rows)

    def walk(y: Column, steps: int) -> Column:
        if steps < 1:
            return y
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)), y, lambda v,
            _: F.when(v < n_rows, v).otherwise(feistel(v, n_rows, seed, rounds))
        )

    outside = left * right - n_rows
    first = walk(feistel(x, n_rows, seed, rounds), min(UNROLLED_WALK, outside))
    return first if outside <= UNROLLED_WALK else F.transform(
        F.array(first), lambda v: F.when(v < n_rows, v).otherwise(walk(v, outside))
    )[0]


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with row_number, its place (from 0) in the order of the columns, and the number of rows.

    Range partitions give the order, row counts per partition the offsets: no window over all rows. Rows that tie
    in every column of the order are dealt among them in any way, so order should hold all that tells rows apart.
    """
    spread = [*(F.col(c).asc_nulls_first() for c in order), F.col("__spread")]
    ordered = cut(
        df.withColumn(
            "__spread", F.monotonically_increasing_id()
        ).repartitionByRange(*spread).sortWithinPartitions(*spread).drop("__spread")
    )
    numbered = ordered.withColumn("__part", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    counts = sorted((r[0], r[1]) for r in numbered.groupBy("__part").count().collect())  # one row per partition
    offsets, total = [], 0
    for part, count in counts:
        offsets.append((part, total))
        total += count
    starts = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __start long")
    return numbered.join(F.broadcast(starts), "__part").withColumn(
        "row_number", F.col("__at") + F.col("__start")
    ).drop("__part", "__at", "__start"), total


def shard_rows(
    df: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and row_number for every row of df.

    Rows are numbered in the order of id, text hash and size; the number's place in the permutation gives shard
    (place mod n_shards) and slot (place div n_shards), so shard sizes differ by one row at most (law "rows") and
    anyone who knows the row number can compute where it lies. A null text has size 1 and the checksum of the empty
    text. Null ids come first; equal rows get neighbouring numbers. Other columns are ignored; no rows, no shards.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
    )
    numbered, total = number_rows(narrow, ["doc_id", "text_crc32", "text_hash", "size"])
    place = permuted(F.col("row_number"), total, seed, rounds)
    return numbered.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(F.col("place"), F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), n_shards=16)
