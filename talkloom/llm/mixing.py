"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.llm.support import cut, join_by_key, table

#: The tables of all sources are broadcast up to so many numbers (8 bytes each); beyond, only those of very large sources.
BROADCAST_NUMBERS = 2_000_000
TEMPERATURE = 0.7
SEED = "mix-1"


def _hex_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def poisson_table(rate: float) -> tuple[int, np.ndarray]:
    """start and the distribution function of a Poisson variable at start, start + 1, ... up to where the rest is below
    a double's resolution: nine standard deviations around the mode, so memory grows with the rate's square root.

    Chances are multiplied up from the mode on, and down from it, and then divided by their sum: none overflows.
    """
    spread, mode = 9 * np.sqrt(rate) + 30, int(rate)
    start, end = max(0, int(rate - spread)), int(np.ceil(rate + spread))
    down = np.cumprod(np.arange(mode, start, -1) / rate) if mode > start else np.array([])
    up = np.cumprod(rate / np.arange(mode + 1, end + 1))
    sums = np.cumsum(np.r_[down[::-1], 1.0, up])
    return start, sums / sums[-1]


def _with_tables(rates: DataFrame) -> DataFrame:
    """source, n, start and cdf of rates (source, n, rate)."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, n, rate in zip(frame["source"], frame["n"], frame["rate"]):
                start, cdf = poisson_table(rate)
                yield pd.DataFrame({"source": [source], "n": [n], "start": [start], "cdf": [cdf]})

    return rates.select("source", "n", "rate").mapInPandas(made, "source string, n long, start long, cdf array<double>")


def _places_below(cdf: Column, u: Column) -> Column:
    """How many of the ascending numbers are below u, by bisection."""
    halve = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        below = F.coalesce(F.get(cdf, halve(s)) < u, F.lit(False))
        done = s["lo"] >= s["hi"]
        lo = F.when(~done & below, halve(s) + 1).otherwise(s["lo"])
        hi = F.when(~done & ~below, halve(s)).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.size(cdf).alias("hi"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + 1)).cast("int") + 1)
    return F.aggregate(steps, start, step, lambda s: s["lo"])


def _source_key(source: Column) -> Column:
    """The source as a text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_rates(
    df: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0,
    source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """source, n, size, weight and rate: how often a document of the source is repeated in the mean.

    Sizes are UTF-8 bytes plus one per document, over all rows. weights gives the share of each source (sources it
    leaves out get none); without it, shares are sizes to the power of temperature. rate = weight * epochs * total
    size / size of the source. Null is a source of its own.
    """
    octets = F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long") + 1
    sizes = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(
        F.sum(octets).alias("size"), F.count("*").alias("n")
    )
    share = F.pow(F.col("size").cast("double"), F.lit(temperature))
    if weights is not None:
        given = [F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()]
        share = F.coalesce(*given, F.lit(0.0))
    sizes = cut(sizes.withColumn("share", share))
    totals = sizes.agg(F.sum("size").alias("total"), F.sum("share").alias("shares"))
    with_totals = sizes.crossJoin(F.broadcast(totals))  # one row
    weight = F.col("share") / F.when(F.col("shares") > 0, F.col("shares")).otherwise(F.lit(1.0))
    rate = F.col("weight") * F.lit(float(epochs)) * F.col("total") / F.col("size")
    return with_totals.withColumn("weight", weight).select("source", "n", "size", "weight", rate.alias("rate"))


def mix_sources(
    df: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0,
    seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """Each row of df as often as a Poisson variable says, in a globally shuffled order.

    The variable is read off its distribution function at a number in [0, 1) hashed from the seed and the id, so
    the same document always gets the same count, whatever the partitioning. Rows that repeat an id get the same
    count each; a null id hashes as the word null. Returns df's columns, then copy (from 0) and shuffle_key, by
    which the rows are range partitioned and sorted; columns of df with these names are replaced.
    """
    rates = source_rates(
        df, weights, temperature, epochs, source_col, text_col
    ).withColumn("source", _source_key(F.col("source")))
    tables = cut(_with_tables(rates).withColumnsRenamed({c: f"__{c}" for c in ("source", "n", "start", "cdf")}))
    size = tables.agg(F.sum(F.size("__cdf")), F.sum("__n")).first()
    kept = [c for c in df.columns if c not in ("copy", "shuffle_key")]
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    chance = _hex_number(name, 13) / F.lit(2.0**52)
    named = df.select(
        *(F.col(f"`{c}`") for c in kept), chance.alias("__u"), _source_key(F.col(f"`{source_col}`")).alias("__source")
    )
    if (size[0] or 0) <= BROADCAST_NUMBERS:
        counted = named.join(F.broadcast(tables), "__source")
    else:
        counted = join_by_key(named, tables, ["__source"], "__n", size[1])
    times = (F.col("__start") + _places_below(F.col("__cdf"), F.col("__u"))).cast("int")
    some = counted.withColumn("__times", times).where("__times > 0")
    copies = some.select(
        *(F.col(f"`{c}`") for c in kept), F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("copy")
    )
    key = _hex_number(F.concat(name, F.lit("|"), F.col("copy").cast("string")), 15)
    return copies.withColumn("shuffle_key", key).repartitionByRange("shuffle_key", "copy").sortWithinPartitions("shuffle_key", "copy")


def op9_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "shuffle_key")


OP9_SQL = f"""
WITH sizes AS (SELECT source, sum(coalesce(strlen(text), 0) + 1) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(size) AS total, sum(pow(size, {TEMPERATURE})) AS shares FROM sizes),
rates AS (SELECT source, pow(size, {TEMPERATURE}) / shares * total / size AS rate FROM sizes, totals),
steps AS (SELECT source, rate, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM rates, generate_series(0, 200) AS g(j)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM steps),
named AS (SELECT doc_id, source, '{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS name FROM documents),
chances AS (SELECT *, CAST('0x' || substr(md5(name), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM named),
counts AS (SELECT doc_id, d.source, name,
  (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c < u) AS n FROM chances d)
SELECT doc_id, source, CAST(k AS INTEGER) AS copy,
  CAST('0x' || substr(md5(name || '|' || CAST(k AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
FROM (SELECT doc_id, source, name, unnest(range(n)) AS k FROM counts)
"""
