"""Tables, the shared folder, lineage cuts and joins used by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.operators.joins import join_by_key  # noqa: F401
from talkloom.session import checkpointed as cut, new_folder

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: for wide rows, where checkpoint() files would be large."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on, Arrow batches of this session hold about so many bytes, unless it has a setting of its own: with
    long texts, Spark's default of 64 MB times a few copies is much of a worker's memory. Jobs read the setting when
    they run, so it can't be taken back here; it changes no result."""
    if spark.conf.get(ARROW_BYTES).lower() in ("64mb", "64m", "67108864", "67108864b"):
        spark.conf.set(ARROW_BYTES, size)


def spread_hash(parts: int | Column, *columns: str, salt: int = 1) -> Column:
    """A number from 0 below parts, by a hash of the columns."""
    return F.pmod(F.xxhash64(*columns, F.lit(salt)), F.lit(parts) if isinstance(parts, int) else parts).cast("int")
