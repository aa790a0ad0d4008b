"""Counts over the whole archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from talkloom.functions.lexicon import OTHER_TOPIC
from talkloom.operators.ranking import top_k


def month_counts(items: DataFrame, created: str = "created") -> DataFrame:
    return items.where(F.col(created).isNotNull()).groupBy(
        F.date_format(created, "yyyy-MM").alias("month")
    ).agg(F.count("*").alias("count")).orderBy("month")


def month_profile(months: DataFrame) -> DataFrame:
    """months with share, the count relative to the busiest month."""
    busiest = months.agg(F.max("count").alias("most"))
    return months.crossJoin(F.broadcast(busiest)).select(
        "month", "count", (F.col("count") / F.col("most")).alias("share")
    )


def topic_counts(items: DataFrame, limit: int = 30) -> DataFrame:
    """rank, label, count: conversations of each topic; ties in the order in which topics appeared."""
    counts = items.groupBy(
        F.coalesce("cluster_label", F.lit(OTHER_TOPIC)).alias("label")
    ).agg(F.count("*").alias("count"), F.min("index").alias("first"))
    order = [F.desc("count"), F.asc("first")]
    best = counts.orderBy(*order).limit(limit).withColumn("all", F.lit(1))
    return top_k(best, ["all"], order, limit).select("rank", "label", "count")


def corpus_metrics(items: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """total, first_day, last_day, starred: one row."""
    base = items.agg(
        F.count("*").alias("total"), F.date_format(F.min("created"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("created"), "yyyy-MM-dd").alias("last_day")
    )
    if annotations is None:
        return base.withColumn("starred", F.lit(0).cast("long"))
    stars = annotations.where("starred").select("file").distinct().agg(F.count("*").alias("starred"))
    return base.crossJoin(F.broadcast(stars))


def facets(hot: DataFrame, topics: DataFrame, n_terms: int = 18, n_topics: int = 12) -> DataFrame:
    """kind, rank, value, count: the first hot terms and topics, as a filter bar shows them."""
    terms = hot.where(F.col("rank") <= n_terms).select(
        F.lit("keyword").alias("kind"), "rank", F.col("term").alias("value"), "count"
    )
    return terms.union(topics.where(F.col("rank") <= n_topics).select(F.lit("topic"), "rank", "label", "count"))
