"""How users talk with assistants: features of messages, scores of conversations, the report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions import text as T
from talkloom.functions.fields import base_role
from talkloom.functions.lexicon import (
    BOUNDARY_CUES, BOUNDARY_LABEL, CLARIFY_CUES, CONSTRAINT_CUES, CONTEXT_CUES, FEEDBACK_CUES, GAPS, LIST_START,
    OTHER_TOPIC, QUOTE_LABELS, REQUEST_CUES, STRENGTHS, UNITS
)
from talkloom.operators.ranking import number_rows, top_k
from talkloom.session import checkpointed

SALTS = 64
#: Topics that are broadcast at most: a label and two numbers each.
FEW_LABELS = 100_000
BUCKETS = [name for name, _ in QUOTE_LABELS]


def cleaned_turns(messages: DataFrame) -> DataFrame:
    """messages of users and assistants with role and text: no tool calls, cleaned, none empty."""
    kept = [c for c in messages.columns if c not in ("role", "text", "body")]
    turns = messages.where(~T.is_tool_call(F.col("body"))).select(
        *kept, base_role(F.col("role")).alias("role"), T.clean_for_metrics(F.col("body")).alias("text")
    )
    return turns.where("text <> '' and role in ('user', 'assistant')")


def _chars(text: Column) -> Column:
    return F.length(F.replace(text, F.lit(" "), F.lit("")))


def user_message_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with compact (the text with single blanks), char_len and the flags of QUOTE_LABELS."""
    with_text = df.withColumn("compact", T.one_space(F.col(text))).withColumn("char_len", _chars(F.col("compact")))
    c, n = F.col("compact"), F.col("char_len")
    question = c.contains("?") | c.contains("？")
    structure = c.rlike(LIST_START)
    constraint = c.rlike(f"(?i)(?:{CONSTRAINT_CUES})") | c.rlike(rf"(?iU)\d+\s?(?:{UNITS})")
    context = c.rlike(f"(?:{CONTEXT_CUES})") | (n >= 35)
    words = F.regexp_count(c, F.lit("[A-Za-z0-9']+"))
    return with_text.withColumns({
        "clarity": question | c.rlike(f"(?i)(?:{REQUEST_CUES})") | structure | (n >= 18) | (words >= 6),
        "constraint": constraint | (c.rlike(r"\p{Nd}") & (n >= 12)),
        "context": context,
        "feedback": c.rlike(f"(?:{FEEDBACK_CUES})"),
        "vague": (n < 12) & ~question & ~constraint & ~context,
    })


def assistant_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """df with clarify (asks for more) and boundary (says what it can't do)."""
    return df.withColumns(
        {"clarify": F.col(text).rlike(f"(?:{CLARIFY_CUES})"), "boundary": F.col(text).rlike(f"(?i)(?:{BOUNDARY_CUES})")}
    )


def turn_features(turns: DataFrame) -> DataFrame:
    """All flags of turns in one pass; those of users are false on assistants' turns and the other way round."""
    read = assistant_flags(user_message_features(turns))
    user = F.col("role") == "user"
    flags = {name: user & F.col(name) for name in BUCKETS} | {
        name: ~user & F.col(name) for name in ("clarify", "boundary")
    }
    return read.withColumns(flags | {"chars": _chars(F.col("text"))})


def _hits(name: str) -> Column:
    return F.sum(F.col(name).cast("long"))


def conversation_scores(features: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts of both roles, four rates over the user's messages, iteration, and score, the mean of the five."""
    user = F.sum((F.col("role") == "user").cast("long"))
    sums = features.groupBy(*keys).agg(
        user.alias("user_messages"), F.sum((F.col("role") == "assistant").cast("long")).alias("assistant_messages"),
        *(_hits(n).alias(n) for n in BUCKETS[:4])
    )
    rates = {f"{n}_rate": F.col(n) / F.greatest(F.lit(1), F.col("user_messages")) for n in BUCKETS[:4]}
    scored = sums.withColumns(rates).withColumn("iteration", (F.col("user_messages") >= 2).cast("int"))
    total = reduce(Column.__add__, [*(F.col(r) for r in rates), F.col("iteration")])
    return scored.select(
        *keys, "user_messages", "assistant_messages", *rates, "iteration", (total / 5.0).alias("score")
    )


def interaction_totals(features: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row of counters over all turns."""
    user = F.col("role") == "user"
    per = features.groupBy(key).agg(
        F.sum(user.cast("long")).alias("user_messages"), F.sum((~user).cast("long")).alias("assistant_messages"),
        F.sum(F.when(user, F.col("chars")).otherwise(0)).alias("user_chars"), F.sum(
            F.when(~user, F.col("chars")).otherwise(0)
        ).alias("assistant_chars"),
        *(_hits(n).alias(f"{n}_hits") for n in (*BUCKETS[:4], "clarify")),
    )
    names = [c for c in per.columns if c != key]
    return per.agg(
        F.count("*").alias("conversations"),
        F.sum((F.col("user_messages") >= 2).cast("long")).alias("iteration_conversations"),
        *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)
    )


def interaction_summary(totals: DataFrame) -> DataFrame:
    """One row of ratios; none where no user has spoken."""
    per = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return totals.where("user_messages > 0").select(
        "conversations", "user_messages", "assistant_messages",
        per("user_chars", "user_messages").alias("avg_user_len"),
        (
            (F.col("user_messages") + F.col("assistant_messages")) / F.greatest(F.lit(1), F.col("conversations"))
        ).alias("avg_turns"),
        per("clarity_hits", "user_messages").alias("clarity_avg"), *(
            per(f"{n}_hits", "user_messages").alias(f"{n}_rate") for n in BUCKETS[1:4]
        ),
        per(
            "iteration_conversations", "conversations"
        ).alias("iteration_rate"), per("clarify_hits", "assistant_messages").alias("clarification_rate"),
    )


RATES = ["clarity_avg", "constraint_rate", "context_rate", "feedback_rate", "iteration_rate", "clarification_rate"]


def _held_against(summary: DataFrame, rules: list[tuple], schema: str) -> DataFrame:
    table = summary.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rules)], f"place int, {schema}")
    return summary.unpivot([], RATES, "metric", "value").join(F.broadcast(table), "metric")


def strengths(summary: DataFrame, top: int = 3) -> DataFrame:
    """rank, label, value of the rates that reach their threshold, the highest (to three decimals) first."""
    held = _held_against(
        summary, STRENGTHS, "label string, metric string, threshold double"
    ).where("value >= threshold").withColumn("all", F.lit(1))
    return top_k(held, ["all"], [F.desc(F.round("value", 3)), F.asc("place")], top).select("rank", "label", "value")


def gaps(summary: DataFrame, top: int = 3) -> DataFrame:
    """rank, label, value, delta of the rates on the wrong side of their threshold, the farthest first."""
    held = _held_against(summary, GAPS, "label string, metric string, threshold double, reverse boolean")
    short = held.where(
        "(reverse and value >= threshold) or (not reverse and value < threshold)"
    ).withColumn("delta", F.abs(F.col("value") - F.col("threshold"))).withColumn("all", F.lit(1))
    return top_k(
        short, ["all"], [F.desc(F.round("delta", 3)), F.asc("place")], top
    ).select("rank", "label", "value", "delta")


def quote_buckets(features: DataFrame, limit: int = 60, order: tuple[str, ...] = ("index", "msg_pos")) -> DataFrame:
    """bucket, rank, text, score and where it was said: each bucket's best user messages.

    The buckets are few and nearly every message is in one: sub-groups are cut to the limit before buckets are ranked.
    """
    kinds = F.filter(F.array(*(F.when(F.col(n), F.lit(n)) for n in BUCKETS)), lambda b: b.isNotNull())
    said = features.where("role = 'user'").select(
        *order, T.truncate_text(F.col("compact")).alias("text"), "char_len", F.explode(kinds).alias("bucket")
    )
    scored = said.withColumn(
        "score", F.when(F.col("bucket") == "vague", 100 - F.col("char_len")).otherwise(F.col("char_len"))
    )
    return top_k(
        scored, ["bucket"], [F.desc("score"), F.asc("text"), *map(F.asc, order)], limit, salts=SALTS
    ).select("bucket", "rank", "text", "score", *order)


def report_quotes(buckets: DataFrame, most: int = 5) -> DataFrame:
    """place, label, text, index: bucket by bucket, the best quote of a conversation that none before has used."""
    chosen = None
    for place, (bucket, label) in enumerate(QUOTE_LABELS[:most]):
        own = buckets.where(F.col("bucket") == bucket)
        if chosen is not None:
            own = own.join(chosen.select("index"), "index", "left_anti")
        pick = own.orderBy("rank").limit(1).select(
            F.lit(place).alias("place"), F.lit(label).alias("label"), "text", "index"
        )
        chosen = pick if chosen is None else chosen.union(pick)
    return chosen


def boundary_quotes(features: DataFrame, top: int = 4) -> DataFrame:
    """rank, label, text, index: the longest messages in which an assistant says what it can't do."""
    said = features.where("boundary").select(
        "index", "msg_pos", T.truncate_text(F.col("text")).alias("text"), F.length("text").alias("score")
    )
    order = [F.desc("score"), F.asc("text"), F.asc("index"), F.asc("msg_pos")]
    best = said.orderBy(*order).limit(top).withColumn("all", F.lit(1))
    return top_k(best, ["all"], order, top).select("rank", F.lit(BOUNDARY_LABEL).alias("label"), "text", "index")


def topic_trends(
    items: DataFrame, scores: DataFrame, min_points: int = 6, least: float = 0.05, top: int = 4, key: str = "conv_id"
) -> DataFrame:
    """trend, rank, label, delta, early, recent, count: topics whose later half of conversations scores otherwise.

    items needs the key, index, created and cluster_label. Conversations are numbered by label and time over range
    partitions, so a label that most of them have is the work of many tasks; a place within the label is the number
    less the label's first.
    """
    label = F.coalesce("cluster_label", F.lit(OTHER_TOPIC)).alias("label")
    dated = items.where("created is not null").select(key, "index", "created", label)
    scored = dated.join(scores.select(key, "score"), key).select("label", "created", "index", "score")
    points = number_rows(checkpointed(scored), ["label", "created", "index"], "place")  # numbering reads its rows twice
    labels = points.groupBy("label").agg(
        F.min("place").alias("first"), F.count("*").alias("count")
    ).where(F.col("count") >= min_points)
    labels = checkpointed(labels)
    labels = F.broadcast(labels) if labels.count() <= FEW_LABELS else labels
    halves = points.join(labels, "label").withColumn("n", F.col("place") - F.col("first") + 1)
    early = F.col("n") <= F.floor(F.col("count") / 2)
    means = halves.groupBy("label").agg(
        F.avg(F.when(early, F.col("score"))).alias("early"), F.avg(F.when(~early, F.col("score"))).alias("recent"),
        F.max("count").alias("count")
    )
    delta = F.col("recent") - F.col("early")
    moved = means.withColumn("delta", delta).withColumn(
        "trend", F.when(F.col("delta") >= least, "improving").when(F.col("delta") <= -least, "needs_work")
    ).where("trend is not null")
    return top_k(
        moved, ["trend"], [F.desc(F.abs(F.round("delta", 3))), F.desc("count"), F.asc("label")], top
    ).select("trend", "rank", "label", "delta", "early", "recent", "count")
