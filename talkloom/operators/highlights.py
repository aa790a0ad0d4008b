"""Lines of a conversation worth showing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkloom.functions import text as T
from talkloom.functions.lexicon import HIGHLIGHT_CUES
from talkloom.operators.ranking import first_seen, top_k


def highlight_lines(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, msg_pos, line_pos, line, score of lines outside code that say or ask something: 2 for a cue, 1 for a
    question mark at the end, a half for a list prefix; lines of 6 to 180 characters with a score."""
    found = messages.select(
        key, "msg_pos",
        F.posexplode(F.transform(T.lines(T.outside_code(F.col("body"))), T.strip)).alias("line_pos", "raw")
    ).where("raw <> ''")
    line = F.when(T.is_braced(F.col("raw")), T.transcript(F.col("raw"))).otherwise(T.clean_prose(F.col("raw")))
    score = F.when(
        F.col("line").rlike(f"(?i)(?:{HIGHLIGHT_CUES})"), 2.0
    ).otherwise(0.0) + F.when(F.col("line").rlike("[?？]$"), 1.0).otherwise(0.0) + F.when(F.col("raw").rlike(T.LIST_PREFIX), 0.5).otherwise(0.0)
    scored = found.withColumn("line", line).where(F.length("line").between(6, 180)).withColumn("score", score)
    return scored.where("score > 0").select(key, "msg_pos", "line_pos", "line", "score")


def highlights(messages: DataFrame, limit: int = 8, key: str = "conv_id") -> DataFrame:
    """key, rank, line, score: the best lines of a conversation; of equal lines the first counts."""
    order = [F.asc("msg_pos"), F.asc("line_pos")]
    best = top_k(
        first_seen(highlight_lines(messages, key), [key, "line"], order), [key], [F.desc("score"), *order], limit
    )
    return best.select(key, "rank", "line", "score")
