"""Inputs of the registered queries: the conversations table with every feature of real chats worked into its texts.

The table's texts are plain words, so most rules would never fire. BODY adds lists, code, JSON, Chinese, citations and
so on to every text, by fixed rules of conversation and turn; the same expression runs in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.functions.fields import archive_file_name

OPEN, CLOSE = "\ue200", "\ue201"
FENCE = "chr(96), chr(96), chr(96)"
#: The text as it stands in a JSON string.
ESCAPED = "replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"
BODY = f"""CASE (conv_id * 7 + turn * 3) % 10
  WHEN 0 THEN concat('1. ', text, chr(10), '- summary of risk: ', substring(text, 1, 40), chr(10), 'Is this right?')
  WHEN 1 THEN concat(text, chr(10), {FENCE}, 'python', chr(10), 'x = 1', chr(10), {FENCE}, chr(10), '* next step: budget 20 km')
  WHEN 2 THEN concat('{{"search_query": "', {ESCAPED}, '", "response_length": "short"}}')
  WHEN 3 THEN concat('请帮我比较投资组合和基金，预算 500 元，不超过 3 个月？', chr(10), text)
  WHEN 4 THEN concat('{{"content_type": "audio_transcription", "text": "what should I do next? ', {ESCAPED}, '"}}')
  WHEN 5 THEN concat('我无法访问实时数据，请提供更多信息。', text)
  WHEN 6 THEN concat('ok', chr(10), text)
  WHEN 7 THEN concat('how do stocks, ETF and Python portfolio options work: ', text, chr(10), 'src/app.ts +12: changed')
  WHEN 8 THEN concat('{OPEN}cite turn0search1{CLOSE}太长，改成精简版本　再写 ', text)
  ELSE text END"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, index, msg_pos, role, body."""
    return raw(spark, sf_dir).selectExpr(
        "conv_id", "conv_id + 1 AS index", "turn AS msg_pos", "role", f"{BODY} AS body"
    )


def convs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, index, title, id, created, updated, messages, file."""
    counts = raw(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("messages"))
    hours = lambda n: F.expr(
        f"CASE WHEN conv_id % 11 <> 0 THEN timestampadd(HOUR, cast({n} AS int), timestamp'2024-01-01 00:00:00') END"
    )
    named = counts.select(
        "conv_id", (F.col("conv_id") + 1).alias("index"),
        F.concat(F.lit("Chat "), F.col("conv_id").cast("string")).alias("title"),
        F.concat(F.lit("id-"), F.col("conv_id").cast("string")).alias("id"), hours("conv_id * 7").alias("created"),
        hours("conv_id * 7 + 5").alias("updated"), "messages"
    )
    return named.withColumn(
        "file",
        F.concat(
            F.lit("conversations/"), archive_file_name(F.col("index"), F.col("created"), F.col("title"), F.col("id"))
        )
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convs(spark, sf_dir).where("conv_id % 5 = 0").select(
        "file", F.lit(True).alias("starred"), F.concat(F.lit("note "), F.col("index").cast("string")).alias("note")
    )


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, current_node, mapping: turns as a chain of nodes, with a dead branch below every third turn."""
    turns = raw(spark, sf_dir)
    message = lambda time: F.struct(
        F.struct(
            F.col("role"), F.lit(None).cast("string").alias("name")
        ).alias("author"), time.cast("double").alias("create_time"), F.struct(
            F.lit(False).alias("is_visually_hidden_from_conversation")
        ).alias("metadata"),
        F.to_json(F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts"))).alias("content"),
    )
    name = lambda c, n: F.concat(F.lit(c), F.col(n).cast("string"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    each = turns.join(last, "conv_id")
    branch = F.col("turn") % 3 == 0
    down = F.filter(
        F.array(
            F.when(F.col("turn") < F.col("last"), F.concat(F.lit("n"), (F.col("turn") + 1).cast("string"))),
            F.when(branch, name("d", "turn"))
        ),
        lambda x: x.isNotNull()
    )
    node = F.struct(
        F.when(
            F.col("turn") > F.col("first"), F.concat(F.lit("n"), (F.col("turn") - 1).cast("string"))
        ).alias("parent"),
        down.alias("children"), message(F.col("turn") * 10).alias("message")
    )
    dead = F.struct(
        name("n", "turn").alias("parent"), F.array().cast("array<string>").alias("children"),
        message(F.col("turn") * 10 + 5).alias("message")
    )
    nodes = each.select("conv_id", "last", name("n", "turn").alias("id"), node.alias("node")).union(
        each.where(branch).select("conv_id", "last", name("d", "turn"), dead)
    )
    by_id = lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1)
    rows = nodes.groupBy("conv_id", "last").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", "node")), by_id)).alias("mapping")
    )
    return rows.select(
        "conv_id",
        F.when(F.col("conv_id") % 4 != 0, F.concat(F.lit("n"), F.col("last").cast("string"))).alias("current_node"),
        "mapping"
    )
