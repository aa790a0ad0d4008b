"""Conversations of exports to clean, ordered messages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from talkloom.functions import fields, text as T
from talkloom.functions.lexicon import METADATA_TYPES
from talkloom.operators.ranking import number_rows


def normalize_conversation_fields(df: DataFrame, strict: bool = False) -> DataFrame:
    """df with title, id, created and updated; empty and zero values count as missing, in the order of the fields."""
    have = set(df.columns)

    def first(*names: str) -> Column:
        texts = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(
            *(F.when((F.length(t) > 0) & ~F.coalesce(t.try_cast("double") == 0, F.lit(False)), t) for t in texts)
        ) if texts else F.lit(None).cast("string")

    ids = [F.col(n).cast("string") for n in ("id", "conversation_id") if n in have]
    return df.withColumns({
        "title": fields.or_else(F.col("title"), F.lit("Untitled")) if "title" in have else F.lit("Untitled"),
        "id": fields.or_else(*ids, F.lit("")) if not ids else F.coalesce(fields.or_else(*ids), F.lit("")),
        "created": fields.to_time(first("created_utc", "created_at", "create_time"), strict),
        "updated": fields.to_time(first("updated_utc", "updated_at", "update_time"), strict),
    })


def number_conversations(df: DataFrame, order: list[str]) -> DataFrame:
    """df with index, the arrival number from 1 in the order of the columns."""
    return number_rows(df, order, "index")


def explode_messages(df: DataFrame, column: str = "messages") -> DataFrame:
    """One row a message, in order: msg_pos from 0, and message."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.posexplode(column).alias("msg_pos", "message"))


def all_nodes(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Every node of a tree that has a message, by its time (0 if none), then by its id: key, node_id, msg_pos, message."""
    nodes = df.select(key, F.explode("mapping").alias("node_id", "node")).where("node.message is not null")
    order = Window.partitionBy(key).orderBy(F.coalesce(F.col("node.message.create_time"), F.lit(0.0)), "node_id")
    return nodes.select(
        key, "node_id", (F.row_number().over(order) - 1).alias("msg_pos"), F.col("node.message").alias("message")
    )


def _walk(nodes: list[dict], current: str | None) -> list[str]:
    parents = {n["id"]: n["parent"] for n in nodes}
    at = current if current in parents else None
    if at is None:
        best = None
        for n in nodes:  # the first of the latest leaves
            if not n["children"] and (best is None or n["time"] > best):
                at, best = n["id"], n["time"]
    path: list[str] = []
    seen: set[str] = set()
    while at is not None and at in parents and at not in seen:
        path.append(at)
        seen.add(at)
        at = parents[at]
    return path[::-1]


def linear_path(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """The active branch of each tree: key, msg_pos, node_id, from the root down.

    It ends at current_node, or where that is no node at the latest leaf (no time counts as 0, the first of equals),
    and starts where a parent is missing or was met before. Only ids, parents and times leave the JVM.
    """
    slim = F.transform(
        F.map_entries("mapping"),
        lambda e: F.struct(
            e.key.alias("id"), e.value["parent"].alias("parent"),
            (F.coalesce(F.size(e.value["children"]), F.lit(0)) > 0).alias("children"),
            F.coalesce(e.value["message"]["create_time"], F.lit(0.0)).alias("time")
        )
    )

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walked = [
                _walk(n.as_py() or [], c.as_py()) for n, c in zip(batch.column("nodes"), batch.column("current_node"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(walked, pa.list_(pa.string()))], ["key", "path"]
            )

    rows = df.select(F.col(key).alias("key"), slim.alias("nodes"), "current_node")
    found = rows.mapInArrow(paths, f"key {rows.schema['key'].dataType.simpleString()}, path array<string>")
    return found.select(F.col("key").alias(key), F.posexplode("path").alias("msg_pos", "node_id"))


def drop_hidden(df: DataFrame, hidden: str = "hidden") -> DataFrame:
    return df.where(~F.coalesce(F.col(hidden), F.lit(False)))


def drop_system(df: DataFrame, role: str = "role") -> DataFrame:
    return df.where(~F.coalesce(F.col(role) == "system", F.lit(False)))


def drop_metadata_types(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    return df.where(~F.coalesce(F.col(content_type).isin(METADATA_TYPES), F.lit(False)))


def drop_tool_calls(df: DataFrame, body: str = "body") -> DataFrame:
    return df.where(~T.is_tool_call(F.col(body)))


def drop_blank(df: DataFrame, body: str = "body") -> DataFrame:
    return df.where(F.length(T.strip(F.col(body))) > 0)


def message_counts(convs: DataFrame, messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """convs with messages, the number of kept messages (0 if none)."""
    counts = messages.groupBy(key).agg(F.count("*").alias("messages"))
    kept = [c for c in convs.columns if c != "messages"]
    return convs.select(*kept).join(counts, key, "left").withColumn(
        "messages", F.coalesce("messages", F.lit(0)).cast("long")
    )


def in_order(
    messages: DataFrame, value: Column, separator: str = "\n", key: str = "conv_id", name: str = "text"
) -> DataFrame:
    """Each conversation's values, joined in the order of its messages; empty ones are left out."""
    rows = messages.select(key, F.struct("msg_pos", value.alias("v")).alias("x")).where("x.v <> ''")
    return rows.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), separator).alias(name)
    )


def extract_text(messages: DataFrame, keep_code: bool = False, key: str = "conv_id") -> DataFrame:
    return in_order(messages, T.normalize_body(F.col("body"), keep_code), key=key)


def search_text(messages: DataFrame, max_chars: int = 0, key: str = "conv_id") -> DataFrame:
    """conv_id, search_text: all of it, or the first max_chars characters."""
    found = in_order(messages, T.normalize_body(F.col("body"), True), key=key, name="search_text")
    return found.withColumn("search_text", T.search_form(F.col("search_text"), max_chars))


def segments(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Text and code segments of each body as a viewer shows them: key, msg_pos, seg_pos, type, lang, text.

    Unlike normalize_body(), broken JSON lines and list prefixes stay; empty segments and tool calls in code go.
    """
    pieces = messages.select(key, "msg_pos", F.posexplode(F.split("body", "```", -1)).alias("seg_pos", "piece"))
    code = F.col("seg_pos") % 2 == 1
    language = T.strip(F.substring_index("piece", "\n", 1))
    inside = T.strip(
        F.when(F.col("piece").contains("\n"), F.regexp_replace("piece", r"^[^\n]*\n", "")).otherwise(F.lit(""))
    )
    shown = F.transform(
        F.filter(F.transform(F.split("piece", "\n", -1), T.strip), lambda x: x != ""),
        lambda x: F.when(T.is_one_json_object(x), T.transcript(x)).when(
            x.contains("sediment://"), F.lit(None).cast("string")
        ).otherwise(T.strip(T.strip_citations(x)))
    )
    prose = F.array_join(F.filter(shown, lambda x: x.isNotNull() & (x != "")), "\n")
    cut = pieces.select(
        key, "msg_pos", "seg_pos", F.when(code, "code").otherwise("text").alias("type"),
        F.when(code, language).alias("lang"), F.when(code, inside).otherwise(prose).alias("text")
    )
    call = (F.col("type") == "code") & F.lower("lang").isin("", "unknown") & T.is_tool_call(F.col("text"))
    return cut.where(F.length("text") > 0).where(~F.coalesce(call, F.lit(False)))
