"""Conversations as markdown, the index, search shards and reports: writers, and readers of what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.functions.fields import format_ts
from talkloom.functions.text import strip
from talkloom.operators.messages import in_order

#: What marks a message, its heading and the end of the head in markdown.
MESSAGE_OPEN, MESSAGE_OPENED, MESSAGE_CLOSE, HEADING, HEAD_END = "<!-- MSG role: ", " -->\n", "\n<!-- /MSG -->", "### ", "---"
INDEX_COLUMNS = ["index", "title", "created_utc", "updated_utc", "messages", "file", "id"]


def markdown_blocks(role_label: Column, body: Column) -> Column:
    opened = F.concat(F.lit(MESSAGE_OPEN), role_label, F.lit(MESSAGE_OPENED + HEADING), role_label, F.lit("\n\n"))
    return F.concat(opened, strip(body), F.lit(f"\n{MESSAGE_CLOSE}\n"))


def to_markdown(messages: DataFrame, convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """file, markdown: a document for each conversation of convs (file, title, id, created, updated, messages)."""
    bodies = in_order(messages, markdown_blocks(F.col("role_label"), F.col("body")), key=key, name="blocks")
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value, F.lit("\n"))
    head = F.concat(
        F.lit("# "), F.col("title"), F.lit("\n\n"), F.when(
            F.length("id") > 0, line("id", F.col("id"))
        ).otherwise(F.lit("")),
        line("created_utc", format_ts(F.col("created"))), line("updated_utc", format_ts(F.col("updated"))), line(
            "messages", F.col("messages").cast("string")
        ), F.lit("\n---\n\n"),
    )
    return convs.join(bodies, key, "left").select(
        "file", F.concat(head, F.coalesce("blocks", F.lit(""))).alias("markdown")
    )


def write_markdown(documents: DataFrame, path: str) -> None:
    """A dataset of documents: millions of conversations are no millions of files."""
    documents.write.mode("overwrite").parquet(path)


def _behind(text: Column, mark: str) -> Column:
    """What follows the first mark; null if there is none."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _behind_head(text: Column) -> Column:
    """What follows the first line of three dashes, or the whole text if there is none."""
    rows = F.split(text, "\n")
    at = F.array_position(F.transform(rows, lambda x: F.when(x.contains(HEAD_END), strip(x))), HEAD_END)
    return F.when(at > 0, F.array_join(F.slice(rows, at.cast("int") + 1, F.size(rows)), "\n")).otherwise(text)


def _headed(text: Column) -> Column:
    """role_label and body of a text that starts with its heading line and a blank one; null for any other."""
    at = F.locate("\n\n", text)
    first = F.substring_index(text, "\n", 1)
    return F.when(
        (at > 1) & (F.length(first) == at - 1),
        F.struct(strip(first).alias("role_label"), strip(F.substring(text, at + 2, F.length(text))).alias("body")),
    )


def _marked(pieces: Column) -> Column:
    """role_label and body of what lies before closing markers: each piece's first opening marker that ends in its line
    opens its message, whose text goes on to the end of the piece, further markers included."""
    opened = lambda t: F.position(F.lit(MESSAGE_OPENED), F.concat(F.substring_index(t, "\n", 1), F.lit("\n"))) > 1
    tails = F.transform(pieces, lambda x: F.struct(x.alias("x"), F.split(x, F.lit(rf"\Q{MESSAGE_OPEN}\E")).alias("tails")))
    first = F.transform(tails, lambda p: F.struct(
        p["x"].alias("x"), F.get(F.filter(p["tails"], lambda t, i: (i > 0) & opened(t)), 0).alias("tail")
    ))
    found = F.transform(F.filter(first, lambda p: p["tail"].isNotNull()), lambda p: F.substring(
        p["x"], F.position(F.concat(F.lit(MESSAGE_OPEN), p["tail"]), p["x"]) + len(MESSAGE_OPEN), F.length(p["x"])
    ))
    split = F.transform(found, lambda t: F.struct(
        F.substring_index(t, MESSAGE_OPENED, 1).alias("role"), _behind(t, MESSAGE_OPENED).alias("inside")
    ))
    return F.transform(split, lambda p: F.struct(
        strip(p["role"]).alias("role_label"),
        F.coalesce(F.when(p["inside"].startswith(HEADING), _headed(_behind(p["inside"], HEADING))["body"]), strip(p["inside"])).alias("body"),
    ))


def parse_markdown(documents: DataFrame, text: str = "markdown", name: str = "file") -> DataFrame:
    """name, msg_pos, role_label, body of documents: marked messages, or headings of level three where none is marked.

    Messages start behind the first line of three dashes (or at once, if there is none); empty ones are left out. A text
    is cut at closing markers, or before headings, and each piece read by itself, so no pattern spans a document and the
    work grows with its length. A message that ends right behind its marker or heading is empty.
    """
    plain = F.regexp_replace(F.col(text), "\r\n", "\n")
    closed = F.split("__body", F.lit(f"\\Q{MESSAGE_CLOSE}\\E"))
    marked = _marked(F.slice(closed, 1, F.greatest(F.size(closed) - 1, F.lit(0))))
    parts = F.split(F.concat(F.lit("\n"), F.col("__body")), f"\n{HEADING}")
    legacy = F.transform(F.slice(parts, 2, F.size(parts)), _headed)
    both = F.when(F.col("__body").contains(MESSAGE_OPEN.strip()), marked).otherwise(legacy)
    kept = F.filter(both, lambda m: m["body"] != "")
    bodies = documents.select(name, _behind_head(plain).alias("__body"))
    return bodies.select(name, F.posexplode(kept).alias("msg_pos", "m")).select(name, "msg_pos", "m.role_label", "m.body")


def write_markdown_files(documents: DataFrame, path: str) -> None:
    """A folder by document, named file=<its name>, with its markdown: for archives that people read."""
    named = documents.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("markdown").alias("value"))
    named.write.mode("overwrite").partitionBy("file").text(path)


def read_markdown_archive(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """file, msg_pos, role_label, body of a folder of markdown files, or (pattern "part-*") of write_markdown_files()."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/file=([^/]*)/[^/]*$", 1)
    name = F.when(folder != "", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))).otherwise(F.col("_metadata.file_name"))
    return parse_markdown(files.select(name.alias("file"), F.col("value").alias("markdown")))


def index_rows(convs: DataFrame) -> DataFrame:
    """The index: convs with times as text, in INDEX_COLUMNS."""
    return convs.select(
        "index", "title", format_ts(F.col("created")).alias("created_utc"),
        format_ts(F.col("updated")).alias("updated_utc"), "messages", "file", "id"
    )


def write_index_csv(convs: DataFrame, path: str) -> None:
    index_rows(convs).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_index_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(
        "index int, title string, created_utc string, updated_utc string, messages int, file string, id string"
    ).csv(path)
    return rows.withColumns(
        {
            "title": F.coalesce("title", F.lit("Untitled")), "messages": F.coalesce("messages", F.lit(0)),
            "index": F.coalesce("index", F.lit(0)), "id": F.coalesce("id", F.lit(""))
        }
    )


def index_markdown_rows(convs: DataFrame) -> DataFrame:
    """index, line: the rows of a markdown table of conversations."""
    cells = index_rows(convs)
    line = F.concat(
        F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in INDEX_COLUMNS[:-1])), F.lit(" |")
    )
    return cells.select("index", line.alias("line"))


def write_items(items: DataFrame, insights: DataFrame, path: str) -> None:
    """items as JSON lines, insights (one row, e.g. of report()) beside them."""
    items.write.mode("overwrite").json(f"{path}/items")
    insights.write.mode("overwrite").json(f"{path}/insights")


def with_shard(search: DataFrame, shard_size: int = 300) -> DataFrame:
    """search with shard: consecutive conversations by index; a size of 0 or less makes one shard."""
    return search.withColumn(
        "shard", F.floor((F.col("index") - 1) / shard_size).cast("int") if shard_size > 0 else F.lit(0)
    )


def write_search_shards(search: DataFrame, path: str, shard_size: int = 300) -> None:
    """search (index, file, title, search_text) as JSON files of shard_size conversations each, consecutive by index, and
    beside them the manifest of the files that were written.

    A shard is one object, {"shard": …, "items": […]}, as a viewer loads it; shards are dealt over tasks by their number.
    With a size of 0 or less nothing is cut: each task writes its conversations as lines, and the manifest has a file
    for each. Names are given when files are committed (search-<task>-…), so the manifest is read from what is there.
    """
    if shard_size > 0:
        item = F.struct("index", "file", "title", "search_text")
        each = with_shard(search, shard_size).groupBy("shard").agg(F.array_sort(F.collect_list(item)).alias("items"))
        fields = ("file", "title", "search_text")
        rows = each.select("shard", F.transform("items", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("items"))
        limit = 1
    else:
        rows, limit = search.select("file", "title", "search_text"), 0
    options = {"mapreduce.output.basename": "search", "maxRecordsPerFile": limit}
    rows.write.mode("overwrite").options(**options).json(f"{path}/shards")
    kept = _rows_of_shards(search.sparkSession, f"{path}/shards")
    counts = kept.groupBy("name").agg(F.min("shard").alias("shard"), F.sum("n").alias("count"))
    counts.select("shard", F.col("name").alias("file"), "count").write.mode("overwrite").json(f"{path}/manifest")


def _rows_of_shards(spark: SparkSession, path: str) -> DataFrame:
    """name, shard, n of the rows of written shards: files, and how many conversations a row has."""
    read = spark.read.schema("shard int, items array<struct<file:string>>").json(path)
    return read.select(F.col("_metadata.file_name").alias("name"), "shard", F.coalesce(F.size("items"), F.lit(1)).alias("n"))


def search_manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, file, count of the shards written below path: every file is there and holds so many conversations. The
    total is their sum; shard is null where shards have no size."""
    return spark.read.schema("shard int, file string, count long").json(f"{path}/manifest")


def read_search_shards(spark: SparkSession, path: str) -> DataFrame:
    """file, title, search_text of shards: a row a line, or files of one object with a list of items. path is where
    write_search_shards() wrote, or a folder or file of shards."""
    rows = spark.read.schema(
        "file string, title string, search_text string, items array<struct<file:string,title:string,search_text:string>>"
    ).option("recursiveFileLookup", True).json(path).where(~F.contains("_metadata.file_path", F.lit("/manifest/")))
    listed = rows.where("items is not null").select(F.explode("items").alias("i")).select("i.*")
    return rows.where("items is null").select("file", "title", "search_text").union(listed)


def one_list(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """A small table as one row with a list of structs, in order."""
    kept = F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order))))
    return df.agg(kept.alias(name))


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """An interaction report: each part of a few rows as a list of one JSON document."""
    whole = None
    for name, part in report.items():
        row = one_list(part, name, part.columns)
        whole = row if whole is None else whole.crossJoin(row)  # each side is one row
    whole.coalesce(1).write.mode("overwrite").json(path)
