"""Readers of chat exports: which files, which form each has, and their conversations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from talkloom.functions.contents import member
from talkloom.session import written

NODE = """struct<parent:string, children:array<string>, message:struct<
  author:struct<role:string, name:string>, create_time:double,
  metadata:struct<is_visually_hidden_from_conversation:boolean>,
  content:string>>"""
TREE = f"id string, conversation_id string, title string, create_time double, update_time double, current_node string, mapping map<string, {NODE}>"
GENERIC_CONVERSATION = """id string, conversation_id string, title string, created_utc string, created_at string, create_time string,
  updated_utc string, updated_at string, update_time string,
  messages array<string>"""
#: The names of a chat service's own export files, and the endings of any export's.
EXPORT_NAMES, ENDINGS = ["conversations.json", "conversations.jsonl"], [".json", ".jsonl"]
NO_LIST = "a generic export must be a list of conversations"


def select_export_files(
    spark: SparkSession, folder: str, source: str = "chatgpt", pattern: str | None = None, largest_only: bool = True
) -> DataFrame:
    """path, size, lines (whether it holds a conversation a line) of the export files below a folder; with largest_only
    the largest alone, ties by path. None found is an error.

    Of the source chatgpt, files are those named like its export; of any other, those that end in .json or .jsonl, in
    any case. A pattern of file names takes the place of both. Files are listed by Spark; none is read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = listed.option("pathGlobFilter", pattern) if pattern else listed
    name = F.element_at(F.split("path", "/"), -1)
    lower = F.lower(name)
    fits = F.lit(True) if pattern else name.isin(EXPORT_NAMES) if source == "chatgpt" else lower.endswith(ENDINGS[0]) | lower.endswith(ENDINGS[1])
    files = listed.load(folder).where(fits).select("path", F.col("length").alias("size"), name.endswith(ENDINGS[1]).alias("lines"))
    if files.isEmpty():
        raise FileNotFoundError(f"no export in {folder}")
    ordered = files.orderBy(F.desc("size"), "path")
    return ordered.limit(1) if largest_only else ordered


# -- Items of JSON arrays, however large their file -----------------------------------------------------------------

def _depth(plain: Column, inside: bool) -> Column:
    """Brackets opened less brackets closed outside quotes, of a text without escapes that begins inside quotes or not."""
    outside = F.array_join(F.filter(F.split(plain, '"', -1), lambda x, i: i % 2 == int(inside)), "")
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, value, closed: what lies between the closing braces of files, behind each file's first bracket;
    closed says whether a brace follows. Blocks and n are in the order of the file."""
    meta = F.col("_metadata")
    read = spark.read.option("recursiveFileLookup", True).text(path, lineSep="}").select(
        meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    pieces = written(read, "pieces")
    place = F.struct("block", "n")
    files = pieces.groupBy("file").agg(
        F.min(F.when(F.col("value").contains("["), place)).alias("first"), F.max(place).alias("last"),
        (F.sum(F.octet_length("value") + 1) - F.max("size")).alias("over"),
    )
    # Each piece and a brace behind it make up the file (less three bytes, if it has a byte order mark): only if the last
    # one lacks its brace, there is a byte over.
    lacks = (place == F.col("last")) & ~F.col("over").isin(0, -3)
    value = F.when(place == F.col("first"), F.substring("value", F.locate("[", F.col("value")) + 1, F.length("value"))).otherwise(F.col("value"))
    return pieces.join(files, "file").where(place >= F.col("first")).select("file", "block", "n", value.alias("value"), (~lacks).alias("closed"))


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """file, item (from 0), value: the objects of the JSON arrays in text files, as they are written there.

    Files are read in pieces that end at closing braces, by as many tasks as their size asks for, so none is one record.
    Whether a piece begins within a string, and how deep, follows from the quotes and brackets before it: sums over each
    block of a file, and over the blocks' totals. A piece at whose end the depth is that of the array ends an item. What
    precedes a file's first bracket, what follows the array's end, and an item in which a file breaks off have no row;
    so a file that is cut anywhere gives its complete items. (Of a compressed file cut right behind an item, that item
    is lost, as its end can't be told from a cut.)
    """
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))
    closing = lambda out: F.when(out & F.col("closed"), 1).otherwise(0)
    odd = F.col("quotes") % 2 == 1
    measured = _pieces(spark, path).withColumns({"quotes": quotes, "deep": _depth(plain, False), "deep_inside": _depth(plain, True)})
    # Both cases are summed until it is known in which of them a block begins: outside of quotes, or inside.
    so_far = Window.partitionBy("file", "block").orderBy("n")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    flipped = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    out, within = F.col("deep") - closing(~odd), F.col("deep_inside") - closing(odd)
    placed = measured.withColumn("flipped", flipped).withColumns({
        "depth": F.sum(F.when(F.col("flipped"), within).otherwise(out)).over(so_far),
        "depth_inside": F.sum(F.when(F.col("flipped"), out).otherwise(within)).over(so_far),
    })
    placed = written(placed.drop("deep", "deep_inside"), "placed")
    totals = placed.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max_by("depth", "n").alias("depth"), F.max_by("depth_inside", "n").alias("depth_inside")
    )
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c: F.coalesce(F.sum(c).over(blocks), F.lit(0))
    begun = totals.withColumn("inside", summed("quotes") % 2 == 1)
    begun = begun.withColumn("start", summed(F.when(F.col("inside"), F.col("depth_inside")).otherwise(F.col("depth"))))
    known = placed.join(begun.select("file", "block", "inside", "start"), ["file", "block"])
    depth = F.col("start") + F.when(F.col("inside"), F.col("depth_inside")).otherwise(F.col("depth"))
    quoted = (F.col("inside").cast("int") + F.col("flipped").cast("int") + F.col("quotes")) % 2 == 1
    ended = known.select("file", "block", "n", "value", ((depth == 0) & F.col("closed") & ~quoted).cast("int").alias("ends"))
    ends = ended.groupBy("file", "block").agg(F.sum("ends").alias("ends")).withColumn("earlier", summed("ends"))
    numbered = ended.withColumn("item", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    numbered = numbered.join(ends.select("file", "block", "earlier"), ["file", "block"]).withColumn("item", F.col("earlier") + F.col("item"))
    # An item without end has no closing brace, and so a null text.
    brace = F.max(F.when(F.col("ends") == 1, "}")).alias("brace")
    whole = numbered.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("parts"), brace)
    text = F.regexp_replace(F.concat(F.array_join("parts.value", "}"), "brace"), r"^[\s,]+", "")
    return whole.select("file", "item", text.alias("value")).where("value is not null")


# -- Conversations -------------------------------------------------------------------------------------------------

def read_tree_export(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """One row a conversation of a tree-shaped export (JSON arrays in one or many files). Messages' contents stay JSON text.

    Of a file that breaks off, the conversations before the break are read (see array_items()). A conversation that is
    there, but no JSON of this shape, is an error; mode PERMISSIVE leaves it out.
    """
    items = array_items(spark, path)
    rows = items.select(F.from_json("value", TREE, {"mode": mode}).alias("c")).select("c.*")
    return rows.where("id is not null or conversation_id is not null or mapping is not null")


def read_generic_export(spark: SparkSession, path: str, json_lines: bool | None = None) -> DataFrame:
    """One row a conversation of a flat export, a file or a folder of them: lists, objects that wrap one, or JSON lines.
    The content and text of messages are JSON text, as the file has it.

    Each file that ends in .jsonl holds lines, every other one document (json_lines says so for all of them). A file
    that holds none of these forms fails.
    """
    if json_lines is None:
        name = path.rstrip("/").rpartition("/")[2]
        if name.endswith(tuple(ENDINGS)):
            return read_generic_export(spark, path, name.endswith(ENDINGS[1]))
        # One letter tells the endings apart: .jsonl ends in l.
        both = [_generic(spark, path, lines, glob) for lines, glob in ((True, f"*{ENDINGS[1]}"), (False, "*[!l]"))]
        return both[0].union(both[1])
    return _generic(spark, path, json_lines, "*")


def _generic(spark: SparkSession, path: str, json_lines: bool, names: str) -> DataFrame:
    inner = GENERIC_CONVERSATION.replace(" string", ":string").replace("messages array", "messages:array")
    schema = f"{GENERIC_CONVERSATION}, conversations array<struct<{inner}>>"
    options = {"multiLine": not json_lines, "mode": "FAILFAST", "recursiveFileLookup": True, "pathGlobFilter": names}
    rows = spark.read.schema(schema).options(**options).json(path)
    fields = [f for f in rows.columns if f != "conversations"]
    plain = rows.where("conversations is null").select(*fields)
    wrapped = rows.where("conversations is not null").select(F.explode("conversations").alias("c")).select("c.*")
    found = plain.union(wrapped)
    known = F.coalesce("id", "conversation_id", "title", F.when(F.col("messages").isNotNull(), F.lit("")))
    good = F.when(known.isNotNull(), True).otherwise(F.raise_error(F.lit(NO_LIST)).cast("boolean"))

    def message(raw: Column) -> Column:
        read = F.from_json(raw, "role string, created_utc string, created_at string")
        return F.struct(
            read["role"].alias("role"), member(raw, "content").alias("content"), member(raw, "text").alias("text"),
            read["created_utc"].alias("created_utc"), read["created_at"].alias("created_at"),
        )

    return found.where(good).withColumn("messages", F.transform("messages", message))
