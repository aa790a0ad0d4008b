"""Search, filters, order, similar items and notes over the items table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from talkloom.operators.joins import join_by_key
from talkloom.operators.ranking import number_rows, top_k
from talkloom.session import checkpointed


def search(items: DataFrame, texts: DataFrame | None, query: str) -> DataFrame:
    """Items in which every word of the query is part of title, keywords, snippet or search text, in any case."""
    joined = items if texts is None else items.join(
        texts.select("file", F.col("search_text").alias("__text")), "file", "left"
    )
    where = [
        F.lower("title"), F.lower(F.array_join("keywords", " ")), F.lower("snippet"),
        *([] if texts is None else [F.col("__text")])
    ]
    for word in query.lower().split():
        joined = joined.where(
            reduce(Column.__or__, [F.coalesce(F.contains(c, F.lit(word)), F.lit(False)) for c in where])
        )
    return joined.select(*items.columns)


#: Queries that are broadcast at once; each is a short text.
QUERIES = 2000


def search_many(items: DataFrame, texts: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, file for each query (query_id, query) whose words are all found in an item, see search().

    The items are scanned once for every QUERIES queries, which are broadcast.
    """
    hay = items.join(texts.select("file", "search_text"), "file", "left")
    parts = (F.lower("title"), F.lower(F.array_join("keywords", " ")), F.lower("snippet"), F.col("search_text"))
    hay = hay.select("file", F.concat_ws("\n", *parts).alias("hay"))
    blocks = max(1, -(-queries.count() // QUERIES))
    words = queries.select("query_id", F.filter(F.split(F.lower("query"), r"\s+"), lambda w: w != "").alias("words"))
    found = None
    for block in range(blocks):
        some = words.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        met = hay.join(
            F.broadcast(some), F.forall("words", lambda w: F.contains(F.col("hay"), w))
        ).select("query_id", "file")
        found = met if found is None else found.union(met)
    return found


def by_min_messages(items: DataFrame, n: int) -> DataFrame:
    return items.where(F.col("messages") >= n) if n else items


def by_starred(items: DataFrame, annotations: DataFrame) -> DataFrame:
    return items.join(annotations.where("starred").select("file"), "file", "left_semi")


def by_keyword(items: DataFrame, keyword: str) -> DataFrame:
    return items.where(F.array_contains("keywords", keyword))


def by_topic(items: DataFrame, label: str) -> DataFrame:
    return items.where(F.col("cluster_label") == label)


def by_date_range(
    items: DataFrame, start: str | None = None, end: str | None = None, whole_end_day: bool = False
) -> DataFrame:
    """Items created from start to end (days, at midnight UTC: the end day itself is out after it, unless whole_end_day).
    Items without a date are out as soon as there is a bound."""
    if start:
        items = items.where(F.col("created") >= F.lit(datetime.fromisoformat(start)).cast("timestamp"))
    if end:
        bound = F.lit(datetime.fromisoformat(end)).cast("timestamp")
        items = items.where(
            F.col("created") < bound + F.expr("interval 1 day") if whole_end_day else F.col("created") <= bound
        )
    return items


def filter_items(
    items: DataFrame, texts: DataFrame | None = None, query: str = "", min_messages: int = 0,
    starred: DataFrame | None = None, keyword: str | None = None, topic: str | None = None, start: str | None = None,
    end: str | None = None, whole_end_day: bool = False
) -> DataFrame:
    """All given filters at once. The cheap ones come first and reach the scan."""
    found = by_date_range(by_min_messages(items, min_messages), start, end, whole_end_day)
    found = by_topic(found, topic) if topic else found
    found = by_keyword(found, keyword) if keyword else found
    found = by_starred(found, starred) if starred is not None else found
    return search(found, texts, query) if query.strip() else found


def _item_order(by: str) -> list[Column]:
    orders = {
        "updated": F.desc_nulls_last("updated"), "created": F.asc_nulls_last("created"), "messages": F.desc("messages")
    }
    return [orders[by], F.asc("index")]


def sort_items(items: DataFrame, by: str = "updated") -> DataFrame:
    """By updated (latest first), created (earliest first) or messages (most first); no date last, ties by index."""
    return items.orderBy(*_item_order(by))


def item_places(items: DataFrame, by: str = "updated", name: str = "place") -> DataFrame:
    """items with the place, from 1, that each has in the order of sort_items()."""
    return number_rows(items, _item_order(by), name)


#: Items that share a keyword of at most so many are paired directly. Of an item's frequent keywords all sets are listed, if
#: it has so many of them at most.
RARE, MOST_FREQUENT = 32, 8


def _subsets(words: str) -> Column:
    """All non-empty subsets of an array of a few words, each in the array's order."""
    n = F.size(words)
    masks = F.when(
        n > 0, F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), n) - 1)
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        masks, lambda m: F.filter(words, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(1) == 1)
    )


def _by_score() -> list[Column]:
    return [F.desc("score"), F.asc("ib")]


def _scored(pairs: DataFrame) -> DataFrame:
    both = F.size(F.array_intersect("words", "theirs"))
    return pairs.withColumn("score", both / (F.size("words") + F.size("theirs") - both)).select("a", "b", "ib", "score")


def _held_against_all(told: DataFrame, long: DataFrame) -> Iterator[DataFrame]:
    """Pairs (a, words, b, ib, theirs) of items with a common word of which one is long, from either side's view."""
    blocks = -(-long.count() // QUERIES)
    for block in range(blocks):
        part = long.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == block)
        others = F.broadcast(part.select(F.col("a").alias("b"), F.col("index").alias("ib"), F.col("words").alias("theirs")))
        met = told.join(others, F.arrays_overlap("words", "theirs") & (F.col("a") != F.col("b")))
        yield met.select("a", "words", "b", "ib", "theirs")
        yield met.select(F.col("b").alias("a"), F.col("theirs").alias("words"), F.col("a").alias("b"), F.col("index").alias("ib"), F.col("words").alias("theirs"))


def similar(items: DataFrame, k: int = 5, key: str = "conv_id") -> DataFrame:
    """key, other, score, rank: each item's k most similar others by the Jaccard index of their keywords, ties by index.

    No group of items is paired with itself. An item and one of its k best share either a keyword that RARE items have
    at most, and meet there; or they share frequent keywords alone. Let T be those: among the items that hold T and are
    as many words large as the other, the other is one of the first k + 1 by index, as each before it is at least as
    similar. So for each set T of frequent keywords and each size, the first k + 1 items are all that can matter.
    Scores are computed from the whole keyword lists. Items that hold more than MOST_FREQUENT frequent keywords, whose sets
    would be too many, are queries instead: QUERIES of them at a time are held against all items.
    """
    told = items.select(F.col(key).alias("a"), "index", F.array_sort(F.array_distinct("keywords")).alias("words"))
    told = checkpointed(told.where(F.size("words") > 0))
    each = told.select("a", "index", "words", F.explode("words").alias("word"))
    counts = checkpointed(each.groupBy("word").agg(F.count("*").alias("n")).withColumn("df", F.col("n")))
    known = checkpointed(join_by_key(each, counts, ["word"], "n", counts.agg(F.sum("n")).first()[0] or 0))

    rare = known.where(F.col("df") <= RARE)
    others = rare.select("word", F.col("a").alias("b"), F.col("index").alias("ib"), F.col("words").alias("theirs"))
    met = rare.select("a", "words", "word").join(others, "word").drop("word")

    frequent = known.where(F.col("df") > RARE).groupBy("a", "index", "words").agg(
        F.array_sort(F.collect_list("word")).alias("frequent")
    )
    frequent = checkpointed(frequent)
    few = frequent.where(F.size("frequent") <= MOST_FREQUENT)
    sets = checkpointed(few.select("a", "index", "words", F.explode(_subsets("frequent")).alias("set")))
    held = sets.select(
        "set", F.size("words").alias("size"),
        F.struct(F.col("index").alias("ib"), F.col("a").alias("b"), F.col("words").alias("theirs")).alias("item")
    )
    first = top_k(
        held, ["set", "size"], [F.asc("item.ib")], k + 1, "place"
    ).groupBy("set").agg(F.collect_list("item").alias("items"))
    sized = checkpointed(first.join(sets.groupBy("set").agg(F.count("*").alias("n")).where("n > 1"), "set"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    listed = join_by_key(sets, sized, ["set"], "n", total).select("a", "words", F.explode("items").alias("item"))
    met = met.union(listed.select("a", "words", "item.b", "item.ib", "item.theirs")).where(F.col("a") != F.col("b"))

    scored = _scored(met)
    for pairs in _held_against_all(told, frequent.where(F.size("frequent") > MOST_FREQUENT)):
        scored = scored.union(top_k(_scored(pairs), ["a"], _by_score(), k).drop("rank"))
    best = top_k(scored.distinct(), ["a"], _by_score(), k)
    return best.select(F.col("a").alias(key), F.col("b").alias("other"), "score", "rank")


def similar_to(items: DataFrame, key_value, k: int = 5, key: str = "conv_id") -> DataFrame:
    """other, score, rank of one item: its few keywords are a literal, so the items are scanned once."""
    row = items.where(F.col(key) == key_value).select("keywords").first()
    own = sorted(set(row[0] or [])) if row else []
    if not own:
        return items.sparkSession.createDataFrame([], "other long, score double, rank int")
    words = F.array(*map(F.lit, own))
    both, n = F.size(F.array_intersect(F.col("keywords"), words)), F.size(F.array_union(F.col("keywords"), words))
    best = items.where(F.col(key) != key_value).withColumn("score", both / n).where("score > 0").orderBy(F.desc("score"), "index").limit(k).withColumn("all", F.lit(1))
    return top_k(best, ["all"], [F.desc("score"), F.asc("index")], k).select(F.col(key).alias("other"), "score", "rank")


def random_item(items: DataFrame, seed: int) -> DataFrame:
    """One item, the same for a seed however the items are partitioned: that of the least hash of seed and file."""
    return items.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "file")), "file").limit(1)


def attach_notes(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """items with starred and note."""
    kept = [c for c in items.columns if c not in ("starred", "note")]
    return items.select(*kept).join(
        annotations.select("file", "starred", "note"), "file", "left"
    ).withColumn("starred", F.coalesce("starred", F.lit(False)))
