"""Benchmark passages within documents, by a prefix-filtered set join (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from talkloom.llm.support import join_by_key, stored, table

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 10, 4
#: Slots of the sieve, a byte each: so many for each shingle, and so many at most.
SLOT_SHARE, MOST_SLOTS = 32, 1 << 23
_CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: ASCII that is neither letter nor digit.
_APART = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII letters (A-Z in lower case), digits and all that isn't ASCII. Null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _CAPITALS + _APART, _CAPITALS.lower() + " " * len(_APART))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _join(words: Column) -> Column:
    return F.array_join(words, " ")


def _each(first: int, last: Column, of) -> Column:
    """of(i) for i from first to last; empty if last is less."""
    return F.transform(F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>")), of)


def _let(value: Column, of) -> Column:
    """of(value), with value computed once however often of() names it: the optimizer may inline a column, but not the
    variable of a lambda."""
    return F.transform(F.array(value), of)[0]


def _hashes(words: Column, n: Column, width: int) -> Column:
    """A hash of each shingle of width words, in order."""
    return _each(0, n - width, lambda i: F.xxhash64(*(words[i + k] for k in range(width))))


def item_windows(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, window, m: the windows of size consecutive words of each item (all m words of a shorter one), each once."""
    def of_words(words: Column) -> Column:
        m = F.least(F.size(words), F.lit(size))
        windows = _each(1, F.size(words) - m + 1, lambda i: _join(F.slice(words, i, m)))
        return F.struct(m.alias("m"), F.when(m > 0, windows).alias("windows"))

    split = items.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("string").alias("item"), _let(words_of(F.col(f"`{text_col}`")), of_words).alias("d")
    )
    return split.select("item", F.explode("d.windows").alias("window"), "d.m").distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window, m, width, offset, h: the shingles of each different window, and where they lie in it. Windows of fewer
    words than a shingle are one shingle of their own width."""
    width = F.least(F.col("m"), F.lit(shingle))
    parts = windows.select("window", "m").distinct().withColumn("words", F.split("window", " ")).withColumn("width", width)
    hashes = None
    for w in range(1, shingle + 1):
        here = _hashes(F.col("words"), F.col("m"), w)
        hashes = F.when(F.col("width") == w, here) if hashes is None else hashes.when(F.col("width") == w, here)
    return parts.withColumn("hashes", hashes).select("window", "m", "width", F.posexplode("hashes").alias("offset", "h"))


class _Sieve:
    """A literal of bounded size: what was put in passes; of the rest, few do."""

    def __init__(self, hashes: DataFrame) -> None:
        n = hashes.select("h").distinct().count()
        self.size = min(MOST_SLOTS, max(1 << 12, 1 << (SLOT_SHARE * n).bit_length()))
        slots = bytearray(self.size)
        places = hashes.select(F.explode(F.array(*self._places(F.col("h")))).alias("p")).distinct()
        for (place,) in places.collect():  # size rows at most
            slots[place] = 1
        self.slots = F.lit(bytes(slots))

    def _places(self, h: Column) -> tuple[Column, Column]:
        spread = F.shiftrightunsigned(h, 32)
        return tuple(F.pmod(x, F.lit(self.size).cast("long")).cast("int") for x in (h, spread))

    def passes(self, h: Column) -> Column:
        first, second = (F.substring(self.slots, p + 1, F.lit(1)) == F.lit(b"\x01") for p in self._places(h))
        return first & second


def shingles_met(documents: DataFrame, shingles: DataFrame, size: int = WINDOW) -> DataFrame:
    """The places of documents (k1, k2, doc, text) where a shingle of the windows may lie: k1, k2, at, h, n and near, the
    words around it, as many as a window may have there; and for each document a row with at = -1 and its n words.

    Shingles are hashed and sifted within the row, so only what passes becomes a row.
    """
    sieve = _Sieve(shingles)
    widths = [r[0] for r in shingles.select("width").distinct().orderBy("width").collect()]  # at most SHINGLE
    whole = F.expr("named_struct('at', -1, 'h', cast(null as bigint), 'begin', 0, 'near', cast(null as array<string>))")

    def passing(words: Column, hashes: Column, w: int) -> Column:
        begin = lambda i: F.greatest(i - (size - w), F.lit(0))
        places = F.filter(_each(0, F.size(hashes) - 1, lambda i: i), lambda i: sieve.passes(hashes[i]))
        near = lambda i: F.slice(words, begin(i) + 1, i + size - begin(i))
        return F.transform(
            places, lambda i: F.struct(i.alias("at"), hashes[i].alias("h"), begin(i).alias("begin"), near(i).alias("near"))
        )

    def of_words(words: Column) -> Column:
        found = [_let(_hashes(words, F.size(words), w), lambda hashes, w=w: passing(words, hashes, w)) for w in widths]
        return F.struct(F.size(words).alias("n"), F.concat(F.array(whole), *found).alias("met"))

    rows = documents.select("k1", "k2", "doc", _let(words_of(F.col("text")), of_words).alias("d"))
    return rows.select("k1", "k2", "doc", "d.n", F.explode("d.met").alias("met")).select("k1", "k2", "doc", "n", "met.*")


def rarest(shingles: DataFrame, met: DataFrame) -> DataFrame:
    """window, m, offset, h, df: of each window the shingle that the fewest places have, df of them. Windows with a
    shingle that is nowhere are left out: a document that holds all of a set holds its rarest member."""
    counts = met.where("at >= 0").groupBy("h").agg(F.count("*").alias("df"))
    known = shingles.select("window", "m", "offset", "h").join(counts, "h", "left")
    least = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "h")).alias("s")
    return known.groupBy("window", "m").agg(least).select("window", "m", "s.offset", "s.h", "s.df").where("df > 0")


def window_places(met: DataFrame, prefixes: DataFrame) -> DataFrame:
    """k1, k2, start, m, window: where documents hold windows. Places of a window's rarest shingle are its candidates;
    those with too few words before or behind are no candidates, and of the others the whole window is compared."""
    places = met.where("at >= 0").select("k1", "k2", "at", "h", "n", "begin", "near")
    total = places.count()
    found = join_by_key(places, prefixes, ["h"], "df", total)
    start = F.col("at") - F.col("offset")
    able = found.withColumn("start", start).where((F.col("start") >= 0) & (F.col("start") + F.col("m") <= F.col("n")))
    same = _join(F.slice("near", F.col("start") - F.col("begin") + 1, F.col("m"))) == F.col("window")
    return able.where(same).select("k1", "k2", "start", "m", "window").distinct()


def contamination(
    df: DataFrame, benchmark: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id",
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and items, their ids sorted as text) for every row of
    df: how many words lie in an occurrence of a window of the benchmark, and which items' windows occur.

    A window is size consecutive words of an item, or all words of a shorter one. Null and empty texts have no words, and
    an item without words has no window; an item without an id takes no part. Repeated rows and ids get a row each;
    items that repeat an id count as one. Other columns are ignored; an empty benchmark hits nothing.
    """
    key = lambda salt: F.xxhash64(F.lit(salt), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    documents = df.select(key(1).alias("k1"), key(2).alias("k2"), F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    windows = stored(item_windows(benchmark, size, item_col, item_text_col), "windows")
    shingles = stored(window_shingles(windows, shingle), "shingles")
    met = stored(shingles_met(documents, shingles, size), "met")
    prefixes = stored(rarest(shingles, met), "prefixes")
    places = stored(window_places(met, prefixes), "places")

    before = Window.partitionBy("k1", "k2").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = places.groupBy("k1", "k2", "start").agg(F.max("m").alias("m")).withColumn("end", F.col("start") + F.col("m"))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))), F.lit(0))
    hits = spans.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").alias("n_hit"))

    held = places.select("k1", "k2", "window").distinct()
    owners = windows.select("item", "window").join(held.groupBy("window").agg(F.count("*").alias("rows")), "window")
    owners = stored(owners, "owners")
    named = join_by_key(held, owners, ["window"], "rows", held.count()).select("k1", "k2", "item").distinct()
    items = named.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("items"))

    whole = met.where("at = -1").select("k1", "k2", "doc", "n")
    found = whole.join(hits.join(items, ["k1", "k2"]), ["k1", "k2"], "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return found.select(
        F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), ids.alias("items"),
    )


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_CAPITALS, _CAPITALS.lower())
OP12_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item, w, least(len(w), {WINDOW}) AS m FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS window
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT n, m, i, array_to_string(w[i:i + m - 1], ' ') AS window
  FROM (SELECT n, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows))),
held AS (SELECT p.n, p.i, p.m, item FROM places p JOIN windows v ON p.window = v.window),
hits AS (SELECT n, count(DISTINCT word) AS n_hit FROM (SELECT n, unnest(range(i, i + m)) AS word FROM held) GROUP BY n),
named AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT n, item FROM held) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (n) LEFT JOIN named USING (n)
"""
