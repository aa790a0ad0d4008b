"""Tokens, vocabulary, term weights and keywords."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkloom.functions.lexicon import (
    DEFAULT, IDENTIFIER_ENDINGS, NUMBERED_NAME, OTHER_TOPIC, SHORT_NAME, TURN_NAME, Lexicon
)
from talkloom.functions.text import strip_artifact_lines
from talkloom.operators.ranking import top_k

LATIN = "([A-Za-z][A-Za-z0-9_]+)"
HAN = r"([\x{4e00}-\x{9fff}]{2,})"
RUN_PLACE, HAN_PLACE = 1 << 20, 1 << 40


def term_text(title: Column, text: Column) -> Column:
    return strip_artifact_lines(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LATIN), 1)


def han_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(HAN), 1)


def han_ngrams(run: Column, least: int = 2, most: int = 4) -> Column:
    """All substrings of those lengths: by length, then by place."""
    grams = lambda n: F.transform(
        F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, F.lit(n))
    )
    empty = F.array().cast("array<string>")
    return F.concat(*(F.when(F.length(run) >= n, grams(n)).otherwise(empty) for n in range(least, most + 1)))


def is_chinese_term(term: Column) -> Column:
    return term.rlike(r"[\x{4e00}-\x{9fff}]")


def is_noise_term(term: Column, lexicon: Lexicon = DEFAULT) -> Column:
    low = F.lower(term)
    ids = low.rlike(TURN_NAME) | low.rlike(SHORT_NAME) | low.rlike(NUMBERED_NAME)
    return F.coalesce(low.isin(lexicon.noise) | ids | (term == ""), F.lit(True))


def han_vocab(
    docs: DataFrame, n_docs: int, min_df: int | None = None, max_df_ratio: float = 0.35, lexicon: Lexicon = DEFAULT,
    text: str = "text", max_run: int = 0
) -> DataFrame:
    """term: n-grams of Han runs (of their first max_run characters, if any are given) in min_df documents or more and max_df_ratio of them or fewer, and the domain terms.

    Grams are made distinct within their document's row, so the shuffle counts documents.
    """
    n = max(1, n_docs)
    least = (2 if n < 80 else 3) if min_df is None else min_df
    grams = F.array_distinct(
        F.flatten(
            F.transform(han_runs(F.col(text)), lambda r: han_ngrams(F.substring(r, 1, max_run) if max_run else r))
        )
    )
    counted = docs.select(F.explode(grams).alias("term")).where(
        ~F.col("term").isin(lexicon.zh_stop) & ~F.col("term").rlike(r"^(.)\1+$")
    ).groupBy("term").agg(F.count("*").alias("df"))
    learned = counted.where(F.col("df").between(least, int(n * max_df_ratio))).select("term")
    domain = docs.sparkSession.createDataFrame([(t,) for t in lexicon.domain], "term string")
    return learned.union(domain).distinct()


def _cut_in_rows(runs: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """segment_han() with the words at hand in each task: a walk along each run, without a shuffle."""
    shared = runs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in words.collect()))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, places, terms = [], [], []
            for row, run in enumerate(batch.column("run").to_pylist()):
                at = 0
                while at < len(run) - 1:
                    term = next((t for n in (4, 3, 2) if len(t := run[at : at + n]) == n and t in known), None)
                    if term:
                        rows.append(row)
                        places.append(at + 1)
                        terms.append(term)
                    at += len(term or "x")
            whole = batch.select(keys).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(places, pa.int32()), pa.array(terms, pa.string())], [*keys, "pos", "term"])

    kinds = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in keys)
    return runs.select(*keys, "run").mapInArrow(walked, f"{kinds}, pos int, term string")


def segment_han(
    runs: DataFrame, vocab: DataFrame, keys: list[str], lexicon: Lexicon = DEFAULT, broadcast_words: int = 1_000_000
) -> DataFrame:
    """keys, pos, term: each run cut from the left into the longest terms of the vocabulary (4, 3, 2 characters).

    A vocabulary of broadcast_words terms at most (some ten bytes each) is sent to all tasks, and runs are cut where they
    lie. With a larger one candidates meet it in a semi join; a fold over a run's hits, by place and falling length, then
    keeps those that start where the last one has ended or later.
    """
    words = vocab.select("term").where(~F.col("term").isin(lexicon.zh_stop))
    if broadcast_words and words.count() <= broadcast_words:
        return _cut_in_rows(runs, words, keys)
    at = F.explode(
        F.flatten(
            F.transform(
                F.array(F.lit(4), F.lit(3), F.lit(2)),
                lambda n: F.when(
                    F.length("run") >= n,
                    F.transform(
                        F.sequence(F.lit(1), F.length("run") - n + 1),
                        lambda i: F.struct(
                            i.alias("pos"), (-n).alias("less"), F.substring(F.col("run"), i, n).alias("term")
                        )
                    )
                ).otherwise(F.array().cast("array<struct<pos:int,less:int,term:string>>"))
            )
        )
    )
    candidates = runs.select(*keys, at.alias("x")).select(*keys, "x.pos", "x.less", "x.term")
    hits = candidates.join(words, "term", "left_semi").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "less", "term"))).alias("hits")
    )
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<pos:int,less:int,term:string>>").alias("out"))
    kept = F.aggregate(
        "hits", start, lambda s,
        x: F.when(
            x["pos"] >= s["free"],
            F.struct((x["pos"] - x["less"]).alias("free"), F.concat(s["out"], F.array(x)).alias("out"))
        ).otherwise(s),
        lambda s: s["out"]
    )
    return hits.select(*keys, F.explode(kept).alias("x")).select(
        *keys, F.col("x.pos").alias("pos"), F.col("x.term").alias("term")
    )


def normalize_terms(tokens: DataFrame, lexicon: Lexicon = DEFAULT, name: str = "term") -> DataFrame:
    """tokens with the term as it is shown; noise, stop words, addresses, numbers and too short ones go.

    Letter case stays unless an alias (keyed in lower case) says otherwise.
    """
    aliases = tokens.sparkSession.createDataFrame(list(lexicon.aliases.items()), "__key string, __shown string")
    shown = tokens.join(
        F.broadcast(aliases), F.lower(name) == F.col("__key"), "left"
    ).withColumn(name, F.coalesce("__shown", name)).drop("__key", "__shown")
    term, low = F.col(name), F.lower(name)
    short = ~is_chinese_term(term) & (
        ((F.length(low) <= 2) & ~low.isin(lexicon.short_allowed)) | (low.rlike(r"\p{Nd}") & (F.length(low) <= 3))
    )
    drop = is_noise_term(term, lexicon) | low.isin(lexicon.en_stop) | term.isin(lexicon.zh_stop) | low.startswith("http") | low.rlike(r"^\p{Nd}+$") | short
    return shown.where(~drop)


def tokenize(
    docs: DataFrame, vocab: DataFrame | None, keys: list[str], lexicon: Lexicon = DEFAULT, text: str = "text",
    max_chars: int = 0
) -> DataFrame:
    """keys, pos, term: Latin tokens in order, then Chinese ones, of the text (its first max_chars characters, if given).

    vocab None stands for no vocabulary: every n-gram of a run is a token then.
    """
    cut = docs.select(*keys, (F.substring(text, 1, max_chars) if max_chars else F.col(text)).alias("text"))
    latin = cut.select(
        *keys, F.posexplode(latin_tokens(F.col("text"))).alias("pos", "term")
    ).withColumn("pos", F.col("pos").cast("long"))
    runs = cut.select(
        *keys, F.posexplode(han_runs(F.col("text"))).alias("run_no", "run")
    ).where(~F.col("run").isin(lexicon.zh_stop))
    if vocab is None:
        han = runs.select(*keys, "run_no", F.posexplode(han_ngrams(F.col("run"))).alias("pos", "term"))
    else:
        han = segment_han(runs, vocab, [*keys, "run_no"], lexicon)
    han = han.select(
        *keys, (F.lit(HAN_PLACE) + F.col("run_no").cast("long") * RUN_PLACE + F.col("pos")).alias("pos"), "term"
    )
    return normalize_terms(latin.unionByName(han), lexicon)


def term_counts(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))


def doc_freq(tf: DataFrame, index: str = "index") -> DataFrame:
    """term, df, first_index, first_pos: documents of each term, and where it was seen first."""
    first = F.min(F.struct(index, "first_pos"))
    return tf.groupBy("term").agg(F.count("*").alias("df"), first.alias("f")).select(
        "term", "df", F.col(f"f.{index}").alias("first_index"), F.col("f.first_pos").alias("first_pos")
    )


def idf(df: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(max(1, n_docs) + 1)) / (df + 1)) + 1.0


def is_good_keyword(term: Column, df: Column, n_docs: int, lexicon: Lexicon = DEFAULT) -> Column:
    low = F.lower(term)
    listed = low.isin(lexicon.blacklist) | is_noise_term(term, lexicon) | term.isin(lexicon.zh_stop) | low.isin(lexicon.en_stop)
    common = (df < 2) | (df > int(max(1, n_docs) * 0.6))
    short = ~is_chinese_term(term) & (F.length(low) <= 2) & ~low.isin(lexicon.short_allowed)
    code = term.rlike(r"^[\x{00}-\x{7F}]*$") & (
        (
            term.contains("_") & (F.length(term) >= 6)
        ) | term.rlike("^[a-z].*[A-Z]") | term.rlike(f"(?:{'|'.join(IDENTIFIER_ENDINGS)})$")
    )
    return ~(listed | common | short | code)


def tfidf_keywords(
    tf: DataFrame, df: DataFrame, n_docs: int, keys: list[str], limit: int = 8, lexicon: Lexicon = DEFAULT
) -> DataFrame:
    """keys, rank, term, tf, df, weight: each document's best terms. Only good keywords are joined."""
    good = df.where(is_good_keyword(F.col("term"), F.col("df"), n_docs, lexicon)).select("term", "df")
    weighed = tf.join(good, "term").withColumn(
        "weight", (1.0 + F.log(F.col("tf").cast("double"))) * idf(F.col("df"), n_docs)
    )
    best = top_k(weighed, keys, [F.desc("weight"), F.desc("tf"), F.asc("term")], limit)
    return best.select(*keys, "rank", "term", "tf", "df", "weight")


def topic_labels(
    docs: DataFrame, tf: DataFrame, keywords: DataFrame, n_docs: int, key: str = "conv_id",
    min_fallback_df: int | None = None, lexicon: Lexicon = DEFAULT
) -> DataFrame:
    """key, cluster_label for every row of docs: the rule with the most hits (two or more; earlier rules win ties),
    else the first keyword that enough documents share, else the label of all others."""
    n = max(1, n_docs)
    least = (3 if n < 100 else max(8, int(n * 0.005))) if min_fallback_df is None else min_fallback_df
    triggers = sorted({(t.lower(), label, place) for place, (label, terms) in enumerate(lexicon.topics) for t in terms})
    rules = tf.sparkSession.createDataFrame(triggers, "low string, label string, place int")
    scores = tf.withColumn("low", F.lower("term")).join(F.broadcast(rules), "low").groupBy(key, "label", "place").agg(F.sum("tf").alias("hits"))
    ruled = scores.groupBy(key).agg(
        F.max_by("label", F.struct("hits", -F.col("place"))).alias("rule"), F.max("hits").alias("hits")
    ).where("hits >= 2").select(key, "rule")
    shared = keywords.where(
        (F.col("df") >= least) & ~F.lower("term").isin(lexicon.blacklist)
    ).groupBy(key).agg(F.min_by("term", "rank").alias("shared"))
    return docs.select(key).join(ruled, key, "left").join(shared, key, "left").select(
        key, F.coalesce("rule", "shared", F.lit(OTHER_TOPIC)).alias("cluster_label")
    )


def _interleaved(candidates: DataFrame, taken: DataFrame, limit: int, han_a_round: int, n_taken: int = 0) -> DataFrame:
    """Rounds of so many Chinese terms and one other, each by falling df; terms already taken (n_taken at most) use up
    their turn, so what fills limit places is among the first limit + n_taken of each side."""
    depth = limit + n_taken
    order = [F.desc("df"), F.asc("first_index"), F.asc("first_pos")]
    n = F.col("n") - 1
    sides = []
    for han, share in ((True, han_a_round), (False, 1)):
        side = candidates.where(is_chinese_term(F.col("term")) == han).orderBy(*order).limit(depth).withColumn("all", F.lit(1))
        side = top_k(side, ["all"], order, depth, "n")
        sides.append(
            side.select(
                "term", "df", F.floor(n / share).alias("round"),
                (F.pmod(n, F.lit(share)) if han else F.lit(han_a_round)).cast("int").alias("turn")
            )
        )
    return sides[0].union(sides[1]).join(taken.select("term"), "term", "left_anti")


def hot_terms(df: DataFrame, n_docs: int, limit: int = 40, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """rank, term, count: the pinned terms that are good keywords here, then two Chinese terms to one other."""
    good = df.where(is_good_keyword(F.col("term"), F.col("df"), n_docs, lexicon))
    pins = df.sparkSession.createDataFrame([(t, k) for k, t in enumerate(lexicon.pinned)], "term string, turn int")
    pinned = good.join(F.broadcast(pins), "term").select("term", "df", F.lit(-1).cast("long").alias("round"), "turn")
    rest = _interleaved(good, pinned, limit, 2, len(lexicon.pinned))
    best = pinned.union(rest).orderBy("round", "turn").limit(limit).withColumn("all", F.lit(1))
    return top_k(
        best, ["all"], [F.asc("round"), F.asc("turn")], limit
    ).select("rank", "term", F.col("df").alias("count"))


def mix_keywords(df: DataFrame, limit: int = 40) -> DataFrame:
    """rank, term, count: Chinese and other terms in turn, each by falling count."""
    none = df.sparkSession.createDataFrame([], "term string")
    best = _interleaved(df, none, limit, 1).orderBy("round", "turn").limit(limit).withColumn("all", F.lit(1))
    return top_k(
        best, ["all"], [F.asc("round"), F.asc("turn")], limit
    ).select("rank", "term", F.col("df").alias("count"))
