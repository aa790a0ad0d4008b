"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.llm.support import cut, small_batches, stored, table

#: Labelled rows to learn from, at most (in the mean: rows are taken by a hash of their id).
SAMPLE = 12_000
#: Rows of the sample that the lexicon weighs in turn without, and every how many rows serve calibration alone.
FOLDS, CALIBRATION = 4, 4
#: A unit enters the lexicon with at least so many toxic texts and at least this z-score of its log odds.
LEAST_TEXTS, LEAST_Z = 3, 2.5
PREFIXES = (4, 5)
REMEMBERED = 150_000

# Second-person words of the four languages, and what stands for letters in disguised words.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen deinem deiner euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestra vuestro tus su sus".split()
)
DISGUISES = str.maketrans(
    {
        "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l",
        "€": "e", "*": None, ".": None, "-": None, "_": None, "+": "t"
    }
)

EDGES = re.compile(r"^\W+|[\W_]+$")
PUNCTUATION = re.compile(r"[^\w\s]")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
REPEATED = re.compile(r"([^\W\d_])\1{2,}|([!?*.])\2{2,}")
FEATURES = (
    "word_max", "word_sum", "word_hits", "word_density", "prefix_max", "prefix_sum", "prefix_hits", "prefix_density",
    "nearness_to_second_person", "second_person_density", "capitals", "shouted_words", "punctuation", "exclamations",
    "disguised_words", "disguised_hits", "repetitions", "log_words",
)


def units_of(word: str) -> tuple[str, str]:
    """The word without what isn't a letter or digit at its ends, and what it says if digits and signs stand for letters."""
    core = EDGES.sub("", word)
    if core.isalpha() or not any(c.isalpha() for c in word):
        return core, ""
    return core, EDGES.sub("", word.strip(".,;:?!()\"'").translate(DISGUISES))


def prefixes_of(core: str) -> list[str]:
    return [core[:n] + "~" for n in PREFIXES if len(core) > n]


def count_units(sample: DataFrame) -> DataFrame:
    """unit, fold, label, texts: in how many texts of the sample each word and word start stands."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            unit, fold, label = zip(*seen)
            texts = list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(unit), pa.array(fold, pa.int32()), pa.array(label, pa.int32()), pa.array(texts, pa.int64())],
                ["unit", "fold", "label", "texts"]
            )

        for batch in batches:
            for text, fold, label in zip(
                batch.column("text"), batch.column("fold").to_pylist(), batch.column("label").to_pylist()
            ):
                cores = {units_of(w)[0] for w in text.as_py().lower().split()}
                units = {u for c in cores if c for u in (c, *prefixes_of(c))}
                seen.update((u, fold, label) for u in units)
                if len(seen) > 1_000_000:
                    yield flush()
        if seen:
            yield flush()

    return sample.select("text", "fold", "label").mapInArrow(counted, "unit string, fold int, label int, texts long")


def lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """unit -> z-score of its log odds, by fold from all rows but the fold's, and last from all rows."""
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("fold", "label").count().collect()}
    sums = [
        F.sum(
            F.when((F.col("fold") == k) & (F.col("label") == y), F.col("texts")).otherwise(0)
        ).alias(f"n{k}_{y}") for k in range(FOLDS) for y in (0, 1)
    ]
    toxic = sum((F.col(f"n{k}_1") for k in range(1, FOLDS)), F.col("n0_1"))
    rows = count_units(sample).groupBy("unit").agg(*sums).where(toxic >= LEAST_TEXTS).collect()  # bounded by the sample
    out = []
    for left_out in (*range(FOLDS), None):
        folds = [k for k in range(FOLDS) if k != left_out]
        total = [sum(sizes.get((k, y), 0) for k in folds) for y in (0, 1)]
        lexicon = {}
        for r in rows:
            clean, bad = (sum(r[1 + 2 * k + y] for k in folds) for y in (0, 1))
            if bad >= LEAST_TEXTS:
                odds = math.log((bad + 0.5) / (total[1] + 1)) - math.log((clean + 0.5) / (total[0] + 1))
                z = odds / math.sqrt(1 / (bad + 0.5) + 1 / (clean + 0.5))
                if z >= LEAST_Z:
                    lexicon[r[0]] = round(z, 4)
        out.append(lexicon)
    return out


class Reader(dict):
    """word -> None, or (weight, prefix weight, second person, disguised, disguised weight) of a word that counts."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        core, plain = units_of(word)
        weight = self.lexicon.get(core, 0.0)
        start = max((self.lexicon.get(p, 0.0) for p in prefixes_of(core)), default=0.0)
        disguised = bool(plain) and plain != core
        hidden = self.lexicon.get(plain, 0.0) if disguised else 0.0
        found = (
            weight, start, core in SECOND_PERSON, disguised, hidden
        ) if weight or start or disguised or core in SECOND_PERSON else None
        if len(self) < REMEMBERED:
            self[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.lower().split()
        n = max(len(words), 1)
        met = [(at, x) for at, x in enumerate(map(self.__getitem__, words)) if x is not None]
        weights = {words[at]: max(x[0], x[4]) for at, x in met if x[0] or x[4]}
        starts = {words[at]: x[1] for at, x in met if x[1]}
        hits = [at for at, x in met if x[0] or x[1] or x[4]]
        persons = [at for at, x in met if x[2]]
        nearest, p = math.inf, 0
        for at in hits:
            while p < len(persons) and persons[p] < at:
                p += 1
            nearest = min(nearest, *(abs(persons[k] - at) for k in (p - 1, p) if 0 <= k < len(persons)), math.inf)
        length = max(len(text), 1)
        return [
            max(weights.values(), default=0.0), sum(weights.values()), float(len(weights)), 100.0 * sum(1 for _, x in met if x[0]) / n,
            max(starts.values(), default=0.0), sum(starts.values()), float(len(starts)), 100.0 * sum(1 for _, x in met if x[1]) / n,
            1.0 / (1.0 + nearest), 100.0 * len(persons) / n, len(CAPITALS.findall(text)) / length, 100.0 * len(SHOUTED.findall(text)) / n,
            len(PUNCTUATION.findall(text)) / length, (text.count("!") + text.count("?")) / length,
            100.0 * sum(1 for _, x in met if x[3]) / n, float(sum(1 for _, x in met if x[4])), 100.0 * sum(1 for _ in REPEATED.finditer(text)) / n, math.log1p(len(words)),
        ]


def features_of(text: Column, lexicons: list[dict[str, float]], which: Column | None = None) -> Column:
    """The dense features of a text (FEATURES, in order), as an array of doubles; a null text has those of an empty one.
    which is the place of the row's lexicon among lexicons (the first, if left out)."""

    @F.pandas_udf("array<double>")
    def read(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        readers = [Reader(lexicon) for lexicon in lexicons]
        for texts, places in rows:
            yield pd.Series([readers[k].features(t) for t, k in zip(texts, places)], dtype=object)

    return read(text, F.lit(0) if which is None else which)


@dataclass
class ToxicityModel:
    """What scores texts: a lexicon, trees and their calibration; or, without rows of both labels, one score for all."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    constant: float = 0.0

    def with_score(self, df: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """df with a score from 0 to 1 of each whole text; higher is likelier toxic."""
        kept = [F.col(f"`{c}`") for c in df.columns if c != name]
        if self.trees is None:
            return df.select(*kept, F.lit(self.constant).alias(name))
        small_batches(df.sparkSession)
        read = df.withColumn("__features", array_to_vector(features_of(F.col(f"`{text_col}`"), [self.lexicon])))
        judged = self.calibration.transform(_with_margin(self.trees, read))
        return judged.select(*kept, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)).alias(name))


def _with_margin(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    return trees.transform(df).withColumn("__margin", vector_to_array("__raw")[1])


def in_held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = 24, depth: int = 4, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """A model of the labels, from labelled documents that are not held out (crc32 of the id mod 5 isn't 0).

    sample bounds the rows in the mean, whatever the tables' size: rows are taken by a hash of the id. A quarter of
    them calibrates what the trees, grown on the rest, return. So that trees don't trust the lexicon on rows it was
    counted on, each row's features use the lexicon of the other folds. Null labels and ids teach nothing.
    """
    key = F.col(f"`{id_col}`").alias("id")
    given = labels.select(
        key, F.col(f"`{label_col}`").cast("int").alias("label")
    ).where("id is not null and label in (0, 1)").where(~in_held_out(F.col("id")))
    n = given.count()
    slot = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    chosen = given.where(slot < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20))))
    texts = docs.select(key, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    h = F.xxhash64("id", F.lit(seed + 1))
    rows = texts.join(F.broadcast(chosen), "id").select(
        "text", "label", F.pmod(h, F.lit(CALIBRATION)).cast("int").alias("part"),
        F.pmod(F.shiftright(h, 8), F.lit(FOLDS)).cast("int").alias("fold")
    )
    rows = stored(rows, "toxicity-sample")
    have = {(r[0], r[1]): r[2] for r in rows.groupBy(F.col("part") > 0, "label").count().collect()}
    if not all(have.get((grown, y)) for grown in (True, False) for y in (0, 1)):
        total = sum(have.values())
        return ToxicityModel({}, None, None, sum(v for k, v in have.items() if k[1]) / total if total else 0.0)
    lexicon = lexicons(rows.where("part > 0"))
    which = F.when(F.col("part") > 0, F.col("fold")).otherwise(FOLDS)  # calibrating rows: that of all others
    read = rows.select("part", "label", features_of(F.col("text"), lexicon, which).alias("f"))
    read = cut(read).select(
        "part", F.col("label").cast("double").alias("label"), array_to_vector("f").alias("__features")
    ).coalesce(1)  # sample rows of a few numbers
    grow = GBTClassifier(
        featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=trees, maxDepth=depth,
        stepSize=0.3, seed=seed, minInstancesPerNode=3
    )
    grow.setRawPredictionCol("__raw").setProbabilityCol("__probability")
    grown = grow.fit(read.where("part > 0"))
    calibrate = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="__score")
    return ToxicityModel(
        lexicon[-1], grown, calibrate.fit(cut(_with_margin(grown, read.where("part = 0")).select("__margin", "label")))
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, at_least: float = 0.5, text_col: str = "text", **fit
) -> DataFrame:
    """The rows of docs whose score is under the bound; every row is scored on its own text."""
    model = fit_toxicity(docs, labels, text_col=text_col, **fit)
    return model.with_score(docs, text_col, "__toxicity").where(F.col("__toxicity") < at_least).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit_toxicity(docs, table(spark, sf_dir, "labels")).with_score(docs)
    return scored.select(
        "doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
