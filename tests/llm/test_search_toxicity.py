import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkloom.llm import topk
from talkloom.llm.topk import quantised, top_k
from talkloom.llm.toxicity import FEATURES, Reader, features_of, fit_toxicity, in_held_out, units_of, without_toxic


def by_hand(rows, k):
    """Of (row, id, whole vector): each query row's best others, as (id, score)."""
    out = {}
    for q, i, a in rows:
        if i % 50 == 0:
            scored = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), j, r) for r, j, b in rows if r != q and len(a) == len(b))
            out.setdefault(i, []).append([(j, -s) for s, j, _ in scored[:k]])
    return {i: sorted(v) for i, v in out.items()}


def searched(vectors, k=5, **how):
    found = topk.search_blocks(vectors.where("vec_id % 50 = 0"), vectors, k, **how)
    assert found.where("tested is null and vec_id is null").count() == 0
    got = {}
    ranked = top_k(vectors.where("vec_id % 50 = 0"), vectors, k, **how).toPandas()
    for q, g in ranked.groupby("query_id"):
        got[q] = [(int(r.vec_id), int(r.score)) for r in g.sort_values(["rank", "vec_id"]).itertuples()]
    return got


@pytest.mark.parametrize("scale, block", [(256.0, 64), (1.0, 8192), (1e9, 40)])
def test_top_k_is_exact(spark, monkeypatch, scale, block):
    monkeypatch.setattr(topk, "QUERIES", 3)  # so that crowds of queries are cut into parts
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)] + [(1000 + k, [0.5] * 6) for k in range(20)] + [(2000 + k, rng.normal(size=3).tolist()) for k in range(3)]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, rank string").repartition(3)
    got = searched(quantised(df, scale), block=block)
    want = by_hand([(n, i, np.floor(np.array(v) * scale)) for n, (i, v) in enumerate(rows)], 5)
    assert got == {i: v[0] for i, v in want.items()} and len(got[2000]) == 2


def test_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 40 * 10, rng.normal(size=4).round(2).tolist()) for k in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    vectors = quantised(df)
    found = top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).toPandas()
    assert found.groupby(["query_id", "rank"]).size().eq(2).all() and set(found["rank"]) == {1, 2, 3, 4, 5}
    want = by_hand([(n, i, np.floor(np.array(v) * 256)) for n, (i, v) in enumerate(rows)], 5)
    for i, both in want.items():
        assert sorted(found[found.query_id == i][["vec_id", "score"]].apply(tuple, axis=1)) == sorted(x for one in both for x in one)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e12, 0.0]), (1, [3e12, 0.0]), (2, [2e12, 0.0]), (3, [-5e12, 1.0]), (4, [1e307, 0.0])]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = top_k(vectors.where("vec_id = 0"), vectors, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 2**63 - 1), (2, 2**63 - 1), (3, -(2**63))]  # 256 * 1e307 is no number
    assert quantised(spark.createDataFrame([(1, [1e17, -0.3])], "vec_id long, embedding array<double>")).first().vector == [2.56e19, -77.0]


def test_bounds_spare_most_candidates(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    rows = [(k, (centres[k % 40] + 0.6 * rng.normal(size=64)).tolist()) for k in range(1200)]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert topk.tested_share(vectors.where("vec_id % 50 = 0"), vectors, 5) < 0.3


def test_unsound_vectors_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("-inf"), 1.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (50, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = quantised(df)
    assert sorted(r.vec_id for r in vectors.collect()) == [0, 6]
    found = top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 6, 0)]
    assert top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0


WORDS = "the quick brown fox jumps over a lazy dog while rain falls on green hills and birds sing in trees by quiet water".split()
BAD = "blork snarg fleeb".split()


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "er", "ing", "s"]) for _ in range(rng.randrange(5, 80))]
        toxic = k % 5 == 0 or k % 7 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words), "clash", 3))
        labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1500)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, lang int").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(df, marks, trees=8)
    got = model.with_score(df).withColumn("held", in_held_out(F.col("doc_id"))).join(marks, "doc_id").toPandas()
    held = got[got.held]
    assert len(held) > 200 and got.score.between(0, 1).all()
    assert ((held.score >= 0.5) == (held.toxic == 1)).mean() > 0.97
    assert {"blork", "snarg", "fleeb"} <= set(model.lexicon)
    kept = without_toxic(df, marks, trees=8)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert len(ids & {i for i, t in labels if t}) < 20 and len({i for i, t in labels if not t} - ids) < 20


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, lang int")
    flipped = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("toxic", F.when(in_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit_toxicity(df, m, trees=3).lexicon for m in (spark.createDataFrame(labels, "doc_id long, toxic int"), flipped))
    assert a == b


def test_odd_texts_and_too_few_labels(spark):
    rows = [(1, None, None, 1), (2, "", None, 1), (3, "you " * 100_000, None, 1), (None, "x", None, 1), (4, "!!! ??? 123 @#$ ☃", None, 1), (4, "again", None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, lang int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = fit_toxicity(df, none).with_score(df).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.0}
    docs, labels = corpus(200)
    model = fit_toxicity(spark.createDataFrame(docs, "doc_id long, text string, score string, lang int"), spark.createDataFrame(labels, "doc_id long, toxic int"), trees=2)
    scored = model.with_score(df).collect()
    assert len(scored) == 6 and all(0 <= r.score <= 1 for r in scored)
    assert model.with_score(df.limit(0)).count() == 0


def test_features_read_disguises_and_persons():
    assert units_of("b1ork,") == ("b1ork", "biork") and units_of("(snarg!)") == ("snarg", "") and units_of("--") == ("", "")
    reader = Reader({"blork": 5.0, "blor~": 4.0})
    plain, hidden, other = reader.features("you blork HERE!!!"), reader.features("bl0rk"), reader.features("nothing at all")
    names = dict(zip(("word_max", "nearness"), (plain[0], plain[8])))
    assert names == {"word_max": 5.0, "nearness": 0.5} and hidden[15] == 1.0 and other[0] == 0.0 and plain[11] > 0


def test_features_by_hand():
    text = "You BLORK, yes!! a fl33b blorking *** soooo 7th. du"  # ten words, 51 characters
    got = dict(zip(FEATURES, Reader({"blork": 5.0, "blor~": 4.0, "fleeb": 3.0}).features(text)))
    assert got == pytest.approx({
        "word_max": 5.0, "word_sum": 5.0 + 3.0, "word_hits": 2.0, "word_density": 10.0,  # blork and, behind its digits, fleeb
        "prefix_max": 4.0, "prefix_sum": 4.0 + 4.0, "prefix_hits": 2.0, "prefix_density": 20.0,  # blork and blorking
        "nearness_to_second_person": 1 / 2, "second_person_density": 20.0,  # you beside blork; du
        "capitals": 6 / 51, "shouted_words": 10.0, "punctuation": 7 / 51, "exclamations": 2 / 51,
        "disguised_words": 20.0, "disguised_hits": 1.0, "repetitions": 20.0, "log_words": math.log1p(10),  # fl33b and 7th; *** and soooo
    })


def test_a_row_is_read_by_its_own_lexicon_in_one_pass(spark):
    lexicons = [{"blork": 5.0}, {"blork": 3.0, "snarg": 2.0}, {}]
    rows = [(k, text) for k in range(3) for text in ("blork", "snarg blork", None)]
    df = spark.createDataFrame(rows, "k int, text string").repartition(2)
    read = df.select("k", "text", features_of(F.col("text"), lexicons, F.col("k")).alias("f"))
    assert read._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r.k, r.text): r.f for r in read.collect()}
    assert got == {(k, text): Reader(lexicons[k]).features(text) for k, text in rows}


def test_products_beyond_all_doubles(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 2.0]), (50, [1e-200, 1e200]), (5, [0.0, 1e200])]
    vectors = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in top_k(vectors.where("vec_id % 50 = 0"), vectors, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    most, least = 2**63 - 1, -(2**63)
    assert got[0] == [(1, most), (3, most), (5, most), (50, most), (2, least)]
    assert got[50] == [(5, most), (3, most), (0, most), (1, 0), (2, 0)]


def margin_by_hand(description, weights, features):
    """The weighted sum of trees, walked line by line through their printed form."""
    total, tree, lines = 0.0, -1, description.splitlines()
    skip = None  # indentation of a branch that isn't taken
    for line in lines:
        depth, said = len(line) - len(line.lstrip()), line.strip()
        if said.startswith("Tree "):
            tree, skip = tree + 1, None
        elif skip is not None and depth > skip:
            continue
        elif said.startswith(("If", "Else")):
            skip = None
            feature, relation, bound = said[said.index("(") + 1 : -1].removeprefix("feature ").split(" ")
            holds = features[int(feature)] <= float(bound)
            if holds != (relation == "<="):
                skip = depth
        elif said.startswith("Predict:"):
            total += weights[tree] * float(said.split()[1])
    return total


def test_scores_by_hand(spark):
    """A small model's scores, from its printed trees and the points of its calibration, in plain Python."""
    docs, labels = corpus(500, seed=3)
    labels = [(i, 1 - y if i % 11 == 3 else y) for i, y in labels]  # so that scores lie between, too
    df = spark.createDataFrame(docs, "doc_id long, text string, score string, lang int").repartition(3)
    model = fit_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"), trees=5, depth=3)
    xs, ys = (v.toArray() for v in (model.calibration.boundaries, model.calibration.predictions))
    reader = Reader(model.lexicon)
    description, weights = model.trees.toDebugString, list(model.trees.treeWeights)
    got = {r.doc_id: r.score for r in model.with_score(df).collect()}
    for doc_id, text, *_ in docs:
        margin = margin_by_hand(description, weights, reader.features(text))
        assert got[doc_id] == pytest.approx(min(max(float(np.interp(margin, xs, ys)), 0.0), 1.0), abs=1e-9), doc_id
    assert len(set(got.values())) > 3
