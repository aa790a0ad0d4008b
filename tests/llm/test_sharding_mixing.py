import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from talkloom.llm.mixing import _places_below, mix_sources, poisson_table, source_rates
from talkloom.llm.sharding import ROUNDS, _sides, permuted, shard_rows

DOCS = "doc_id long, text string, source string, slot string, shard int"


def xx(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def permute_by_hand(x, n, seed):
    left, right = _sides(n)
    while True:
        l, r = divmod(x, right)
        for i in range(ROUNDS):
            if i % 2 == 0:
                l = (l + xx(seed, i, r) % left) % left
            else:
                r = (r + xx(seed, i, l) % right) % right
        x = l * right + r
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation_is_one_to_one_and_computable(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), n, 7).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.p == permute_by_hand(r.id, n, 7) for r in rows[:50])


def test_shards_are_even_and_gapless_with_odd_rows(spark):
    rows = [(k, f"text {k}", "a", "clash", 9) for k in range(50)] + [(None, None, None, None, None)] * 3 + [(7, "text 7", "a", "x", 1)] * 30 + [(60, "", "b", None, 0), (61, "é" * 100_000, "b", None, 0)]
    got = shard_rows(spark.createDataFrame(rows, DOCS), 4).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))
    by_id = got.set_index("doc_id")
    assert by_id.loc[61, "size"] == 200_001 and by_id.loc[60, "size"] == 1
    assert by_id.loc[61, "text_crc32"] == zlib.crc32(("é" * 100_000).encode())
    assert got[got.doc_id.isna()]["size"].tolist() == [1, 1, 1]


def test_row_numbers_give_shard_and_slot(spark):
    rows = [(k * 7 % 101, f"text {k}", "a", "", 0) for k in range(101)] + [(None, "é", "a", "", 0), (3, "again", "a", "", 0)]
    got = shard_rows(spark.createDataFrame(rows, DOCS).repartition(4), 5, seed=3).toPandas()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode())))
    want = []
    for number, (doc, text, *_) in enumerate(order):
        place = permute_by_hand(number, len(rows), 3)
        want.append((-1 if doc is None else doc, len(text.encode()) + 1, zlib.crc32(text.encode()), place % 5, place // 5, number))
    found = got.fillna({"doc_id": -1})[["doc_id", "size", "text_crc32", "shard", "slot", "row_number"]].astype(int)
    assert sorted(map(tuple, found.values.tolist())) == sorted(want)


def test_shards_dont_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(k, f"t{k}", "a", "", 0) for k in range(200)], DOCS)
    a, b = (shard_rows(rows.repartition(n), 5).select("doc_id", "shard", "slot").toPandas().sort_values("doc_id").values.tolist() for n in (2, 7))
    assert a == b


def test_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert shard_rows(empty, 4).count() == 0
    assert mix_sources(empty).count() == 0


def test_replication_follows_the_target_weights(spark):
    rows = [(k, "x" * 99, "big" if k % 10 else "small", "c", 1) for k in range(4000)]
    docs = spark.createDataFrame(rows, DOCS)
    rates = {r.source: r.rate for r in source_rates(docs, {"big": 0.5, "small": 0.5}).collect()}
    assert rates == {"big": pytest.approx(0.5 / 0.9), "small": pytest.approx(5.0)}
    got = mix_sources(docs, {"big": 0.5, "small": 0.5}).toPandas()
    share = (got.source == "small").mean()
    assert abs(share - 0.5) < 0.04 and abs(len(got) - 4000) < 300
    counts = got[got.source == "small"].groupby("doc_id").size().reindex(range(0, 4000, 10), fill_value=0)
    assert abs(counts.var() - 5.0) < 1.5  # a Poisson variable's variance is its mean
    assert got.shuffle_key.is_monotonic_increasing
    assert list(got.columns) == ["doc_id", "text", "source", "slot", "shard", "copy", "shuffle_key"]


def test_replication_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "a", None, None), (1, "", "a", None, None), (2, "y" * 200_000, "a", None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("clash"))
    got = mix_sources(docs, epochs=20.0).toPandas()
    twins = got[got.doc_id == 1].groupby("copy").size()
    assert set(twins) <= {2}  # rows that repeat an id get equal counts
    assert mix_sources(docs, weights={}).count() == 0


@pytest.mark.parametrize("rate", [0.0, 1e-9, 0.3, 1.0, 7.5, 40.0, 3000.0, 1e7])
def test_poisson_tables(spark, rate):
    start, cdf = poisson_table(rate)
    assert len(cdf) <= 18 * math.sqrt(rate) + 64 and cdf[-1] == pytest.approx(1) and (np.diff(cdf) >= 0).all()
    chances = np.diff(np.r_[0.0, cdf])
    counts = start + np.arange(len(cdf))
    assert (chances * counts).sum() == pytest.approx(rate, rel=1e-9, abs=1e-12)
    assert (chances * (counts - rate) ** 2).sum() == pytest.approx(rate, rel=1e-6, abs=1e-9)
    if 0 < rate < 50:
        exact = np.cumsum([math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) for k in counts])
        assert np.abs(exact - cdf).max() < 1e-13
    numbers = [0.0, 1e-300, 0.1, 0.5, float(cdf[0]), float(cdf[len(cdf) // 2]), 1 - 2.0**-52]
    rows = spark.createDataFrame([(u, cdf.tolist()) for u in numbers], "u double, cdf array<double>")
    assert [r[0] for r in rows.select(_places_below(F.col("cdf"), F.col("u"))).collect()] == [int((cdf < u).sum()) for u in numbers]


def test_very_large_rates(spark, monkeypatch):
    from talkloom.llm import mixing

    rows = [(k, "x" * 99_999, "big", "c", 1) for k in range(40)] + [(100, "", "small", "c", 1), (101, "", None, "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"big": 0.5, "small": 0.25}
    rate = {r.source: r.rate for r in source_rates(docs, weights).collect()}["small"]
    assert rate > 1e6
    counts = []
    for most in (mixing.BROADCAST_NUMBERS, 10):  # by broadcast, and by key
        monkeypatch.setattr(mixing, "BROADCAST_NUMBERS", most)
        counts.append({r.source: r["count"] for r in mix_sources(docs, weights).groupBy("source").count().collect()})
    assert counts[0] == counts[1] and abs(counts[0]["small"] - rate) < 6 * math.sqrt(rate) and None not in counts[0]
