import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from talkloom.llm import simhash
from talkloom.llm import components
from talkloom.llm.components import connected_components
from talkloom.llm.neardup_vectors import near_vectors, number_of_cells, unit_rows, visit_distance
from talkloom.llm.simhash import covering_masks, fingerprint, near_links, one_of_each_group, simhash_groups
from talkloom.llm.support import join_by_key


def least_reachable(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chains_stars_and_noise(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3), (3, None)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    sound = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == least_reachable({x for p in sound for x in p}, sound)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("least, cuts", [(100_000, [2]), (50, range(5, 40))])
def test_few_links_are_settled_in_one_partition(spark, monkeypatch, least, cuts):
    """Chains and stars over many partitions, by one more cut; with a small bound by rounds over several partitions."""
    monkeypatch.setattr(components, "LINKS", least, raising=False)
    made, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(1) or cut(df))
    rng = random.Random(5)
    names = rng.sample(range(-(10**12), 10**12), 900)
    links = [*zip(names[:400], names[1:400]), *((names[400], x) for x in names[401:600]), *zip(names[600::2], names[601::2])]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(12)
    assert dict(tuple(r) for r in connected_components(df).collect()) == least_reachable(set(names), links)
    assert len(made) in cuts


def test_hubs_are_joined_where_they_lie(spark):
    links = [(5000, k) for k in range(1200)] + [(k, k + 10_000) for k in range(0, 1200, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    assert dict(tuple(r) for r in connected_components(df).collect()) == least_reachable({x for p in links for x in p}, links)
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)] + [(None, -1)], "key long, v long")
    per = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    for how in ("inner", "left"):
        got = join_by_key(rows, per.where("key <> 905 and key < 990"), ["key"], "n", 1000, how)
        plain = rows.join(per.where("key <> 905 and key < 990").drop("n"), "key", how)
        assert sorted(map(str, got.select("key", "v", "least").collect())) == sorted(map(str, plain.select("key", "v", "least").collect()))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.sets(st.integers(0, 63), max_size=6))
def test_masks_cover(radius, bits):
    bits = set(sorted(bits)[:radius])
    pattern = sum(1 << b for b in bits)
    assert any(m & pattern == 0 for m in covering_masks(radius))
    assert len(covering_masks(radius)) == 2 ** (radius + 1) - 1


@pytest.mark.parametrize("radius, bits", [(4, 64), (6, 32), (5, 32), (4, 21)])
def test_no_mask_is_nearly_empty(radius, bits):
    assert min(m.bit_count() for m in covering_masks(radius, bits)) >= bits // 4


def by_hand(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c d", "A B c d e", "É é Z z É é Z z", "x " * 70_000, "w\x0bv\x0cu t\xa0s r q p"])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 4) == by_hand(text, 4)


def test_links_connect_what_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # so that crowded buckets are cut into blocks
    rng = random.Random(2)
    prints = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, 3}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4)
    roots = {r.id: r.root for r in connected_components(links).collect()}
    array = np.array(signed, dtype=np.int64)
    pairs = [(int(a), int(b)) for a in array for b in array[np.bitwise_count((array ^ a).view(np.uint64)) <= 4] if a < b]
    want = least_reachable(signed, pairs)
    assert {i: roots.get(i, i) for i in signed} == want


DOCS = "doc_id long, text string, fingerprint string, component_id int"


def test_groups_and_representatives_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, long, "x", 1), (3, long + " tail", None, 2), (3, long + " tail", None, 2), (9, None, None, None), (8, "", None, None), (7, "other words here now ok", "y", 3), (None, "nameless text of its own kind", None, None), (None, long, None, None)]
    got = simhash_groups(spark.createDataFrame(rows, DOCS), 4, 4).toPandas()
    by_id = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id").component_id.to_dict()
    assert by_id == {5: 3, 3: 3, 9: 8, 8: 8, 7: 7} and len(got) == len(rows)
    assert got[got.fingerprint == f"{by_hand(long, 4):016x}"].component_id.tolist() == [3.0, 3.0]
    kept = one_of_each_group(spark.createDataFrame(rows, DOCS), 4, 4).toPandas()
    assert sorted(kept.doc_id.fillna(-1)) == [-1, 3, 7, 8] and list(kept.columns) == ["doc_id", "text", "fingerprint", "component_id"]
    clashing = spark.createDataFrame([(3, long, k, "b") for k in (2, 1)] + [(4, "", 5, "c")], "doc_id long, text string, id int, doc string")
    again = {r.doc_id: r for r in one_of_each_group(clashing.repartition(2), 4, 4).collect()}
    least = clashing.where("doc_id = 3").orderBy(F.xxhash64(F.struct(*clashing.columns))).first()
    assert again == {3: least, 4: clashing.where("doc_id = 4").first()}
    assert simhash_groups(spark.createDataFrame([], DOCS), 4, 4).count() == 0
    assert one_of_each_group(spark.createDataFrame([], DOCS), 4, 4).count() == 0


def near_by_hand(vectors, cosine=0.9):
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(v) for i, v in vectors.items()}
    pairs = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine]
    links = {i: sum(i in p for p in pairs) for i in unit}
    return links, least_reachable(unit, pairs)


def clustered(n, dim, groups, seed=0, noise=0.25):
    """Vectors around centres; of a third, so near that many pairs are just over and just under 0.9."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    spread = rng.normal(size=(n, dim)) / np.sqrt(dim) * np.where(np.arange(n) % 3 == 0, 1.0, noise)[:, None]
    return (centres[np.arange(n) % groups] + spread).astype(np.float32)


def measured(spark, vectors, **how):
    """Recall of links, over a brute-force run, and whether any count is over it."""
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    want = np.array([(unit @ u >= 0.9).sum() - 1 for u in unit])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    got = near_vectors(df, **how).toPandas().set_index("vec_id").n_links.reindex(range(len(vectors))).to_numpy()
    return got.sum() / want.sum(), (got > want).any()


@pytest.mark.parametrize("block", [7, 4096])
def test_vectors_against_all_pairs(spark, block):
    rows = {k: v.tolist() for k, v in enumerate(clustered(400, 16, 12))}
    df = spark.createDataFrame([(k, v, "clash") for k, v in rows.items()], "vec_id long, embedding array<float>, kept string").repartition(3)
    links, components = near_by_hand({k: np.float32(v).astype(float) for k, v in rows.items()})
    got = near_vectors(df, block=block).toPandas().set_index("vec_id")
    assert sum(links.values()) > 1000 and got.n_links.to_dict() == links and got.component_id.to_dict() == components
    assert (got.kept == (got.component_id == got.index)).all()


def test_cells_grow_with_the_table():
    assert [number_of_cells(n) for n in (1, 4, 5, 200, 500, 40_000, 4_000_000)] == [1, 1, 2, 8, 12, 100, 1000]
    assert visit_distance(0.9, 16) == visit_distance(0.9, 768, exact=True) == pytest.approx(np.sqrt(0.2) / 2)
    assert visit_distance(0.9, 64) == visit_distance(0.9, 768) == visit_distance(0.9, 16) / 2


@pytest.mark.parametrize("cells", [8, 100])
def test_recall_of_the_default_visits(spark, cells):
    recall, over = measured(spark, clustered(1500, 64, 40, seed=cells, noise=0.3), cells=cells)
    assert recall >= 0.99 and not over


def test_exact_visits_lose_no_link(spark):
    recall, over = measured(spark, clustered(600, 64, 20, seed=3, noise=0.3), cells=30, exact=True)
    assert recall == 1.0 and not over


def test_visits_simulated_over_a_thousand_cells():
    """Pairs at a cosine of exactly 0.9, the hardest to find, by what with_cells() would have them visit."""
    rng = np.random.default_rng(7)
    centres = unit_rows(rng.normal(size=(1000, 64)))
    a = unit_rows(centres[rng.integers(1000, size=4000)] + rng.normal(size=(4000, 64)) * 0.25)
    side = rng.normal(size=a.shape)
    side = unit_rows(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * side
    apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0)) * visit_distance(0.9, 64)
    homes, visits = [], []
    for x in (a, b):
        likeness = x @ centres.T
        homes.append(likeness.argmax(1))
        visits.append(likeness.max(1, keepdims=True) - likeness <= apart[homes[-1]])
    n = np.arange(len(a))
    found = visits[0][n, homes[1]] | visits[1][n, homes[0]]
    assert (homes[0] != homes[1]).mean() > 0.1 and found.mean() >= 0.99


def test_copies_are_compared_once(spark):
    rng = np.random.default_rng(1)
    one, near, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 0.0, 1.0]
    rows = [(k, one) for k in range(10, 40)] + [(k, near) for k in range(5)] + [(99, far)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id")
    assert got.n_links.to_dict() == {k: 34 for k in (*range(10, 40), *range(5))} | {99: 0}
    assert got.component_id.to_dict() == {k: 0 for k in (*range(10, 40), *range(5))} | {99: 99}


def test_cosine_at_the_bound_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert near_vectors(df, cosine=0.6).toPandas().set_index("vec_id").n_links.to_dict() == {1: 1, 2: 2, 3: 1}
    assert near_vectors(df, cosine=0.8000001).toPandas().n_links.sum() == 0


def test_many_dimensions_are_one_job(spark):
    rows = [(k, [1.0] * (1 + k % 40)) for k in range(120)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().set_index("vec_id")
    assert set(got.n_links) == {2} and all(got.component_id[k] == k % 40 for k in got.index)


def test_odd_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-200, 0.0]), (None, [1.0, 0.0]), (2, [0.0, 5.0]), (11, [0.0, 1e200]), (12, [0.0, 5e-324])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    found = got.groupby("vec_id").n_links.max().to_dict()
    assert found == {1: 2, 2: 2, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 2, 11: 2, 12: 2}
    assert len(got) == len(rows) and got[got.vec_id == 10].component_id.tolist() == [1]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def worded(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, words, places):
    return [f"x{rng.randrange(10**6)}" if k in places else w for k, w in enumerate(words)]


def test_only_similar_sets_are_copies(spark):
    rng = random.Random(5)
    line = "the same line is here again and again "
    rows = [(k, line * 60 + " ".join(worded(rng, 40)), "", 0) for k in range(4)]  # near fingerprints, few common shingles
    prints = [fingerprint(r[1].encode(), 5) for r in rows]
    assert all((a ^ b).bit_count() <= 13 for a in prints for b in prints)
    kept = one_of_each_group(spark.createDataFrame(rows, DOCS), 5, 13).toPandas()
    assert sorted(kept.doc_id) == [0, 1, 2, 3]


@pytest.mark.parametrize("crowd, block", [(24, 1024), (3, 4)])
def test_copies_within_the_radius_by_all_pairs(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)  # so that buckets of both kinds, and crowds of many blocks, occur
    monkeypatch.setattr(simhash, "CROWD_BLOCK", block)
    monkeypatch.setattr(simhash, "BROADCAST_HASHES", 0 if crowd == 3 else 4_000_000)
    monkeypatch.setattr(simhash, "PAIRS", 7)  # so that comparisons go in many steps
    monkeypatch.setattr(simhash, "GROUP", 50)
    rng = random.Random(3)
    texts = {}
    for g in range(30):
        base = worded(rng, 120)
        for k in range(25 if g == 0 else 5):
            texts[len(texts)] = " ".join(changed(rng, base, rng.sample(range(120), k % 6)))
    sets = {i: {" ".join(t.split()[k : k + 5]) for k in range(116)} for i, t in texts.items()}
    prints = {i: fingerprint(t.encode(), 5) for i, t in texts.items()}
    similar = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    links = [(a, b) for a, b in similar if (prints[a] ^ prints[b]).bit_count() <= 13]
    assert any((prints[a] ^ prints[b]).bit_count() > 6 for a, b in links)
    want = {i for i, least in least_reachable(texts, links).items() if i == least}
    kept = one_of_each_group(spark.createDataFrame([(i, t, "", 0) for i, t in texts.items()], DOCS), 5, 13).toPandas()
    assert sorted(kept.doc_id) == sorted(want)


def test_no_task_compares_and_contracts(spark, monkeypatch):
    """Two Python workers a core would stay for the session; and few links are contracted in one task."""
    seen = []

    def looked_at(links):
        seen.append((links._jdf.queryExecution().executedPlan().toString(), links.rdd.getNumPartitions()))
        return connected_components(links)

    monkeypatch.setattr(simhash, "connected_components", looked_at)
    rng = random.Random(8)
    base = worded(rng, 120)
    rows = [(k, " ".join(changed(rng, base, rng.sample(range(120), k % 2))), "", 0) for k in range(40)]
    assert one_of_each_group(spark.createDataFrame(rows, DOCS), 5, 13).count() < 40
    assert len(seen) == 3 and not any("MapInArrow" in plan for plan, _ in seen) and {n for _, n in seen} == {1}


@pytest.mark.parametrize("parts", [2, 3])
def test_part_masks_cover(parts):
    rng = random.Random(parts)
    masks = simhash.part_masks(13, parts)
    for _ in range(2000):
        pattern = sum(1 << b for b in rng.sample(range(64), 13))
        assert any(m & pattern == 0 for m in masks)
