from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from talkloom.llm.simhash import shingle_hashes
from talkloom.llm.tokens import VOCABULARY

SMALL = "/root/testdata/sf0.001"


def test_stages_are_named_and_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "mixing", "packing"]
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_each_stage_works_on_what_its_predecessor_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, columns = {}, list(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in kept.items()}
    assert set(ids["simhash"]) <= set(ids["toxicity"]) and set(ids["mixing"]) <= set(ids["simhash"])
    assert len(ids["simhash"]) == len(set(ids["simhash"]))
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    texts = [t.text for t in kept["mixing"].select("text").collect()]
    want = sum(len(e.ids) + 1 for e in library.encode_batch(texts, add_special_tokens=False))
    pieces = kept["packing"].toPandas()
    assert pieces.length.sum() == want == sum(len(t) // 4 for t in pieces.token_ids)
    sequences = defaultdict(int)
    for s, n in zip(pieces.sequence_id, pieces.length):
        sequences[s] += n
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())


def test_pipeline_of_no_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_operators_against_sql(spark, name):
    import duckdb

    with duckdb.connect() as db:
        for t in ("documents", "embeddings", "pages", "benchmark"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        want = db.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)

    def plain(value):
        if value is None or pd.isna(value):
            return ""
        return str(float(value)) if isinstance(value, (int, float, np.number)) and not isinstance(value, (bool, np.bool_)) else str(value)

    norm = lambda d: sorted(tuple(map(plain, row)) for row in d[sorted(got.columns)].astype(object).values.tolist())
    assert norm(got) == norm(want)


def similar_pairs(texts, width, least):
    """All pairs of different shingle sets with at least that Jaccard index, by the rarest shingles of each."""
    sets = {}
    for doc, text in texts:
        sets.setdefault(np.unique(shingle_hashes(text.encode(), width)).tobytes(), []).append(doc)
    arrays = [np.frombuffer(k, dtype=np.uint64) for k in sets]
    every, counts = np.unique(np.concatenate(arrays), return_counts=True)
    met, pairs = defaultdict(list), set()
    for n, a in enumerate(arrays):
        rare = a[np.lexsort((a, counts[np.searchsorted(every, a)]))][: len(a) - int(np.ceil(least * len(a))) + 1]
        others = {m for h in rare.tolist() for m in met[h]}
        for m in others:
            both = len(np.intersect1d(a, arrays[m], assume_unique=True))
            if both >= least * (len(a) + len(arrays[m]) - both):
                pairs.add((m, n))
        for h in rare.tolist():
            met[h].append(n)
    return list(sets.values()), pairs


def test_near_copies_are_found_and_others_kept(spark):
    """The stage on its own input, against all pairs of five-word shingle sets with a Jaccard index of 0.8 or more."""
    assert corpus_pipeline.SHINGLE == 5 and corpus_pipeline.SIMILARITY == 0.8
    large = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{large}/documents.parquet").where("text is not null")
    groups, pairs = similar_pairs([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 5, 0.8)
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, docs, large).select("doc_id").collect()}
    survives = [bool(kept & set(g)) for g in groups]
    assert all(len(kept & set(g)) <= 1 for g in groups)  # equal sets
    recall = np.mean([not (survives[a] and survives[b]) for a, b in pairs])
    assert len(pairs) > 30 and recall >= 0.9
    alone = set(range(len(groups))) - {n for p in pairs for n in p}
    assert all(survives[n] and min(groups[n]) in kept for n in alone)  # nothing else goes
