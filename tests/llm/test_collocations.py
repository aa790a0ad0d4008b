import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from talkloom.llm import collocations as c

SMALL = "/root/testdata/sf0.001"
DOCS = "text string, lang string, rank int, n string"


def by_hand(rows, least, cover, best):
    """Counts with plain dictionaries, straight from the definition."""
    out = []
    langs = {}
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            langs.setdefault(lang or "und", []).append(re.findall("[^ \t]+", piece))
    for lang, pieces in langs.items():
        f = Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, 5) for i in range(len(p) - m + 1))
        n = sum(v for k, v in f.items() if len(k) == 1)
        good = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        found = []
        for k, a in good.items():
            inside = lambda w: any(w[i : i + len(k)] == k for i in range(len(w) - len(k) + 1))
            if any(100 * v >= cover * a and len(w) > len(k) and inside(w) for w, v in good.items()):
                continue
            score, _, left, right = min((c.SCALE * a // (f[k[:x]] + f[k[x:]]), x, f[k[:x]], f[k[x:]]) for x in range(1, len(k)))
            found.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("burst, held, words, tokens", [(4096, 10**6, 10**6, 1 << 20), (2, 40, 25, 17)])
def test_against_plain_counting(spark, monkeypatch, burst, held, words, tokens):
    """With small limits containers burst, subtrees spill, dictionaries are forgotten and texts are cut into slices."""
    monkeypatch.setattr(c, "BURST", burst)
    monkeypatch.setattr(c, "HELD", held)
    monkeypatch.setattr(c, "WORDS", words)
    monkeypatch.setattr(c, "TOKENS", tokens)
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "é", "É", "x\x01", "tea", "new", "york", "city"] + [f"w{k}" for k in range(40)]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice((4, 10, 50))]) + rng.choice(["", "", "", ",", "\n", " ?", "\t"]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "en", None, "und", "de"])) for _ in range(150)] + [(None, "en"), ("", None), ("only", "fr")]
    rows += [("new york city " * 40 + "." + "a b c d " * 30, "en")] * 3
    df = spark.createDataFrame([(t, lang, 1, "clash") for t, lang in rows], DOCS).repartition(3)
    for least, cover, best in ((3, 80, 10**6), (4, 30, 7)):
        got = rows_of(c.collocations(df, least, cover, best))
        assert got == by_hand(rows, least, cover, best) and len(got) > 5


def test_long_counts_are_exact(spark):
    big = 4 * 10**12
    words = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big), ("en", None, 2 * big)], "lang string, phrase string, n long")
    phrases = spark.createDataFrame([("en", "a b", big - 3)], "lang string, phrase string, n long")
    assert c.with_scores(phrases, words).first().score == c.SCALE * (big - 3) // (2 * big + 1)


def test_empty_tables_have_no_phrases(spark):
    assert c.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert c.collocations(spark.createDataFrame([(None, None, 1, "")] * 3, DOCS)).count() == 0


def test_a_sieve_loses_nothing(spark):
    keys = spark.createDataFrame([("en", f"w{k}") for k in range(5000)], "lang string, phrase string")
    ids = c.WordIds("en", c.sieve_of(keys, c.word_hash(keys.phrase)))
    found = ids.of(c.tokens_of([" ".join(f"w{k}" for k in range(100_000)).encode()]))
    assert (found[:5000] > 0).all() and (found[5000:-1] > 0).mean() < 0.2 and found[-1] == 0


def test_a_trie_counts_what_a_dictionary_counts(monkeypatch):
    monkeypatch.setattr(c, "BURST", 8)
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.2, size=(4, 5000)), 30).astype(np.int64)
    ids[3, ids[2] == 7] = 0
    trie = c.HatTrie(4)
    for at in range(0, 5000, 700):
        trie.add(ids[:, at : at + 700])
    want = Counter(map(tuple, ids.T.tolist()))
    assert trie.size == len(want) and any(type(x) is dict for x in trie.root.values())
    got: Counter = Counter()
    for keep in (len(want) // 2, 0):
        some, counts = trie.spill(keep)
        assert trie.size <= keep
        got.update(dict(zip(map(tuple, some.T.tolist()), counts.tolist())))
    assert got == want


def test_query_against_sql(spark):
    got = rows_of(c.op11_collocations(spark, SMALL))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
        want = db.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({c.OP11_SQL})").fetchall()
    assert got == sorted(want) and len(got) > 20


def test_phrases_across_batches_are_summed_once():
    """Each batch ends within a phrase that the next one goes on with, behind many others."""
    rng, rows, edges = random.Random(0), [], [0]
    for k in range(60):
        rows += sorted(("en", f"{k:02d} {rng.randrange(10**9):09d}", 1) for _ in range(3000)) + [("en", f"{k:02d} z", 20)]
        edges.append(len(rows))
        rows.append(("en", f"{k:02d} z", 15))
    rows.append(("fr", "59 z", 30))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[a:b])], schema=c.RUN) for a, b in zip(edges, [*edges[1:], len(rows)])
    ]
    got = [(r["lang"], r["phrase"], r["n"]) for b in c.summed_runs(iter(batches), 30) for r in b.to_pylist()]
    assert got == [("en", f"{k:02d} z", 35) for k in range(60)] + [("fr", "59 z", 30)]
