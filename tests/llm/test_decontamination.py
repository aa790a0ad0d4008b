import hashlib
import random
import re

import duckdb

from talkloom.llm import decontamination as d

SMALL = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, n long, item string, words int", "item_id long, text string, doc_id int, m string"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, size=10):
    windows = {}
    for i, text in items:
        w = words(text)
        m = min(len(w), size)
        if i is not None and m:
            for k in range(len(w) - m + 1):
                windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_against_every_window(spark):
    rng = random.Random(6)
    say = lambda n, kinds=12: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:kinds]) for _ in range(n))
    items = [(k, say(rng.choice((11, 15, 30)), 26)) for k in range(20)]
    items += [(100, "One, Two; three"), (101, "q Q"), (102, "É1 ñ"), (103, "zz"), (104, ""), (105, None), (None, "never listed words"), (7, "a second text of item seven that has more than ten words"), (9, items[9][1])]
    items += [(200, items[3][1]), (30, items[3][1])]  # one text, several items
    docs = []
    for k in range(80):
        text = say(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            at = rng.randrange(max(1, len(w)))
            text += rng.choice([" ", ". ", "-"]) + " ".join(w[at : at + rng.randrange(8, 14)]).upper() + " " + say(rng.randrange(5))
        docs.append((k, text))
    docs += [(3, docs[3][1]), (3, docs[4][1]), (None, docs[4][1]), (None, None), (500, ""), (501, "..."), (502, " ".join(w for _, t in items[:3] for w in words(t)) + " zz" * 3000), (503, "never listed words"), (504, "zz\x00zz")]
    docs += [(600 + k, "x " + items[5][1]) for k in range(700)]  # one passage of very many documents
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in docs], DOCS).repartition(5)
    bench = spark.createDataFrame([(i, t, 3, "clash") for i, t in items], ITEMS)
    want = by_hand(docs, items)
    assert sum(r[5] for r in want) > 700 and len({r[3] for r in want}) > 3
    assert result(d.contamination(df, bench)) == want
    assert result(d.contamination(df, bench, size=6, shingle=2)) == by_hand(docs, items, 6)
    named = d.contamination(df, bench).where("doc_id = 502").first()
    assert {"0", "1", "2", "103"} <= set(named["items"])


def test_nothing_to_find(spark):
    df = spark.createDataFrame([(1, "some words here", 1, "", 1)], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert result(d.contamination(df, none)) == by_hand([(1, "some words here")], [])
    assert d.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "some words", 1, "")], ITEMS)).count() == 0


def test_only_the_rarest_shingle_is_joined(spark):
    items = spark.createDataFrame([(1, "the of and to in a is that for it rare words"), (2, "it is not in any document at all here or there")], "item_id long, text string")
    docs = spark.createDataFrame([(k, "the of and to in a is that for it") for k in range(30)] + [(99, "the of and to in a is that for it rare")], "doc_id long, text string")
    windows = d.item_windows(items)
    shingles = d.window_shingles(windows)
    met = d.shingles_met(docs.selectExpr("doc_id k1", "doc_id k2", "doc_id doc", "text"), shingles).cache()
    rare = {r.window: r.df for r in d.rarest(shingles, met).collect()}
    assert rare == {"the of and to in a is that for it": 31, "of and to in a is that for it rare": 1}


def test_query_is_native_and_equals_sql(spark):
    df = d.op12_contamination(spark, SMALL)
    got = result(df)
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
        want = db.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({d.OP12_SQL})").fetchall()
    assert got == sorted(want, key=str) and any(r[5] for r in got)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|MapInArrow|ArrowEval", plan)
