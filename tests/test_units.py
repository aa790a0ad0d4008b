"""Hand-made rows for each rule."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from talkloom.functions import contents, fields, text as T
from talkloom.operators.joins import join_by_key
from talkloom.operators import highlights as H, interaction as I, messages as M, retrieval as R, rollups, terms as K


def values(spark, expression, inputs, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def test_times(spark):
    read = lambda strict: values(spark, lambda c: fields.format_ts(fields.to_time(c, strict)), ["1705307400", "0", "", None, "2024-01-15T08:30:00Z", "2024-01-15T08:30:00+00:00", "2024-01-15 08:30:00Z", "2024-01-15T08:30:00.5Z", "soon"])
    good = "2024-01-15 08:30:00Z"
    assert read(False) == [good, "unknown", "unknown", "unknown", good, "unknown", good, good, "unknown"]
    assert read(True) == [good, "unknown", "unknown", "unknown", good, "unknown", "unknown", "unknown", "unknown"]
    assert values(spark, fields.parse_ts, ["2024-01-15 08:30:00Z", "2024-01-15", "unknown", None]) == [dt.datetime(2024, 1, 15, 8, 30), None, None, None]


def test_names_and_roles(spark):
    assert values(spark, fields.slugify, ["Héllo, W!", "投资", "", None, "--a--"]) == ["h-llo-w", "conv", "conv", "conv", "a"]
    assert values(spark, fields.base_role, ["assistant:web (2024-01-15 08:30:00Z)", "User", "", None]) == ["assistant", "user", "", ""]
    name = lambda c: fields.archive_file_name(F.lit(12345), F.lit(None).cast("timestamp"), F.lit("T"), c)
    assert values(spark, name, ["a-b-123456789", "", None]) == ["12345_unknown_t_12345678.md", "12345_unknown_t_12345.md", "12345_unknown_t_12345.md"]


def lines_of(content):
    """What a content says, by Python's reading of it."""
    if isinstance(content, list):
        return "\n".join(lines_of(x) for x in content if x)
    return content if isinstance(content, str) else "" if content is None else "<>"


def test_contents_as_json_text(spark):
    cases = {
        '{"b":1,"a":2.0}': '{"b":1,"a":2.0}', "1.50": "1.50", "1e3": "1e3", " null ": "", '"a\\n\\"]b"': 'a\n"]b', '{"a":1,"a":2}': '{"a":1,"a":2}', "true": "true",
        '["a",["b",["c",["d",["e","f"]]]],1.50,0,0.0,false,null,"",[],{},{"x":[1,{"y":"]}"}],"x":2}]': 'a\nb\nc\nd\ne\nf\n1.50\n{"x":[1,{"y":"]}"}],"x":2}', "[{ },-0.0,1e0]": "1e0",
    }
    assert values(spark, contents.content_text, list(cases)) == list(cases.values())
    lists = ['[["",""],"a"]', '[[[]],"a"]', '[[[""]],"a"]', "[]", '[""]', '[ ["b" , "c\\\\"] ,\n"\\u00e9\\ud83d\\ude00" ]', '[[["a"],""],[[0]],["z"]]', '["[1]","{}",["]"]]']
    assert values(spark, contents.content_text, lists) == [lines_of(json.loads(x)) for x in lists]
    long = '["' + "x y \\n" * 200_000 + '",' + json.dumps([{"a": list(range(3000))}] * 20) + "]"
    assert len(values(spark, contents.content_text, [long])[0]) > 1_200_000
    objects = ['{"role": "u", "x,y":[1,{"q":"}"}], "content" : "no", "content":[1.50] }', "{}", "[1]", '"content"', '{"content":null}']
    assert values(spark, lambda c: contents.member(c, "content"), objects) == ["[1.50]", None, None, None, "null"]


def test_bodies_as_json_text(spark):
    cases = {
        '{"content_type":"text","parts":["a"," ","b",{"x":1.0,"w":2}]}': 'a\nb\n{"x":1.0,"w":2}', '{"content_type":"code","text":"x=1","language":"python"}': "```python\nx=1\n```", '{"content_type":"code","text":" "}': "",
        '{"content_type":"execution_output","text":"out"}': "out", '{"content_type":"thoughts","parts":["hm"]}': "", '{"parts":["a"]}': "", "null": "", '{"content_type":"other","text":"t"}': "",
        '{"content_type":"multimodal_text","parts":["t","{\\"content_type\\":\\"text\\"}",{"content_type":"image_asset_pointer","asset_pointer":"p","width":4,"height":3},{"content_type":"image_asset_pointer"},{"content_type":"text","text":"u"}]}': 't\n{"content_type":"text"}\n[image] (4x3) p\n[image] image\nu',
    }
    assert values(spark, contents.rendered, list(cases)) == list(cases.values())
    assert values(spark, lambda c: contents.rendered(c, True), ['{"content_type":"thoughts","b":1, "a":2.0}']) == ['{"content_type":"thoughts","b":1, "a":2.0}']
    assert values(spark, contents.rendered, [None]) == [""]


def test_contents(spark):
    contents = ['["a","",null,["b"]]', '"plain"', "null", '{"k":1}', "[]", "[0,[],{}]"]
    assert values(spark, lambda c: fields.normalize_content(F.parse_json(c)), contents) == ["a\nb", "plain", "", '{"k":1}', "", ""]
    schema = "content_type string, parts array<variant>, text string, language string"
    render = lambda keep: values(spark, lambda c: fields.render_content(F.from_json(c, schema), keep), [
        '{"content_type":"text","parts":["a"," ","b",{"x":1}]}', '{"content_type":"code","text":"x=1","language":"python"}', '{"content_type":"code","text":" "}', '{"content_type":"execution_output","text":"out"}',
        '{"content_type":"multimodal_text","parts":["t",{"content_type":"image_asset_pointer","asset_pointer":"p","width":4,"height":3},{"content_type":"image_asset_pointer"},{"content_type":"text","text":"u"}]}', '{"content_type":"thoughts","parts":["hm"]}', '{"parts":["a"]}',
    ])
    assert render(False) == ['a\nb\n{"x":1}', "```python\nx=1\n```", "", "out", "t\n[image] (4x3) p\n[image] image\nu", "", ""]
    assert "thoughts" in render(True)[5]


def test_tool_calls(spark):
    bodies = ['{"path":1}', '```\n{"path":1}\n```', '```unknown\n{"args":{}}\n```', '```json\n{"path":1}\n```', '{"path":1} x', '{"path":1}\n{"path":2}', '[{"path":1}]', '{"a":{"path":1}}', "", "```", '{"path":1', "{'path':1}"]
    assert values(spark, T.is_tool_call, bodies) == [True, True, True] + [False] * 9
    lenient = ['{"path":1,"path":2}', '{"path":NaN}', '{"b":[1,{"c":-Infinity}],"args":Infinity}', '```\n{"a":1,"a":2,"call":0}\n```']
    assert values(spark, T.is_tool_call, lenient) == [True] * 4
    broken = ['{"path":1} {"b":2}', '{"path":1,}', '{"path":01}', "{path:1}", '{"path":"a\nb"}', '{"path":tru}', '{"path":1},{"b":2}', '{"path":1}]', "{}"]
    assert values(spark, T.is_tool_call, broken) == [False] * 9


def test_bodies(spark):
    fence = "```"
    body = f"- a\n{fence}\nx\n{fence}\n3.14 b\n{{bad}}\n[image] p\nsee sediment://q\ncite１. c\n　d　\n**e**\n" + '{"content_type":"audio_transcription","text":" said "}\r\n{"k":1}'
    assert values(spark, T.normalize_body, [body, "", None, f"{fence}\nopen"]) == ["a\n14 b\nc\nd\n*e**\nsaid", "", None, ""]
    assert values(spark, lambda c: T.normalize_body(c, True), [f"a\n  {fence}py\nx\n{fence}\nb"]) == ["a\nx\nb"]
    assert values(spark, T.strip_artifact_lines, ["src/a.ts: err\nsee a.ts\n" + "x" * 160 + "\n" + "x" * 159 + "\nin node_modules/y\n" + "投" * 160]) == ["see a.ts\n" + "x" * 159 + "\n" + "投" * 160]
    assert values(spark, T.truncate_text, ["a" * 180, "b" * 181, "c" * 178 + "  " + "d"]) == ["a" * 180, "b" * 179 + "…", "c" * 178 + "…"]
    assert values(spark, T.ascii_ratio, ["", "aé", "投资"]) == [1.0, 0.5, 0.0]
    assert values(spark, lambda c: T.search_form(c, 5), ["  A　b\n c d"]) == ["a b c"]


def test_fence_split_is_the_line_state_machine(spark):
    import random

    rng = random.Random(5)
    bodies = ["\n".join(rng.choice(["a", " b ", "```", "  ```js", "```\t", "c```", "", "　```"]) for _ in range(rng.randrange(12))) for _ in range(200)]

    def by_hand(body):
        out, inside = [], False
        for line in body.splitlines():
            if line.strip().startswith("```"):
                inside = not inside
            elif not inside and line.strip():
                out.append(line.strip())
        return "\n".join(out)

    assert values(spark, lambda c: F.array_join(T.stripped_lines(T.outside_code(c)), "\n"), bodies) == [by_hand(b) for b in bodies]


def test_segments(spark):
    body = "- one\n{bad}\n```py\nx = 1\n```\n```\n{\"path\":1}\n```"
    rows = M.segments(spark.createDataFrame([(1, 0, body)], "conv_id long, msg_pos int, body string")).orderBy("seg_pos").collect()
    assert [(r.type, r.lang, r.text) for r in rows] == [("text", None, "- one\n{bad}"), ("code", "py", "x = 1")]


def test_tree_paths(spark):
    schema = "conv_id long, current_node string, mapping map<string,struct<parent:string,children:array<string>,message:struct<create_time:double>>>"
    at = lambda t: {"create_time": t}
    tree = {"a": (None, ["b", "d"], at(1.0)), "b": ("a", ["c"], at(2.0)), "c": ("b", [], at(3.0)), "d": ("a", [], at(9.0))}
    rows = [(1, "c", tree), (2, None, tree), (3, "x", {"x": ("y", ["y"], None), "y": ("x", ["x"], None)}), (4, None, {}), (5, "q", {"m": ("gone", [], None), "n": (None, None, None)}), (6, None, None)]
    rows = [(i, c, t and {k: {"parent": p, "children": ch, "message": m} for k, (p, ch, m) in t.items()}) for i, c, t in rows]
    paths = {}
    for r in M.linear_path(spark.createDataFrame(rows, schema)).orderBy("conv_id", "msg_pos").collect():
        paths.setdefault(r.conv_id, []).append(r.node_id)
    assert paths == {1: ["a", "b", "c"], 2: ["a", "d"], 3: ["y", "x"], 5: ["m"]}


def test_message_filters_and_counts(spark):
    rows = spark.createDataFrame([(1, "system", True, "text", "a"), (1, "user", None, "thoughts", " "), (2, "user", False, None, "b"), (2, None, None, "text", None)], "conv_id long, role string, hidden boolean, content_type string, body string")
    assert M.drop_hidden(rows).count() == 3 and M.drop_system(rows).count() == 3 and M.drop_metadata_types(rows).count() == 3
    assert sorted(r.body for r in M.drop_blank(rows).collect()) == ["a", "b"]
    counts = M.message_counts(spark.createDataFrame([(1,), (2,), (3,)], "conv_id long"), M.drop_blank(rows))
    assert {r.conv_id: r.messages for r in counts.collect()} == {1: 1, 2: 1, 3: 0}


def test_tokens(spark):
    assert values(spark, K.latin_tokens, ["2abc wörld x foo_1"]) == [["abc", "rld", "foo_1"]]
    assert values(spark, K.han_runs, ["资产 a 配置投资，b投"]) == [["资产", "配置投资"]]
    assert values(spark, K.han_ngrams, ["投资组", "一"]) == [["投资", "资组", "投资组"], []]
    tokens = spark.createDataFrame([(k, t) for k, t in enumerate(["The", "Market", "gp3", "turn0search1", "AI", "Hello", "ok", "a1b", "http_x", "的", "投资", "x2y3", "123"])], "k int, term string")
    assert {r.k: r.term for r in K.normalize_terms(tokens).collect()} == {1: "市场", 4: "AI", 5: "Hello", 10: "投资", 11: "x2y3"}


def test_segment_han(spark):
    runs = spark.createDataFrame([(1, "资产配置投资"), (2, "投资资产"), (3, "天地")], "run_no int, run string")
    vocab = spark.createDataFrame([("资产配置",), ("投资",), ("资产",), ("我们",)], "term string")
    got = K.segment_han(runs, vocab, ["run_no"]).orderBy("run_no", "pos").collect()
    assert K.segment_han(runs, vocab, ["run_no"], broadcast_words=0).orderBy("run_no", "pos").collect() == got
    plan = K.segment_han(runs, vocab, ["run_no"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are cut where they lie
    assert [(r.run_no, r.pos, r.term) for r in got] == [(1, 1, "资产配置"), (1, 5, "投资"), (2, 1, "投资"), (2, 3, "资产")]


def test_han_vocab(spark):
    docs = [("哈哈哈",) for _ in range(10)] + [("天地人",) for _ in range(36)] + [("日月",) for _ in range(2)] + [("山水" * 200,) for _ in range(5)] + [("",) for _ in range(47)]
    vocab = {r.term for r in K.han_vocab(spark.createDataFrame(docs, "text string"), 100).collect()}
    assert "山水" in vocab and "水山" in vocab and "投资" in vocab and not {"哈哈", "天地", "日月"} & vocab


def test_topic_labels(spark):
    tf = spark.createDataFrame([(1, 1, "python", 1), (1, 1, "github", 1), (2, 2, "github", 1), (2, 2, "cursor", 1), (3, 3, "python", 1), (4, 4, "misc", 5)], "conv_id long, index long, term string, tf long")
    keywords = spark.createDataFrame([(3, 1, "Gardening", 4), (4, 1, "misc", 1)], "conv_id long, rank int, term string, df long")
    got = {r.conv_id: r.cluster_label for r in K.topic_labels(tf.select("conv_id").distinct(), tf, keywords, 10).collect()}
    assert got == {1: "编程开发", 2: "编程开发", 3: "Gardening", 4: "其他"}


def test_hot_terms(spark):
    lexicon = K.Lexicon(pinned=["天天"])
    df = spark.createDataFrame([("天天", 9, 1, 1), ("地地", 8, 1, 2), ("人人", 7, 1, 3), ("alpha", 6, 1, 4), ("omega", 5, 1, 5)], "term string, df long, first_index long, first_pos long")
    got = [(r["rank"], r.term) for r in K.hot_terms(df, 100, lexicon=lexicon).orderBy("rank").collect()]
    assert got == [(1, "天天"), (2, "地地"), (3, "alpha"), (4, "人人"), (5, "omega")]
    mixed = [r.term for r in K.mix_keywords(df, 4).orderBy("rank").collect()]
    assert mixed == ["天天", "alpha", "地地", "omega"]


def test_good_keywords(spark):
    rows = spark.createDataFrame([("snake_case", 5), ("camelCase", 5), ("DataPanel", 5), ("Rare", 1), ("Common", 61), ("ai", 5), ("zz", 5), ("Fine", 5), ("class", 5), ("资产", 5)], "term string, df long")
    assert {r.term for r in rows.where(K.is_good_keyword(F.col("term"), F.col("df"), 100)).collect()} == {"ai", "Fine", "资产"}


def test_highlights(spark):
    rows = spark.createDataFrame([(1, 0, "Summary: all good\nab?\n- next step: go"), (1, 1, "Summary: all good\nwhy not now?\nplain words only\n```\nrisk inside code\n```")], "conv_id long, msg_pos int, body string")
    got = [(r.line, r.score) for r in H.highlights(rows).orderBy("rank").collect()]
    assert got == [("next step: go", 2.5), ("Summary: all good", 2.0), ("why not now?", 1.0)]


def test_user_features(spark):
    rows = spark.createDataFrame([(0, "ok"), (1, "预算500元，不超过3个月？"), (2, "太长　改成精简"), (3, "1) x"), (4, "I want six words in this one")], "k int, text string")
    got = {r.k: {n for n in I.BUCKETS if r[n]} for r in I.user_message_features(rows).collect()}
    assert got == {0: {"vague"}, 1: {"clarity", "constraint"}, 2: {"feedback", "vague"}, 3: {"clarity", "vague"}, 4: {"clarity"}}
    flags = {r.k: (r.clarify, r.boundary) for r in I.assistant_flags(spark.createDataFrame([(0, "请提供更多信息"), (1, "As an AI, I can't"), (2, "fine")], "k int, text string")).collect()}
    assert flags == {0: (True, False), 1: (False, True), 2: (False, False)}


def test_scores_of_few_turns(spark):
    turns = spark.createDataFrame([(1, 1, 0, "user", "how does it work?"), (1, 1, 1, "user", "ok"), (2, 2, 0, "assistant", "fine")], "conv_id long, index long, msg_pos int, role string, text string")
    got = {r.conv_id: r for r in I.conversation_scores(I.turn_features(turns), ["conv_id"]).collect()}
    assert got[1].clarity_rate == 0.5 and got[1].iteration == 1 and got[1].score == pytest.approx((0.5 + 1) / 5)
    assert got[2].user_messages == 0 and got[2].score == 0.0
    none = I.interaction_totals(I.turn_features(turns.where("role = 'assistant'")))
    assert I.interaction_summary(none).count() == 0 and I.interaction_totals(I.turn_features(turns.limit(0))).first().conversations == 0


def test_topic_trends(spark):
    points = [(k, k, dt.datetime(2024, 1, 1 + k), "up", 0.2 if k < 3 else 0.6) for k in range(6)] + [(10 + k, 10 + k, dt.datetime(2024, 1, 1 + k), "few", float(k)) for k in range(5)] + [(20 + k, 20 + k, None, "undated", float(k)) for k in range(9)]
    items = spark.createDataFrame(points, "conv_id long, index long, created timestamp, cluster_label string, score double")
    got = I.topic_trends(items.drop("score"), items.select("conv_id", "score")).collect()
    assert [(r.trend, r.label, round(r.delta, 3), r["count"]) for r in got] == [("improving", "up", 0.4, 6)]


def test_quotes_use_each_conversation_once(spark):
    rows = [(1, 0, "user", "x", "long text one", 50, True, True, False, False, False), (2, 0, "user", "x", "second", 40, False, True, False, False, False)]
    features = spark.createDataFrame(rows, "index long, msg_pos int, role string, text string, compact string, char_len int, clarity boolean, constraint boolean, context boolean, feedback boolean, vague boolean")
    quotes = I.report_quotes(I.quote_buckets(features)).orderBy("place").collect()
    assert [(q.label, q["index"]) for q in quotes] == [("清晰提问", 1), ("给出约束", 2)]


def items(spark):
    rows = [(1, 1, "a.md", "Foo fighters", ["a", "b"], "snip", "T", 3, dt.datetime(2024, 1, 15, 8, 30)), (2, 2, "b.md", "Other", ["b", "c"], "bar here", "T", 9, None), (3, 3, "c.md", "Third", ["d"], "", "U", 1, dt.datetime(2024, 2, 1)), (4, 4, "d.md", "Empty", [], "", "U", 1, dt.datetime(2024, 2, 1))]
    return spark.createDataFrame(rows, "conv_id long, index long, file string, title string, keywords array<string>, snippet string, cluster_label string, messages long, created timestamp").withColumn("updated", F.col("created"))


def test_search_and_filters(spark):
    rows = items(spark)
    texts = spark.createDataFrame([("a.md", "some bar text"), ("c.md", "foo")], "file string, search_text string")
    ids = lambda df: sorted(r.conv_id for r in df.collect())
    assert ids(R.search(rows, texts, "foo BAR")) == [1] and ids(R.search(rows, None, " ")) == [1, 2, 3, 4] and ids(R.search(rows, texts, "c")) == [2]
    assert ids(R.by_min_messages(rows, 3)) == [1, 2] and ids(R.by_min_messages(rows, 0)) == [1, 2, 3, 4]
    assert ids(R.by_date_range(rows, end="2024-01-15")) == [] and ids(R.by_date_range(rows, end="2024-01-15", whole_end_day=True)) == [1] and ids(R.by_date_range(rows, start="2024-01-16")) == [3, 4]
    assert ids(R.by_keyword(rows, "b")) == [1, 2] and ids(R.by_topic(rows, "U")) == [3, 4]
    assert ids(R.filter_items(rows, texts, "foo", topic="U")) == [3]
    assert [r.conv_id for r in R.sort_items(rows, "created").collect()] == [1, 3, 4, 2] and [r.conv_id for r in R.sort_items(rows, "messages").collect()] == [2, 1, 3, 4]
    notes = R.attach_notes(rows, spark.createDataFrame([("a.md", True, "n")], "file string, starred boolean, note string"))
    assert {r.conv_id: (r.starred, r.note) for r in notes.collect()}[1] == (True, "n") and notes.where("starred").count() == 1
    assert R.random_item(rows, 1).count() == 1 and R.random_item(rows.limit(0), 1).count() == 0
    assert R.random_item(rows, 1).collect() == R.random_item(rows.repartition(3), 1).collect()


def test_similar(spark):
    got = {(r.conv_id, r.other): r.score for r in R.similar(items(spark)).collect()}
    assert got == {(1, 2): pytest.approx(1 / 3), (2, 1): pytest.approx(1 / 3)}
    assert [(r.other, round(r.score, 3)) for r in R.similar_to(items(spark), 1).collect()] == [(2, 0.333)]
    assert R.similar_to(items(spark), 4).count() == 0 and R.similar_to(items(spark), 99).count() == 0


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_similar_against_all_pairs(spark, monkeypatch, frequent):
    import random

    monkeypatch.setattr(R, "RARE", frequent)
    rng = random.Random(2)
    kept = {n: sorted({"hot"} | set(rng.choices([f"w{k}" for k in range(25)], k=rng.randrange(8)))) for n in range(70)}
    kept |= {200: ["hot"], 201: ["hot"], 202: [], 203: ["alone"], 204: None}
    df = spark.createDataFrame([(n, 1000 - n, w) for n, w in kept.items()], "conv_id long, index long, keywords array<string>")
    want = {}
    for a, x in kept.items():
        scored = [(len(set(x) & set(y)) / len(set(x) | set(y)), b - 1000, b) for b, y in kept.items() if a != b and x and y]
        want[a] = [(b, round(s, 9)) for s, _, b in sorted((r for r in scored if r[0]), key=lambda r: (-r[0], -r[1]))[:3]]
    got = {}
    for r in R.similar(df, k=3).orderBy("conv_id", "rank").collect():
        got.setdefault(r.conv_id, []).append((r.other, round(r.score, 9)))
    assert got == {a: found for a, found in want.items() if found}


@pytest.mark.parametrize("queries", [2000, 9])
def test_similar_items_of_many_keywords(spark, monkeypatch, queries):
    """40 keywords an item, most of them frequent, beside items of a few; against all pairs."""
    import random

    monkeypatch.setattr(R, "RARE", 3)
    monkeypatch.setattr(R, "QUERIES", queries)  # so that queries go in blocks
    rng = random.Random(8)
    kept = {n: rng.sample([f"w{k}" for k in range(70)], 40 if n % 3 else rng.randrange(1, 9)) for n in range(60)}
    df = spark.createDataFrame([(n, n, w) for n, w in kept.items()], "conv_id long, index long, keywords array<string>")
    began = time.time()
    got = {}
    for r in R.similar(df).orderBy("conv_id", "rank").collect():
        got.setdefault(r.conv_id, []).append((r.other, round(r.score, 9)))
    assert time.time() - began < 60
    for a, x in kept.items():
        scored = [(len(set(x) & set(y)) / len(set(x) | set(y)), b) for b, y in kept.items() if a != b]
        want = sorted((r for r in scored if r[0]), key=lambda r: (-r[0], r[1]))[:5]
        assert got.get(a, []) == [(b, round(s, 9)) for s, b in want]


def test_joins_of_hot_keys(spark):
    rows = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)] + [(None, -1)], "key long, v long")
    per = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("least")).where("key <> 905")
    for how in ("inner", "left"):
        got = join_by_key(rows, per, ["key"], "n", 1000, how).select("key", "v", "least").collect()
        assert sorted(map(str, got)) == sorted(map(str, rows.join(per.drop("n"), "key", how).select("key", "v", "least").collect()))


def test_summary_by_hand(spark):
    turns = [(1, "user", "What is it, and why?"), (1, "assistant", "x" * 8), (1, "user", "ok"), (2, "user", "budget 500 km"), (2, "assistant", "y" * 4)]
    rows = spark.createDataFrame([(c, c, p, r, t) for p, (c, r, t) in enumerate(turns)], "conv_id long, index long, msg_pos int, role string, text string")
    got = I.interaction_summary(I.interaction_totals(I.turn_features(rows))).first().asDict()
    assert got == {
        "conversations": 2, "user_messages": 3, "assistant_messages": 2, "avg_user_len": (16 + 2 + 11) / 3, "avg_turns": 2.5, "clarity_avg": 1 / 3,
        "constraint_rate": 1 / 3, "context_rate": 0.0, "feedback_rate": 0.0, "iteration_rate": 0.5, "clarification_rate": 0.0,
    }


def test_trends_of_one_large_topic(spark):
    rows = [(k, k + 1, f"2024-01-{k % 28 + 1:02d} 00:00:00", "hot" if k % 4 else f"t{k}", (k % 28) / 28) for k in range(400)]
    items = spark.createDataFrame(rows, "conv_id long, index long, created string, cluster_label string, score double").withColumn("created", F.to_timestamp("created"))
    got = I.topic_trends(items.drop("score"), items.select("conv_id", "score")).collect()
    points = sorted((r[2], r[1], r[4]) for r in rows if r[3] == "hot")
    half = len(points) // 2
    early, late = (sum(p[2] for p in part) / len(part) for part in (points[:half], points[half:]))
    assert [(r.trend, r.label, r["count"]) for r in got] == [("improving", "hot", 300)]
    assert (got[0].early, got[0].recent) == (pytest.approx(early), pytest.approx(late))


def test_rollups_of_nothing(spark):
    none = items(spark).limit(0)
    assert rollups.month_counts(none).count() == 0 and rollups.topic_counts(none).count() == 0
    assert rollups.corpus_metrics(none).first().total == 0 and rollups.month_profile(rollups.month_counts(none)).count() == 0


def test_numbering(spark):
    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(7)
    assert all(r["index"] == r.k + 1 for r in M.number_conversations(rows, ["k"]).collect())


def test_search_finds_words_at_the_end_of_long_conversations(spark):
    from talkloom.plans.jobs import Insights

    messages = spark.createDataFrame([(1, 0, "user", "word " * 3000), (1, 1, "user", "needle")], "conv_id long, msg_pos int, role string, body string")
    convs = spark.createDataFrame([(1, 1, "t", "f")], "conv_id long, index long, title string, file string")
    assert M.search_text(messages).first().search_text.endswith("needle")
    assert Insights(messages, convs).search.where(F.col("search_text").contains("needle")).count() == 1


def test_terms_at_the_end_of_long_texts(spark):
    run = "".join(chr(0x4E00 + k) for k in range(300))
    docs = spark.createDataFrame([(1, "word " * 3000 + "needle " + run), (2, run)], "conv_id long, text string")
    assert K.tokenize(docs, None, ["conv_id"]).where("term = 'needle'").count() == 1
    learned = {r.term for r in K.han_vocab(docs, 2, min_df=2, max_df_ratio=1.0).collect()}
    assert run[-2:] in learned and run[:2] in learned
