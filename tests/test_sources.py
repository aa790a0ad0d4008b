"""Readers and writers: what is written is read back."""

import json
import time

import pytest
from pyspark.sql import functions as F

from talkloom.operators import messages as M
from talkloom.plans import fixtures
from talkloom.plans.jobs import Insights, InteractionReport, build_archive, generic_messages, tree_messages
from talkloom.sources import archive as A, exports as X

SMALL = "/root/testdata/sf0.001"


def conversation(k, text="hi"):
    message = lambda role, body, t, **more: {"author": {"role": role}, "create_time": t, "content": {"content_type": "text", "parts": [body]}, **more}
    return {"id": f"c-{k}", "title": f"T {k}", "create_time": 1705307400.0, "current_node": "b", "mapping": {
        "r": {"parent": None, "children": ["a"], "message": None}, "a": {"parent": "r", "children": ["b", "x"], "message": message("user", text, 1705307400)},
        "b": {"parent": "a", "children": [], "message": message("assistant", "yo", 1705307401)}, "x": {"parent": "a", "children": [], "message": message("assistant", "dead", 1705307402, metadata={"is_visually_hidden_from_conversation": True})}}}


def test_tree_export(spark, tmp_path):
    (tmp_path / "conversations.json").write_text(json.dumps([conversation(1), conversation(2, '{"path": 1}')]))
    trees = M.normalize_conversation_fields(X.read_tree_export(spark, str(tmp_path / "conversations.json"))).withColumn("conv_id", F.col("id"))
    rows = tree_messages(trees).orderBy("conv_id", "msg_pos").collect()
    assert [(r.conv_id, r.role_label, r.body) for r in rows] == [("c-1", "user (2024-01-15 08:30:00Z)", "hi"), ("c-1", "assistant (2024-01-15 08:30:01Z)", "yo"), ("c-2", "assistant (2024-01-15 08:30:01Z)", "yo")]
    assert tree_messages(trees, whole_tree=True, keep_hidden=True).count() == 5
    numbered = M.number_conversations(trees, ["id"])
    files = [r.file for r in build_archive(numbered, tree_messages(trees)).orderBy("index").collect()]
    assert files == ["conversations/0001_20240115_t-1_1.md", "conversations/0002_20240115_t-2_2.md"]


def test_tree_export_cut_anywhere(spark, tmp_path):
    """Every cut of a text whose strings are full of braces, brackets and escapes gives its complete items."""
    tricky = [{**conversation(1, 'a}]"\\"{['), "title": "\\\\"}, {"id": "2", "title": 'é\U0001f600 } ] \\" [', "mapping": {}}, {"id": "3}"}, {"conversation_id": "\n,{"}]
    whole = " x [" + " ,\n ".join(json.dumps(c, ensure_ascii=k % 2 == 0) for k, c in enumerate(tricky)) + "\n] {}"
    raw = whole.encode()
    ends = [len(whole[: m].encode()) for m in (whole.index(',\n {"id": "2"') - 1, whole.index(' ,\n {"id": "3}"'), whole.index(' ,\n {"conv'), whole.rindex("]") - 1)]
    for k in [*range(0, len(raw), 61), len(raw) - 1, len(raw), *(e + d for e in ends for d in (-1, 0, 1))]:
        (tmp_path / f"{k}.json").write_bytes(raw[:k])
    (tmp_path / "bom.json").write_bytes("\ufeff".encode() + raw[: ends[0]])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        items = X.array_items(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in items:
        got.setdefault(r.file.rpartition("/")[2], []).append((r.item, json.loads(r.value)))
    for path in tmp_path.iterdir():
        size = int(path.stem) if path.stem != "bom" else ends[0]
        assert sorted(x for x, _ in got.get(path.name, [])) == list(range(sum(e <= size for e in ends))), path.name
        assert [c for _, c in sorted(got.get(path.name, []), key=lambda x: x[0])] == tricky[: sum(e <= size for e in ends)]


def test_broken_tree_export(spark, tmp_path):
    path = tmp_path / "broken.json"
    path.write_text(json.dumps([conversation(1), conversation(2), conversation(3)])[:-200])
    assert sorted(r.id for r in X.read_tree_export(spark, str(path)).collect()) == ["c-1", "c-2"]
    path.write_text(json.dumps([conversation(1), {"id": {"no": "text"}, "mapping": 7}, conversation(3)]))
    with pytest.raises(Exception):
        X.read_tree_export(spark, str(path)).collect()
    assert {"c-1", "c-3"} <= {r.id for r in X.read_tree_export(spark, str(path), mode="PERMISSIVE").collect()}


def test_a_large_file_is_many_tasks(spark, tmp_path):
    path = tmp_path / "big.json"
    path.write_text(json.dumps([{**conversation(k), "title": "t" * 2000} for k in range(3000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = X.read_tree_export(spark, str(path))
        pieces = spark.read.text(str(path), lineSep="}")
        assert pieces.rdd.getNumPartitions() >= 8 and pieces.agg(F.max(F.length("value"))).first()[0] < 10_000
        assert sorted(r.id for r in rows.select("id").collect()) == sorted(f"c-{k}" for k in range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "conversations.json").write_text(json.dumps([{"id": "1", "messages": []}]))
    (tmp_path / "sub" / "other.json").write_text(json.dumps({"conversations": [{"id": "4"}, {"id": "5"}]}, indent=1))
    (tmp_path / "sub" / "conversations.jsonl").write_text('{"id": "2"}\n\n{"id": "3"}\n')
    assert sorted(r.id for r in X.read_generic_export(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4", "5"]


@pytest.mark.parametrize("form", ["list", "wrapped", "lines"])
def test_generic_export(spark, tmp_path, form):
    convs = [{"id": "1", "title": "A", "created_utc": "2024-01-15 08:30:00Z", "messages": [{"role": " user ", "content": ["x", ["y"]], "created_utc": "2024-01-15T08:30:00Z"}, {"role": "", "text": "t"}, {"role": "tool", "content": '{"path": 1}'}]}, {"conversation_id": "2", "create_time": 1705307400, "messages": []}]
    path = tmp_path / ("e.jsonl" if form == "lines" else "e.json")
    path.write_text("\n\n".join(map(json.dumps, convs)) if form == "lines" else json.dumps(convs if form == "list" else {"conversations": convs}))
    read = M.normalize_conversation_fields(X.read_generic_export(spark, str(path)))
    assert [(r.id, r.title, str(r.created)) for r in read.orderBy("id").collect()] == [("1", "A", "2024-01-15 08:30:00"), ("2", "Untitled", "2024-01-15 08:30:00")]
    rows = generic_messages(read.withColumn("conv_id", F.col("id"))).orderBy("msg_pos").collect()
    assert [(r.role_label, r.body) for r in rows] == [("user (2024-01-15 08:30:00Z)", "x\ny"), ("unknown", "t")]


def test_export_of_another_shape_fails(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="list of conversations"):
        X.read_generic_export(spark, str(tmp_path / "e.json")).collect()


def test_selecting_export_files(spark, tmp_path):
    for name, size in (("a/conversations.json", 10), ("b/conversations.jsonl", 30), ("c/conversations.json", 30), ("d/other.JSON", 99), ("d/Conversations.json", 98), ("e/x.txt", 200)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    of = lambda **how: [(r.path.split("/")[-2], r.size, r.lines) for r in X.select_export_files(spark, str(tmp_path), **how).collect()]
    assert of() == [("b", 30, True)] and of(source="generic") == [("d", 99, False)] and of(pattern="x*") == [("e", 200, False)]
    assert of(largest_only=False) == [("b", 30, True), ("c", 30, False), ("a", 10, False)]
    with pytest.raises(FileNotFoundError):
        X.select_export_files(spark, str(tmp_path / "e"))


def test_markdown_round_trip(spark, tmp_path):
    text = "# T\n\n- id: 1\n\n  ---  \n\n<!-- MSG role: user -->\n### user\n\nhello\nthere\n\n<!-- /MSG -->\n\n<!-- MSG role: tool -->\n### tool\n\n\n\n<!-- /MSG -->\n"
    legacy = "# T\n---\n### user\n\nhi\n### no blank line\nx\n\n### assistant\n\nyo\n"
    (tmp_path / "a.md").write_text(text.replace("\n", "\r\n"))
    (tmp_path / "b.md").write_text(legacy)
    (tmp_path / "c.md").write_text("### user\n\nno dashes\n")
    rows = A.read_markdown_archive(spark, str(tmp_path)).orderBy("file", "msg_pos").collect()
    assert [(r.file, r.role_label, r.body) for r in rows] == [("a.md", "user", "hello\nthere"), ("b.md", "user", "hi"), ("b.md", "assistant", "yo"), ("c.md", "user", "no dashes")]


def said(spark, text):
    return [(r.role_label, r.body) for r in A.parse_markdown(spark.createDataFrame([("f", text)], "file string, markdown string")).orderBy("msg_pos").collect()]


def test_odd_markdown(spark):
    mark = lambda role, text: f"<!-- MSG role: {role} -->\n{text}\n<!-- /MSG -->"
    assert said(spark, mark("user", "a\n---\nb")) == []  # what looks like the end of the head hides the marker
    assert said(spark, "---\n" + mark("user", "a\n---\nb") + mark(" tool:x (t) ", "### h\n\nb")) == [("user", "a\n---\nb"), ("tool:x (t)", "b")]
    assert said(spark, "x\n<!-- MSG role: cut\n" + mark("user", "one <!-- MSG role: b -->\ntwo") + "\n<!-- /MSG --> " + mark("a", "### h\nno blank line")) == [("user", "one <!-- MSG role: b -->\ntwo"), ("a", "### h\nno blank line")]
    assert said(spark, mark("user", "no end")[:-5]) == [] and said(spark, "") == [] and said(spark, None) == []
    assert said(spark, mark("user", "") + mark("b", " \u3000 ") + mark("c", "x") + "<!-- MSG role:") == [("c", "x")]
    assert said(spark, "### a\n\nx\n#### no\n### \n\nlost\n### b\n\n\n y \n\n### c\n\n") == [("a", "x\n#### no"), ("b", "y")]
    assert said(spark, "\u2003---\u3000\r\n### a\r\n\r\nx\r\n") == [("a", "x")]


@pytest.mark.parametrize("letter", ["x", "\U0001f600"])
def test_large_markdown_is_read_in_linear_time(spark, letter):
    """A megabyte each, with and without a head, and in all forms; a quarter of it first, so that all is compiled."""
    message = f"<!-- MSG role: user -->\n### user\n\nhello {letter} there\nline two - of text ---x\n\n<!-- /MSG -->\n\n"
    forms = {
        "marked": lambda n: message * (n // len(message)), "one": lambda n: "<!-- MSG role: u -->\n" + f"{letter} words and\n" * (n // 13) + "<!-- /MSG -->",
        "bare": lambda n: f"{letter} words and\n" * (n // 13), "legacy": lambda n: f"### user\n\nhi {letter}\n" * (n // 15), "line": lambda n: "### u\n\n" + f"{letter} words" * (n // 7),
    }
    for make in forms.values():
        for head in ("", f"# {letter}\n\n---\n\n"):
            said(spark, head + make(250_000))
            began = time.time()
            found = said(spark, head + make(1_000_000))
            assert time.time() - began < 5 and (sum(len(b) for _, b in found) > 200_000 or make is forms["bare"])


def test_index_csv(spark, tmp_path):
    convs = fixtures.convs(spark, SMALL).withColumn("title", F.when(F.col("index") == 1, 'A "quoted", title\nof two lines').otherwise(F.col("title")))
    A.write_index_csv(convs, str(tmp_path / "index"))
    got = {r["index"]: r for r in A.read_index_csv(spark, str(tmp_path / "index")).collect()}
    assert len(got) == convs.count() and got[1].title == 'A "quoted", title\nof two lines' and got[1].created_utc == "unknown"


def test_search_shards_and_manifest(spark, tmp_path):
    rows = spark.range(1, 602).select(F.col("id").alias("index"), F.concat(F.lit("f"), "id").alias("file"), F.lit("t").alias("title"), F.lit("s").alias("search_text"))
    for size, counts in ((300, {0: 300, 1: 300, 2: 1}), (0, None)):
        path = tmp_path / str(size)
        A.write_search_shards(rows.repartition(3), str(path), size)
        manifest = A.search_manifest(spark, str(path)).collect()
        assert {f.name for f in (path / "shards").glob("search-*.json")} == {r.file for r in manifest} and sum(r["count"] for r in manifest) == 601
        for r in manifest:  # each as a viewer reads it
            lines = [json.loads(x) for x in (path / "shards" / r.file).read_text().splitlines()]
            items = lines[0]["items"] if size else lines
            assert len(items) == r["count"] and set(items[0]) == {"file", "title", "search_text"}
            if size:
                assert len(lines) == 1 and lines[0]["shard"] == r.shard and [i["file"] for i in items] == [f"f{k}" for k in range(300 * r.shard + 1, 300 * r.shard + 1 + r["count"])]
        assert {r.shard: r["count"] for r in manifest} == counts if counts else len(manifest) == 3
        assert A.read_search_shards(spark, str(path)).select("file").distinct().count() == 601 == A.read_search_shards(spark, str(path)).count()
    A.write_search_shards(rows.where("index < 0"), str(tmp_path / "none"))
    assert A.search_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "search.json").write_text(json.dumps({"items": [{"file": "a", "title": "b", "search_text": "c"}]}))
    assert [r.file for r in A.read_search_shards(spark, str(tmp_path / "old")).collect()] == ["a"]


def test_jobs_end_to_end(spark, tmp_path):
    messages, convs = fixtures.messages(spark, SMALL), fixtures.convs(spark, SMALL)
    job = Insights(messages, convs)
    assert job.items.count() == convs.count() == job.search.count()
    A.write_items(job.items, job.report(), str(tmp_path / "out"))
    said = spark.read.json(str(tmp_path / "out" / "insights")).first()
    assert said.total == convs.count() and sum(c["count"] for c in said.clusters) <= said.total
    parts = InteractionReport(messages, job.items).parts()
    A.write_report(parts, str(tmp_path / "report"))
    report = spark.read.json(str(tmp_path / "report")).first()
    assert {"summary", "strengths", "gaps", "quotes", "boundaries"} <= set(report.asDict())
    assert all(0 <= r.score <= 1 for r in InteractionReport(messages).scores.collect())
    A.write_markdown(A.to_markdown(messages.withColumn("role_label", F.col("role")), convs), str(tmp_path / "md"))
    assert spark.read.parquet(str(tmp_path / "md")).count() == convs.count()
