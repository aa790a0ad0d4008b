"""Queries over the driver's tables, each one an operator (or a few), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkloom.functions import contents, fields, text as T
from talkloom.functions.lexicon import GAPS, QUOTE_LABELS, STRENGTHS, ZH_STOPWORDS
from talkloom.operators import highlights as H, interaction as I, messages as M, retrieval as R, rollups, terms as K
from talkloom.plans import fixtures, oracle as O
from talkloom.plans.jobs import Insights, InteractionReport, build_archive, generic_messages, tree_messages
from talkloom.session import new_folder
from talkloom.sources import archive as A, exports as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "tfidf_keywords"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLE_SQL[query.__name__] = O.sql(sql)
        return query

    return add


def on_bodies(name: str, expression: Callable, sql: str) -> None:
    """A query that maps an expression over every body: conv_id, msg_pos, value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.messages(spark, sf_dir).select("conv_id", "msg_pos", expression(F.col("body")).alias("value"))

    query.__name__ = name
    register(f"SELECT conv_id, msg_pos, {sql} AS value FROM c_fx")(query)


def on_convs(name: str, expression: Callable, sql: str) -> None:
    """A query that maps an expression over the conversations: conv_id, value."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fixtures.convs(spark, sf_dir).select("conv_id", expression().alias("value"))

    query.__name__ = name
    register(f"SELECT conv_id, {sql} AS value FROM c_convs")(query)


def insights(spark: SparkSession, sf_dir: str) -> Insights:
    return Insights(fixtures.messages(spark, sf_dir), fixtures.convs(spark, sf_dir))


def report(spark: SparkSession, sf_dir: str, items: bool = False) -> InteractionReport:
    return InteractionReport(
        fixtures.messages(spark, sf_dir),
        fixtures.convs(spark, sf_dir).join(insights(spark, sf_dir).topics, "conv_id") if items else None
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# -- Fields of exports ---------------------------------------------------------------------------------------------

WHEN = "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%SZ'), 'unknown')"
on_convs("format_ts", lambda: fields.format_ts(F.col("created")), WHEN.format("created"))
on_convs(
    "parse_ts", lambda: F.coalesce(fields.parse_ts(fields.format_ts(F.col("created"))).cast("long"), F.lit(0)),
    "coalesce(epoch_us(created) // 1000000, 0)"
)
on_convs(
    "to_time",
    lambda: fields.format_ts(
        fields.to_time(
            F.when(F.col("conv_id") % 3 == 0, F.unix_timestamp("created").cast("string")).when(
                F.col("conv_id") % 3 == 1, F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'")
            ).otherwise(fields.format_ts(F.col("created")))
        )
    ),
    WHEN.format("created")
)
on_convs(
    "slugify", lambda: fields.slugify(F.concat(F.lit("-Chat, No. "), "conv_id", F.lit("!"))), "'chat-no-' || conv_id"
)
on_convs(
    "archive_file_name",
    lambda: fields.archive_file_name(F.col("index"), F.col("created"), F.col("title"), F.col("id")), "substr(file, 15)"
)


@register(
    f"""SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN title ELSE 'Untitled' END AS title, CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN id ELSE 'c' || conv_id END AS id, {WHEN.format("CASE WHEN conv_id % 2 = 1 THEN created END")} AS created FROM c_convs"""
)
def normalize_fields(spark, sf_dir):
    c = F.col("conv_id")
    rows = fixtures.convs(spark, sf_dir).select(
        "conv_id", F.when(c % 2 == 0, F.col("title")).otherwise(F.when(c % 4 == 1, F.lit(""))).alias("title"), F.when(c % 3 == 1, F.col("id")).otherwise(F.lit("")).alias("id"),
        F.when(
            c % 3 == 2, F.concat(F.lit("c"), c.cast("string"))
        ).alias("conversation_id"), F.lit("0").alias("created_utc"), F.when(
            c % 2 == 1, F.unix_timestamp("created").cast("string")
        ).alias("create_time"),
    )
    found = M.normalize_conversation_fields(rows)
    return found.select("conv_id", "title", "id", fields.format_ts(F.col("created")).alias("created"))


@register(
    """SELECT conv_id, turn AS msg_pos, role || CASE WHEN turn % 2 = 1 THEN ':web' ELSE '' END || CASE WHEN turn > 0 THEN ' (1970-01-01 00:' || printf('%02d', turn * 10 // 60) || ':' || printf('%02d', turn * 10 % 60) || 'Z)' ELSE '' END AS label, lower(role) AS base FROM conversations"""
)
def role_labels(spark, sf_dir):
    rows = fixtures.raw(spark, sf_dir).withColumn(
        "ts", F.when(F.col("turn") > 0, F.timestamp_seconds(F.col("turn") * 10))
    )
    label = fields.role_label(F.col("role"), F.when(F.col("turn") % 2 == 1, "web"), F.col("ts"))
    return rows.select(
        "conv_id", F.col("turn").alias("msg_pos"), label.alias("label")
    ).withColumn("base", fields.base_role(F.col("label")))


@register(
    "SELECT conv_id, turn AS msg_pos, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || chr(10) || text || chr(10) "
        "|| 'x' ELSE '{\"t\":\"' || replace(text, chr(10), '\\n') || '\"}' END AS body FROM conversations"
)
def normalize_content(spark, sf_dir):
    nested = F.to_json(F.array(F.col("role"), F.lit(""), F.col("text"), F.lit("x")))
    raw = F.when(
        F.col("turn") % 3 == 0, F.to_json(F.to_variant_object(F.array("text")))
    ).when(F.col("turn") % 3 == 1, nested).otherwise(F.to_json(F.struct(F.col("text").alias("t"))))
    rows = fixtures.raw(spark, sf_dir).select("conv_id", F.col("turn").alias("msg_pos"), F.parse_json(raw).alias("v"))
    return rows.select("conv_id", "msg_pos", fields.normalize_content(F.col("v")).alias("body"))


@register(
    "SELECT conv_id, turn AS msg_pos, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN repeat(chr(96), 3) || 'sql' || "
        "chr(10) || text || chr(10) || repeat(chr(96), 3) WHEN 2 THEN text || chr(10) || '[image] (640x480) file-' "
        "|| conv_id ELSE '' END AS body FROM conversations"
)
def render_content(spark, sf_dir):
    t = F.col("turn") % 4
    image = F.to_json(
        F.struct(
            F.lit("image_asset_pointer").alias("content_type"),
            F.concat(F.lit("file-"), F.col("conv_id").cast("string")).alias("asset_pointer"),
            F.lit(640).alias("width"), F.lit(480).alias("height")
        )
    )
    parts = F.concat(
        F.lit("["), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2),
        F.when(t == 2, F.concat(F.lit(","), image)).otherwise(F.lit("")), F.lit("]")
    )
    kind = F.when(t == 0, "text").when(t == 1, "code").when(t == 2, "multimodal_text").otherwise("thoughts")
    content = F.struct(
        kind.alias("content_type"), F.from_json(parts, "array<variant>").alias("parts"), F.col("text"),
        F.lit("sql").alias("language")
    )
    return fixtures.raw(spark, sf_dir).select(
        "conv_id", F.col("turn").alias("msg_pos"), fields.render_content(content).alias("body")
    )


_QUOTED = "replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"
_ODD = f"""SELECT conv_id, turn AS msg_pos, text, '"' || {_QUOTED} || '"' AS q FROM conversations"""


@register(f"""SELECT conv_id, msg_pos, CASE msg_pos % 7 WHEN 0 THEN text WHEN 1 THEN 'a' || repeat(chr(10) || text, 3) || chr(10) || '1.50'
  WHEN 2 THEN '{{"b":1,"a": 2.0,"t":' || q || ',"b":1e3}}' WHEN 3 THEN chr(10) || text WHEN 4 THEN '1e3' WHEN 5 THEN '{{"x":[' || q || ',{{}}]}}' || chr(10) || 'true'
  ELSE '' END AS body FROM ({_ODD})""")
def json_contents(spark, sf_dir):
    """Contents as JSON text: deep lists, empty values, repeated keys, key order and numbers as they stand."""
    rows = fixtures.raw(spark, sf_dir).select("conv_id", F.col("turn").alias("msg_pos"), "text")
    q = F.regexp_replace(F.to_json(F.array("text")), r"(?s)^\[|\]\z", "")
    form = lambda text: F.replace(F.lit(text), F.lit("@"), q)
    t = F.col("msg_pos") % 7
    raw = F.when(t == 0, q).when(t == 1, form('["a",[@,[@,[[[@]]]]], 0, "", null, {}, [], 1.50]')).when(
        t == 2, form('{"b":1,"a": 2.0,"t":@,"b":1e3}')
    ).when(t == 3, form('[ ["", false], @ ]')).when(t == 4, F.lit("1e3")).when(t == 5, form('[{"x":[@,{}]}, true]')).otherwise("[]")
    return rows.select("conv_id", "msg_pos", contents.content_text(raw).alias("body"))


@register(f"""SELECT conv_id, msg_pos, CASE msg_pos % 5 WHEN 0 THEN text || chr(10) || '{{"k":1.50,"j":' || q || ',"k":2}}'
  WHEN 1 THEN repeat(chr(96), 3) || 'sql' || chr(10) || text || chr(10) || repeat(chr(96), 3)
  WHEN 2 THEN text || chr(10) || '[image] (640x480) f-' || conv_id || chr(10) || '[image] image' || chr(10) || text || chr(10) || '{{"a":[1]}}'
  WHEN 3 THEN text ELSE '' END AS body FROM ({_ODD})""")
def json_bodies(spark, sf_dir):
    """Bodies of messages whose contents are JSON text, of every type."""
    rows = fixtures.raw(spark, sf_dir).select("conv_id", F.col("turn").alias("msg_pos"), "text")
    q = F.regexp_replace(F.to_json(F.array("text")), r"(?s)^\[|\]\z", "")
    form = lambda text: F.replace(F.replace(F.lit(text), F.lit("@"), q), F.lit("#"), F.col("conv_id").cast("string"))
    t = F.col("msg_pos") % 5
    raw = F.when(t == 0, form('{"parts":[" "],"content_type" : "text", "parts":[@,"", "\\n",{"k":1.50,"j":@,"k":2}]}')).when(
        t == 1, form('{"content_type":"code","language":" sql ","text":@}')
    ).when(t == 2, form(
        '{"content_type":"multimodal_text","parts":[@, {"content_type":"image_asset_pointer","asset_pointer":"f-#","width":640,"height":480},'
        '{"content_type":"image_asset_pointer"},{"content_type":"text","text":@},{"content_type":"text","text":" "},{"a":[1]}]}'
    )).when(t == 3, form('{"content_type":"execution_output","text":@}')).otherwise(form('{"content_type":"thoughts","text":@}'))
    return rows.select("conv_id", "msg_pos", contents.rendered(raw).alias("body"))


# -- Trees and messages --------------------------------------------------------------------------------------------

@register("""WITH ends AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
  ends2 AS (SELECT conv_id, last, CASE WHEN conv_id % 4 = 0 AND last % 3 = 0 THEN 'd' || last END AS dead FROM ends)
  SELECT c.conv_id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 AS INTEGER) AS msg_pos, 'n' || turn AS node_id FROM conversations c
  UNION ALL SELECT conv_id, CAST((SELECT count(*) FROM conversations x WHERE x.conv_id = ends2.conv_id) AS INTEGER), dead FROM ends2 WHERE dead IS NOT NULL""")
def linear_path(spark, sf_dir):
    return M.linear_path(fixtures.trees(spark, sf_dir))


@register("""SELECT conv_id, node_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY t, node_id) - 1 AS INTEGER) AS msg_pos FROM (
  SELECT conv_id, 'n' || turn AS node_id, turn * 10 AS t FROM conversations UNION ALL SELECT conv_id, 'd' || turn, turn * 10 + 5 FROM conversations WHERE turn % 3 = 0)""")
def all_nodes(spark, sf_dir):
    return M.all_nodes(fixtures.trees(spark, sf_dir)).select("conv_id", "node_id", "msg_pos")


@register(
    "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS msg_pos, role, "
        "text FROM conversations"
)
def explode_messages(spark, sf_dir):
    listed = fixtures.raw(spark, sf_dir).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")
    )
    return M.explode_messages(listed).select("conv_id", "msg_pos", "message.role", "message.text")


@register(
    "SELECT conv_id, CAST(row_number() OVER (ORDER BY conv_id) AS BIGINT) AS arrival FROM (SELECT DISTINCT conv_id "
        "FROM conversations)"
)
def number_conversations(spark, sf_dir):
    numbered = M.number_conversations(fixtures.raw(spark, sf_dir).select("conv_id").distinct(), ["conv_id"])
    return numbered.select("conv_id", F.col("index").alias("arrival"))


@register(
    f"SELECT c.conv_id, count(f.body) AS messages FROM c_convs c LEFT JOIN (SELECT * FROM c_fx WHERE NOT "
        f"{O.tool_call('body')}) f ON c.conv_id = f.conv_id GROUP BY c.conv_id"
)
def message_counts(spark, sf_dir):
    return M.message_counts(
        fixtures.convs(spark, sf_dir).select("conv_id"), M.drop_tool_calls(fixtures.messages(spark, sf_dir))
    )


@register(
    "SELECT conv_id, turn AS msg_pos FROM conversations WHERE turn % 5 <> 4 AND role <> 'system' AND turn % 7 <> 6"
)
def drop_hidden_system_metadata(spark, sf_dir):
    rows = fixtures.raw(spark, sf_dir).select(
        "conv_id", F.col("turn").alias("msg_pos"), "role", F.when(F.col("turn") % 5 == 4, True).alias("hidden"),
        F.when(F.col("turn") % 7 == 6, "thoughts").otherwise("text").alias("content_type")
    )
    return M.drop_metadata_types(M.drop_system(M.drop_hidden(rows))).select("conv_id", "msg_pos")


@register(f"SELECT conv_id, msg_pos FROM c_fx WHERE {O.tool_call('body')}")
def tool_calls(spark, sf_dir):
    return fixtures.messages(spark, sf_dir).where(T.is_tool_call(F.col("body"))).select("conv_id", "msg_pos")


@register("SELECT conv_id, turn AS msg_pos FROM conversations WHERE turn % 3 <> 1")
def drop_blank(spark, sf_dir):
    rows = fixtures.raw(spark, sf_dir).select(
        "conv_id", F.col("turn").alias("msg_pos"),
        F.when(F.col("turn") % 3 == 1, "　 \n").otherwise(F.col("text")).alias("body")
    )
    return M.drop_blank(rows).select("conv_id", "msg_pos")


_TREE_MESSAGES = """SELECT conv_id, turn AS msg_pos, text AS body FROM conversations WHERE role <> 'system'
  UNION ALL SELECT c.conv_id, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id), text FROM conversations c
  JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) e ON c.conv_id = e.conv_id AND c.turn = last
  WHERE c.conv_id % 4 = 0 AND last % 3 = 0 AND role <> 'system'"""


@register(_TREE_MESSAGES)
def tree_archive_messages(spark, sf_dir):
    return tree_messages(fixtures.trees(spark, sf_dir)).select(
        "conv_id", F.col("msg_pos").cast("long").alias("msg_pos"), "body"
    )


_GENERIC_MESSAGES = f"SELECT conv_id, msg_pos, {O.strip('body')} AS body FROM c_fx WHERE NOT {O.tool_call('body')}"


@register(_GENERIC_MESSAGES)
def generic_archive_messages(spark, sf_dir):
    content = F.col("body").alias("content")
    listed = fixtures.messages(spark, sf_dir).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("msg_pos", "role", content))).alias("m")
    )
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]\z", "")
    rows = listed.select(
        "conv_id",
        F.transform(
            "m",
            lambda x: F.struct(
                x["role"].alias("role"), quoted(x["content"]).alias("content"),
                F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("created_utc"),
                F.lit(None).cast("string").alias("created_at")
            )
        ).alias("messages")
    )
    return generic_messages(rows).select("conv_id", F.col("msg_pos").cast("long").alias("msg_pos"), "body")


# -- Text ----------------------------------------------------------------------------------------------------------

on_bodies("normalize_body", T.normalize_body, O.normalize("body"))
on_bodies("normalize_body_with_code", lambda c: T.normalize_body(c, True), O.normalize("body", True))
on_bodies("strip_artifacts", T.strip_artifact_lines, O.strip_artifacts("body"))
on_bodies("ascii_share", lambda c: F.round(T.ascii_ratio(c), 6), f"round({O.ascii_ratio('body')}, 6)")
on_bodies("clean_for_metrics", T.clean_for_metrics, O.strip(O.strip_artifacts(O.normalize("body"))))
on_bodies("truncate_text", T.truncate_text, O.truncate("body"))
on_bodies("strip_list_prefix", T.strip_list_prefix, r"regexp_replace(body, '^\s*(?:[-*•]|\d+[.、])\s*', '')")
on_bodies("strip_citations", T.strip_citations, f"regexp_replace(body, '{fixtures.OPEN}.*?{fixtures.CLOSE}', '', 'g')")


@register("SELECT conv_id, text FROM c_texts WHERE text IS NOT NULL")
def extract_text(spark, sf_dir):
    return M.extract_text(fixtures.messages(spark, sf_dir))


@register(f"SELECT conv_id, {O.strip('substr(text, 1, 240)')} AS snippet FROM c_texts WHERE text IS NOT NULL")
def snippets(spark, sf_dir):
    return M.extract_text(fixtures.messages(spark, sf_dir)).select("conv_id", T.snippet(F.col("text")).alias("snippet"))


@register("SELECT conv_id, search_text FROM c_search")
def search_text(spark, sf_dir):
    return fixtures.convs(spark, sf_dir).select("conv_id").join(
        M.search_text(fixtures.messages(spark, sf_dir)), "conv_id", "left"
    ).withColumn("search_text", F.coalesce("search_text", F.lit("")))


_PIECES = "SELECT conv_id, msg_pos, unnest(p) AS piece, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS seg_pos FROM (SELECT conv_id, msg_pos, string_split(body, repeat(chr(96), 3)) AS p FROM c_fx)"
_SHOWN = f"CASE WHEN {O.braced('l')} AND json_valid(l) THEN {O.transcript('l')} WHEN contains(l, 'sediment://') THEN NULL ELSE {O.strip(f'''regexp_replace(l, '{fixtures.OPEN}.*?{fixtures.CLOSE}', '', 'g')''')} END"


@register(f"""SELECT * FROM (SELECT conv_id, msg_pos, seg_pos, CASE WHEN seg_pos % 2 = 1 THEN 'code' ELSE 'text' END AS type, CASE WHEN seg_pos % 2 = 1 THEN trim(string_split(piece, chr(10))[1]) END AS lang,
  CASE WHEN seg_pos % 2 = 1 THEN trim(regexp_replace(piece, '^[^\\n]*\\n?', ''), chr(10) || ' ') ELSE array_to_string(list_filter(list_transform({O.stripped_lines('piece')}, lambda l: {_SHOWN}), lambda l: l IS NOT NULL AND l <> ''), chr(10)) END AS text FROM ({_PIECES})) WHERE text <> ''""")
def segments(spark, sf_dir):
    return M.segments(fixtures.messages(spark, sf_dir))


# -- Terms ---------------------------------------------------------------------------------------------------------

@register("SELECT conv_id, text FROM c_docs")
def term_text(spark, sf_dir):
    return insights(spark, sf_dir).docs.select("conv_id", "text")


@register("SELECT conv_id, CAST(pos AS INTEGER) AS pos, tok AS term FROM c_latin")
def latin_tokens(spark, sf_dir):
    return insights(spark, sf_dir).docs.select(
        "conv_id", F.posexplode(K.latin_tokens(F.col("text"))).alias("pos", "term")
    )


@register("SELECT conv_id, CAST(run_no AS INTEGER) AS run_no, run FROM c_runs")
def han_runs(spark, sf_dir):
    return insights(spark, sf_dir).docs.select(
        "conv_id", F.posexplode(K.han_runs(F.col("text"))).alias("run_no", "run")
    )


@register(
    "SELECT term, count(*) AS runs FROM (SELECT substr(run, i, n) AS term FROM c_runs, (VALUES (2), (3), (4)) AS "
        "l(n), unnest(range(1, length(run) + 1)) AS p(i) WHERE i + n - 1 <= length(run)) GROUP BY term"
)
def han_ngrams(spark, sf_dir):
    runs = insights(spark, sf_dir).docs.select(F.explode(K.han_runs(F.col("text"))).alias("run"))
    return runs.select(
        F.explode(K.han_ngrams(F.col("run"))).alias("term")
    ).groupBy("term").agg(F.count("*").alias("runs"))


@register("SELECT term FROM c_vocab")
def han_vocab(spark, sf_dir):
    return insights(spark, sf_dir).vocab


@register(
    "SELECT conv_id, CAST(run_no AS INTEGER) AS run_no, CAST(i - length(term) AS INTEGER) AS pos, term FROM c_seg "
        "WHERE term IS NOT NULL"
)
def segment_han(spark, sf_dir):
    job = insights(spark, sf_dir)
    runs = job.docs.select(
        "conv_id", F.posexplode(K.han_runs(F.col("text"))).alias("run_no", "run")
    ).where(~F.col("run").isin(ZH_STOPWORDS))
    return K.segment_han(runs, job.vocab, ["conv_id", "run_no"])


@register("SELECT conv_id, pos, term FROM c_tokens")
def normalize_terms(spark, sf_dir):
    return insights(spark, sf_dir).tokens.select("conv_id", "pos", "term")


@register(f"SELECT DISTINCT tok AS term, {O.noise_term('tok')} AS noise, {O.chinese('tok')} AS chinese FROM c_raw")
def term_kinds(spark, sf_dir):
    job = insights(spark, sf_dir)
    latin = job.docs.select(F.explode(K.latin_tokens(F.col("text"))).alias("term"))
    runs = job.docs.select(
        "conv_id", F.posexplode(K.han_runs(F.col("text"))).alias("run_no", "run")
    ).where(~F.col("run").isin(ZH_STOPWORDS))
    found = latin.union(K.segment_han(runs, job.vocab, ["conv_id", "run_no"]).select("term")).distinct()
    return found.select(
        "term", K.is_noise_term(F.col("term")).alias("noise"), K.is_chinese_term(F.col("term")).alias("chinese")
    )


@register("SELECT conv_id, term, tf, first_pos FROM c_tf")
def term_counts(spark, sf_dir):
    return insights(spark, sf_dir).tf.select("conv_id", "term", "tf", "first_pos")


@register("SELECT term, df, first_index, first_pos FROM c_df")
def doc_freq(spark, sf_dir):
    return insights(spark, sf_dir).df


@register(f"SELECT term, round(ln(CAST({O.N} + 1 AS DOUBLE) / (df + 1)) + 1, 6) AS idf FROM c_df")
def idf(spark, sf_dir):
    job = insights(spark, sf_dir)
    return job.df.select("term", F.round(K.idf(F.col("df"), job.n), 6).alias("idf"))


@register("SELECT term, df FROM c_good")
def good_keywords(spark, sf_dir):
    job = insights(spark, sf_dir)
    return job.df.where(K.is_good_keyword(F.col("term"), F.col("df"), job.n)).select("term", "df")


@register("SELECT conv_id, rank, term, tf, df, round(weight, 6) AS weight FROM c_kw")
def tfidf_keywords(spark, sf_dir):
    return rounded(insights(spark, sf_dir).keywords, "weight")


@register("SELECT conv_id, cluster_label FROM c_topics")
def topic_label(spark, sf_dir):
    return insights(spark, sf_dir).topics


@register("SELECT rank, term, count FROM c_hot")
def hot_terms(spark, sf_dir):
    return insights(spark, sf_dir).hot


@register(
    f"""SELECT CAST(row_number() OVER (ORDER BY n, NOT han) AS INTEGER) AS rank, term, df AS count FROM (SELECT *, {O.chinese('term')} AS han, row_number() OVER (PARTITION BY {O.chinese('term')} ORDER BY {O.BEST}) AS n FROM c_df) QUALIFY rank <= 40"""
)
def mix_keywords(spark, sf_dir):
    return K.mix_keywords(insights(spark, sf_dir).df)


# -- Highlights and interaction ------------------------------------------------------------------------------------

@register("SELECT conv_id, msg_pos, line, score FROM c_scored WHERE score > 0")
def highlight_lines(spark, sf_dir):
    return H.highlight_lines(fixtures.messages(spark, sf_dir)).select("conv_id", "msg_pos", "line", "score")


@register("SELECT conv_id, rank, line, score FROM c_high")
def highlights(spark, sf_dir):
    return H.highlights(fixtures.messages(spark, sf_dir))


@register("SELECT conv_id, msg_pos, role, text FROM c_feat")
def cleaned_turns(spark, sf_dir):
    return I.cleaned_turns(fixtures.messages(spark, sf_dir)).select("conv_id", "msg_pos", "role", "text")


@register('SELECT conv_id, msg_pos, char_len, clarity, "constraint", context, feedback, vague FROM c_user')
def user_features(spark, sf_dir):
    turns = I.cleaned_turns(fixtures.messages(spark, sf_dir)).where("role = 'user'")
    return I.user_message_features(turns).select(
        "conv_id", "msg_pos", F.col("char_len").cast("long").alias("char_len"), *I.BUCKETS
    )


@register("SELECT conv_id, msg_pos, clarify, boundary FROM c_bot")
def assistant_flags(spark, sf_dir):
    turns = I.cleaned_turns(fixtures.messages(spark, sf_dir)).where("role = 'assistant'")
    return I.assistant_flags(turns).select("conv_id", "msg_pos", "clarify", "boundary")


_RATES = [f"{n}_rate" for n in I.BUCKETS[:4]]


@register(
    f"SELECT conv_id, user_messages, assistant_messages, {', '.join(f'round({r}, 6) AS {r}' for r in _RATES)}, "
        f"iteration, round(score, 6) AS score FROM c_scores"
)
def conversation_scores(spark, sf_dir):
    return rounded(report(spark, sf_dir).scores.drop("index"), *_RATES, "score")


@register("SELECT * FROM c_totals")
def interaction_totals(spark, sf_dir):
    return I.interaction_totals(report(spark, sf_dir).features)


_SUMMARY = ["avg_user_len", "avg_turns", *I.RATES]


@register(
    f"SELECT conversations, user_messages, assistant_messages, {', '.join(f'round({r}, 6) AS {r}' for r in _SUMMARY)} "
        f"FROM c_summary"
)
def interaction_summary(spark, sf_dir):
    return rounded(report(spark, sf_dir).summary, *_SUMMARY)


@register(
    f"SELECT CAST(row_number() OVER (ORDER BY round(value, 3) DESC, place) AS INTEGER) AS rank, label, round(value, "
        f"6) AS value FROM c_rates JOIN (VALUES {O.rows([(k, *r) for k, r in enumerate(STRENGTHS)])}) AS s(place, "
        f"label, metric, threshold) USING (metric) WHERE value >= threshold QUALIFY rank <= 3"
)
def strengths(spark, sf_dir):
    return rounded(I.strengths(report(spark, sf_dir).summary), "value")


@register(
    f"SELECT CAST(row_number() OVER (ORDER BY round(abs(value - threshold), 3) DESC, place) AS INTEGER) AS rank, "
        f"label, round(value, 6) AS value, round(abs(value - threshold), 6) AS delta FROM c_rates JOIN (VALUES "
        f"{O.rows([(k, *r) for k, r in enumerate(GAPS)])}) AS s(place, label, metric, threshold, reverse) USING "
        f"(metric) WHERE (reverse AND value >= threshold) OR (NOT reverse AND value < threshold) QUALIFY rank <= 3"
)
def gaps(spark, sf_dir):
    return rounded(I.gaps(report(spark, sf_dir).summary), "value", "delta")


@register("SELECT bucket, rank, text, score, conv_id + 1 AS conversation, msg_pos FROM c_buckets")
def quote_buckets(spark, sf_dir):
    found = I.quote_buckets(report(spark, sf_dir).features)
    return found.select(
        "bucket", "rank", "text", F.col("score").cast("long").alias("score"), F.col("index").alias("conversation"),
        "msg_pos"
    )


def _greedy() -> str:
    """The quotes of the report: each bucket's best that no bucket before has used."""
    picks, parts = [], []
    for k, (bucket, label) in enumerate(QUOTE_LABELS):
        used = f" AND conv_id NOT IN ({' UNION ALL '.join(f'SELECT conv_id FROM q{j}' for j in range(k))})" if k else ""
        picks.append(
            f"q{k} AS (SELECT {k} AS place, '{label}' AS label, text, conv_id FROM c_buckets WHERE bucket = "
                f"'{bucket}'{used} ORDER BY rank LIMIT 1)"
        )
        parts.append(f"SELECT * FROM q{k}")
    return f"SELECT place, label, text, conv_id + 1 AS conversation FROM (WITH {', '.join(picks)} {' UNION ALL '.join(parts)})"


@register(_greedy())
def report_quotes(spark, sf_dir):
    return report(spark, sf_dir).quotes.withColumnRenamed("index", "conversation")


@register(
    f"SELECT CAST(row_number() OVER (ORDER BY length(text) DESC, short, conv_id, msg_pos) AS INTEGER) AS rank, short "
        f"AS text, conv_id + 1 AS conversation FROM (SELECT *, {O.truncate('text')} AS short FROM c_bot WHERE "
        f"boundary) QUALIFY rank <= 4"
)
def boundary_quotes(spark, sf_dir):
    return I.boundary_quotes(report(spark, sf_dir).features).select(
        "rank", "text", F.col("index").alias("conversation")
    )


_TREND = """SELECT label, avg(score) FILTER (n <= c // 2) AS early, avg(score) FILTER (n > c // 2) AS recent, max(c) AS count FROM (
  SELECT cluster_label AS label, score, row_number() OVER (PARTITION BY cluster_label ORDER BY created, k.conv_id) AS n, count(*) OVER (PARTITION BY cluster_label) AS c
  FROM c_convs k JOIN c_topics t ON k.conv_id = t.conv_id JOIN c_scores s ON k.conv_id = s.conv_id WHERE created IS NOT NULL) WHERE c >= 6 GROUP BY label"""


@register(f"""SELECT trend, CAST(row_number() OVER (PARTITION BY trend ORDER BY abs(round(recent - early, 3)) DESC, count DESC, label) AS INTEGER) AS rank, label, round(recent - early, 6) AS delta, round(early, 6) AS early, round(recent, 6) AS recent, count
  FROM (SELECT *, CASE WHEN recent - early >= 0.05 THEN 'improving' WHEN recent - early <= -0.05 THEN 'needs_work' END AS trend FROM ({_TREND})) WHERE trend IS NOT NULL QUALIFY rank <= 4""")
def topic_trends(spark, sf_dir):
    job = report(spark, sf_dir, items=True)
    return rounded(I.topic_trends(job.items, job.scores), "delta", "early", "recent")


# -- Roll-ups ------------------------------------------------------------------------------------------------------

_MONTHS = "SELECT strftime(created, '%Y-%m') AS month, count(*) AS count FROM c_convs WHERE created IS NOT NULL GROUP BY ALL"


@register(_MONTHS)
def month_counts(spark, sf_dir):
    return rollups.month_counts(fixtures.convs(spark, sf_dir))


@register("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY ALL")
def order_month_counts(spark, sf_dir):
    return rollups.month_counts(
        spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("created"))
    )


@register(f"SELECT month, count, round(count / max(count) OVER (), 6) AS share FROM ({_MONTHS})")
def month_profile(spark, sf_dir):
    return rounded(rollups.month_profile(rollups.month_counts(fixtures.convs(spark, sf_dir))), "share")


@register("SELECT rank, label, count FROM c_topcounts")
def topic_counts(spark, sf_dir):
    job = insights(spark, sf_dir)
    return rollups.topic_counts(job.convs.join(job.topics, "conv_id"))


@register(
    "SELECT count(*) AS total, strftime(min(created), '%Y-%m-%d') AS first_day, strftime(max(created), '%Y-%m-%d') AS "
        "last_day, (SELECT count(*) FROM c_stars) AS starred FROM c_convs"
)
def corpus_metrics(spark, sf_dir):
    return rollups.corpus_metrics(fixtures.convs(spark, sf_dir), fixtures.annotations(spark, sf_dir))


@register(
    "SELECT 'keyword' AS kind, rank, term AS value, count FROM c_hot WHERE rank <= 18 UNION ALL SELECT 'topic', rank, "
        "label, count FROM c_topcounts WHERE rank <= 12"
)
def facets(spark, sf_dir):
    job = insights(spark, sf_dir)
    return rollups.facets(job.hot, rollups.topic_counts(job.convs.join(job.topics, "conv_id")))


# -- Retrieval -----------------------------------------------------------------------------------------------------

_FOUND = "contains(lower(title), '{0}') OR contains(lower(array_to_string(keywords, ' ')), '{0}') OR contains(lower(snippet), '{0}') OR contains(search_text, '{0}')"
_HAY = "(SELECT i.*, search_text FROM c_items i LEFT JOIN c_search s ON i.conv_id = s.conv_id)"


@register(f"SELECT conv_id FROM {_HAY} WHERE ({_FOUND.format('summary')}) AND ({_FOUND.format('risk')})")
def search_terms(spark, sf_dir):
    job = insights(spark, sf_dir)
    return R.search(job.items, job.search, "summary RISK").select("conv_id")


@register(
    f"SELECT 1 AS query_id, file FROM {_HAY} WHERE ({_FOUND.format('python')}) UNION ALL SELECT 2, file FROM {_HAY} "
        f"WHERE ({_FOUND.format('chat')}) AND ({_FOUND.format('投资组合')})"
)
def search_many(spark, sf_dir):
    job = insights(spark, sf_dir)
    return R.search_many(
        job.items, job.search, spark.createDataFrame([(1, "Python"), (2, "chat 投资组合")], "query_id int, query string")
    )


@register("SELECT conv_id, messages FROM c_convs WHERE messages >= 6")
def filter_min_messages(spark, sf_dir):
    return R.by_min_messages(fixtures.convs(spark, sf_dir), 6).select("conv_id", "messages")


@register("SELECT conv_id FROM c_convs WHERE conv_id % 5 = 0")
def filter_starred(spark, sf_dir):
    return R.by_starred(fixtures.convs(spark, sf_dir), fixtures.annotations(spark, sf_dir)).select("conv_id")


@register("SELECT conv_id FROM c_items WHERE list_contains(keywords, '预算') OR list_contains(keywords, 'Python')")
def filter_keyword(spark, sf_dir):
    items = insights(spark, sf_dir).items
    return R.by_keyword(items, "预算").union(R.by_keyword(items, "Python")).select("conv_id").distinct()


@register("SELECT conv_id FROM c_topics WHERE cluster_label = '投资理财'")
def filter_topic(spark, sf_dir):
    job = insights(spark, sf_dir)
    return R.by_topic(job.topics, "投资理财").select("conv_id")


@register(
    "SELECT conv_id, 'day' AS kind FROM c_convs WHERE created >= timestamp '2024-01-03' AND created <= timestamp "
        "'2024-01-12' UNION ALL SELECT conv_id, 'whole' FROM c_convs WHERE created < timestamp '2024-01-13'"
)
def filter_dates(spark, sf_dir):
    rows = fixtures.convs(spark, sf_dir)
    both = R.by_date_range(rows, "2024-01-03", "2024-01-12").select("conv_id", F.lit("day").alias("kind"))
    return both.union(R.by_date_range(rows, end="2024-01-12", whole_end_day=True).select("conv_id", F.lit("whole")))


@register(
    f"SELECT conv_id FROM {_HAY} WHERE ({_FOUND.format('how')}) AND messages >= 4 AND conv_id % 5 = 0 AND created >= "
        f"timestamp '2024-01-02'"
)
def filter_all(spark, sf_dir):
    job = insights(spark, sf_dir)
    return R.filter_items(
        job.items, job.search, "how", 4, fixtures.annotations(spark, sf_dir), start="2024-01-02"
    ).select("conv_id")


_ORDERS = {"updated": "updated DESC NULLS LAST", "created": "created ASC NULLS LAST", "messages": "messages DESC"}


_PLACED = "SELECT '{0}' AS kind, row_number() OVER (ORDER BY {1}, conv_id) AS place, conv_id FROM c_convs"


@register(" UNION ALL ".join(_PLACED.format(k, v) for k, v in _ORDERS.items()))
def sort_items(spark, sf_dir):
    """The place of every item in each order."""
    rows = fixtures.convs(spark, sf_dir)
    placed = [R.item_places(rows, kind).select(F.lit(kind).alias("kind"), "place", "conv_id") for kind in _ORDERS]
    return placed[0].union(placed[1]).union(placed[2])


@register("""SELECT conv_id, other, round(score, 6) AS score, rank FROM (SELECT a.conv_id, b.conv_id AS other, len(list_intersect(a.keywords, b.keywords)) / CAST(len(a.keywords) + len(b.keywords) - len(list_intersect(a.keywords, b.keywords)) AS DOUBLE) AS score,
  CAST(row_number() OVER (PARTITION BY a.conv_id ORDER BY len(list_intersect(a.keywords, b.keywords)) / CAST(len(a.keywords) + len(b.keywords) - len(list_intersect(a.keywords, b.keywords)) AS DOUBLE) DESC, b.conv_id) AS INTEGER) AS rank
  FROM c_items a JOIN c_items b ON a.conv_id <> b.conv_id WHERE len(list_intersect(a.keywords, b.keywords)) > 0) WHERE rank <= 5""")
def similar_items(spark, sf_dir):
    job = insights(spark, sf_dir)
    listed = job.keywords.groupBy("conv_id").agg(
        F.collect_list("term").alias("keywords")
    )  # no more of the items is needed
    return rounded(R.similar(job.convs.select("conv_id", "index").join(listed, "conv_id")), "score")


@register(
    "SELECT conv_id, coalesce(starred, false) AS starred, note FROM c_convs c LEFT JOIN c_stars s ON c.file = s.file"
)
def attach_notes(spark, sf_dir):
    return R.attach_notes(
        fixtures.convs(spark, sf_dir), fixtures.annotations(spark, sf_dir)
    ).select("conv_id", "starred", "note")


@register("SELECT conv_id, title FROM c_convs ORDER BY md5('3|' || file), file LIMIT 1")
def random_item(spark, sf_dir):
    return R.random_item(
        fixtures.convs(spark, sf_dir).select("conv_id", "title", "file"), seed=3
    ).select("conv_id", "title")


# -- Sinks ---------------------------------------------------------------------------------------------------------

@register("SELECT CAST((idx - 1) // 30 AS INTEGER) AS shard, file, title, search_text FROM c_search")
def search_shards(spark, sf_dir):
    return A.with_shard(insights(spark, sf_dir).search, 30).select("shard", "file", "title", "search_text")


@register("SELECT CAST((idx - 1) // 30 AS INTEGER) AS shard, count(*) AS count, true AS there FROM c_search GROUP BY ALL")
def search_manifest(spark, sf_dir):
    """The manifest of written shards, and whether the file that each row names is there with so many items."""
    path = new_folder(spark, "shards")
    A.write_search_shards(insights(spark, sf_dir).search, path, 30)
    files = spark.read.schema("items array<struct<file:string>>").json(f"{path}/shards")
    files = files.select(F.col("_metadata.file_name").alias("file"), F.size("items").cast("long").alias("count"), F.lit(True).alias("there"))
    named = A.search_manifest(spark, path).join(files, ["file", "count"], "left")
    return named.select("shard", "count", F.coalesce("there", F.lit(False)).alias("there"))


@register(
    f"SELECT conv_id, '| ' || idx || ' | ' || title || ' | ' || {WHEN.format('created')} || ' | ' || "
        f"{WHEN.format('updated')} || ' | ' || messages || ' | ' || file || ' |' AS line FROM c_convs"
)
def index_rows(spark, sf_dir):
    return A.index_markdown_rows(fixtures.convs(spark, sf_dir)).select((F.col("index") - 1).alias("conv_id"), "line")


_BLOCK = f"'<!-- MSG role: ' || role || ' -->' || chr(10) || '### ' || role || chr(10) || chr(10) || {O.strip('body')} || chr(10) || chr(10) || '<!-- /MSG -->' || chr(10)"
_DOC = f"""SELECT c.conv_id, '# ' || title || chr(10) || chr(10) || '- id: ' || id || chr(10) || '- created_utc: ' || {WHEN.format('created')} || chr(10) || '- updated_utc: ' || {WHEN.format('updated')} || chr(10) || '- messages: ' || messages || chr(10) || chr(10) || '---' || chr(10) || chr(10) || coalesce(b, '') AS markdown
  FROM c_convs c LEFT JOIN (SELECT conv_id, string_agg({_BLOCK}, chr(10) ORDER BY msg_pos) AS b FROM c_fx GROUP BY conv_id) m ON c.conv_id = m.conv_id"""


def _documents(spark, sf_dir):
    rows = fixtures.messages(spark, sf_dir).withColumn("role_label", F.col("role"))
    return A.to_markdown(rows, fixtures.convs(spark, sf_dir))


@register(_DOC)
def markdown_docs(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        F.regexp_extract("file", r"_(\d+)\.md$", 1).cast("long").alias("conv_id"), "markdown"
    )


@register(
    f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY msg_pos) - 1 AS INTEGER) AS msg_pos, role "
        f"AS role_label, {O.strip('body')} AS body FROM c_fx"
)
def markdown_parse(spark, sf_dir):
    return A.parse_markdown(_documents(spark, sf_dir)).select(
        F.regexp_extract("file", r"_(\d+)\.md$", 1).cast("long").alias("conv_id"), "msg_pos", "role_label", "body"
    )


@register(
    f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY msg_pos) - 1 AS INTEGER) AS msg_pos, role "
        f"AS role_label, {O.strip('body')} AS body FROM c_fx"
)
def markdown_files(spark, sf_dir):
    """A folder of markdown files, one by conversation, read as an archive."""
    path = new_folder(spark, "markdown")
    A.write_markdown_files(_documents(spark, sf_dir), path)
    return A.read_markdown_archive(spark, path, "part-*").select(
        F.regexp_extract("file", r"_(\d+)\.md$", 1).cast("long").alias("conv_id"), "msg_pos", "role_label", "body"
    )


@register("SELECT conv_id, messages, file FROM c_convs")
def archive_index(spark, sf_dir):
    bare = fixtures.convs(spark, sf_dir).drop("messages", "file")
    return build_archive(bare, fixtures.messages(spark, sf_dir)).select("conv_id", "messages", "file")


# -- Files: written to the shared folder, and read back ------------------------------------------------------------

def _arrays(spark, sf_dir) -> DataFrame:
    """part, value: trees as JSON arrays of the conversations of 50 ids each, by id."""
    rows = fixtures.trees(spark, sf_dir).select(F.col("conv_id").cast("string").alias("id"), "current_node", "mapping")
    node = lambda n: n.withField("message", n["message"].withField("content", F.from_json(n["message"]["content"], "content_type string, parts array<string>")))
    rows = rows.withColumn("mapping", F.transform_values("mapping", lambda _, n: node(n)))
    item = F.struct(F.col("id").cast("long").alias("conv_id"), F.to_json(F.struct(*rows.columns)).alias("json"))
    listed = rows.groupBy(F.floor(F.col("id").cast("long") / 50).alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return listed.select("part", F.concat(F.lit("["), F.array_join("items.json", ","), F.lit("]")).alias("value"))


def _tree_files(spark, arrays: DataFrame) -> DataFrame:
    path = new_folder(spark, "trees")
    arrays.write.partitionBy("part").text(path)
    read = M.normalize_conversation_fields(X.read_tree_export(spark, path)).withColumn("conv_id", F.col("id").cast("long"))
    return tree_messages(read).select("conv_id", F.col("msg_pos").cast("long").alias("msg_pos"), "body")


@register(_TREE_MESSAGES)
def tree_export_files(spark, sf_dir):
    """Trees as files of JSON arrays, 50 conversations each, read as an export."""
    return _tree_files(spark, _arrays(spark, sf_dir))


@register(f"SELECT * FROM ({_TREE_MESSAGES}) WHERE conv_id NOT IN (SELECT max(conv_id) FROM conversations GROUP BY conv_id // 50)")
def cut_export_files(spark, sf_dir):
    """The same files, each broken off 40 characters before its end: within its last conversation."""
    return _tree_files(spark, _arrays(spark, sf_dir).withColumn("value", F.expr("substring(value, 1, length(value) - 40)")))


def _flat(spark, sf_dir) -> DataFrame:
    said = F.struct("msg_pos", "role", F.col("body").alias("content"))
    listed = fixtures.messages(spark, sf_dir).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(said)).alias("messages")
    )
    return listed.select(F.col("conv_id").cast("string").alias("id"), "messages")


def _flat_messages(read: DataFrame) -> DataFrame:
    read = read.withColumn("conv_id", F.col("id").cast("long"))
    return generic_messages(read).select("conv_id", F.col("msg_pos").cast("long").alias("msg_pos"), "body")


@register(_GENERIC_MESSAGES)
def generic_export_files(spark, sf_dir):
    """Conversations as JSON lines, read as an export."""
    path = new_folder(spark, "generic")
    _flat(spark, sf_dir).write.json(path)
    return _flat_messages(X.read_generic_export(spark, path, json_lines=True))


@register(_GENERIC_MESSAGES)
def mixed_export_files(spark, sf_dir):
    """A folder with JSON lines, lists and objects that wrap a list, a third of the conversations each."""
    path = new_folder(spark, "mixed")
    rows, third = _flat(spark, sf_dir), F.col("id").cast("long") % 3
    rows.where(third == 0).coalesce(2).write.json(f"{path}/lines")
    lists = rows.where(third > 0).groupBy(third.alias("form"), F.floor(F.col("id").cast("long") / 60).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("list")
    )
    value = F.when(F.col("form") == 1, F.col("list")).otherwise(F.concat(F.lit('{"conversations": '), "list", F.lit("}")))
    lists.select("part", "form", value.alias("value")).write.partitionBy("part", "form").text(f"{path}/lists")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lines")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):  # two files
        name = status.getPath().getName()
        files.rename(status.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.replace(".json", ".jsonl")))
    return _flat_messages(X.read_generic_export(spark, path))


_SIZES = "SELECT conv_id % 7 AS part, CAST(sum(strlen(text) + 1) AS BIGINT) AS size FROM conversations GROUP BY ALL"


@register(
    f"SELECT 'all' AS kind, part, size FROM ({_SIZES}) UNION ALL (SELECT 'largest', part, size FROM ({_SIZES}) ORDER "
        f"BY size DESC, part LIMIT 1)"
)
def export_files(spark, sf_dir):
    """Files of known sizes, and the largest of them."""
    path = new_folder(spark, "sized")
    rows = fixtures.raw(spark, sf_dir).select(F.col("text").alias("value"), (F.col("conv_id") % 7).alias("part"))
    rows.repartition("part").write.partitionBy("part").text(path)
    kinds = [
        X.select_export_files(spark, path, pattern="part-*", largest_only=only).withColumn("kind", F.lit(kind))
        for kind, only in (("all", False), ("largest", True))
    ]
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part")
    return kinds[0].union(kinds[1]).select("kind", part, "size")


@register(
    f"SELECT CAST(idx AS INTEGER) AS number, title, {WHEN.format('created')} AS created_utc, {WHEN.format('updated')} "
        f"AS updated_utc, CAST(messages AS INTEGER) AS messages, file, id FROM c_convs"
)
def index_csv_files(spark, sf_dir):
    path = new_folder(spark, "index")
    A.write_index_csv(fixtures.convs(spark, sf_dir), path)
    return A.read_index_csv(spark, path).withColumnRenamed("index", "number")


@register(
    "SELECT conv_id, title, snippet, cluster_label, array_to_string(keywords, '|') AS keywords, (SELECT count(*) FROM "
        "c_convs) AS total FROM c_items"
)
def items_files(spark, sf_dir):
    """Items as JSON lines, with the one row of insights beside them."""
    path, job = new_folder(spark, "items"), insights(spark, sf_dir)
    A.write_items(job.items, job.report(), path)
    schema = "conv_id long, title string, snippet string, cluster_label string, keywords array<string>"
    total = spark.read.schema("total long").json(f"{path}/insights")
    items = spark.read.schema(schema).json(f"{path}/items").withColumn("keywords", F.array_join("keywords", "|"))
    return items.crossJoin(F.broadcast(total))  # one row


@register("SELECT file, title, search_text FROM c_search")
def search_shard_files(spark, sf_dir):
    path = new_folder(spark, "shards")
    A.write_search_shards(insights(spark, sf_dir).search, path, 30)
    return A.read_search_shards(spark, path)


_REPORT = """SELECT 'summary' AS part, NULL AS label, round(avg_turns, 6) AS value FROM c_summary
  UNION ALL SELECT 'quotes', label, CAST(conversation AS DOUBLE) FROM ({quotes})"""


@register(_REPORT.format(quotes=_greedy()))
def report_files(spark, sf_dir):
    """The interaction report as one JSON document: its summary's turns, and whose quotes it has."""
    path = new_folder(spark, "report")
    A.write_report(report(spark, sf_dir).parts(), path)
    schema = "summary array<struct<avg_turns:double>>, quotes array<struct<label:string,index:long>>"
    read = spark.read.schema(schema).json(path)
    turns = read.select(F.explode("summary").alias("s")).select(
        F.lit("summary").alias("part"), F.lit(None).cast("string").alias("label"),
        F.round("s.avg_turns", 6).alias("value")
    )
    quotes = read.select(F.explode("quotes").alias("q")).select(
        F.lit("quotes"), "q.label", F.col("q.index").cast("double")
    )
    return turns.union(quotes)
