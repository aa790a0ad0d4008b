"""DuckDB forms of the rules, as expressions and common table expressions that oracles are put together from."""

from __future__ import annotations

import re

from talkloom.functions import lexicon as L
from talkloom.operators.terms import HAN_PLACE, RUN_PLACE
from talkloom.plans.fixtures import BODY, CLOSE, OPEN

NL = "chr(10)"


def words(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def rows(values) -> str:
    return ", ".join(
        "(" + ", ".join(
            "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r
        ) + ")" for r in values
    )


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x{{3000}}]+|[\s\x{{3000}}]+$', '', 'g')"


def one_space(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[\s\x{{3000}}]+', ' ', 'g')")


def pieces(body: str) -> str:
    return rf"regexp_split_to_array({body}, '(?m)^[ \t]*```[^\n]*$')"


def outside_code(body: str) -> str:
    return f"array_to_string(list_filter({pieces(body)}, lambda p, i: i % 2 = 1), {NL})"


def stripped_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {NL}), lambda l: {strip('l')}), lambda l: l <> '')"


def prose(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '{OPEN}.*?{CLOSE}', '', 'g'), '^\s*(?:[-*•]|\d+[.、])\s*', '')")


def transcript(x: str) -> str:
    return f"CASE WHEN json_valid({x}) AND contains(coalesce(json_extract_string({x}, '$.content_type'), ''), 'transcription') THEN {strip(f'''json_extract_string({x}, '$.text')''')} END"


def braced(x: str) -> str:
    return f"(starts_with({x}, '{{') AND ends_with({x}, '}}'))"


def clean_line(x: str) -> str:
    return f"CASE WHEN {braced(x)} THEN {transcript(x)} WHEN contains({x}, 'sediment://') OR starts_with({x}, '[image]') THEN NULL ELSE {prose(x)} END"


def normalize(body: str, code: bool = False) -> str:
    text = f"array_to_string({pieces(body)}, {NL})" if code else outside_code(body)
    return f"array_to_string(list_filter(list_transform({stripped_lines(text)}, lambda l: {clean_line('l')}), lambda l: l IS NOT NULL AND l <> ''), {NL})"


def ascii_ratio(x: str) -> str:
    return rf"CASE WHEN length({x}) > 0 THEN length(regexp_replace({x}, '[^\x00-\x7F]', '', 'g')) / CAST(length({x}) AS DOUBLE) ELSE 1.0 END"


def artifact(x: str) -> str:
    noise = " OR ".join(f"contains(lower({x}), '{n}')" for n in L.BUILD_NOISE)
    files = rf"(regexp_matches({x}, '(?i){L.FILE_TOKEN.removeprefix("(?iU)")}') AND (regexp_matches({x}, '\+\d+') OR contains({x}, ':')))"
    return f"({noise} OR {files} OR (length({x}) >= 160 AND {ascii_ratio(x)} >= 0.85))"


def strip_artifacts(x: str) -> str:
    return f"array_to_string(list_filter({stripped_lines(x)}, lambda l: NOT {artifact('l')}), {NL})"


def truncate(x: str, limit: int = 180) -> str:
    return rf"CASE WHEN length({x}) <= {limit} THEN {x} ELSE regexp_replace(substr({x}, 1, {limit - 1}), '\s+$', '') || '…' END"


def tool_call(body: str) -> str:
    whole = strip(body)
    payload = rf"coalesce(nullif(regexp_extract({whole}, '^```(?:unknown)?\s*\n([\s\S]*)\n\s*```[^\n]*$', 1), ''), {whole})"
    return f"coalesce({braced(payload)} AND json_valid({payload}) AND len(list_intersect(json_keys(CASE WHEN json_valid({payload}) THEN {payload} ELSE '{{}}' END), {list(L.TOOL_KEYS)})) > 0, false)"


def noise_term(x: str) -> str:
    return rf"(lower({x}) IN {words(L.NOISE_TERMS)} OR regexp_matches(lower({x}), '^turn\d+(?:search|news|view|file|calc|code|media)\d+$') OR regexp_matches(lower({x}), '^[a-z]{{1,2}}\d{{1,4}}$') OR regexp_matches(lower({x}), '^[a-z]{{1,3}}\d{{3,}}$'))"


def chinese(x: str) -> str:
    return rf"regexp_matches({x}, '[\x{{4e00}}-\x{{9fff}}]')"


def good(x: str, df: str, n: str) -> str:
    short = words(L.SHORT_ALLOWED)
    listed = f"lower({x}) IN {words(L.KEYWORD_BLACKLIST)} OR {noise_term(x)} OR {x} IN {words(L.ZH_STOPWORDS)} OR lower({x}) IN {words(L.EN_STOPWORDS)}"
    code = rf"(regexp_matches({x}, '^[\x00-\x7F]*$') AND ((contains({x}, '_') AND length({x}) >= 6) OR regexp_matches({x}, '^[a-z].*[A-Z]') OR regexp_matches({x}, '(?:{'|'.join(L.IDENTIFIER_ENDINGS)})$')))"
    return f"NOT ({listed} OR {df} < 2 OR {df} > floor({n} * 0.6) OR (NOT {chinese(x)} AND length({x}) <= 2 AND lower({x}) NOT IN {short}) OR {code})"


def _drop(x: str) -> str:
    short = f"(NOT {chinese(x)} AND ((length({x}) <= 2 AND lower({x}) NOT IN {words(L.SHORT_ALLOWED)}) OR (regexp_matches({x}, '[0-9]') AND length({x}) <= 3)))"
    return f"({noise_term(x)} OR lower({x}) IN {words(L.EN_STOPWORDS)} OR {x} IN {words(L.ZH_STOPWORDS)} OR starts_with(lower({x}), 'http') OR regexp_matches({x}, '^[0-9]+$') OR {short})"


N = "(SELECT count(*) FROM c_convs)"
HAN_CLASS = r"[\x{4e00}-\x{9fff}]{2,}"
BEST = "df DESC, first_index, first_pos"


def _flags(c: str) -> str:
    question = f"(contains({c}, '?') OR contains({c}, '？'))"
    constraint = rf"(regexp_matches({c}, '(?i)(?:{L.CONSTRAINT_CUES})') OR regexp_matches({c}, '(?i)[0-9]+\s?(?:{L.UNITS})'))"
    context = f"(regexp_matches({c}, '(?:{L.CONTEXT_CUES})') OR char_len >= 35)"
    return rf"""({question} OR regexp_matches({c}, '(?i)(?:{L.REQUEST_CUES})') OR regexp_matches({c}, '^\s*(?:[-*•]|[0-9]+[\\.、)])') OR char_len >= 18 OR len(regexp_extract_all({c}, '[A-Za-z0-9'']+')) >= 6) AS clarity,
      ({constraint} OR (regexp_matches({c}, '[0-9]') AND char_len >= 12)) AS "constraint", {context} AS context,
      regexp_matches({c}, '(?:{L.FEEDBACK_CUES})') AS feedback, (char_len < 12 AND NOT {question} AND NOT {constraint} AND NOT {context}) AS vague"""


def _file(conv: str = "conv_id", created: str = "created") -> str:
    return f"'conversations/' || printf('%04d', {conv} + 1) || '_' || coalesce(strftime({created}, '%Y%m%d'), 'unknown') || '_chat-' || {conv} || '_' || {conv} || '.md'"


_CUES = {"boundary": L.BOUNDARY_CUES.replace("'", "''"), "clarify": L.CLARIFY_CUES}
CTES = {
    "c_fx": f"SELECT conv_id, turn AS msg_pos, role, {BODY} AS body FROM conversations",
    "c_base": "SELECT conv_id, count(*) AS messages, CASE WHEN conv_id % 11 <> 0 THEN timestamp '2024-01-01 00:00:00' "
        "+ to_hours(CAST(conv_id * 7 AS INTEGER)) END AS created, CASE WHEN conv_id % 11 <> 0 THEN timestamp "
        "'2024-01-01 00:00:00' + to_hours(CAST(conv_id * 7 + 5 AS INTEGER)) END AS updated FROM conversations GROUP "
        "BY conv_id",
    "c_convs": f"SELECT conv_id, conv_id + 1 AS idx, 'Chat ' || conv_id AS title, 'id-' || conv_id AS id, created, "
        f"updated, messages, {_file()} AS file FROM c_base",
    "c_norm": f"SELECT *, {normalize('body')} AS clean FROM c_fx",
    "c_texts": f"SELECT conv_id, string_agg(clean, {NL} ORDER BY msg_pos) FILTER (clean <> '') AS text FROM c_norm "
        f"GROUP BY conv_id",
    "c_docs": f"SELECT c.conv_id, idx, {strip_artifacts(f'title || {NL} || coalesce(text, chr(32))')} AS text FROM "
        f"c_convs c LEFT JOIN c_texts t ON c.conv_id = t.conv_id",
    "c_latin": "SELECT conv_id, idx, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT conv_id, "
        "idx, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+') AS t FROM c_docs)",
    "c_runs": f"SELECT conv_id, idx, unnest(t) AS run, generate_subscripts(t, 1) - 1 AS run_no FROM (SELECT conv_id, "
        f"idx, regexp_extract_all(text, '{HAN_CLASS}') AS t FROM c_docs)",
    "c_grams": "SELECT DISTINCT conv_id, substr(run, i, n) AS term FROM c_runs r, (VALUES (2), (3), (4)) AS l(n), "
        "unnest(range(1, length(run) + 1)) AS p(i) WHERE i + n - 1 <= length(run)",
    "c_vocab": f"SELECT term FROM c_grams WHERE term NOT IN {words(L.ZH_STOPWORDS)} AND replace(term, substr(term, 1, "
        f"1), '') <> '' GROUP BY term HAVING count(*) >= CASE WHEN {N} < 80 THEN 2 ELSE 3 END AND count(*) <= "
        f"floor({N} * 0.35) UNION SELECT unnest({list(L.DOMAIN_TERMS)})",
    "c_words": f"SELECT term FROM c_vocab WHERE term NOT IN {words(L.ZH_STOPWORDS)}",
    "c_seg(conv_id, idx, run_no, run, i, term)": f"""SELECT conv_id, idx, run_no, run, 1, CAST(NULL AS VARCHAR) FROM c_runs WHERE run NOT IN {words(L.ZH_STOPWORDS)}
      UNION ALL SELECT conv_id, idx, run_no, run, i + coalesce(length(w4.term), length(w3.term), length(w2.term), 1), coalesce(w4.term, w3.term, w2.term) FROM c_seg
      LEFT JOIN c_words w4 ON w4.term = substr(run, i, 4) AND length(w4.term) = 4 LEFT JOIN c_words w3 ON w3.term = substr(run, i, 3) AND length(w3.term) = 3 LEFT JOIN c_words w2 ON w2.term = substr(run, i, 2) AND length(w2.term) = 2 WHERE i <= length(run)""",
    "c_raw": f"SELECT conv_id, idx, pos, tok FROM c_latin UNION ALL SELECT conv_id, idx, {HAN_PLACE} + run_no * "
        f"{RUN_PLACE} + i - length(term), term FROM c_seg WHERE term IS NOT NULL",
    "c_alias": f"SELECT * FROM (VALUES {rows(L.TERM_ALIASES.items())}) AS a(k, shown)",
    "c_tokens": f"SELECT * FROM (SELECT conv_id, idx, pos, coalesce(shown, tok) AS term FROM c_raw LEFT JOIN c_alias "
        f"ON lower(tok) = k) WHERE NOT {_drop('term')}",
    "c_tf": "SELECT conv_id, idx, term, count(*) AS tf, min(pos) AS first_pos FROM c_tokens GROUP BY ALL",
    "c_df": "SELECT term, count(*) AS df, min(idx) AS first_index, arg_min(first_pos, idx) AS first_pos FROM c_tf "
        "GROUP BY term",
    "c_good": f"SELECT * FROM c_df WHERE {good('term', 'df', N)}",
    "c_weights": f"SELECT conv_id, tf.term, tf, df, (1 + ln(tf)) * (ln(CAST({N} + 1 AS DOUBLE) / (df + 1)) + 1) AS "
        f"weight FROM c_tf tf JOIN c_good g ON tf.term = g.term",
    "c_kw": "SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY weight DESC, tf DESC, term) AS INTEGER) "
        "AS rank FROM c_weights QUALIFY rank <= 8",
    "c_rules": f"SELECT * FROM (VALUES "
        f"{rows([(t.lower(), label, k) for k, (label, ts) in enumerate(L.TOPIC_RULES) for t in ts])}) AS r(low, "
        f"label, place)",
    "c_ruled": "SELECT conv_id, label, hits FROM (SELECT conv_id, label, place, sum(tf) AS hits FROM c_tf JOIN "
        "c_rules ON lower(term) = low GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY hits "
        "DESC, place) = 1",
    "c_shared": f"SELECT conv_id, arg_min(term, rank) AS term FROM c_kw WHERE df >= CASE WHEN {N} < 100 THEN 3 ELSE "
        f"greatest(8, floor({N} * 0.005)) END AND lower(term) NOT IN {words(L.KEYWORD_BLACKLIST)} GROUP BY conv_id",
    "c_topics": f"SELECT c.conv_id, coalesce(CASE WHEN hits >= 2 THEN label END, s.term, '{L.OTHER_TOPIC}') AS "
        f"cluster_label FROM c_convs c LEFT JOIN c_ruled r ON c.conv_id = r.conv_id LEFT JOIN c_shared s ON "
        f"c.conv_id = s.conv_id",
    "c_sides": f"SELECT *, {chinese('term')} AS han, row_number() OVER (PARTITION BY {chinese('term')} ORDER BY "
        f"{BEST}) - 1 AS n FROM c_good",
    "c_pins": f"SELECT * FROM (VALUES {rows([(t, k) for k, t in enumerate(L.PINNED_KEYWORDS)])}) AS p(term, turn)",
    "c_hot": "SELECT CAST(row_number() OVER (ORDER BY round, turn) AS INTEGER) AS rank, term, df AS count FROM "
        "(SELECT term, df, -1 AS round, turn FROM c_good JOIN c_pins USING (term) UNION ALL SELECT term, df, CASE "
        "WHEN han THEN n // 2 ELSE n END, CASE WHEN han THEN n % 2 ELSE 2 END FROM c_sides WHERE term NOT IN "
        "(SELECT term FROM c_pins)) QUALIFY rank <= 40",
    "c_topcounts": "SELECT CAST(row_number() OVER (ORDER BY count DESC, first) AS INTEGER) AS rank, label, count FROM "
        "(SELECT cluster_label AS label, count(*) AS count, min(conv_id) AS first FROM c_topics GROUP BY "
        "cluster_label) QUALIFY rank <= 30",
    "c_lines": f"SELECT conv_id, msg_pos, unnest(t) AS raw, generate_subscripts(t, 1) AS n FROM (SELECT conv_id, "
        f"msg_pos, {stripped_lines(outside_code('body'))} AS t FROM c_fx)",
    "c_cand": f"SELECT *, CASE WHEN {braced('raw')} THEN {transcript('raw')} ELSE {prose('raw')} END AS line FROM "
        f"c_lines",
    "c_scored": rf"SELECT *, CAST(CASE WHEN regexp_matches(line, '(?i)(?:{L.HIGHLIGHT_CUES})') THEN 2.0 ELSE 0 END + "
        rf"CASE WHEN regexp_matches(line, '[?？]$') THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(raw, "
        rf"'^\s*(?:[-*•]|\d+[.、])\s*') THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM c_cand WHERE length(line) "
        rf"BETWEEN 6 AND 180",
    "c_high": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, msg_pos, n) AS "
        "INTEGER) AS rank, line, score FROM (SELECT * FROM c_scored WHERE score > 0 QUALIFY row_number() OVER "
        "(PARTITION BY conv_id, line ORDER BY msg_pos, n) = 1) QUALIFY rank <= 8",
    "c_turns": f"SELECT conv_id, msg_pos, lower(role) AS role, {strip(strip_artifacts('clean'))} AS text FROM c_norm "
        f"WHERE NOT {tool_call('body')} AND lower(role) IN ('user', 'assistant')",
    "c_feat": f"SELECT *, length(replace(text, ' ', '')) AS chars, {_flags('compact')} FROM (SELECT *, "
        f"{one_space('text')} AS compact, length(replace({one_space('text')}, ' ', '')) AS char_len FROM c_turns "
        f"WHERE text <> '')",
    "c_user": "SELECT * FROM c_feat WHERE role = 'user'",
    "c_bot": f"SELECT *, regexp_matches(text, '(?:{_CUES['clarify']})') AS clarify, regexp_matches(text, "
        f"'(?i)(?:{_CUES['boundary']})') AS boundary FROM c_feat WHERE role = 'assistant'",
    "c_counts": """SELECT conv_id, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS u, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS a, """ + ", ".join(
        f'count(*) FILTER (role = \'user\' AND "{n}") AS {n[:5]}' for n in (
            "clarity", "constraint", "context", "feedback"
        )
    ) + " FROM c_feat GROUP BY conv_id",
    "c_scores": """SELECT conv_id, u AS user_messages, a AS assistant_messages, clari / greatest(1, u) AS clarity_rate, const / greatest(1, u) AS constraint_rate, conte / greatest(1, u) AS context_rate, feedb / greatest(1, u) AS feedback_rate, CAST(u >= 2 AS INTEGER) AS iteration,
      (clari / greatest(1, u) + const / greatest(1, u) + conte / greatest(1, u) + feedb / greatest(1, u) + CAST(u >= 2 AS INTEGER)) / 5.0 AS score FROM c_counts""",
    "c_totals": """SELECT (SELECT count(*) FROM c_counts) AS conversations, (SELECT count(*) FROM c_counts WHERE u >= 2) AS iteration_conversations, (SELECT count(*) FROM c_user) AS user_messages, (SELECT count(*) FROM c_bot) AS assistant_messages,
      (SELECT CAST(sum(chars) AS BIGINT) FROM c_user) AS user_chars, (SELECT CAST(sum(chars) AS BIGINT) FROM c_bot) AS assistant_chars, """ + ", ".join(f'(SELECT count(*) FROM c_user WHERE "{n}") AS {n}_hits' for n in ("clarity", "constraint", "context", "feedback")) + ", (SELECT count(*) FROM c_bot WHERE clarify) AS clarify_hits",
    "c_summary": """SELECT conversations, user_messages, assistant_messages, user_chars / greatest(1, user_messages) AS avg_user_len, (user_messages + assistant_messages) / greatest(1, conversations) AS avg_turns, clarity_hits / greatest(1, user_messages) AS clarity_avg, constraint_hits / greatest(1, user_messages) AS constraint_rate,
      context_hits / greatest(1, user_messages) AS context_rate, feedback_hits / greatest(1, user_messages) AS feedback_rate, iteration_conversations / greatest(1, conversations) AS iteration_rate, clarify_hits / greatest(1, assistant_messages) AS clarification_rate FROM c_totals WHERE user_messages > 0""",
    "c_rates": "UNPIVOT (SELECT clarity_avg, constraint_rate, context_rate, feedback_rate, iteration_rate, "
        "clarification_rate FROM c_summary) ON COLUMNS(*) INTO NAME metric VALUE value",
    "c_buckets": "SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY score DESC, text, conv_id, msg_pos) "
        "AS INTEGER) AS rank FROM (" + " UNION ALL ".join(
        f"""SELECT '{n}' AS bucket, {truncate('compact')} AS text, {"100 - char_len" if n == "vague" else "char_len"} AS score, conv_id, msg_pos FROM c_user WHERE "{n}" """ for n,
        _ in L.QUOTE_LABELS
    ) + ") QUALIFY rank <= 60",
    "c_search": f"SELECT c.conv_id, idx, file, title, coalesce({strip('lower(t)')}, '') AS search_text FROM c_convs c "
        f"LEFT JOIN (SELECT conv_id, regexp_replace(string_agg(clean_code, {NL} ORDER BY msg_pos) FILTER "
        f"(clean_code <> ''), '[\\s\\x{{3000}}]+', ' ', 'g') AS t FROM (SELECT *, {normalize('body', True)} AS "
        f"clean_code FROM c_fx) GROUP BY conv_id) s ON c.conv_id = s.conv_id",
    "c_kwlist": "SELECT conv_id, list(term ORDER BY rank) AS keywords FROM c_kw GROUP BY conv_id",
    "c_items": f"SELECT c.*, coalesce(keywords, []) AS keywords, cluster_label, "
        f"{strip('substr(coalesce(text, chr(32)), 1, 240)')} AS snippet FROM c_convs c LEFT JOIN c_texts t ON "
        f"c.conv_id = t.conv_id LEFT JOIN c_kwlist k ON c.conv_id = k.conv_id JOIN c_topics p ON c.conv_id = "
        f"p.conv_id",
    "c_stars": f"SELECT file, true AS starred, 'note ' || idx AS note FROM c_convs WHERE conv_id % 5 = 0",
}


def sql(select: str) -> str:
    """select behind the table expressions that it, or one of them, names."""
    names = {head.split("(")[0]: head for head in CTES}
    needed: set[str] = set()
    todo = [select]
    while todo:
        for name in set(re.findall(r"\bc_[a-z]+\b", todo.pop())) & set(names) - needed:
            needed.add(name)
            todo.append(CTES[names[name]])
    parts = [f"{head} AS ({body})" for head, body in CTES.items() if head.split("(")[0] in needed]
    return f"WITH RECURSIVE {', '.join(parts)} {select}" if parts else select
