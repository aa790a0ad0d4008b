"""String expressions: white space, lines, cleaning of message bodies, tool calls. All are native columns.

Python's notions hold: white space, digits and letters are Unicode ones, and a text's lines end at any of its line
separators.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkloom.functions.lexicon import BUILD_NOISE, FILE_TOKEN, LIST_PREFIX, TOOL_KEYS

SPACE = r"[\s\x{1c}-\x{1f}]"
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
FENCE_LINE = r"(?mdU)^[^\S\n]*```[^\n]*(?:\n|\z)"
CITATION = r"\x{E200}.*?\x{E201}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def one_space(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){SPACE}+", " "))


def lines(c: Column) -> Column:
    return F.split(c, LINE_END, -1)


def with_plain_ends(c: Column) -> Column:
    return F.regexp_replace(c, LINE_END, "\n")


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, CITATION, "")


def strip_list_prefix(c: Column) -> Column:
    return F.regexp_replace(c, LIST_PREFIX, "")


def outside_code(body: Column) -> Column:
    """The text between code fences. Fence lines alternate, so of the pieces between them every second is code."""
    return F.array_join(F.filter(F.split(with_plain_ends(body), FENCE_LINE, -1), lambda p, i: i % 2 == 0), "\n")


def without_fences(body: Column) -> Column:
    return F.array_join(F.split(with_plain_ends(body), FENCE_LINE, -1), "\n")


def is_braced(s: Column) -> Column:
    return s.startswith("{") & s.endswith("}")


def json_objects(s: Column) -> Column:
    """The JSON objects that s, in brackets, is a list of, as maps to raw values; null for anything else.

    Keys may repeat and numbers be NaN or infinite, as the usual readers have it; quotes and commas are strict. In
    brackets, nothing can follow an object unseen.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}
    return F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<map<string,string>>", strict)


def is_one_json_object(s: Column) -> Column:
    return is_braced(s) & F.coalesce(F.size(json_objects(s)) == 1, F.lit(False))


def transcript(line: Column) -> Column:
    """What was said, of a JSON line that is a transcription; else null."""
    said = F.get_json_object(line, "$.text")
    return F.when(
        is_one_json_object(line) & F.coalesce(
            F.get_json_object(line, "$.content_type"), F.lit("")
        ).contains("transcription") & (F.length(said) > 0),
        strip(said)
    )


def clean_prose(line: Column) -> Column:
    return strip(strip_list_prefix(strip_citations(line)))


def clean_line(line: Column) -> Column:
    """A stripped line as normalize_body() keeps it, or null."""
    return (
        F.when(is_braced(line), transcript(line))
        .when(line.contains("sediment://") | line.startswith("[image]"), F.lit(None).cast("string"))
        .otherwise(clean_prose(line))
    )


def _kept(found: Column) -> Column:
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def stripped_lines(c: Column) -> Column:
    return _kept(F.transform(lines(c), strip))


def normalize_body(body: Column, keep_code: bool = False) -> Column:
    """A message's text without fences, code, JSON lines, attachments, citations and one list prefix a line."""
    text = without_fences(body) if keep_code else outside_code(body)
    return F.array_join(_kept(F.transform(stripped_lines(text), clean_line)), "\n")


def ascii_ratio(c: Column) -> Column:
    """Share of characters below 128; 1 for an empty text."""
    plain = F.length(F.regexp_replace(c, r"[^\x{00}-\x{7F}]", ""))
    return F.when(F.length(c) > 0, plain / F.length(c)).otherwise(F.lit(1.0))


def is_artifact(line: Column) -> Column:
    """Lines of build tools, of changed files, and very long ones of nearly ASCII alone."""
    low = F.lower(line)
    noise = low.contains(BUILD_NOISE[0])
    for word in BUILD_NOISE[1:]:
        noise |= low.contains(word)
    files = line.rlike(FILE_TOKEN) & (line.rlike(r"\+\p{Nd}+") | line.contains(":"))
    return noise | files | ((F.length(line) >= 160) & (ascii_ratio(line) >= 0.85))


def strip_artifact_lines(c: Column) -> Column:
    return F.array_join(F.filter(stripped_lines(c), lambda x: ~is_artifact(x)), "\n")


def clean_for_metrics(body: Column) -> Column:
    return strip(strip_artifact_lines(normalize_body(body)))


def is_tool_call(body: Column) -> Column:
    """Whether the body, alone or in a fence without language, is one JSON object with a key of tool calls."""
    whole = strip(with_plain_ends(body))
    rows = F.split(whole, "\n", -1)
    language = F.lower(strip(F.substring(strip(rows[0]), 4, 1 << 30)))
    fenced = whole.startswith("```")
    closed = (F.size(rows) >= 2) & strip(F.element_at(rows, -1)).startswith("```") & language.isin("", "unknown")
    inner = strip(F.array_join(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 2, F.lit(0))), "\n"))
    payload = F.when(fenced, F.when(closed, inner)).otherwise(whole)
    found = json_objects(F.when(is_braced(payload), payload))
    keys = F.arrays_overlap(F.map_keys(found[0]), F.array(*map(F.lit, TOOL_KEYS)))
    return F.coalesce((F.size(found) == 1) & keys, F.lit(False))


def truncate_text(c: Column, limit: int = 180) -> Column:
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), rf"(?U){SPACE}+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def snippet(text: Column, n: int = 240) -> Column:
    return strip(F.substring(text, 1, n))


def search_form(text: Column, max_chars: int = 8000) -> Column:
    """Text as it is searched: one blank between words, lower case, cut (0: not cut)."""
    found = strip(F.lower(F.regexp_replace(text, rf"(?U){SPACE}+", " ")))
    return F.substring(found, 1, max_chars) if max_chars else found
