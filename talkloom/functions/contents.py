"""Contents as the JSON text that they stand in: order of keys, repeated keys and the form of numbers are kept, and lists
may be of any depth. Texts are cut into tokens, over which a fold counts how deep it is."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkloom.functions.fields import or_else
from talkloom.functions.lexicon import METADATA_TYPES
from talkloom.functions.text import strip

#: A string, a mark, or what lies between; together they are the whole text. No part of it goes back over what it took.
TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},:]|[^\[\]{},:"]++'
KEY = r'(?s)^"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_SPANS = "array<struct<a:int,b:int>>"


def _tokens(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0))


def _with(value: Column, of) -> Column:
    """of(value), with value computed once."""
    return F.get(F.transform(F.array(value), of), 0)


def _text(tokens: Column, span: Column) -> Column:
    return F.trim(F.array_join(F.slice(tokens, span["a"] + 1, span["b"] - span["a"]), ""), F.lit(" \t\r\n"))


def _one(x: Column, *values: str) -> Column:
    return x.isin(*values)


def elements(raw: Column) -> Column:
    """The texts of what a JSON list or object holds (of an object: key, colon and value); none of any other text."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("deep"), F.lit(0).alias("a"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = _one(t, "[", "{"), _one(t, "]", "}")
        ends = (s["deep"] == 1) & (closes | (t == ","))
        return F.struct(
            (s["i"] + 1).alias("i"), (s["deep"] + opens.cast("int") - closes.cast("int")).alias("deep"),
            F.when(ends | ((s["deep"] == 0) & opens), s["i"] + 1).otherwise(s["a"]).alias("a"),
            F.when(ends, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    def found(tokens: Column) -> Column:
        return F.transform(F.aggregate(tokens, start, step, lambda s: s["out"]), lambda span: _text(tokens, span))

    return F.filter(_with(_tokens(raw), found), lambda x: x != "")


def _value(members: Column, key: str) -> Column:
    own = F.filter(members, lambda x: F.regexp_extract(x, KEY, 0) == f'"{key}"')
    return F.get(F.transform(F.slice(F.reverse(own), 1, 1), lambda x: F.regexp_replace(x, KEY + r"\s*:\s*", "")), 0)


def member(raw: Column, key: str) -> Column:
    """The text of an object's value for a key, the last one if it is repeated; null if there is none."""
    return _value(elements(raw), key)


def decoded(raw: Column) -> Column:
    """A JSON string's text; null for any other value."""
    return F.when(raw.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), 0))


def _is_nothing(t: Column) -> Column:
    """Whether a scalar's text stands for an empty string, no, nothing or zero."""
    return _one(t, '""', "null", "false") | F.coalesce(t.try_cast("double") == 0, F.lit(False))


def list_lines(raw: Column) -> Column:
    """The texts of what a JSON list holds, however deep its lists are: strings decoded, all else as it stands. Values that
    count as nothing (empty strings and containers, no, null, zero) are left out; a list that holds only such is an empty
    line, unless it is the outermost."""
    types = "struct<i:int,deep:int,open:int,lines:int,stack:array<int>,last:string,out:" + _SPANS + ">"
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("deep"), F.lit(0).alias("open"), F.lit(0).alias("lines"),
        F.array().cast("array<int>").alias("stack"), F.lit("").alias("last"), F.array().cast(_SPANS).alias("out"),
    ).cast(types)

    def step(s: Column, token: Column) -> Column:
        t = F.trim(token, F.lit(" \t\r\n"))
        i, inside, stack = s["i"], s["deep"] > 0, s["stack"]
        opens, closes = _one(t, "[", "{"), _one(t, "]", "}")
        object_opens, list_opens, list_closes = ~inside & (t == "{"), ~inside & (t == "["), ~inside & (t == "]")
        object_ends = (s["deep"] == 1) & closes & ~((t == "}") & (s["last"] == "{"))
        scalar = ~inside & ~_one(t, "[", "]", "{", "}", ",", ":", "") & ~_is_nothing(t)
        bare = list_closes & (F.size(stack) > 1) & (F.element_at(stack, -1) == s["lines"]) & (s["last"] != "[")
        line = object_ends | scalar | bare
        span = F.when(object_ends, F.struct(s["open"].alias("a"), (i + 1).alias("b"))).when(
            scalar, F.struct(i.alias("a"), (i + 1).alias("b"))
        ).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
        deep = F.when(inside, s["deep"] + opens.cast("int") - closes.cast("int")).otherwise(object_opens.cast("int"))
        depths = F.when(list_opens, F.concat(stack, F.array(s["lines"]))).when(
            list_closes, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        ).otherwise(stack)
        return F.struct(
            (i + 1).alias("i"), deep.alias("deep"), F.when(object_opens, i).otherwise(s["open"]).alias("open"),
            (s["lines"] + line.cast("int")).alias("lines"), depths.alias("stack"), F.when(t == "", s["last"]).otherwise(t).alias("last"),
            F.when(line, F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"),
        ).cast(types)

    def found(tokens: Column) -> Column:
        spans = F.aggregate(tokens, start, step, lambda s: s["out"])
        return F.transform(F.transform(spans, lambda span: _text(tokens, span)), lambda x: F.coalesce(decoded(x), x))

    return _with(_tokens(raw), found)


def content_text(raw: Column) -> Column:
    """The text of a content: a string's own, a list's by line, an object's or scalar's as it stands; null has none."""
    value = F.trim(raw, F.lit(" \t\r\n"))
    text = F.when(value.startswith("["), F.array_join(list_lines(value), "\n")).otherwise(F.coalesce(decoded(value), value))
    return F.when(value.isNull() | (value == "null"), "").otherwise(text)


PART = "content_type string, text string, asset_pointer string, width int, height int"


def rendered(raw: Column, keep_metadata: bool = False) -> Column:
    """The body of a message of a tree export: raw is an object of content_type, parts, text and language. What has no form
    of its own appears as it stands."""
    filled = lambda t: F.when(F.length(strip(t)) > 0, t)

    def media(p: Column) -> Column:
        read = F.from_json(F.when(p.startswith("{"), p), PART)
        dims = F.when((read["width"] != 0) & (read["height"] != 0), F.format_string(" (%dx%d)", read["width"], read["height"]))
        pointer = F.coalesce(or_else(read["asset_pointer"]), F.lit("image"))
        image = F.concat(F.lit("[image]"), F.coalesce(dims, F.lit("")), F.lit(" "), pointer)
        return F.when(read["content_type"] == "text", filled(read["text"])).when(
            read["content_type"] == "image_asset_pointer", image
        ).otherwise(p)

    def body(members: Column) -> Column:
        text_of = lambda key: F.coalesce(decoded(_value(members, key)), F.lit(""))
        kind, said = text_of("content_type"), text_of("text")
        joined = lambda of: F.array_join(F.filter(F.transform(elements(_value(members, "parts")), of), lambda x: x != ""), "\n")
        plain = joined(lambda p: F.when(p.startswith('"'), filled(decoded(p))).otherwise(p))
        mixed = joined(lambda p: F.when(p.startswith('"'), filled(decoded(p))).otherwise(media(p)))
        fence = F.concat(F.lit("```"), strip(text_of("language")), F.lit("\n"), said, F.lit("\n```"))
        found = F.when(kind == "text", plain).when(kind == "code", F.when(F.length(strip(said)) > 0, fence)).when(
            kind == "execution_output", said
        ).when(kind == "multimodal_text", mixed).otherwise(raw if keep_metadata else F.lit(""))
        if not keep_metadata:
            found = F.when(~kind.isin(METADATA_TYPES), found)
        return F.when(kind != "", found)

    return F.coalesce(_with(elements(raw), body), F.lit(""))


def content_type(raw: Column) -> Column:
    return decoded(member(raw, "content_type"))
