"""Expressions for fields of exports: values that count as missing, times, roles, names, contents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkloom.functions.lexicon import METADATA_TYPES
from talkloom.functions.text import strip

TIME = "yyyy-MM-dd HH:mm:ss'Z'"
UNKNOWN = "unknown"


def or_else(*columns: Column) -> Column:
    """The first text that is neither null nor empty; null if there is none."""
    return F.coalesce(*(F.when(F.length(c) > 0, c) for c in columns))


def to_time(value: Column, strict: bool = False) -> Column:
    """A timestamp of epoch seconds or a text: ISO with T and Z, or 'yyyy-MM-dd HH:mm:ssZ' (not if strict).

    Empty and zero values are missing. Fractions of a second are dropped from texts (if strict, they make a time missing).
    """
    text = strip(value.cast("string"))
    number = text.try_cast("double")
    iso_text = F.regexp_replace(text, "T", " ")
    if not strict:
        iso_text = F.regexp_replace(iso_text, r"\.[0-9]+Z$", "Z")
    iso = F.when(text.endswith("Z") & text.contains("T"), F.try_to_timestamp(iso_text, F.lit(TIME)))
    plain = F.lit(None).cast("timestamp") if strict else F.try_to_timestamp(text, F.lit(TIME))
    return F.when(
        number.isNotNull(), F.when(number != 0, F.timestamp_seconds(number))
    ).otherwise(F.coalesce(iso, plain))


def format_ts(time: Column) -> Column:
    """A timestamp as 'yyyy-MM-dd HH:mm:ssZ' (in UTC sessions), unknown if null."""
    return F.coalesce(F.date_format(time, TIME), F.lit(UNKNOWN))


def parse_ts(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(TIME))


def slugify(title: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return or_else(slug, F.lit("conv"))


def role_label(role: Column, name: Column | None = None, time: Column | None = None) -> Column:
    label = or_else(strip(role), F.lit(UNKNOWN))
    if name is not None:
        label = F.concat(label, F.coalesce(F.concat(F.lit(":"), or_else(name)), F.lit("")))
    if time is not None:
        label = F.concat(label, F.coalesce(F.concat(F.lit(" ("), F.date_format(time, TIME), F.lit(")")), F.lit("")))
    return label


def base_role(label: Column) -> Column:
    return F.lower(
        strip(F.split_part(F.split_part(F.coalesce(label, F.lit("")), F.lit(" "), F.lit(1)), F.lit(":"), F.lit(1)))
    )


def archive_file_name(index: Column, created: Column, title: Column, conv_id: Column) -> Column:
    number = F.format_string("%04d", index)
    day = F.coalesce(F.date_format(created, "yyyyMMdd"), F.lit(UNKNOWN))
    tail = F.coalesce(F.substring(F.element_at(F.split(or_else(conv_id), "-", -1), -1), 1, 8), number)
    return F.concat_ws("_", number, day, slugify(title), F.concat(tail, F.lit(".md")))


def normalize_content(content: Column) -> Column:
    """A variant's text: strings as they are, lists of them by line (empty ones out), objects as JSON.

    Lists are read three levels deep, which is what exports hold; deeper ones appear as JSON.
    """

    def text(v: Column, depth: int) -> Column:
        whole = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        items = F.try_variant_get(v, "$", "array<variant>")
        if depth:
            truthy = lambda x: x.isNotNull() & ~F.is_variant_null(x) & ~F.coalesce(
                F.to_json(x).isin('""', "0", "false", "[]", "{}"), F.lit(False)
            )
            joined = F.array_join(F.transform(F.filter(items, truthy), lambda x: text(x, depth - 1)), "\n")
            return F.coalesce(whole, joined, F.to_json(v))
        return F.coalesce(whole, F.to_json(v))

    return F.when(content.isNull() | F.is_variant_null(content), F.lit("")).otherwise(text(content, 3))


def _parts(content: Column, render) -> Column:
    parts = F.transform(F.coalesce(content["parts"], F.array()), render)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), "\n")


def render_content(content: Column, keep_metadata: bool = False) -> Column:
    """The body of a message of a tree export: content is a struct of content_type, parts (variants), text, language."""
    blank_out = lambda t: F.when(F.length(strip(t)) > 0, t)
    is_text = lambda p: F.schema_of_variant(p) == "STRING"
    of = lambda p, path, kind="string": F.try_variant_get(p, path, kind)
    kind, said = content["content_type"], F.coalesce(content["text"], F.lit(""))
    plain = _parts(content, lambda p: F.when(is_text(p), blank_out(of(p, "$"))).otherwise(F.to_json(p)))

    def media(p: Column) -> Column:
        w, h = of(p, "$.width", "int"), of(p, "$.height", "int")
        dims = F.when((w != 0) & (h != 0), F.format_string(" (%dx%d)", w, h)).otherwise(F.lit(""))
        image = F.concat(
            F.lit("[image]"), dims, F.lit(" "), F.coalesce(or_else(of(p, "$.asset_pointer")), F.lit("image"))
        )
        return (
            F.when(is_text(p), blank_out(of(p, "$")))
            .when(of(p, "$.content_type") == "text", blank_out(of(p, "$.text")))
            .when(of(p, "$.content_type") == "image_asset_pointer", image)
            .otherwise(F.to_json(p))
        )

    code = F.when(
        F.length(strip(said)) > 0,
        F.concat(F.lit("```"), strip(F.coalesce(content["language"], F.lit(""))), F.lit("\n"), said, F.lit("\n```"))
    )
    other = F.to_json(content) if keep_metadata else F.lit("")
    body = F.when(kind == "text", plain).when(kind == "code", code).when(kind == "execution_output", said).when(
        kind == "multimodal_text", _parts(content, media)
    ).otherwise(other)
    if not keep_metadata:
        body = F.when(kind.isin(METADATA_TYPES), F.lit("")).otherwise(body)
    return F.when(F.length(kind) > 0, F.coalesce(body, F.lit(""))).otherwise(F.lit(""))
