"""Keywords and fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gapspark.config import METHOD_PHRASES, METHOD_TOOLS

PAIR_SEPARATOR = " x "


def normalize_keyword(c: Column) -> Column:
    """Lower case, Unicode white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def token_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"(?U)\s+")))


def split_author_keywords(c: Column) -> Column:
    """`;` and `|` separate; parts are trimmed, empty ones go; null gives an empty array."""
    parts = F.filter(F.transform(F.split(F.translate(c, "|", ";"), ";"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.coalesce(parts, F.expr("array()").cast("array<string>"))


def normalized_keywords(keywords: Column) -> Column:
    """Normal forms, the first appearance of each, in order."""
    return F.array_distinct(F.filter(F.transform(keywords, normalize_keyword), lambda x: x != ""))


def known(c: Column) -> Column:
    """The trimmed text; null and the strings nan and None are empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(t.isin("nan", "None"), "").otherwise(t)


def combined_text(title: Column, abstract: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.trim(title), F.trim(abstract)))


def coerce_year(c: Column) -> Column:
    """The first run of four digits as a number."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})", 1), F.lit("")).try_cast("int")


def coerce_number(c: Column) -> Column:
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def is_methodological(c: Column, phrases=METHOD_PHRASES, tools=METHOD_TOOLS) -> Column:
    """A tool's name, or contains a phrase, or is contained in one."""
    listed = F.array(*[F.lit(p) for p in phrases]) if phrases else F.expr("array()").cast("array<string>")
    within = F.exists(listed, lambda p: F.contains(c, p) | F.contains(p, c))
    return (c.isin(list(tools)) | within) if tools else within


def capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
