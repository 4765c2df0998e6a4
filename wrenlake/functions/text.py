"""Paths, label lists, times and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def split_labels(text: Column) -> Column:
    """Labels of a ``;`` list, trimmed, without empty ones; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def parse_list(text: Column) -> Column:
    """A list literal such as ``['a', "it's"]``; what can't be parsed is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}), F.array().cast("array<string>"))


def seconds(text: Column) -> Column:
    """``H:M:S``, ``M:S`` or plain seconds; null if neither."""
    p = F.transform(F.split(text, ":"), lambda x: x.try_cast("double"))
    n = F.size(p)
    return F.when(n == 3, F.get(p, F.lit(0)) * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2))).when(n == 2, F.get(p, F.lit(0)) * 60 + F.get(p, F.lit(1))).when(n == 1, F.get(p, F.lit(0)))


def clock_seconds(time: Column) -> Column:
    """Seconds since 1970 on the time's own clock, with their fraction."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time) / 1e6


def catalogue_id(path: Column) -> Column:
    """A recording's number from its file name: letters X and C and leading zeros go; nothing left is 0, an empty path null."""
    digits = F.regexp_replace(F.regexp_replace(F.upper(stem(path)), "^[XC]+", ""), "^0+", "")
    return F.when(path.isNull() | (path == ""), None).otherwise(F.when(digits == "", "0").otherwise(digits))


def segment_id(source: Column, start: Column, end: Column, prefix: str = "") -> Column:
    return F.format_string(prefix + "%s_%.1f_%.1f", source, start, end)


def row_id(path: Column, end: Column) -> Column:
    return F.concat_ws("_", stem(path), end.cast("int").cast("string"))


def safe_number(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")
