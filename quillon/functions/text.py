"""Scalar text functions as column expressions; white space is Unicode white space throughout."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII_MARK = r"^[\x00-\x7F]+$"


def squash(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, r"(?U)\s+", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clip(x: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something was cut."""
    return F.when(F.char_length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def all_caps(x: Column) -> Column:
    """Has letters, and only upper-case ones; scripts without case don't count as upper case."""
    return x.rlike(r"\p{L}") & ~x.rlike(r"[\p{L}&&[^\p{Lu}]]")


def is_substantive(x: Column) -> Column:
    """Long enough to be looked for: four characters or more, one of them a letter or digit."""
    y = collapse(x)
    return (F.char_length(y) >= 4) & y.rlike(r"[\p{L}\p{N}]")


def is_prose(x: Column) -> Column:
    """Not a row of a table or a table of contents."""
    pipes = F.char_length(x) - F.char_length(F.replace(x, F.lit("|"), F.lit("")))
    empty = F.size(F.regexp_extract_all(x, F.lit(r"(?U)\|\s*\|"), F.lit(0)))  # empty cells, wherever they are
    return ~x.rlike(r"\.{6,}") & (pipes < 7) & (empty < 2) & x.rlike("[A-Za-z가-힣]{2,}")


def marker_pattern(marker: str) -> str:
    """Case-insensitive pattern of a marker; markers in ASCII match whole words only."""
    quoted = r"\Q" + marker + r"\E"
    return rf"(?i)(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])" if marker.isascii() else f"(?i){quoted}"


def full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def java_pattern(pattern: str) -> str:
    """Named groups as Java writes them."""
    return pattern.replace("(?P<", "(?<")


def captured(x: Column, pattern: str) -> Column:
    """The group "value", else the first group, else the whole match; null without a match."""
    names = [p.split(">", 1)[0] for p in pattern.split("(?P<")[1:]]
    before = pattern.split("(?P<value>")[0] if "value" in names else ""
    plain = lambda s: sum(1 for i, c in enumerate(s) if c == "(" and (i == 0 or s[i - 1] != "\\") and (s[i + 1 : i + 2] != "?" or s[i + 1 : i + 4] == "?P<"))
    group = plain(before) + 1 if "value" in names else (1 if plain(pattern) else 0)
    java = java_pattern(pattern)
    return F.when(x.rlike(java), F.regexp_extract(x, java, group))


def comparable(x: Column) -> Column:
    """Without a trailing version in brackets."""
    return strip(F.regexp_replace(x, r"(?i)\s*\(\s*ver[^)]*\)\s*$", ""))


def date_key(x: Column) -> Column:
    """YYYYMMDD of a date written YYYY. M. D.; null if unreadable or not in the calendar."""
    part = lambda i: F.regexp_extract(x, r"^\s*(\d{4})\s*\.\s*(\d{1,2})\s*\.\s*(\d{1,2})\s*\.?\s*$", i)
    text = F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.when(F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull() & (text != ""), text)


def rollup_parent(x: Column, separator: str = "-") -> Column:
    """An id without its last segment; null where it has only one."""
    quoted = r"\Q" + separator + r"\E"
    return F.when(x.contains(separator), F.regexp_replace(x, rf"{quoted}(?:(?!{quoted}).)*$", ""))


#: Suffixes of revised files, the first that fits is cut off.
REVISION_SUFFIXES = ("_수정", "_rev", "_revised", "_v2", "_v3", "_최종", "_회신", "_re")


def original_name(x: Column) -> Column:
    """File name without extension and without one revision suffix."""
    stem = F.regexp_replace(x, r"\.[^.]+$", "")
    return F.regexp_replace(stem, f"(?:{'|'.join(REVISION_SUFFIXES)})$", "")


def broken(*patterns: str | None) -> bool:
    """Whether one of the patterns can't be read."""
    try:
        for p in patterns:
            re.compile(p or "")
    except re.error:
        return True
    return False


def version_order(x: Column) -> Column:
    """Dotted numbers as an array of integers, which sorts as versions do."""
    return F.transform(F.split(x, r"\."), lambda p: F.try_to_number(p, F.lit("999999999")).cast("long"))


def without_reasoning(x: Column) -> Column:
    """A model's answer without its reasoning block."""
    return strip(F.regexp_replace(x, r"(?s)<think>.*?(?:</think>|$)", ""))


def one_object(text: str | None, keys: set[str] | None = None, most_failures: int = 500) -> str | None:
    """The one JSON object in a model's answer, as JSON; null where there is none or where several differ in more than white space.

    Scanning stops after ``most_failures`` failed starts in a row. A lone object inside another one is unwrapped once.
    """
    if not text:
        return None
    decode, found, at, failures = json.JSONDecoder().raw_decode, {}, text.find("{"), 0
    while at >= 0 and failures < most_failures:
        try:
            value, end = decode(text, at)
            failures = 0
            if keys and not keys & value.keys() and len(value) == 1 and isinstance(inner := next(iter(value.values())), dict):
                value = inner
            if not keys or keys & value.keys():
                whole = json.dumps(value, sort_keys=True, ensure_ascii=False)
                found.setdefault(" ".join(whole.split()), whole)
            at = text.find("{", end)
        except (ValueError, RecursionError):  # nested too deeply
            failures += 1
            at = text.find("{", at + 1)
    return next(iter(found.values())) if len(found) == 1 else None


def json_object(keys: set[str] | None = None):
    """Pandas UDF of ``one_object``: from_json can't find an object within prose."""

    @F.pandas_udf("string")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: one_object(x, keys))

    return find
