"""Text functions: hashes, estimates, keyword gates, sizes of JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of the text, of the empty text for NULL."""
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, halves to even, at least 1; 0 for no text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.bround(n / 4), F.lit(1))).cast("long")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends; NULL gives the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def keyword_pattern(keywords: list[str]) -> str | None:
    """One pattern for any of the keywords, without case; None for no keyword.

    A keyword stands between two word boundaries: beside a letter, digit or
    underscore of its own there is none outside, and beside another character
    of its own there is one ("C++" is met in "C++11", not in "C++ daily").
    """
    words = [k for k in keywords if k]
    if not words:
        return None
    inner = r"[\p{L}\p{N}_]"
    word = lambda c: c.isalnum() or c == "_"
    alike: dict[tuple[bool, bool], list[str]] = {}  # keywords by whether they begin and end with such a character
    for k in words:
        alike.setdefault((word(k[0]), word(k[-1])), []).append(re.sub(r"([^\w\s])", r"\\\1", k))
    parts = [(f"(?<!{inner})" if a else f"(?<={inner})") + "(?:" + "|".join(own) + ")" + (f"(?!{inner})" if b else f"(?={inner})") for (a, b), own in alike.items()]
    return "(?iu)" + ("(?:" + "|".join(parts) + ")" if len(parts) > 1 else parts[0])


def included(title: Column, text: Column, keywords: list[str]) -> Column:
    """The include gate: the title decides where there is one, the text only without a title; no keywords pass all."""
    pattern = keyword_pattern(keywords)
    if pattern is None:
        return F.lit(True)
    t = F.coalesce(title, F.lit(""))
    return F.when(t != "", t.rlike(pattern)).otherwise(F.coalesce(text, F.lit("")).rlike(pattern))


def excluded(title: Column, text: Column, keywords: list[str]) -> Column:
    """The exclude gate: any keyword in title or text; no keywords exclude none."""
    pattern = keyword_pattern(keywords)
    if pattern is None:
        return F.lit(False)
    return F.concat_ws("\n", title, text).rlike(pattern)


def relevant(title: Column, text: Column, enabled: bool = True, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """The keyword filter: disabled passes all; exclusion wins over inclusion."""
    if not enabled:
        return F.lit(True)
    return ~excluded(title, text, exclude or []) & included(title, text, include or [])


def json_within(value: Column, most_bytes: int) -> Column:
    """Whether JSON text in its compact form is within a limit of UTF-8 bytes; invalid JSON is not, NULL is."""
    return F.when(value.isNull(), True).otherwise(F.coalesce(F.octet_length(F.to_json(F.try_parse_json(value))) <= most_bytes, F.lit(False)))
