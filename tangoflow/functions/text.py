"""Text scalar expressions: answer normalisation, seeded choices, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_answer(text: Column) -> Column:
    """lower + strip of Unicode whitespace on both ends (H3)."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def seeded_bucket(seed: str, *parts: Column) -> Column:
    """Deterministic 32-bit unsigned integer from md5(seed|parts...).

    md5 (not xxhash64 / rand) so that an SQL engine can reproduce it.
    """
    key = F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def seeded_key(seed: str, *parts: Column) -> Column:
    """md5 hex text — a seeded, uniformly spread ordering key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]))


def quote_json(value: Column) -> Column:
    """A string as a JSON string literal."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def decode_setting(value: Column) -> Column:
    """Stored setting text -> canonical JSON text (H10 inverse).

    JSON text is kept (normalised); anything else is a raw string and is
    quoted — 'try to decode as JSON, else keep the string'.  NULL stays NULL.
    """
    parsed = F.try_parse_json(value)
    return F.when(value.isNull(), F.lit(None).cast("string")).when(parsed.isNotNull(), F.to_json(parsed)).otherwise(quote_json(value))


#: A sentence: a run of characters other than . ! ? and newline, with the mark that ends it if there is one.
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]?"


def sentences_of(text: Column) -> Column:
    """All sentences of a text, the unterminated ones (headings, tails) too.
    The pattern never backtracks: a run always matches, so one pass does."""
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))
