"""Variants of a text that undo common hiding tricks: zero-width characters, compatibility letters,
spaced-out words, leet digits and base64 payloads. Compatibility letters are read in :mod:`hints`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden.rules import patterns as P
from callwarden.rules.patterns import java


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, P.ZERO_WIDTH, "")


def join_spaced(text: Column) -> Column:
    """``i g n o r e`` becomes ``ignore``; other blanks stay."""
    rx = java(P.SPACED_LETTERS)
    words = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    gaps = F.split(text, rx, -1)
    parts = F.zip_with(
        gaps, words, lambda g, w: F.concat(g, F.coalesce(F.regexp_replace(w, P.SPACERS, ""), F.lit("")))
    )
    return F.when(text.rlike(rx), F.array_join(parts, "")).otherwise(text)


def unleet(text: Column) -> Column:
    return F.translate(text, P.LEET_FROM, P.LEET_TO)


def base64_payloads(text: Column) -> Column:
    """Decoded base64 runs that are valid UTF-8 and either printable or of several lines."""
    runs = F.filter(
        F.regexp_extract_all(text, F.lit(P.BASE64_RUN), F.lit(0)), lambda r: (F.length(r) % 4 == 0)
    )
    raw = F.transform(runs, lambda r: F.try_to_binary(r, F.lit("base64")))
    decoded = F.transform(
        F.filter(raw, lambda b: b.isNotNull()), lambda b: F.try_validate_utf8(b.cast("string"))
    )
    # not printable: control, format, surrogate, private or unassigned characters, line and paragraph
    # separators, and every blank but the plain space
    hidden = r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]"
    readable = F.filter(
        decoded, lambda d: d.isNotNull() & (F.contains(d, F.lit("\n")) | ~d.rlike(hidden))
    )
    return F.when(text.rlike(P.BASE64_RUN), readable).otherwise(F.array().cast("array<string>"))
