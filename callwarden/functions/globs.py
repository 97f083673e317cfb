"""Shell-style globs as regular expressions, and keyed hashes, as Column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: Column) -> Column:
    """``*`` (also across ``/``), ``?`` and ``[seq]``/``[!seq]``; everything else is literal."""
    out = F.regexp_replace(glob, r"([\\.^$|(){}+&~#-])", r"\\$1")
    out = F.regexp_replace(out, r"\[(?!!?\]?[^\]]*\])", r"\\[")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(out, r"(\[[^\]]*?)\\-", "$1-")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", ".*"), r"\?", ".")
    return F.concat(F.lit("(?s)^(?:"), out, F.lit(r")\z"))


def glob_regexes(globs: Column) -> Column:
    return F.transform(globs, glob_to_regex)


def matches_any(value: Column, regexes: Column) -> Column:
    return F.coalesce(F.exists(regexes, lambda r: F.rlike(value, r)), F.lit(False))


def hmac_pads(secret: bytes) -> tuple[bytes, bytes]:
    """Inner and outer key blocks of HMAC-SHA256."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex digest. The key blocks are constants; the two hashes run in the JVM."""
    inner, outer = hmac_pads(secret)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)
