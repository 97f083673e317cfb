"""Checksum tests on matched identifiers, as boolean Columns."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden.rules.patterns import ID_CARD_WEIGHTS, NIP_WEIGHTS, PASSPORT_WEIGHTS, PESEL_WEIGHTS

# Decimal digits of every script on the basic plane and the ASCII digit each stands for.
_FOREIGN = [chr(c) for c in range(0x80, min(sys.maxunicode, 0xFFFF)) if unicodedata.category(chr(c)) == "Nd"]
_FOREIGN_FROM = "".join(_FOREIGN)
_FOREIGN_TO = "".join(str(unicodedata.decimal(c)) for c in _FOREIGN)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(F.translate(value, _FOREIGN_FROM, _FOREIGN_TO), "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _alnum_value(char: Column) -> Column:
    """0-9 for digits, 10-35 for upper-case letters."""
    code = F.ascii(char)
    return F.when(code >= 65, code - 55).otherwise(code - 48)


def _weighted_sum(values: Column, weights: list[int]) -> Column:
    products = F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda v, w: F.coalesce(v * w, F.lit(0)))
    return F.aggregate(products, F.lit(0), lambda a, x: a + x)


def _digit_values(digits: Column) -> Column:
    return F.transform(_chars(digits), lambda c: F.ascii(c) - 48)


def pesel_ok(value: Column) -> Column:
    d = _digit_values(digits_only(value))
    return (10 - _weighted_sum(F.slice(d, 1, 10), PESEL_WEIGHTS) % 10) % 10 == F.try_element_at(d, F.lit(11))


def luhn_ok(value: Column) -> Column:
    d = F.reverse(_digit_values(digits_only(value)))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise((x * 2) % 10 + F.floor(x / 5).cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.size(d).between(13, 19) & (total % 10 == 0)


def iban_ok(value: Column) -> Column:
    s = F.upper(F.regexp_replace(F.translate(value, _FOREIGN_FROM, _FOREIGN_TO), r"(?U)\s", ""))
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.transform(_chars(moved), _alnum_value),
        F.lit(0),
        lambda a, v: (a * F.when(v >= 10, 100).otherwise(10) + v) % 97,
    )
    return F.length(s).between(15, 34) & (rest == 1)


def nip_ok(value: Column) -> Column:
    d = _digit_values(digits_only(value))
    check = _weighted_sum(F.slice(d, 1, 9), NIP_WEIGHTS) % 11
    return (F.size(d) == 10) & (check != 10) & (check == F.try_element_at(d, F.lit(10)))


def _document_number_ok(value: Column, weights: list[int]) -> Column:
    s = F.upper(F.regexp_replace(F.translate(value, _FOREIGN_FROM, _FOREIGN_TO), r"(?U)\s", ""))
    total = _weighted_sum(F.transform(_chars(s), _alnum_value), weights)
    return (F.length(s) == len(weights)) & (total % 10 == 0)


def id_card_ok(value: Column) -> Column:
    return _document_number_ok(value, ID_CARD_WEIGHTS)


def passport_ok(value: Column) -> Column:
    return _document_number_ok(value, PASSPORT_WEIGHTS)


VALIDATORS = {
    "PESEL": pesel_ok,
    "CREDIT_CARD": luhn_ok,
    "CARD_NUMBER": luhn_ok,
    "IBAN": iban_ok,
    "NIP": nip_ok,
    "ID_CARD": id_card_ok,
    "PASSPORT": passport_ok,
}
