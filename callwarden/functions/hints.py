r"""Which patterns may match a text: every pattern in a weaker form that RE2 runs over whole Arrow batches.

The weaker form matches wherever the pattern does and also elsewhere: look-around, boundaries and upper bounds of repeats are left
out, ``\w`` and ``\s`` take every character beyond ASCII. It costs about a hundredth of the pattern itself, so the patterns of the JVM run only on
the texts where they may match. A pattern that cannot be read here may match everywhere: a test left out costs time, never a match.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from callwarden.functions.literals import nested_set
from callwarden.rules import patterns as P

_ANY = r"[\x00-\x{10FFFF}]"
_CATEGORY = {K.CATEGORY_DIGIT: r"\p{Nd}", K.CATEGORY_WORD: r"0-9A-Z_a-z\x{80}-\x{10FFFF}", K.CATEGORY_SPACE: r"\x09-\x0D \x{80}-\x{10FFFF}"}
#: Letters that the JVM folds to i, s and k.
_ODD = "ıİſ\u212a"
#: Lower bounds of repeats are kept up to here, so that the automata stay small.
_REPEAT = 40
_PREFIX = re.compile(r"\(\?Ud([a-z]*)\)")
# read differently by the JVM: octal numbers, references of two digits, vertical space
_OTHERWISE = re.compile(r"\\(?:0|[1-9]\d|v)")


class _Unread(Exception):
    pass


def weaker(pattern: str) -> str | None:
    """An RE2 pattern that matches every text in which the JVM finds ``pattern``, or None if it cannot be told."""
    flags, raw = "", pattern
    if m := _PREFIX.match(pattern):
        flags, raw = m.group(1), pattern[m.end():]
    if set(flags) - set("is") or _OTHERWISE.search(raw) or nested_set(raw):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # set operations
            tree = _parser.parse(raw, re.IGNORECASE if "i" in flags else 0)
        if tree.state.flags & re.VERBOSE:
            return None
        made = _sequence(tree, bool(tree.state.flags & re.IGNORECASE), {})
        pc.match_substring_regex(pa.array([""]), made)
    except (re.error, Warning, RecursionError, OverflowError, _Unread, pa.ArrowInvalid):
        return None
    return made


def _char(code: int) -> str:
    return f"\\x{{{code:X}}}"


def _set(body: str, fold: bool) -> str:
    return f"(?i:[{body}{_ODD}])" if fold else f"[{body}]"


def _one(code: int, fold: bool) -> str:
    if fold and code > 0x17F:
        return _ANY
    letter = chr(code)
    if not (fold and letter.isalpha()):
        return f"[{_char(code)}]"
    return _set(_char(code), True) if letter in "iIsSkK" + _ODD else f"(?i:{_char(code)})"


def _members(items, fold: bool) -> str:
    if items[0][0] is K.NEGATE:
        kept = "".join(_char(v) if op is K.LITERAL else f"{_char(v[0])}-{_char(v[1])}" for op, v in items[1:] if op in (K.LITERAL, K.RANGE))
        return f"[^{kept}]" if kept else _ANY
    body = ""
    for op, value in items:
        if op is K.LITERAL and not (fold and value > 0x17F):
            body += _char(value)
        elif op is K.RANGE and not (fold and value[1] > 0x17F):
            body += f"{_char(value[0])}-{_char(value[1])}"
        elif op is K.CATEGORY and value in _CATEGORY:
            body += _CATEGORY[value]
        else:
            return _ANY
    return _set(body, fold)


def _sequence(items, fold: bool, groups: dict[int, str]) -> str:
    out = ""
    for op, value in items:
        if op is K.LITERAL:
            out += _one(value, fold)
        elif op is K.NOT_LITERAL:
            out += f"[^{_char(value)}]"
        elif op is K.ANY:
            out += _ANY
        elif op is K.IN:
            out += _members(value, fold)
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            continue
        elif op is K.SUBPATTERN:
            number, on, off, inner = value
            made = f"(?:{_sequence(inner, (fold or bool(on & re.IGNORECASE)) and not off & re.IGNORECASE, groups)})"
            if number is not None:
                groups[number] = made
            out += made
        elif op is K.ATOMIC_GROUP:
            out += f"(?:{_sequence(value, fold, groups)})"
        elif op is K.BRANCH:
            out += "(?:" + "|".join(_sequence(b, fold, groups) for b in value[1]) + ")"
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, inner = value
            part = f"(?:{_sequence(inner, fold, groups)})"
            least = min(int(least), _REPEAT)
            out += part if least == 1 else f"{part}{{{least}}}" if least else ""
            out += "" if most == least else f"{part}?" if (least, most) == (0, 1) else f"{part}*"
        elif op is K.GROUPREF and value in groups and not fold:
            out += groups[value]
        else:
            raise _Unread
    return out


class Hints:
    """Numbers of patterns, and the Arrow function that names those that may match."""

    def __init__(self, patterns: list[str], injection: list[str]):
        self.patterns = list(dict.fromkeys([*patterns, *injection]))
        self.number = {p: i for i, p in enumerate(self.patterns)}
        self.injection = [self.number[p] for p in dict.fromkeys(injection)]

    def test(self, column: str):
        """SQL, for a pattern, that it may match the text of which ``column`` holds the numbers."""
        return lambda pattern: f"array_contains({column}, {self.number[pattern]})"

    def function(self):
        """An Arrow function of (text, inbound): ``LOOK_TYPE``."""
        weak = [weaker(p) for p in self.patterns]
        every, injection = list(range(len(weak))), self.injection

        @F.arrow_udf(LOOK_TYPE)
        def look(text: pa.Array, inbound: pa.Array) -> pa.Array:
            text = _valid(text)
            clean, changed = _cleaned(text, inbound) if injection else (text, np.zeros(len(text), bool))
            spaced, leet = np.zeros(len(text), bool), [None] * len(text)
            clean_may = [None] * len(text)
            if injection:
                inside = np.asarray(inbound, bool)
                spaced = inside & _found(clean, MAY_BE_SPACED)
                rows = np.flatnonzero(changed)
                for i, may in zip(rows, _may(clean.take(pa.array(rows)), weak, injection).to_pylist(), strict=True):
                    clean_may[i] = may
                rows = np.flatnonzero(inside & ~spaced & _found(clean, LEET))
                for i, may in zip(rows, _may(_unleet(clean.take(pa.array(rows))), weak, injection).to_pylist(), strict=True):
                    leet[i] = may
                for i in np.flatnonzero(spaced):  # what joining leaves is not known here
                    leet[i] = injection
            numbers = pa.list_(pa.int32())
            return pa.StructArray.from_arrays(
                [_may(text, weak, every), pc.if_else(pa.array(changed), clean, pa.scalar(None, clean.type)), pa.array(clean_may, numbers),
                 pa.array(spaced), pa.array(leet, numbers)], names=["may", "clean", "clean_may", "spaced", "leet_may"])

        return look


#: ``may``: numbers for the text; ``clean``: its cleaned form if that differs, with ``clean_may``; ``spaced``: it may hold spaced-out
#: words; ``leet_may``: injection patterns for the text without leet digits, null if there are none.
LOOK_TYPE = "struct<may:array<int>,clean:string,clean_may:array<int>,spaced:boolean,leet_may:array<int>>"
# weaker than the pattern of spaced-out words, but not inside a longer word of ASCII letters
MAY_BE_SPACED = r"(?:^|[^0-9A-Z_a-z])(?:[0-9A-Z_a-z\x{80}-\x{10FFFF}][ .\-_*]){3}[0-9A-Z_a-z\x{80}-\x{10FFFF}]"
LEET = "[" + "".join(_char(ord(c)) for c in P.LEET_FROM) + "]"
_ZERO_WIDTH = re.compile(P.ZERO_WIDTH)
_LEET_BYTES = bytes.maketrans(P.LEET_FROM.encode(), P.LEET_TO.encode())


def _valid(text: pa.Array) -> pa.Array:
    """Texts as the JVM reads them: bytes that are no UTF-8 become replacement characters."""
    try:
        text.validate(full=True)
        return text
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", "replace") for b in text.cast(pa.binary()).to_pylist()], text.type)


def _found(text: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(text, pattern), bool)


def _may(text: pa.Array, weak: list[str | None], numbers: list[int]) -> pa.Array:
    hits = np.ones((len(text), len(numbers)), bool)
    for at, number in enumerate(numbers):
        if weak[number] is not None and len(text):
            hits[:, at] = _found(text, weak[number])
    stops = np.concatenate([[0], np.cumsum(hits.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.asarray(numbers, np.int32)[np.nonzero(hits)[1]], pa.int32()))


def _cleaned(text: pa.Array, inbound: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts without zero-width characters in NFKC, and which of them differ. ASCII is both already."""
    rows = np.flatnonzero(np.asarray(inbound, bool) & (np.asarray(pc.binary_length(text)) != np.asarray(pc.utf8_length(text))))
    changed, forms = np.zeros(len(text), bool), []
    for i, value in zip(rows, text.take(pa.array(rows)).to_pylist(), strict=True):
        form = unicodedata.normalize("NFKC", _ZERO_WIDTH.sub("", value))
        if form != value:
            changed[i] = True
            forms.append(form)
    return (pc.replace_with_mask(text, pa.array(changed), pa.array(forms, text.type)) if forms else text), changed


def _unleet(text: pa.Array) -> pa.Array:
    """Leet digits and signs are single bytes, before and after."""
    _, offsets, data = text.buffers()
    return pa.Array.from_buffers(text.type, len(text), [None, offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_LEET_BYTES))])
