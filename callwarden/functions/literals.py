"""Literals that a regex cannot match without, taken from the pattern itself.

A text is searched with a pattern only if it holds what the pattern needs. Needs are trees of literals joined by *and* and
*or*; they are compared with the case-folded text, so they hold for patterns that ignore case as well. A pattern that cannot be
read here needs nothing and is always run: leaving a test out costs time, never a match.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import ahocorasick

#: Literals of one conjunction that are tested before the pattern runs; the longest ones.
TESTED = 3
_SET_IN_SET = re.compile(r"(?s)(?:\\.|[^\\\[])*\[\^?\]?(?:\\.|[^\\\[\]])*(?:(\[)|\])")


@dataclass(frozen=True)
class Lit:
    text: str


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


Need = Lit | All | Any | None


def needs(pattern: str, flags: str = "") -> Need:
    """What every text with a match holds, or None if nothing is known."""
    if r"\0" in pattern or nested_set(pattern):  # read differently by the JVM
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # set operations
            tree = _parser.parse(pattern, re.IGNORECASE if "i" in flags else 0)
    except (re.error, Warning, RecursionError, OverflowError):
        return None
    if tree.state.flags & re.VERBOSE:
        return None
    return _sequence(tree)


def nested_set(pattern: str) -> bool:
    """Whether a character set stands inside another one."""
    at = 0
    while m := _SET_IN_SET.match(pattern, at):
        if m.group(1):
            return True
        at = m.end()
    return False


def _flat(items) -> list:
    """Groups that hold one sequence are read as part of the sequence around them."""
    out = []
    for op, value in items:
        if op is K.SUBPATTERN:
            out += _flat(value[3])
        elif op is K.ATOMIC_GROUP:
            out += _flat(value)
        else:
            out.append((op, value))
    return out


def _sequence(items) -> Need:
    parts, run = [], ""
    for op, value in [*_flat(items), (None, None)]:
        if op is K.LITERAL and 0x20 <= value <= 0x7E:
            run += chr(value).lower()
            continue
        if run:
            parts.append(Lit(run))
            run = ""
        if op is K.BRANCH:
            parts.append(_either([_sequence(b) for b in value[1]]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] > 0:
            parts.append(_sequence(value[2]))
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    texts = [p.text for p in parts if isinstance(p, Lit)]
    parts = [p for p in parts if not (isinstance(p, Lit) and any(p.text != t and p.text in t for t in texts))]
    if not parts:
        return None
    parts.sort(key=lambda p: -_weight(p))
    return parts[0] if len(parts) == 1 else All(tuple(parts[:TESTED]))


def _either(parts: list[Need]) -> Need:
    if any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else Any(tuple(parts))


def clause(need: Need) -> frozenset[str]:
    """The most telling set of literals of which one at least must occur; empty if nothing is known."""
    if need is None:
        return frozenset()
    if isinstance(need, Lit):
        return frozenset([need.text])
    if isinstance(need, Any):
        return frozenset().union(*[clause(p) for p in need.parts])
    return max((clause(p) for p in need.parts), key=lambda c: (min(map(len, c)), -len(c)))


def _weight(need: Need) -> int:
    return min(map(len, clause(need)))


class LiteralIndex:
    """The needed literals of many patterns in one automaton: a single pass over a text names the patterns worth running."""

    def __init__(self, clauses: list[frozenset[str]]):
        self.always = [i for i, c in enumerate(clauses) if not c]
        owners: dict[str, list[int]] = {}
        for i, c in enumerate(clauses):
            for literal in c:
                owners.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton() if owners else None
        for literal, patterns in owners.items():
            self.automaton.add_word(literal, tuple(patterns))
        if owners:
            self.automaton.make_automaton()

    def candidates(self, folded: str) -> list[int]:
        """Ordinals of the patterns that may match, ascending."""
        if self.automaton is None or not folded:
            return list(self.always)
        found = {patterns for _, patterns in self.automaton.iter(folded)}
        return sorted(set(self.always).union(*found))
