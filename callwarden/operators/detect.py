"""Detectors: personal data, credentials, injection, signatures and manipulation risk."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from callwarden.functions import spans as S
from callwarden.functions.checksums import VALIDATORS
from callwarden.functions.literals import LiteralIndex, clause, needs
from callwarden.functions.spans import Rule
from callwarden.rules import patterns as P
from callwarden.rules.feed import TARGETS
from callwarden.rules.patterns import java

ALL_ENTITIES = list(P.PII)
INBOUND = ["user_input", "tool_results", "file_content"]
STRINGS = "array<string>"


def rule(name: str, pattern: str, label: str | None = None, group: int = 0) -> Rule:
    return Rule(name, java(pattern), label or name, group)


# ---------------------------------------------------------------- personal data


def pii_rules(entities: list[str] | None = None) -> list[Rule]:
    """Rules of the entities. Cards also have one for whole numbers, as digits beside a number can join its match and fail the check."""
    wanted = ALL_ENTITIES if entities is None else entities
    rules = [rule(e, P.PII[e]) for e in wanted]
    if "CREDIT_CARD" in wanted:
        rules.append(rule("CARD_NUMBER", P.CARD_NUMBER, "CREDIT_CARD"))
    return rules


def checksum_ok(name: Column, value: Column) -> Column:
    ok = F.lit(True)
    for entity, test in VALIDATORS.items():
        ok = F.when(name == entity, test(value)).otherwise(ok)
    return ok


def pii_spans(text: Column, matched: Column) -> Column:
    """Checked and merged spans of the matched entity types."""
    return S.merge_spans(S.extract(text, matched, checksum_ok))


# ---------------------------------------------------------------- credentials


def looks_like_password(value: Column) -> Column:
    v = F.regexp_replace(value, r"[.!?)]+$", "")
    digit = v.rlike(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")
    letter_and_symbol = v.rlike(r"\p{L}") & v.rlike(r"[^\p{L}\p{N}]")
    mixed_case = F.substring(v, F.lit(2), F.length(v)).rlike(r"\p{IsUppercase}") & v.rlike(r"\p{IsLowercase}")
    return (F.length(v) >= 6) & ~F.contains(v, F.lit("://")) & (digit | letter_and_symbol | mixed_case)


def plain_password(value: Column) -> Column:
    w = F.regexp_replace(F.lower(value), r"[.!?)]+$", "")
    words = F.split(F.lit(" ".join(P.NOT_A_PASSWORD)), " ")
    return (F.length(w) >= 4) & ~F.array_contains(words, w) & ~w.rlike(java(P.VERB_ENDING))


def secret_rules() -> list[Rule]:
    """Machine credentials, then credentials in plain words, where only the value is reported."""
    return [rule(n, rx) for n, rx in P.SECRETS.items()] + [
        rule("PASSWORD_PHRASE", P.PASSWORD_PHRASE, "PASSWORD", group=1),
        rule("PASSWORD_STRONG", P.PASSWORD_STRONG, "PASSWORD", group=1),
        rule("PIN_PHRASE", P.PIN_PHRASE, "PIN", group=1),
    ]


def credential_ok(name: Column, value: Column) -> Column:
    return (
        F.when(name == "PASSWORD_PHRASE", looks_like_password(value))
        .when(name == "PASSWORD_STRONG", plain_password(value))
        .otherwise(True)
    )


def secret_spans(text: Column, matched: Column) -> Column:
    return S.merge_spans(S.extract(text, matched, credential_ok))


# ---------------------------------------------------------------- injection


def injection_rules() -> list[Rule]:
    return [rule(n, rx) for n, rx in P.INJECTION.items()]


def matched_names(text: str, rules: list[Rule], may: Callable[[str], str] | None = None) -> str:
    """SQL for the names of the matching rules."""
    return f"transform({S.matched(text, rules, may)}, r -> r.name)"


def payload_names(payloads: str) -> str:
    """SQL for the names of the injection patterns matched inside any decoded payload."""
    return f"array_distinct(flatten(transform({payloads}, v -> {matched_names('v', injection_rules())})))"


def widen(text: Column, hidden: Column, start: Column, end: Column, label: Column) -> Column:
    """Grow a hit to its hidden markup block, or else to the sentence or line around it."""
    block = F.try_element_at(F.filter(hidden, lambda b: (b["start"] <= start) & (start < b["end"])), F.lit(1))
    before = F.substring(text, F.lit(1), start)
    lead = F.least(F.length(F.substring_index(before, "\n", -1)), F.length(F.substring_index(before, ". ", -1)))
    after = F.substring(text, end + 1, F.length(text))
    line, stop = F.instr(after, "\n"), F.instr(after, ". ")
    reach = F.least(F.when(line > 0, line), F.when(stop > 0, stop))
    return S.span(
        F.coalesce(block["start"], start - lead),
        F.coalesce(block["end"], end + reach, F.length(text)),
        label,
    )


def hidden_rules() -> list[Rule]:
    return [Rule("HIDDEN", java(P.HIDDEN_BLOCK), "HIDDEN")]


def injection_spans(text: Column, matched: Column, hidden: Column) -> Column:
    """Merged, widened spans of the patterns that match the text itself."""
    return S.merge_spans(
        F.transform(S.extract(text, matched), lambda h: widen(text, hidden, h["start"], h["end"], h["label"]))
    )


# ---------------------------------------------------------------- signatures


#: Up to this many patterns become expressions of the plan; more are looked up in an index of their literals.
INLINE = 200


def feed_patterns(feed: list[dict], target: str | None = None) -> list[dict]:
    """The enabled regex matchers of a feed, in feed order; with a target only those that apply to it."""
    return [r for r in feed if r["kind"] == "regex" and r.get("enabled") is not False
            and (target is None or target in (r.get("targets") or TARGETS))]


def feed_pattern(row: dict) -> str:
    return java(row["pattern"], "s" + ("i" if "i" in (row.get("flags") or "") else ""))


def inline_signatures(feed: list[dict], target: str, tool: str, only: str | None = None) -> list[Rule] | None:
    """The matchers of a feed as rules, in feed order, or None if there are more than ``INLINE``; ``only`` names the target if all rows share it."""
    rows = feed_patterns(feed, only)
    if len(rows) > INLINE:
        return None
    rules = []
    for row in rows:
        applies = [] if only else [f"array_contains({S.sql_array(row.get('targets') or TARGETS)}, {target})"]
        if row.get("tools") is not None:
            applies.append(f"coalesce(array_contains({S.sql_array(row['tools'])}, {tool}), false)")
        rules.append(Rule(row["id"], feed_pattern(row), row["id"], applies=" AND ".join(applies) or None))
    return rules


def picked_signatures(text: str, folded: Column, target: str, tool: str, feed: list[dict], only: str | None = None) -> Column:
    """The matchers of a large feed that occur in the text and apply to its target and tool, in feed order.

    A single pass of an automaton over the folded text picks the matchers whose literals occur; only these are tried, without a shuffle.
    """
    picked = _picker(feed_patterns(feed, only))(folded, F.col(target), F.col(tool))
    return F.filter(picked, lambda r: F.rlike(F.col(text), r["pattern"]))


def _picker(rows: list[dict]):
    """An Arrow function of (folded text, target, tool): the matchers whose literals occur. A task builds the index once."""
    clauses = [clause(needs(r["pattern"], r.get("flags") or "")) for r in rows]
    entries = [{"name": r["id"], "pattern": feed_pattern(r), "label": r["id"], "group": 0} for r in rows]
    targets = [frozenset(r.get("targets") or TARGETS) for r in rows]
    tools = [None if r.get("tools") is None else frozenset(r["tools"]) for r in rows]
    kept: list[LiteralIndex] = []

    @F.arrow_udf(S.MATCHED_TYPE)
    def pick(folded: pa.Array, target: pa.Array, tool: pa.Array) -> pa.Array:
        if not kept:
            kept.append(LiteralIndex(clauses))
        out = [[entries[i] for i in kept[0].candidates(f) if t in targets[i] and (tools[i] is None or u in tools[i])]
               for f, t, u in zip(folded.to_pylist(), target.to_pylist(), tool.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("name", pa.string()), ("pattern", pa.string()), ("label", pa.string()), ("group", pa.int32())])))

    return pick


def signature_hits(text: Column, matched: Column) -> Column:
    """``array<struct<id,spans>>``; of several matching patterns of one signature the first counts."""
    first = F.filter(
        matched,
        lambda r, i: ~F.exists(F.slice(matched, F.lit(1), i), lambda e: e["name"] == r["name"]),
    )
    return F.transform(
        first,
        lambda r: F.struct(
            r["name"].alias("id"),
            F.transform(
                find_all(text, r["pattern"]), lambda h: S.span(h["start"], h["end"], r["name"])
            ).alias("spans"),
        ),
    )


def find_all(text: Column, pattern: Column) -> Column:
    return S.find_hits(text, pattern, F.lit(0))


# ---------------------------------------------------------------- manipulation risk


def risk_rules() -> list[Rule]:
    return [rule(n, rx) for n, rx in P.RISK_PATTERNS.items()]


def risk_features(text: str, may: Callable[[str], str], injected: Column) -> Column:
    """Names of the manipulation features present, in the order of their weights."""
    override = F.when(injected, F.array(F.lit("instruction_override"))).otherwise(F.array().cast(STRINGS))
    return F.concat(override, F.expr(matched_names(text, risk_rules(), may)))


def risk_score(names: Column) -> Column:
    """Noisy-OR of the weights. All combinations of the six features are scored up front, so the stored
    value is the correctly rounded one and no row rounds a binary fraction of its own."""
    weights = list(P.RISK_WEIGHTS.items())
    scores = []
    for present in product([False, True], repeat=len(weights)):
        safe = 1.0
        for (_, w), on in zip(weights, present):
            safe *= 1 - w if on else 1.0
        scores.append(round(1 - safe, 3))
    table = F.expr("array(" + ", ".join(f"{s}D" for s in scores) + ")")
    index = F.lit(1)
    for i, (name, _) in enumerate(weights):
        index = index + F.when(F.array_contains(names, name), 1 << (len(weights) - 1 - i)).otherwise(0)
    return F.element_at(table, index)


def risk_label(names: Column) -> Column:
    return (
        F.when(F.array_contains(names, "exfiltration_request"), "exfiltration")
        .when(F.size(names) > 0, "injection")
        .otherwise("benign")
    )


def risk_reason(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("no manipulation features")
