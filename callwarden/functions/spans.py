"""Span extraction, merging and redaction as Column expressions.

A span is ``struct<start:int, end:int, label:string>`` with 0-based, end-exclusive character offsets.
Everything stays in the JVM. The i-th match of a pattern starts after the i-th gap that ``split``
leaves around the matches, so offsets follow from the lengths of gaps and matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.rules.patterns import KEYWORD_PATTERN

SPAN_TYPE = "struct<start:int,end:int,label:string>"
SPANS_TYPE = f"array<{SPAN_TYPE}>"
HITS_TYPE = "array<struct<start:int,end:int,value:string>>"
MATCHED_TYPE = "array<struct<name:string,pattern:string,label:string,group:int>>"


def pin(value: Column) -> Column:
    """The value itself, but never moved or copied by the optimizer.

    Filters above a projection are otherwise rewritten in terms of its inputs, which would run the detectors again
    inside the filter, and constraint inference would multiply long expressions. An expression that is not
    deterministic is left where it is.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def stage(df: DataFrame, keep: list[str] | None = None, **columns: Column) -> DataFrame:
    """One evaluation step: the kept columns and new pinned ones."""
    return df.select(*(["*"] if keep is None else keep), *[pin(c).alias(n) for n, c in columns.items()])


def empty_spans() -> Column:
    return F.array().cast(SPANS_TYPE)


def span(start: Column, end: Column, label: Column | str) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), name.alias("label"))


@dataclass(frozen=True)
class Rule:
    """One pattern; ``applies`` is an SQL condition on the row."""

    name: str
    pattern: str
    label: str
    group: int = 0
    applies: str | None = None


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values: list[str]) -> str:
    return "array(" + ", ".join(sql_text(v) for v in values) + ")"


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def fold_case(text: Column) -> Column:
    """Lower case that also folds the letters a Unicode-aware, case-blind regex treats as s, k and i."""
    odd = any_word(text, list("ſKıİ"))
    return F.when(odd, F.lower(F.translate(text, "ſKıİ", "skii"))).otherwise(F.lower(text))


def keywords(folded: Column) -> Column:
    """The pattern keywords that occur in a folded text: one pass serves every pattern."""
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(KEYWORD_PATTERN), F.lit(0)))


def find_hits(text: Column, pattern: Column, group: Column) -> Column:
    """All matches as ``(start, end, value)``. With a group, the span of that group, which must end the match."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(HITS_TYPE).alias("out"))

    def rows(whole: Column) -> Column:
        values = F.when(group == 0, whole).otherwise(F.regexp_extract_all(text, pattern, group))
        matches = F.zip_with(whole, values, lambda m, v: F.struct(F.length(m).alias("n"), v.alias("value")))
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        # the gap after the last match pairs with no match and is dropped
        return F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), lambda r: r["m"].isNotNull())

    def step(acc: Column, row: Column) -> Column:
        end = acc["pos"] + row["gap"] + row["m"]["n"]
        hit = F.struct(
            (end - F.length(row["m"]["value"])).alias("start"), end.alias("end"), row["m"]["value"].alias("value")
        )
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(hit)).alias("out"))

    # a list of one keeps what is found for both uses
    return F.flatten(F.transform(F.array(found), lambda w: F.when(
        F.size(w) > 0, F.aggregate(rows(w), start, step, lambda acc: acc["out"])).otherwise(F.array().cast(HITS_TYPE))))


def matched(text: str, rules: list[Rule], may: Callable[[str], str] | None = None, sure: bool = True) -> str:
    """SQL for the rules whose pattern occurs: ``array<struct<name,pattern,label,group>>``.

    ``text`` names a column or lambda variable; ``may`` gives the SQL that a pattern may match it (:class:`hints.Hints`). Each rule costs
    at most one ``rlike``; nothing is extracted yet. If not ``sure``, the rules that may occur, for those that are only extracted
    afterwards. SQL text keeps plan building fast.
    """
    cases = []
    for rule in rules:
        tests = [rule.applies] if rule.applies else []
        if may is not None:
            tests.append(may(rule.pattern))
        if sure:
            tests.append(f"rlike({text}, {sql_text(rule.pattern)})")
        entry = (f"named_struct('name', {sql_text(rule.name)}, 'pattern', {sql_text(rule.pattern)}, "
                 f"'label', {sql_text(rule.label)}, 'group', {rule.group})")
        cases.append(f"CASE WHEN {' AND '.join(tests)} THEN {entry} END")
    if not cases:
        return f"cast(array() AS {MATCHED_TYPE})"
    return f"filter(array({', '.join(cases)}), r -> r IS NOT NULL)"


def extract(text: Column, rules: Column, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """Spans of the matched rules, in rule order; ``keep(name, value)`` validates each match."""

    def of_rule(rule: Column) -> Column:
        hits = find_hits(text, rule["pattern"], rule["group"])
        if keep is not None:
            hits = F.filter(hits, lambda h: keep(rule["name"], h["value"]))
        return F.transform(hits, lambda h: span(h["start"], h["end"], rule["label"]))

    return F.flatten(F.transform(rules, of_rule))


def merge_spans(spans: Column) -> Column:
    """Sort by (start, end, label) and join overlapping spans; touching spans stay apart, the first label wins."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = span(last["start"], F.greatest(last["end"], s["end"]), last["label"])
        return F.when(
            (F.size(acc) > 0) & (s["start"] < last["end"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)),
        ).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty_spans(), step)


def redact(text: Column, spans: Column) -> Column:
    """Replace every merged span with ``[REDACTED:label]``."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        mark = F.concat(F.lit("[REDACTED:"), s["label"], F.lit("]"))
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], kept, mark).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))

    return F.aggregate(merge_spans(spans), start, step, finish)


def span_labels(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"])))
