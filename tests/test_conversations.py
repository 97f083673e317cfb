import random
import re

from callwarden.operators import conversations as V
from callwarden.rules import patterns as P


def _checked(spark, chats):
    rows = [(c, i, role, text) for c, chat in chats.items() for i, (role, text) in enumerate(chat)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    return V.check_messages(df)


def _joined(chat):
    return " ".join(t for role, t in chat if role != "assistant")


def test_a_link_may_reach_over_any_distance(spark):
    filler, link = [("user", "nothing to see here " * 300)] * 4, ("tool", "text](https://x.example/a?b=c) and more")
    chats = {
        1: [("user", "see ![pic"), *filler, link],
        2: [("user", "see ![pic"), *filler, ("user", "a ] closes"), link],
        3: [("user", "see ![pic"), *filler, ("user", "text]("), *[("user", "  ")] * 1500, ("user", "https://x.example/a?b=c)")],
        4: [("user", "see ![pic"), *filler, ("user", "text]("), ("user", "word"), ("user", "https://x.example/a?b=c)")],
        5: [("user", "see ![pic](" + " " * 5000), ("assistant", "word"), ("user", "https://x.example/a?b=c)")],
        6: [("assistant", "see ![pic"), *filler, link],
    }
    got = {r.conv_id: r.patterns for r in V.split_injection(_checked(spark, chats)).collect()}
    want = {c for c, chat in chats.items() if re.search(P.INJECTION["MARKDOWN_EXFIL"], _joined(chat))}
    assert want == {1, 3, 5} and got == {c: ["MARKDOWN_EXFIL"] for c in want}


def test_link_parts_match_the_pattern(spark):
    rng = random.Random(3)
    pieces = ["![", "]", "](", "](https://x.example/?q)", "https://x.example/?q)", "https://x.example/q)", "w", " ", "[", "\n"]
    chats = {c: ["".join(rng.choices(pieces, k=rng.randrange(4))) for _ in range(6)] for c in range(1500)}
    rows = [(c, 6, i, t) for c, chat in chats.items() for i, t in enumerate(chat)]
    got = V._split_links(spark.createDataFrame(rows, "conv_id long, messages long, turn int, sanitized string"))
    alone = {c for c, chat in chats.items() if any(re.search(P.INJECTION["MARKDOWN_EXFIL"], t) for t in chat)}
    want = {c for c, chat in chats.items() if re.search(P.INJECTION["MARKDOWN_EXFIL"], " ".join(chat))}
    found = {r.conv_id for r in got.collect()}
    assert found <= want and want - alone <= found and len(want - alone) > 20
