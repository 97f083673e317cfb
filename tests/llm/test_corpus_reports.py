"""Filter audit, ranked search and page extraction against brute force on small tables."""

import html
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from callwarden.llm import audit, mainpart, ranking

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def words(seed, n, vocabulary=WORDS):
    rng = np.random.default_rng(seed)
    return " ".join(vocabulary[i] for i in rng.integers(len(vocabulary), size=n))


DOCS = [(i, words(i % 9, 20 + 7 * (i % 9)), ["a", "b", None][i % 3]) for i in range(40)]
DOCS += [(50, None, "a"), (51, "", "a"), (52, "", None), (None, "", "b"), (None, DOCS[3][1], "a"), (53, "SHOUT Now", "c"), (54, "a # b", "c"),
         (54, "a # b", "c"), (54, "other words", "c"), (55, " ".join(f"w{i}" for i in range(30_000)), "hot"), (56, "Über ÄÖÜ   naïve", "c")]
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1), (53, None, 1)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def failing(rows):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield i, part or "", {f for f, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t),
            i is not None and i > smallest[t])) if bad}


def test_audit_equals_replay_of_every_order(spark):
    docs = frame(spark, [(*r, 7, "x") for r in DOCS], "doc_id long, text string, source string, mask int, part string")
    labels = frame(spark, LABELS, "doc_id long, quality int, toxic int")
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, t in LABELS if t == 1 and i is not None}
    cases, want = list(failing(DOCS)), {}
    for part in {p for _, p, _ in cases}:
        own = [(i, f) for i, p, f in cases if p == part]
        sums = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i, fails in left if f in fails]
                after = [(i, fails) for i, fails in left if f not in fails]
                every = sum(f in fails for _, fails in own)
                sums[f] += len(gone)
                want[part, "".join(order), step] = [f, len(after), len(gone), every - len(gone), sum(fails == {f} for _, fails in own),
                                                    sum(i in good for i in gone), sum(i in toxic for i in gone)]
                left = after
        for key, row in want.items():
            if key[0] == part:
                row.append(sums[row[0]])
    got = audit.audit(docs, labels).collect()
    assert {(r.part, r.filter_order, r.step): [r["filter"], *r[4:]] for r in got} == want and len(got) == len(want)
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert audit.audit(docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_paths_through_the_lattice():
    for before in ([], [("A", "C"), ("B", "C")], [("E", "A")]):
        lattice = audit.Lattice("ABCDE", before)
        allowed = [o for o in permutations("ABCDE") if all(o.index(a) < o.index(b) for a, b in before)]
        assert lattice.forward[31] == lattice.backward[0] == len(allowed)
        through = Counter((sum(1 << "ABCDE".index(f) for f in o[:k]), "ABCDE".index(o[k])) for o in allowed for k in range(5))
        assert {e: lattice.paths(*e) for e in lattice.edges if lattice.paths(*e)} == through
        assert len(lattice.steps()) == 5 * len(allowed)
    with pytest.raises(ValueError):
        audit.Lattice("ABCDEFGH")


TEXTS = [(i, words(i, 5 + 11 * i, WORDS + ["Ünï", "9"])) for i in range(25)]
TEXTS += [(30, None), (31, ""), (32, "-- // "), (33, TEXTS[4][1]), (33, TEXTS[4][1]), (None, TEXTS[4][1]), (34, "alpha_beta\x7fgamma"),
          (35, words(3, 40_000, WORDS + [f"x{i}" for i in range(3000)]))]
ITEMS = [(i, words(100 + i, 12, WORDS + ["ÜNÏ", "Ünï", "9", "absent"])) for i in range(12)] + [(12, None), (13, "..."), (14, "absent"), (3, words(103, 12, WORDS + ["ÜNÏ", "Ünï", "9", "absent"])),
                                                                                     (15, words(5, 30_000, WORDS + [f"x{i}" for i in range(3000)]))]


def brute_ranking(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [(i, Counter(re.findall(pattern, (t or "").translate(lower)))) for i, t in docs]
    held = [(i, b, b.total()) for i, b in bags if b]
    df = Counter(t for _, b, _ in held for t in b)
    size = sum(n for *_, n in held)
    out = {}
    for item, text in set(items):
        want = re.findall(pattern, (text or "").translate(lower))
        scored = []
        for i, b, n in held:
            m = 25 + 75 * n * len(held) // size
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in want if b[t])
            if s > 0:
                scored.append((-s, i is None, i))
        for at, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1):
            out[item, at] = (i, -s)
    return out


def test_ranking_equals_brute_force(spark, monkeypatch):
    docs = frame(spark, [(i, t, 1, 2) for i, t in TEXTS], "doc_id long, text string, n int, score int").repartition(3)
    items = frame(spark, [(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    want = brute_ranking(TEXTS, ITEMS, 4)
    for terms in (50_000, 20):
        monkeypatch.setattr(ranking, "BLOCK_TERMS", terms)
        got = ranking.rank(docs, items, k=4).collect()
        assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got} == want and len(got) == len(want)
    assert ranking.rank(docs.limit(0), items).count() == 0 == ranking.rank(docs, items.limit(0)).count()


def test_shared_sets_are_evaluated_once():
    items = [ranking.terms_of(words(i, 9)) for i in range(30)]
    plan = ranking.SharedPlan(items)
    assert plan.levels and sum(len(p) for p in plan.parts) + sum(len(a) for a, _ in plan.levels) < sum(len(set(i)) for i in items)
    rng = np.random.default_rng(1)
    gains, weights = rng.integers(1000, size=(len(plan.terms), 7)), rng.integers(100, size=len(plan.terms))
    want = [sum(gains[plan.terms.index(t)] * weights[plan.terms.index(t)] for t in i) for i in items]
    assert np.array_equal(plan.scores(gains, weights), want)


PROSE = "This is the main text of the page and it has what is said to be of use to all who read it."
SPAM = "Buy the best of all that we have for you now and save more than you would with the others."
PAGES = {
    "": "", "no tags at all": "", "<p>": "", PROSE: PROSE,
    f"<nav><a href='/'>Home</a> {SPAM}</nav><article><h1>A &amp;amp; B</h1><p>{PROSE}<p>Short.<p>zq wk%% vv## xj qq yy ww kk zz pp</article><footer>{SPAM}</footer>":
        f"A &amp; B\n\n{PROSE}\n\nShort.\n\nzq wk%% vv## xj qq yy ww kk zz pp",
    f"<header>{SPAM}</header><div class='cookie-notice'>{SPAM}</div><h2>Title</h2><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p><aside>{SPAM}</aside><form>{SPAM}</form>":
        f"Title\n\n{PROSE}\n\nYes.\n\n{PROSE}",
    f"<article><header><h1>T</h1></header><p>{PROSE}</p><div class='ad'>{SPAM}</div><p>End.</p></article><div id='comments'><article><p>{PROSE}</p></article></div>":
        f"T\n\n{PROSE}\n\nEnd.",
    f"<script>if (a<b) '</p>'</script><style>p{{}}</style><!-- {PROSE} --><p title='a > b'>1 < 2 &lt;b&gt; {PROSE}\n\t&nbsp;x<br>y</p><ul><li><a href=x>{SPAM}</a></ul>":
        f"1 < 2 <b> {PROSE} x y",
    f"<p>{PROSE}</p><script>{SPAM}": PROSE, f"<p>{PROSE}</p><!-- {SPAM}": PROSE, f"</div></p><p>{PROSE}": PROSE,
    "<p>" + (PROSE + " ") * 3000: " ".join([PROSE] * 3000),
    f"<div class='layout sidebar-left'><main><p>{PROSE}</p><p class='notice'>{SPAM}<p>Last words.</main></div>": f"{PROSE}\n\nLast words.",
}


def test_main_text_of_pages(spark):
    rows = [(i, f"http://x/{i}", page, "t", 5) for i, page in enumerate(PAGES)] + [(90, None, None, "t", 5), (90, None, None, "t", 5), (None, "u", PROSE, None, None)]
    got = mainpart.extract(frame(spark, rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, (page, want) in enumerate(PAGES.items()):
        assert (by[i].text, by[i].n_chars, by[i].url) == (want, len(want), f"http://x/{i}"), page[:200]
    assert by[90].text == "" and by[None].text == PROSE
    assert mainpart.extract(frame(spark, [], "page_id long, url string, html string")).count() == 0


def test_given_pages_keep_their_article(spark):
    rows = mainpart.extract(pages := spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()
    source = {r.page_id: r.html for r in pages.collect()}
    assert rows
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1).replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        parts = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(p for p in parts if p)


def test_broken_markup_is_read_in_linear_time():
    for hostile in ('<a "' * 100_000, '<p x="' * 100_000, "<" * 200_000, "<a " * 100_000, "<!--" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<script>" * 50_000):
        assert isinstance(mainpart.main_text(hostile), str)
