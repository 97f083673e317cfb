"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from callwarden.llm import covertree, fingerprint, language, minhash, mixing, packing, pii, suffix, toxicity, urls
from callwarden.llm.queries import RULES, TOKENIZER

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(9)) for i in rng.integers(len(WORDS), size=n))


BASE = text(1, 120)
ROWS = [(1, BASE), (2, BASE), (3, BASE + " tail"), (4, None), (5, ""), (6, "one two"), (7, "one two"), (None, BASE), (8, text(2, 3000)),
        (9, text(3, 80) + " " + BASE[:400]), (10, "ab" * 300), (11, "  \n\t"), (12, "ünï cödé " * 60), (3, BASE + " tail")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, node string, comp int")


def empty(spark, schema="doc_id long, text string, source string, lang string"):
    return spark.createDataFrame([], schema)


def test_minhash(spark, docs):
    got = minhash.near_duplicates(docs, 4).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by[1] == (117, 1, True) and by[2][1:] == (1, False) and by[3][1] == 1 and by[None][1] == 1
    assert by[4] == (0, 4, True) and by[5] == (0, 5, True) and by[7][:2] == (1, 6) and by[8][1] == 8
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_suffix(spark, docs, monkeypatch):
    count = {}
    for _, t in ROWS:
        b = (t or "").encode()
        for p in range(len(b) - 199):
            count[b[p:p + 200]] = count.get(b[p:p + 200], 0) + 1
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p:p + 200]] > 1:
                gone[p:p + 200] = True
        want.append((i, len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    for bucket in (50_000, 1):
        monkeypatch.setattr(suffix, "BUCKET", bucket)
        got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(docs).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_fingerprint(spark):
    rows = [(i, t) for i, t in ROWS if i is not None][:-1]
    got = {r.doc_id: r for r in fingerprint.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ids = sorted((i for i, _ in rows), reverse=True)
    texts = {i: t or "" for i, t in rows}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        k = len(texts[i]) // 3
        edited = texts[i][:len(texts[i]) - k] + texts[after][:k]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(texts[i])
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[6].near_edited <= 1.0
    assert fingerprint.compare_edited(empty(spark)).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), ["a", "b", None][i % 3]) for i in range(300)] + [(1, None, "z")]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 301 and max(r.copies for r in got) <= 3
    total = sum(r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - total) < 1e-6
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 6
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == sum(r.copies for r in got)
    assert mixing.plan_mix(empty(spark)).count() == 0


def test_covertree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(6, 8))
    vecs = [heads[i % 6] + rng.normal(size=8) * 0.12 for i in range(240)]
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(vecs)] + [(900, vecs[0].tolist(), 0), (901, None, 0), (902, [0.0] * 8, 0),
                                                                      (903, [float("nan")] * 8, 0), (904, vecs[0].tolist(), None), (905, [1.0], 0)]
    ok = [(i, np.array(v), l) for i, v, l in rows if v is not None and l is not None and np.isfinite(v).all() and any(v)]
    near = {i: [j for j, w, m in ok if j != i and l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98] for i, v, l in ok}
    comp = {i: i for i, _, _ in rows}
    for _ in rows:
        for i, js in near.items():
            comp[i] = min([comp[i], *[comp[j] for j in js]])
    for homes in (2000, 20):
        monkeypatch.setattr(covertree, "HOMES", homes)
        monkeypatch.setattr(covertree, "LEVELS", 3)
        got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (len(near.get(i, [])), comp[i]) for i, _, _ in rows}


def test_urls(spark):
    rows = [(1, "http://a.EXAMPLE.org/es/x?y"), (2, "https://example.org/en/12"), (3, "http://b.org/"), (4, None), (5, "nothing"), (6, "http://x.com/de/#a"),
            (7, "http://x.com/de/#b"), (8, "http://com/fr/1"), (9, "ftp://myorg/"), (None, "http://b.org")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.listed) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), RULES).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block", True) and got[2][2:4] == ("example.org/en/1", "block")
    assert got[3][2:4] == ("org/", "allow") and got[4] == ("", "", None, "allow", False) == got[5] and got[6][3] == got[7][3] == "block"
    assert got[8][2] == "com/fr/" and got[9][2] is None and got[None] == ("b.org", "", None, "allow", False)
    keys = spark.range(5000).selectExpr("cast(id AS string) AS key", "id % 7 = 0 AS listed")
    cascade = urls.build_cascade(keys)
    assert cascade.mark(keys, "key", "found").where("found <> listed").count() == 0 and cascade.shards > 1


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = packing.pack(docs, TOKENIZER, capacity=256).collect()
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ROWS]
    want = sorted((len(x), s, zlib.crc32(np.array(x[s:s + 256], "<u4").tobytes())) for x in ids for s in range(0, len(x), 256))
    assert sorted((p.doc_tokens, p.start, p.ids_crc32) for p in pieces) == want
    fill = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 256 and sorted(fill) == list(range(len(fill)))
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_words_are_cut_before_punctuation(monkeypatch):
    """Ids equal those of the whole text, and a word is encoded once for all the punctuation behind it."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self):
            self.inner, self.encoded = Tokenizer.from_file(TOKENIZER), []

        def get_vocab(self):
            return self.inner.get_vocab()

        def encode(self, text, **options):
            self.encoded.append(text)
            return self.inner.encode(text, **options)

        def __getattr__(self, name):
            def batch(texts, **options):
                self.encoded += texts
                return getattr(self.inner, name)(texts, **options)
            return batch

    marks = [".", "%%%", "***", "$$$", "&&&", "###", "?!", "';", "'", "'s", "'S.", "|>", ".a"]
    texts = [f"{w}{m}" for w in ("Word", "caf\u00e9", "x\u0130", "e\u0301", "\u00d7", "a1", "\u4e2d", "\u0100", "\u00aa", "<|endoftext|>", "<|ENDOFTEXT", "") for m in marks]
    texts += [" ".join(texts), "", " ", "a\tb\nc\x0bd\x0ce\rf\x1cg\x85h\u00a0i", "%", "a" * 5000, " ".join(["a"] * 8), " ".join(["a"] * 7), "\U0001f600a. a\U0001f600.", "A<|endoftext|>B. \u00c9"]
    counting = Counting()
    words = packing._Words(counting)
    monkeypatch.setattr(packing, "_words", lambda path: words)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for part in (batch, batch.slice(3, 100), batch):  # again with known words, and from the middle of a batch
        rows = pa.Table.from_batches(packing._tokenize(TOKENIZER, 8)(iter([part]))).to_pylist()
        assert [r["doc_id"] for r in rows] == part.column(0).to_pylist()
        for row in rows:
            ids = np.array([*counting.inner.encode(texts[row["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
            assert row["doc_tokens"] == len(ids) and row["rest"] == len(ids) % 8
            assert row["crcs"] == [zlib.crc32(ids[i:i + 8].tobytes()) for i in range(0, len(ids), 8)], texts[row["doc_id"]]
    counting.encoded.clear()
    once = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([" ".join(f"qxqx\u00e9{m}" for m in ("%%%", "***", "$$$", "&&&", "###", ".", "!", ""))])], names=["doc_id", "text"])
    list(packing._tokenize(TOKENIZER, 8)(iter([once])))
    assert sum("qxqx" in text for text in counting.encoded) == 1


def test_windows_use_every_piece():
    counts = {3000: 2, 1096: 3, 700: 5, 5: 9, 4095: 1, 1: 1}
    plan = packing.plan_windows(counts)
    used = {}
    for filling, times in plan:
        assert sum(n * k for n, k in filling.items()) <= 4096
        for n, k in filling.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts and plan[0] == ({4095: 1, 1: 1}, 1) and plan[1][0] == {3000: 1, 1096: 1}


def test_language(spark):
    latin, greek = "the house of the rising sun ", "το σπίτι του ήλιου και "
    rows = [(i, (latin if i % 2 else greek) * 20, "en" if i % 2 else "el", "s") for i in range(40)]
    df = spark.createDataFrame(rows + [(100, None, None, "s"), (101, "12 34", "en", "s"), (102, latin * 9 + greek * 4, "en", "s")], "doc_id long, text string, lang string, spans string")
    got = {r.doc_id: r for r in language.identify(df, language.train(df)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0 and [s.lang for s in got[102].spans] == ["en", "el"]
    assert language.identify(df, language.train(empty(spark))).where("lang_pred <> 'und'").count() == 0


def test_viterbi_is_optimal():
    rng = np.random.default_rng(2)
    sizes = np.array([4, 0, 6, 1])
    scores = rng.normal(size=(11, 3)).astype(np.float32) * 3
    path = language.viterbi(scores, sizes, 2.0)
    from itertools import product
    start = 0
    for n in sizes:
        s = scores[start:start + n]
        value = lambda p: sum(s[i, c] for i, c in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert n == 0 or abs(value(path[start:start + n]) - max(map(value, product(range(3), repeat=int(n))))) < 1e-4
        start += n


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    words = ["idiot", "stupid", "abominable", "ass"]
    automaton = toxicity.Automaton(words, [])
    rng = np.random.default_rng(4)
    for _ in range(3000):
        w = list(words[rng.integers(4)])
        for _ in range(rng.integers(4)):
            at = int(rng.integers(len(w) + 1))
            kind = rng.integers(3)
            w[at:at + (kind != 0)] = [] if kind == 1 else [chr(97 + rng.integers(26))]
        w = "".join(w)
        best = max((2 if w == x else 1 if distance(w, x) <= toxicity.errors_allowed(len(x), False) else 0) for x in words)
        assert automaton.match(w) == best, w


def test_toxicity(spark):
    rows = [(i, text(i, 40) + (" you scumbag go away idiot" if i % 4 == 0 else "")) for i in range(200)]
    df = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "what an idjot scumbag")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(df, toxicity.train(df, labels)).collect()}
    assert all((got[i] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(200)) and got[900] == got[901] < 0.3 <= got[902]
    assert toxicity.score(df, toxicity.train(df, labels.limit(0))).count() == 203


def test_toxicity_scores_keep_the_share_of_the_classes(spark):
    """Toxic texts are one in ten; a sample that draws both classes alike must not change what a score means."""
    rows = [(i, f"{text(i % 997, 12)} {'you scumbag' if i % 10 == 0 or i % 20 == 5 else 'you'}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")
    # the lexicon is given: only the fit may depend on the sample
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_lexicon", lambda *_: (["scumbag"], []))
        whole, drawn = (toxicity.train(df, labels, sample=n) for n in (6000, 300))
    got = [{r.doc_id: r.score for r in toxicity.score(df.limit(40), m).collect()} for m in (whole, drawn)]
    assert abs(got[0][0] - 2 / 3) < 0.05  # two of three texts with the word are toxic
    assert all(abs(got[0][i] - got[1][i]) < 0.12 for i in got[0]), got


def test_pii(spark):
    def plain(t):
        out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
                if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    rng = np.random.default_rng(8)
    for _ in range(3000):
        t = "".join(rng.choice(list("a@.-+1 4(%"), size=40))
        assert pii.base_spans(t) == plain(t), t
    assert len(pii.base_spans("4111 1111 1111 1111, 10.0.0.1")) == 2
    rows = [(i, f"{text(i, 6)} zorblax wrote from bob@example.com about {text(i + 50, 5)}") for i in range(5)] + [(i, text(i, 30)) for i in range(5, 60)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.report(df).collect()}
    assert "term:" in found[0].spans and found[0].n_email == 1 and found[99].spans == "" and found[7].n_terms == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "bob@" not in clean[0] and "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and clean[7] == rows[7][1] and clean[99] is None
    assert pii.report(empty(spark)).count() == 0


def test_pii_marks_every_occurrence(spark, monkeypatch):
    rows = [(i, f"{text(i, 6)} Zorblax wrote from bob@example.com about {text(i + 50, 12)} zorblax") for i in range(5)]
    rows += [(5, f"zorblax {text(5, 4)} ZORBLAX, zorblax@example.com"), (5, f"zorblax {text(5, 4)} ZORBLAX, zorblax@example.com"), (None, "zorblax")]
    rows += [(i, text(i, 30)) for i in range(6, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (26, 15, 3):  # a filter that lets nearly all words through gives the same marks
        monkeypatch.setattr(pii, "_BITS", bits)
        for r, (i, t) in zip(sorted(pii.report(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
            inside = {a for _, a, _ in pii.base_spans(t)}
            want = {f"term:{m.start()}:{m.end()}" for m in re.finditer("zorblax", t, re.I) if m.start() not in inside}
            assert r.doc_id == i and {s for s in r.spans.split(",") if s.startswith("term:") and t[int(s.split(":")[1]):].lower().startswith("zorblax")} == want
    assert not any("zorblax" in r.text.lower() for r in pii.sanitise(df).collect())


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns and 0 < docs.count() <= before.count()
