"""Parts of record batches that are bounded by rows and by bytes."""

import pyarrow as pa

from callwarden.llm.common import slices


def test_slices_keep_all_rows_in_order():
    texts = ["", None, "x" * 90, "y" * 30, "é" * 40, None, "z" * 500, "a", "b", "c", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(slices(batch, 1, rows=3, size=100))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts and all(0 < p.num_rows <= 3 for p in parts)
    for p in parts:
        held = [len((t or "").encode()) for t in p.column(1).to_pylist()]
        assert sum(held) <= 100 or len([n for n in held if n]) == 1
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_words_seen_in_several_slices_are_kept_and_rare_ones_are_not(monkeypatch):
    from callwarden.llm import packing
    from callwarden.llm.queries import TOKENIZER

    known = packing._Words(packing._words(TOKENIZER).tokenizer)
    monkeypatch.setattr(packing, "_ONCE", 8)
    common = {b"the", b"the,", "naïve".encode(), b"x1"}
    for i in range(30):
        words = common | {b"rare%d" % i, b"odd%d;" % i, b"..."}
        known.learn(words)
        for w in words:
            ids = known.tokenizer.encode(w.decode(), add_special_tokens=False).ids
            assert known[w] == b"".join(n.to_bytes(4, "little") for n in ids), w
    assert common <= set(known) and b"rare3" not in known


def test_a_misspelled_term_never_lowers_a_score_and_chance_words_are_not_learned(spark):
    import numpy as np

    from callwarden.llm import toxicity

    rng = np.random.default_rng(3)
    plain = [f"w{i}x" for i in range(400)]

    def words(n):
        return [plain[i] for i in rng.integers(len(plain), size=n)]

    rows = []
    for i in range(900):
        w = words(30)
        if i % 5 == 0:
            w[7:7] = ["scumbag"] if i % 2 else ["scumbag", "blockhead"]
            w += [f"junk{i // 5 % 60}q"]  # stands in three toxic texts and in no clean one
        rows.append((i, " ".join(w)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert {"scumbag", "blockhead"} <= set(model.words) and not [w for w in model.words if w.startswith("junk")]
    assert all(model.weights[1 + i] >= 0 for i in toxicity._RISING)
    texts = [" ".join(words(40)) for _ in range(60)]
    more = [t.replace(t.split()[20], "scumbga", 1) for t in texts] + [t + " blokhead" for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts + more)) + [(500, None), (501, "")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert all(got[60 + i] >= got[i] <= got[120 + i] for i in range(60)) and got[500] == got[501]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for i, t in enumerate(texts + more):  # the whole result, with distances to every entry
        kinds = []
        for w in t.split():
            exact = w in model.words or any(w.startswith(s) for s in model.stems)
            near = any(distance(w, e) <= toxicity.errors_allowed(len(e), False) for e in model.words) or any(
                distance(w[:k], s) <= toxicity.errors_allowed(len(s), True) for s in model.stems for k in range(len(w) + 1))
            kinds.append(2 if exact else 1 if near and w not in model.harmless else 0)
        at = [n for n, k in enumerate(kinds) if k]
        dense = sum(any(n != m and abs(n - m) <= toxicity.WINDOW for m in at) for n in at)
        x = [np.log1p(kinds.count(2)), np.log1p(kinds.count(1)), 0.0, np.log1p(dense), min(1.0, 20 * len(at) / len(kinds))]
        assert abs(got[i] - 1 / (1 + np.exp(-(model.weights[0] + model.weights[1:] @ x)))) < 1e-9
