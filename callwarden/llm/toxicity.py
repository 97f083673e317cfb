"""Toxicity scores from a learned lexicon.

The lexicon (words, and stems that inflected words begin with) is a trie. Its product with Levenshtein automata is one automaton whose
states hold trie nodes with the errors spent so far; it is made deterministic step by step as words are read, so a word costs one
look-up a letter. Hits are weighed in a window of neighbouring words: hits in quotation marks or next to words of report count as
quoted, several hits close together as abuse. A logistic regression turns the counts into a score.
"""

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import crc_bucket, documents, store

#: Labelled texts of each class that are learned from, at most.
SAMPLE = 8000
#: Expected number of lexicon entries that stand in toxic texts by chance.
CHANCE = 0.05
STEM = (4, 6)
WINDOW = 12
THRESHOLD = 0.3
#: Tenths of the sample that the lexicon is learned from; the weights are fitted on the others, whose words it has not seen.
LEARN = 6
_KNOWN = 60_000
_STATES = 50_000
_WORD = re.compile(r"[^\W_]+")
_QUOTES = "\"'«»‘’‚‛“”„‹›`"
#: Words that report speech, in the languages served.
REPORT = frozenset("said says quoted quote called wrote reported sagte sagt schrieb zitat dijo dice escribió cita dit disait écrit citation".split())
FEATURES = ["exact", "fuzzy", "quoted", "dense", "share"]
#: Features that never make a text less toxic.
_RISING = (0, 1, 3, 4)


def errors_allowed(length: int, stem: bool) -> int:
    """Short entries must match exactly: one edit of them reaches too many ordinary words."""
    if stem:
        return 1 if length >= 6 else 0
    return 2 if length >= 9 else 1 if length >= 5 else 0


class Automaton:
    """Lexicon trie with Levenshtein automata. ``match`` gives 0 (no entry), 1 (with errors) or 2 (exact)."""

    def __init__(self, words: list[str], stems: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word_limit, self.stem_limit, self.reach = [-1], [-1], [0]
        for entry, stem in [*[(w, False) for w in words], *[(s, True) for s in stems]]:
            if not entry:
                continue
            limit, node = errors_allowed(len(entry), stem), 0
            self.reach[0] = max(self.reach[0], limit)
            for letter in entry:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.word_limit.append(-1)
                    self.stem_limit.append(-1)
                    self.reach.append(0)
                node = self.children[node][letter]
                self.reach[node] = max(self.reach[node], limit)
            which = self.stem_limit if stem else self.word_limit
            which[node] = max(which[node], limit)
        self._forget()

    def _forget(self) -> None:
        self.sets: list[bytes] = []
        self.numbers: dict[bytes, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.stem: list[int] = []
        self.first = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Close ``{node: fewest errors}`` over entry letters that a word leaves out; number the result."""
        todo = list(nodes.items())
        while todo:
            node, spent = todo.pop()
            for child in self.children[node].values():
                if spent + 1 <= self.reach[child] and nodes.get(child, 9) > spent + 1:
                    nodes[child] = spent + 1
                    todo.append((child, spent + 1))
        key = array("i", [x for pair in sorted(nodes.items()) for x in pair]).tobytes()  # compact: states are many
        at = self.numbers.get(key)
        if at is None:
            at = self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append(max((2 if e == 0 else 1 for n, e in nodes.items() if e <= self.word_limit[n]), default=0))
            self.stem.append(max((2 if e == 0 else 1 for n, e in nodes.items() if e <= self.stem_limit[n]), default=0))
        return at

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        held = array("i", self.sets[state])
        for node, spent in zip(held[::2], held[1::2], strict=True):
            for edge, child in self.children[node].items():
                cost = spent + (edge != letter)
                if cost <= self.reach[child] and after.get(child, 9) > cost:
                    after[child] = cost
            if spent + 1 <= self.reach[node] and after.get(node, 9) > spent + 1:  # a letter too many
                after[node] = spent + 1
        to = self.steps[state][letter] = self._state(after)
        return to

    def match(self, word: str) -> int:
        if len(self.sets) > _STATES:
            self._forget()
        state, found = self.first, 0
        for letter in word:
            to = self.steps[state].get(letter)
            state = self._step(state, letter) if to is None else to
            found = max(found, self.stem[state])
            if found == 2 or not self.sets[state]:
                return found
        return max(found, self.ends[state])


class Model:
    def __init__(self, words: list[str], stems: list[str], harmless: set[str], weights: np.ndarray):
        self.words, self.stems, self.harmless, self.weights = words, stems, harmless, weights


def _features(text: str, hits: dict[str, int], find) -> list[float]:
    """Counts of exact, fuzzy and quoted hits, of hits with another one within the window, and hits by length."""
    lowered = text.lower()
    found: list[tuple[int, int, int, str]] = []
    total = 0
    for total, m in enumerate(_WORD.finditer(lowered), 1):  # noqa: B007
        word = m.group()
        kind = hits.get(word)
        if kind is None:
            kind = find(word)
        if kind:
            found.append((total, m.start(), m.end(), word)) if kind == 2 else found.append((total, m.start(), -m.end(), word))
    exact = fuzzy = quoted = dense = 0
    for i, (at, start, end, _) in enumerate(found):
        stop = abs(end)
        around = lowered[max(0, start - 60):start].split()[-4:]
        mark = lowered[start - 1:start]
        if (mark and mark in _QUOTES and lowered[stop:stop + 3].strip(".,!?;: ")[:1] in tuple(_QUOTES)) or not REPORT.isdisjoint(w.strip(".,:;" + _QUOTES) for w in around):
            quoted += 1
        elif end > 0:
            exact += 1
        else:
            fuzzy += 1
        if (i and at - found[i - 1][0] <= WINDOW) or (i + 1 < len(found) and found[i + 1][0] - at <= WINDOW):
            dense += 1
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(dense), min(1.0, 20 * (exact + fuzzy) / max(total, 1))]


@lru_cache(maxsize=1)
def _shared_finder(words: tuple[str, ...], stems: tuple[str, ...], harmless: frozenset[str]):
    """One automaton and one table of judged words for all tasks of a Python worker. A full table is kept: it holds the common words."""
    automaton = Automaton(list(words), list(stems))
    hits: dict[str, int] = {}

    def find(word: str) -> int:
        kind = automaton.match(word)
        kind = 0 if kind == 1 and word in harmless else kind
        if len(hits) < _KNOWN:
            hits[word] = kind
        return kind
    return hits, find


def _finder(model: Model):
    return _shared_finder(tuple(model.words), tuple(model.stems), frozenset(model.harmless))


def _score(model: Model, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, find = _finder(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = np.array([_features(t or "", hits, find) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
                if raw:
                    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, i]) for i in range(x.shape[1])]], names=["toxic", *FEATURES])
                else:
                    z = np.clip(x @ model.weights[1:] + model.weights[0], -30, 30)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])
    return run


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class that hold a word or a stem, summed up before they are shuffled."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            counts[toxic].update(words)
            counts[toxic].update({w[:n] + "*" for w in words for n in range(STEM[0], STEM[1] + 1) if len(w) >= n})
        terms = list({*counts[0], *counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "pos", "neg"])


def _near_misses(model: Model):
    """Words of clean texts that would match with errors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.words, model.stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if automaton.match(w) == 1], pa.string())], names=["word"])
    return run


def _fit(x: np.ndarray, y: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; a row counts ``times``. Hits may not lower a score: such weights are 0, the others refitted."""
    x = np.hstack([np.ones((len(x), 1)), x])
    used = list(range(x.shape[1]))
    while True:
        part, w = x[:, used], np.zeros(len(used))
        ridge = np.diag([1e-3, *[0.05] * (len(used) - 1)])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            w = w - np.linalg.solve((part * (times * p * (1 - p))[:, None]).T @ part + ridge, part.T @ (times * (p - y)) + ridge @ w)
        falling = [c for c, v in zip(used, w, strict=True) if c - 1 in _RISING and v < 0]
        if not falling:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        used = [c for c in used if c not in falling]


def _lexicon(terms: DataFrame, positives: int, negatives: int) -> tuple[list[str], list[str]]:
    """Entries that toxic texts hold far more often than clean ones, and not by chance.

    A term that ignores the classes reaches its share of toxic texts with probability exp(-n KL(share, base)) at most; entries are the
    terms for which this bound times the number of terms is below ``CHANCE``. A stem must stand in clearly more texts than its best word;
    a word is left out if a stem covers it and allows as many errors. There are no more entries than the bounded sample supports.
    """
    base = F.lit(positives / max(positives + negatives, 1))
    n, q = F.col("pos") + F.col("neg"), F.col("pos") / (F.col("pos") + F.col("neg"))
    unlikely = F.col("pos") * F.log(q / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - q) / (1 - base))).otherwise(0.0)
    rate = F.col("neg") / max(negatives, 1) * max(positives, 1)
    needed = math.log(max(terms.count(), 1) / CHANCE)
    rows = terms.where((n > 0) & (q > base) & (rate <= F.col("pos") * 0.02) & (unlikely >= needed)).collect()
    counts = {r["term"]: r["pos"] for r in sorted(rows, key=lambda r: r["term"])}
    words = [t for t in counts if not t.endswith("*") and len(t) >= 3]
    best: dict[str, int] = {}
    for w in words:
        for k in range(STEM[0], STEM[1] + 1):
            best[w[:k]] = max(best.get(w[:k], 0), counts[w])
    stems: list[str] = []
    for term in sorted((t for t in counts if t.endswith("*")), key=lambda t: (len(t), t)):
        body = term[:-1]
        if counts[term] >= 1.2 * best.get(body, 0) and not any(body.startswith(s) for s in stems):
            stems.append(body)
    covered = {w for w in words for s in stems if w.startswith(s) and errors_allowed(len(w), False) <= errors_allowed(len(s), True)}
    return [w for w in words if w not in covered], stems


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """One text of those that share the least hash of four words in a row; near copies mostly do, other texts do not."""
    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 4, F.lit(0))), lambda i: F.xxhash64(F.slice("_w", i + 1, F.lit(4))))
    return rows.withColumn("_w", words).groupBy("toxic", F.array_min(hashes).alias("_h")).agg(F.min("text").alias("text")).select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled texts of each class at most, chosen by a hash of the id. The lexicon counts copies and near copies once.

    In the regression a text counts for all those of its class that it was drawn from, so a score is a probability at the share of
    toxic texts in ``labels``, however large they are.
    """
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    share = [max(1, int(min(1.0, sample / max(sizes.get(k, 0), 1)) * 1_000_000)) for k in (0, 1)]
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    # bounded: about two samples of ids
    chosen = documents(docs).join(F.broadcast(drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id").select("toxic", "text")
    chosen = store(chosen, "toxic-sample")
    learn = F.pmod(F.xxhash64("text", F.lit(9)), F.lit(10)) < LEARN
    lexical, fitting = _one_of_copies(chosen.where(learn)), chosen.where(~learn)
    terms = store(lexical.mapInArrow(_terms, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-terms")
    n = {r["toxic"]: r["count"] for r in lexical.groupBy("toxic").count().collect()}
    words, stems = _lexicon(terms, n.get(1, 0), n.get(0, 0))
    model = Model(words, stems, set(), np.zeros(len(FEATURES) + 1))
    clean = terms.where("neg > 0").where(~F.col("term").endswith("*")).select("term")
    model.harmless = {r["word"] for r in clean.mapInArrow(_near_misses(model), "word string").collect()}
    schema = "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = np.array([list(r) for r in fitting.mapInArrow(_score(model, True), schema).collect()], float).reshape(-1, len(FEATURES) + 1)
    if len(rows) and 0 < rows[:, 0].sum() < len(rows):
        order = np.lexsort(rows.T[::-1])
        model.weights = _fit(rows[order, 1:], rows[order, 0], np.where(rows[order, 0] == 1, 1_000_000 / share[1], 1_000_000 / share[0]))
    else:
        model.weights = np.array([-4.0, 3.0, 2.0, 0.0, 1.0, 1.0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row; the score depends on the text alone.

    Null and empty texts get the score of a text without hits. Null ids stay, repeated rows agree, extra columns are ignored. Without
    labels of both classes the weights are fixed ones and the lexicon may be empty.
    """
    return documents(docs).mapInArrow(_score(model, False), "doc_id long, score double")


def split_out(docs: DataFrame, folds: int = 4, held: int = 2):
    """Rows that labels may be learned from."""
    return docs.where(crc_bucket("doc_id", folds) != held)


def with_score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """All columns and the score, without a shuffle."""
    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits, find = _finder(model)
        for series in texts:
            x = np.array([_features(t or "", hits, find) for t in series]).reshape(-1, len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ model.weights[1:] + model.weights[0], -30, 30))))

    return docs.withColumn(into, run(F.col("text").cast("string")))
