"""Language identification of mixed texts.

The script of a word narrows the languages that may have written it. A word's score for a language is the log-likelihood of its letter
trigrams. A Viterbi pass over the words, with a penalty for each change of language, labels spans; all texts of a batch are
decoded together, a word of each at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import crc_bucket, documents, store

#: Training texts of one language, at most; trigrams of the model, at most.
SAMPLE = 3000
TRIGRAMS = 30_000
SWITCH = 9.0
_KNOWN = 200_000
_WORDS = 600_000
_STRANGE = -12.0
_LETTERS = re.compile(r"[^\W\d_]+")
#: Unicode blocks by script.
SCRIPTS = [
    ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]


_NAMES = ["latin", *[name for name, _, _ in SCRIPTS], "other"]


def scripts_of(points: np.ndarray) -> np.ndarray:
    """Numbers of the scripts (places in ``_NAMES``) of code points."""
    lows, highs = (np.array([row[k] for row in SCRIPTS]) for k in (1, 2))
    block = np.searchsorted(lows, points, side="right")  # the last block that begins at or before the point
    return np.where(block == 0, 0, np.where(points <= highs[np.maximum(block, 1) - 1], block, len(SCRIPTS) + 1))


def script_of(word: str) -> str:
    return _NAMES[int(scripts_of(np.array([ord(word[0])]))[0])]


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i:i + 3] for i in range(len(padded) - 2)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _keys(points: np.ndarray) -> np.ndarray:
    """A number for each three code points in a row."""
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts by language, summed up before they are shuffled."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(_LETTERS.findall(text.lower()))
        seen: Counter = Counter()
        for lang, counts in words.items():
            for word, n in counts.items():
                seen[lang, "\0" + script_of(word)] += n * len(word)
                for gram in _trigrams(word):
                    seen[lang, gram] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                          pa.array(list(seen.values()), pa.int64())], names=["lang", "gram", "n"])


class Model:
    """Log-likelihoods of trigrams by language; plain arrays, a few megabytes at most."""

    def __init__(self, langs: list[str], grams: list[str], table: np.ndarray, unseen: np.ndarray, scripts: dict[str, np.ndarray]):
        keys = np.array([_keys(_points(g))[0] for g in grams], np.int64)
        order = np.argsort(keys)
        self.langs, self.keys = langs, keys[order]
        self.table = np.vstack([table[order], unseen[None, :]])
        self.allowed = np.array([scripts.get(name, np.zeros(len(langs), bool)) for name in _NAMES], bool)

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: 0 for its best language, less for others; languages that do not use its script get the lowest value.

        A word of a script that no language uses says nothing: all zero.
        """
        if not words:
            return np.zeros((0, len(self.langs)), np.float32)
        points = _points("".join(f"^{w}$" for w in words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 2)
        within = np.ones(len(points), bool)
        within[ends - 1] = within[ends - 2] = False  # no trigram begins there
        keys = _keys(points)[within[:-2]]
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        total = np.add.reduceat(self.table[np.where(known, at, len(self.keys))], np.cumsum(sizes) - sizes, axis=0)
        allowed = self.allowed[scripts_of(points[ends - sizes - 1])]
        total = np.where(allowed, total, -np.inf)
        best = total.max(axis=1, keepdims=True)
        some = allowed.any(axis=1)
        return np.where(some[:, None], np.maximum(total - np.where(some[:, None], best, 0), _STRANGE), 0).astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE, trigrams: int = TRIGRAMS) -> Model:
    """Fit on a bounded sample of ``docs(doc_id, text, lang)``: about ``sample`` texts of each language, chosen by a hash of the id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()
    share = F.lit(0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], F.lit(int(min(1.0, sample / r["count"]) * 1_000_000))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share).select("lang", "text")
    counts = chosen.mapInArrow(_count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = store(counts, "trigrams")  # read twice
    tops = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
    scripts = tops.where(F.col("gram").startswith("\0")).collect()
    kept = tops.where(~F.col("gram").startswith("\0")).orderBy(F.desc("all"), "gram").limit(trigrams).collect()
    langs = sorted(r["lang"] for r in sizes)
    place = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((len(kept), len(langs)))
    for i, r in enumerate(kept):
        for cell in r["by"]:
            table[i, place[cell["lang"]]] = cell["n"]
    totals = table.sum(axis=0) + len(kept) * 0.5 + 1
    letters: dict[str, np.ndarray] = {}
    for r in scripts:
        letters[r["gram"][1:]] = np.array([next((c["n"] for c in r["by"] if c["lang"] == lang), 0) for lang in langs], float)
    every = np.maximum(sum(letters.values(), np.zeros(len(langs))), 1)
    used = {name: n / every >= 0.01 for name, n in letters.items()}
    return Model(langs, [r["gram"] for r in kept], np.log((table + 0.5) / totals).astype(np.float32),
                 np.log(0.5 / totals).astype(np.float32), {name: ok for name, ok in used.items() if ok.any()})


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of every word; ``scores`` holds the words of all texts one after the other, ``sizes`` their numbers of words."""
    n_langs = scores.shape[1]
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    path = np.zeros(len(scores), np.int16)
    if not len(scores):
        return path
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts that have a t-th word
    stay = np.zeros((len(scores), n_langs), bool)
    best_before = np.zeros(len(scores), np.int16)
    value = scores[begins[:active[0]]].astype(np.float64)
    finals = np.zeros((len(sizes), n_langs))
    for t in range(1, len(active)):
        a = active[t]
        finals[a:len(value)] = value[a:]
        value = value[:a]
        top = value.argmax(axis=1)
        jump = value[np.arange(a), top] - switch
        at = begins[:a] + t
        keep = value >= jump[:, None]
        stay[at], best_before[at] = keep, top
        value = np.where(keep, value, jump[:, None]) + scores[at]
    finals[:len(value)] = value
    now = finals.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = begins[:a] + t
        path[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], best_before[at])
    return path


def _decode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table, lengths = model.scores([]), np.zeros(0, np.int64)

        def decode(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            nonlocal table, lengths
            words = [w for t in texts for w in t]
            new = [w for w in set(words) if w not in known]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            table = np.concatenate([table, model.scores(new)])
            lengths = np.concatenate([lengths, np.fromiter(map(len, new), np.int64, len(new))])
            sizes = np.array([len(t) for t in texts])
            flat = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            letters = lengths[flat]
            path = viterbi(table[flat], sizes)
            doc = np.repeat(np.arange(len(texts)), sizes)
            weight = np.bincount(doc * len(model.langs) + path, weights=letters, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
            all_letters = weight.sum(axis=1)
            best = weight.argmax(axis=1)
            labels = [model.langs[b] if n else "und" for b, n in zip(best, all_letters, strict=True)]
            score = np.where(all_letters > 0, weight.max(axis=1, initial=0) / np.maximum(all_letters, 1), 0.0)
            spans, start = [], 0
            for n in sizes.tolist():
                p = path[start:start + n]
                cuts = np.flatnonzero(np.diff(p, prepend=-1))
                ends = [*cuts[1:].tolist(), n][:len(cuts)]
                spans.append([{"lang": model.langs[p[c]], "first_word": int(c), "n_words": int(e - c)} for c, e in zip(cuts, ends, strict=True)])
                start += n
            if len(known) > _KNOWN:
                known.clear()
                table, lengths = table[:0], lengths[:0]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(score.astype(np.float64)),
                pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])))],
                names=["doc_id", "lang_pred", "score", "spans"])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _LETTERS.findall(text.lower())
                ids.append(doc)
                texts.append(words)
                held += len(words)
                if held > _WORDS:
                    yield decode(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield decode(ids, texts)
    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row: the language with most letters, their share, and spans of words of one language.

    Null texts and texts without letters are ``und`` with score 0. Ties go to the language that sorts first. Every row is judged by
    its text alone, so repeated rows agree; extra columns are ignored; a model of no languages labels everything ``und``.
    """
    if not model.langs:
        nothing = F.array().cast("array<struct<lang:string,first_word:int,n_words:int>>")
        return documents(docs).select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), nothing.alias("spans"))
    return documents(docs).mapInArrow(_decode(model), "doc_id long, lang_pred string, score double, "
                                                      "spans array<struct<lang:string,first_word:int,n_words:int>>")


def held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows a model may learn from are those whose crc32 of the id is not 0 modulo ``folds`` (null ids: none)."""
    return docs.where(crc_bucket("doc_id", folds) != 0)
