"""Packing token sequences by minimum bin slack.

Documents are cut into whole sequences and one remainder. How often each remainder length occurs is a table of fewer rows than a
sequence has tokens; from it windows are filled one after the other: a bitset holds all sums that the remaining lengths can reach,
the sum that comes closest to the capacity is taken, and backtracking gives how many of each length make it. A filling is repeated
as often as the counts allow, so the plan does not grow with the corpus; documents look up their place by length and rank.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import documents, prefix_sums, slices, store

CAPACITY = 4096
END = 2
#: Words a worker keeps, and words it remembers to have seen once.
_KNOWN = 200_000
_ONCE = 250_000
#: Rows and bytes of texts that are tokenized together.
_SLICE = 1000, 4 << 20
#: Words that are encoded in one text.
_TOGETHER = 100
#: Punctuation behind a letter is a token run of its own; none of these stands in a special token.
_TAIL = ".,?!;:%*$&#"
_TOKENS = "doc_id long, doc_tokens long, rest int, crcs array<long>"
#: Letters that a word may end with before it is cut there, as their last two bytes: a-z, A-Z, and U+00C0 to U+012F but for the two signs.
_LETTER = np.zeros((256, 256), bool)
_LETTER[:, [*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTER[0xC3, 0x80:0xC0] = _LETTER[0xC4, 0x80:0xB0] = True
_LETTER[0xC3, [0x97, 0xB7]] = False


class _Words(dict):
    """Ids of words (as little-endian bytes). A word is what stands between ASCII white space: no token spans that.

    The table keeps words that several slices held and is never emptied, so common words are learned once a worker; the others live as
    long as their slice. ``once`` holds hashes of words that one slice has held.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.once: set[int] = set()
        marks = sorted((i, token.endswith("</w>")) for token, i in tokenizer.get_vocab().items())
        self.closes = np.zeros(marks[-1][0] + 1, bool)
        self.closes[[i for i, end in marks if end]] = True

    def ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words. Letters and the punctuation behind them are looked up apart."""
        cores = pc.ascii_rtrim(words, characters=_TAIL)
        letters = pc.if_else(_ends_in_letter(cores), cores, words)
        sizes = pc.binary_length(letters)
        cut = pc.not_equal(sizes, pc.binary_length(words))
        whole = words.filter(cut).to_pylist()
        tails = pa.array([w[len(w.rstrip(_TAIL)):] for w in whole], pa.string()).dictionary_encode()
        letters = letters.dictionary_encode()
        ids = self._lookup(letters.dictionary).take(letters.indices)
        behind = self._lookup(tails.dictionary).take(tails.indices)
        return pc.replace_with_mask(ids, cut, pc.binary_join_element_wise(ids.filter(cut), behind, pa.scalar(b"", pa.large_binary())))

    def _lookup(self, words: pa.Array) -> pa.Array:
        words = words.to_pylist()
        ids = [*map(self.get, words)]
        new = [w for w, found in zip(words, ids, strict=True) if found is None]
        if new:
            local = self._learn(new)
            ids = [local[w] if found is None else found for w, found in zip(words, ids, strict=True)]
        return pa.array(ids, pa.large_binary())

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        local: dict[str, bytes] = {}
        plain, others = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        parts = [plain[at:at + _TOGETHER] for at in range(0, len(plain), _TOGETHER)]
        for part, got in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):  # a letter that normalization takes apart
                others += part
                continue
            data, stops = ids.tobytes(), (4 * ends).tolist()
            for word, lo, hi in zip(part, [0, *stops[:-1]], stops, strict=True):
                local[word] = data[lo:hi]
        for word, got in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            ids = got.ids
            local[word] = pack_ids(f"<{len(ids)}I", *ids)
        if len(self) < _KNOWN:
            self.update((w, i) for w, i in local.items() if hash(w) in self.once)
            if len(self.once) > _ONCE:
                self.once.clear()
            self.once.update(map(hash, local))
        return local


def _ends_in_letter(words: pa.Array) -> pa.Array:
    """Whether a word's last character is one of ``_LETTER``; longer characters than two bytes are none."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset + 1:words.offset + len(words) + 1]
    sizes = pc.binary_length(words).to_numpy()
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    if not len(data):
        return pa.array(np.zeros(len(words), bool))
    last, before = data[np.maximum(ends, 1) - 1], data[np.maximum(ends, 2) - 2]
    return pa.array((sizes > 0) & _LETTER[before, last])


@cache
def _words(path: str) -> _Words:
    """What a Python worker has learned; it serves all tasks that the worker runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path))


def _tokenize(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _words(path)
        end = END.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, 1, *_SLICE):
                texts = batch.column(1)
                # the tokenizer folds letters anyway, but for its special tokens
                lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
                words = lists.flatten().dictionary_encode()
                ids = known.ids(words.dictionary).take(words.indices)
                _, offsets, data = ids.buffers()
                data = memoryview(data) if data else memoryview(b"")
                stops = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
                sizes, crcs = [], []
                for lo, hi in zip(stops[:-1], stops[1:], strict=True):
                    sizes.append((hi - lo) // 4 + 1)
                    found = [zlib.crc32(data[at:min(at + 4 * capacity, hi)]) for at in range(lo, hi + 1, 4 * capacity)]
                    found[-1] = zlib.crc32(end, found[-1])
                    crcs.append(found)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([n % capacity for n in sizes], pa.int32()),
                                                  pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "doc_tokens", "rest", "crcs"])
    return run


def _fill(counts: dict[int, int], target: int, first: int, capacity: int) -> dict[int, int]:
    """How many of each length stand beside ``first`` so that the window comes closest to its capacity."""
    reach, stages = 1, []
    for length in sorted((n for n in counts if n <= target), reverse=True):
        left = min(counts[length] - (length == first), target // length)
        stages.append((length, left, reach))
        size = 1
        while left > 0:  # multiples in binary parts
            part = min(size, left)
            reach |= reach << (length * part)
            left -= part
            size *= 2
        reach &= (1 << (target + 1)) - 1
        if reach >> target & 1:
            break
    best = reach.bit_length() - 1
    if best < target:  # a window that ends at a power of two is not padded either
        exact = [p for p in (1 << i for i in range(capacity.bit_length())) if p >= first and reach >> (p - first) & 1]
        best = max(exact) - first if exact else best
    used: dict[int, int] = {}
    for length, most, before in reversed(stages):
        k = next(k for k in range(most + 1) if best >= k * length and before >> (best - k * length) & 1)
        if k:
            used[length] = k
            best -= k * length
    return used


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used. Every window holds the longest remainder that is left."""
    counts, plan = {n: c for n, c in counts.items() if c > 0}, []
    while counts:
        longest = max(counts)
        used = _fill(counts, capacity - longest, longest, capacity)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        plan.append((used, times))
    return plan


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row for each piece of a document.

    ``tokenizer`` is the path of a tokenizer file that every executor can read, whose tokens do not span ASCII white space; each document
    ends with the id 2. Pieces of a sequence stand without gaps; sequences are numbered from 0. Null or empty texts are documents of one
    token. Null ids and repeated ids are packed like others. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tokens = store(documents(docs).mapInArrow(_tokenize(tokenizer, capacity), _TOKENS), "tokens")
    ranked = prefix_sums(tokens, ["rest", "doc_id"], {"place": "1", "whole_before": f"doc_tokens div {capacity}"}, "tokens-ranked")
    counts = {r[0]: r[1] for r in tokens.groupBy("rest").count().collect()}  # fewer rows than a sequence has tokens
    first_place, below = {}, 0
    for length in sorted(counts):
        first_place[length] = below
        below += counts[length]
    rows, taken, sequence = [], dict(first_place), 0
    for used, times in plan_windows({n: c for n, c in counts.items() if n}, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            rows.append((length, taken[length], taken[length] + k * times, k, sequence, offset))
            taken[length] += k * times
            offset += k * length
        sequence += times
    plan = spark.createDataFrame(rows, "r_length int, r_from long, r_to long, r_each long, r_sequence long, r_offset long")
    # bounded: at most one row for each length and window that is not a repetition
    placed = ranked.join(F.broadcast(plan), F.expr("rest = r_length AND place >= r_from AND place < r_to"), "left")
    placed = placed.withColumn("whole", F.expr(f"doc_tokens div {capacity}")).withColumn("j", F.explode(F.sequence(F.lit(0), F.size("crcs") - 1)))
    full = F.col("j") < F.col("whole")
    nth = F.col("place") - F.col("r_from")
    return placed.select(
        "doc_id", (F.col("j").cast("long") * capacity).alias("start"), F.when(full, F.lit(capacity)).otherwise(F.col("rest")).cast("long").alias("length"),
        F.get("crcs", F.col("j")).alias("ids_crc32"), "doc_tokens",
        F.when(full, F.lit(sequence) + F.col("whole_before") + F.col("j")).otherwise(F.col("r_sequence") + F.expr("(place - r_from) div r_each")).alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("r_offset") + (nth % F.col("r_each")) * F.col("rest")).cast("long").alias("offset"))
