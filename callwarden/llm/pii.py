"""Personal data: pattern spans, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. How strongly a term reveals an entity is estimated from the whole
corpus: the pointwise mutual information of finding the term beside the entity, as a share of the information of the entity
itself. A share of 1 means that the term occurs nowhere else. Terms beyond a disclosure threshold are generalised, those
beyond a second one removed, wherever they stand in the corpus.
"""

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.common import store

KINDS = ["email", "ip", "card", "phone"]
#: Words on each side of an entity that count as beside it.
BESIDE = 8
#: Different contexts in which a term must stand beside an entity.
SUPPORT = 3
GENERALISE = 0.85
REMOVE = 0.97
_NO_ID = -(1 << 63)
#: Bits of the filter that texts are searched with before the exact join on the term.
_BITS = 26
_SEEN = 300_000
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")
_SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local part, @ and domain, in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, stop)`` in code points, by kind and start; matches that fail their check are dropped."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def _entity(kind: str, value: str) -> int:
    """A hash of the entity, equal for different ways of writing it."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else "".join(c for c in value if c.isdigit())
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _beside(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Terms near each entity: entity, term, and a hash of the whole context."""
    words = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    starts = [w[0] for w in words]
    covered = sorted((a, b) for _, a, b in spans)
    out = []
    for kind, a, b in spans:
        left, right = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        near = [w for w in words[max(0, left - BESIDE):left] + words[right:right + BESIDE]
                if not any(c < w[1] and w[0] < d for c, d in covered[max(0, bisect.bisect_left(covered, (w[0], 0)) - 2):][:4])]
        terms = [text[s:e].lower() for s, e in near]
        context = xxhash.xxh3_64_intdigest(" ".join(terms).encode("utf-8", "surrogatepass")) - (1 << 63)
        entity = _entity(kind, text[a:b])
        out += [{"entity": entity, "term": t, "context": context} for t in terms]
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
    near = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("context", pa.int64())]))
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            spans, beside = [], []
            for text in batch.column(2).to_pylist():
                got = base_spans(text)
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in got])
                beside.append(_beside(text, got) if got else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, span), pa.array(beside, near)], names=["doc_id", "mark", "spans", "beside"])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the batches that hold each term; handed on whenever many terms have gathered."""
    def result(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update({w.lower() for w in set(_TERM.findall(text))})
            if len(seen) > 300_000:
                yield result(seen)
                seen = Counter()
    yield result(seen)


def _filter(terms: DataFrame) -> dict[int, bytes]:
    """One bit for the hash of each term, in pages of 32,768 bits; of bounded size however many terms there are."""
    at = terms.select(F.expr(f"xxhash64(term) & {(1 << _BITS) - 1}").alias("at"))
    pages = at.groupBy(F.shiftright("at", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits"))
    return {r["page"]: bytes(r["bits"]) for r in pages.collect()}


def _marker(pages: dict[int, bytes]):
    """Every occurrence, outside entities, of words that the filter lets through: ``doc_id, mark, term, start, stop``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}

        def told(word: str) -> bool:
            at = xxhash.xxh64_intdigest(word.lower().encode(), 42) & ((1 << _BITS) - 1)
            bits = pages.get(at >> 15)
            known[word] = got = bits is not None and bool(bits[(at & 32767) >> 3] >> (at & 7) & 1)
            return got

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows, terms, starts, stops = [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    if len(known) > _SEEN:
                        known.clear()
                    if not any([known[w] if w in known else told(w) for w in set(_TERM.findall(text))]):
                        continue
                    covered = sorted((a, b) for _, a, b in base_spans(text))
                    k = reach = 0
                    for m in _TERM.finditer(text):
                        while k < len(covered) and covered[k][0] < m.end():
                            reach, k = max(reach, covered[k][1]), k + 1
                        if m.start() >= reach and known[m.group()]:
                            rows.append(i)
                            terms.append(m.group().lower())
                            starts.append(m.start())
                            stops.append(m.end())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), batch.column(1).take(pa.array(rows, pa.int32())), pa.array(terms, pa.string()),
                                                  pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["doc_id", "mark", "term", "start", "stop"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def find(docs: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """``doc_id, mark, spans, terms`` for every row; ``terms`` holds ``start, stop, strength`` of the terms beyond ``generalise``.

    Document counts of terms and entities cover the whole corpus. A term counts for an entity that it stands beside in at least
    ``support`` different contexts; a context that copies repeat counts once. What tells is marked at every occurrence in every text,
    also far from an entity or without one; its strength is the largest of those for its entities. ``mark`` is a hash of the text; with the id it names a row, so rows
    that repeat both agree. Null texts are empty; null ids are ``-2^63`` here; extra columns are ignored.
    """
    texts = _keyed(docs)
    scanned = store(texts.mapInArrow(_scan, f"doc_id long, mark long, spans {_SPAN}, beside array<struct<entity:long,term:string,context:long>>"), "pii")
    beside = scanned.where(F.size("beside") > 0).select("doc_id", "mark", F.explode("beside").alias("b")).select("doc_id", "mark", "b.*")
    n_docs = scanned.count()
    entities = beside.groupBy("entity", "doc_id", "mark").agg(F.lit(1)).groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    contexts = beside.groupBy("entity", "term", "context").agg(F.lit(1)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support)
    together = beside.groupBy("entity", "term", "doc_id", "mark").agg(F.lit(1)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = store(contexts.join(together, ["entity", "term"]).join(entities, "entity"), "pii-pairs")
    frequent = texts.select("text").mapInArrow(_document_counts, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    information = F.log2(F.lit(float(max(n_docs, 1))) / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * F.lit(float(max(n_docs, 1))) / (F.col("n_entity") * F.col("n_term").cast("double")))
    strong = (pairs.join(frequent, "term").where(information > 0).withColumn("strength", F.least(F.lit(1.0), shared / information))
              .where(F.col("strength") >= generalise).groupBy("term").agg(F.max("strength").alias("strength")))
    strong = store(strong, "pii-strong")
    told = (texts.mapInArrow(_marker(_filter(strong)), "doc_id long, mark long, term string, start int, stop int").join(strong, "term")
            .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "strength"))).alias("terms")))
    found = scanned.select("doc_id", "mark", "spans").join(told, ["doc_id", "mark"], "left")
    return found.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,stop:int,strength:double>>")))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms`` for every row."""
    found = find(docs)
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["stop"].cast("string")))
    return found.select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"),
                        *[F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(F.array_join(text, ","), 256).alias("base_sha256"), F.array_join(F.concat(text, terms), ",").alias("spans"),
                        F.size("terms").cast("long").alias("n_terms"))


def sanitise_text(text: str, spans: list, terms: list, remove: float = REMOVE) -> str:
    """Entities become their kind in brackets, telling terms become ``[TERM]`` or vanish."""
    marks = [(s["start"], s["stop"], f"[{s['kind'].upper()}]") for s in spans]
    marks += [(t["start"], t["stop"], "" if t["strength"] >= remove else "[TERM]") for t in terms]
    out, done = [], 0
    for start, stop, word in sorted(marks):
        if start >= done:
            out += [text[done:start], word]
            done = stop
        elif stop > done:  # overlapping entities: the longer reach goes too
            done = stop
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with personal data and telling terms replaced in ``text``; null texts stay null, empty texts empty."""
    found = find(docs).where((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "mark"])
    found = found.toDF("_pii_id", "_pii_mark", "_pii_spans", "_pii_terms")

    @F.pandas_udf("string")
    def clean(texts: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
        return texts.combine(spans.combine(terms, lambda s, t: (s, t)),
                             lambda text, st: text if text is None or st[0] is None else sanitise_text(text, list(st[0]), list(st[1])))

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col("_pii_id")
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("_pii_mark")
    joined = docs.join(found, key & mark, "left")
    return joined.withColumn(text_col, clean(F.col(text_col), "_pii_spans", "_pii_terms")).select(*docs.columns)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
