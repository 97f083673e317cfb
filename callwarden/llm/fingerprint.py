"""Document fingerprints: a threshold-scaled sketch of word shingles, in Spark expressions only.

The sketch keeps every shingle hash below a fixed fraction of the hash range. The fraction is the same for all documents, so
sketches grow with their texts, the sketch of a union is the union of sketches cut at nothing, and containment of a short
document in a long one can be estimated as well as likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One hash in so many is kept.
SCALE = 4
SHINGLE = 5
_HALF = 1 << 31
_NO_ID = -(1 << 63)
#: Documents of one window partition, beyond the session's number of shuffle partitions.
PART_ROWS = 200_000


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, although ``use`` mentions it more than once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct 32-bit hashes (shifted to signed) of the word shingles that lie below ``2^32 / scale``.

    Words are lower-cased and split at ASCII white space; a shorter text is one shingle. If no hash lies below the threshold the
    smallest one stands alone, so only a text without words has an empty sketch. Null counts as empty.
    """
    def hashes(ws: Column) -> Column:
        at = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.greatest(F.size(ws) - shingle, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(ws, i + k) for k in range(shingle)]), 32))

    def below(hs: Column) -> Column:
        return _let(F.filter(hs, lambda h: h < (1 << 32) // scale),
                    lambda low: F.when((F.size(low) > 0) | (F.size(hs) == 0), low).otherwise(F.array(F.array_min(hs))))

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = _let(words, lambda ws: _let(hashes(ws), below))
    return F.transform(F.array_sort(F.array_distinct(kept)), lambda h: (h - _HALF).cast("int"))


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.cast("long") + _HALF)), 8, "0")), "")


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity; two empty sketches are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_shared(a, b) / (F.size(a) + F.size(b) - _shared(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a`` that is in ``b``; the empty sketch is in every other."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(_shared(a, b) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents taken together (both not empty)."""
    return F.array_sort(F.array_union(a, b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sketch`` (null text: empty); narrow. Null ids stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", sketch(F.col("text")).alias("sketch"))


def with_next(docs: DataFrame) -> DataFrame:
    """Add ``next_text, next_sketch``: the document with the next smaller id, after the smallest the largest.

    Ids are cut into ranges of about equal counts; one range is one window partition, and the first document of the following range
    is copied to its end, so texts are shuffled once. Only range borders (one id for each range) reach the driver. Ids that repeat
    are ordered by a hash of the text; null ids come last.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_key", F.coalesce("doc_id", F.lit(_NO_ID)))
    total = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_ROWS)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    borders = rows.agg(F.percentile_approx("_key", shares, 100 * parts)).first()[0] or []
    cut = F.array(*[F.lit(b) for b in sorted(set(borders))]).cast("array<long>")
    part = F.size(F.filter(cut, lambda b: b >= F.col("_key")))
    heads = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).agg(F.max("_key")).collect())
    sketched = rows.withColumn("_part", part).withColumn("_tie", F.xxhash64("text"))
    before = {heads[i][1]: heads[i - 1][0] for i in range(len(heads))}
    if not before:
        return docs.withColumns({"next_text": F.col("text"), "next_sketch": F.col("sketch")})
    home = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    ghosts = sketched.where(F.col("_key").isin(list(before)))
    first = ghosts.groupBy("_key").agg(F.min_by(F.struct("doc_id", "text", "sketch", "_tie"), "_tie").alias("g"))
    ghosts = first.select("g.doc_id", "g.text", "g.sketch", "_key", F.element_at(home, F.col("_key")).alias("_part"), "g._tie", F.lit(1).alias("_ghost"))
    both = sketched.select("doc_id", "text", "sketch", "_key", "_part", "_tie", F.lit(0).alias("_ghost")).union(ghosts)
    order = Window.partitionBy("_part").orderBy("_ghost", F.desc("_key"), "_tie")
    both = both.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    return both.where("_ghost = 0").select("doc_id", "text", "sketch", "next_text", "next_sketch")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by the first as many (or all) of the next document.
    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited``. Empty texts
    have an empty fingerprint; a single document is its own next; an empty table gives an empty result; extra columns are ignored.
    """
    rows = with_next(fingerprints(docs)).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.expr("cast(floor(n_chars / 3) as int)")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut),
                                              F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("edited")).alias("other"))
    mine, other = F.col("sketch"), F.col("other")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(mine).alias("fingerprint"), as_text(other).alias("edited_fingerprint"),
                       likeness(mine, other).alias("near_edited"), likeness(mine, F.col("next_sketch")).alias("near_next"),
                       containment(mine, other).alias("kept_in_edited"))
