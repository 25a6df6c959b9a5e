"""Similarity of two texts or numbers as Column expressions.

Functions take raw values and normalise them; ``*_of`` forms take values that
are normalised already, so that one projection can share the work.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import normalize as N

# What counts as key information in free text.
KEY_PATTERNS = {
    "emails": r"[\w.+-]+@[\w-]+\.[\w.-]+",
    "urls": r"""https?://[^\s<>"']+|www\.[^\s<>"']+""",
    "vat_numbers": r"(?i)(?:VAT|IE|GB|DE|FR|NL)\s*[\w\d]{6,}",
    "amounts": r"[€$£]\s*[\d,]+\.?\d*|\d+[.,]\d{2}\s*(?:EUR|USD|GBP)",
    "dates": r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}",
    "phones": r"[\+]?[\d\s\-()]{7,}",
}
# End of fixed values.


def both_or_none(a: Column, b: Column, otherwise: Column) -> Column:
    """1 if both are null, 0 if one is."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(otherwise)


def levenshtein_of(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return both_or_none(a, b, F.when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return N.let(N.text(a), lambda x: N.let(N.text(b), lambda y: levenshtein_of(x, y)))


def exact_match(a: Column, b: Column) -> Column:
    return N.text(a).eqNullSafe(N.text(b)).cast("double")


def token_scores_of(gt: Column, pred: Column) -> Column:
    """struct(precision, recall, f1) of two token arrays, taken as sets."""
    return N.let(F.array_distinct(gt), lambda g: N.let(F.array_distinct(pred), lambda p: _set_scores(g, p)))


def _set_scores(g: Column, p: Column) -> Column:
    both = F.size(F.array_intersect(g, p)).cast("double")
    none, one = (F.size(g) == 0) & (F.size(p) == 0), (F.size(g) == 0) | (F.size(p) == 0)
    value = lambda x: F.when(none, 1.0).when(one, 0.0).otherwise(x)
    # Harmonic mean of both/|p| and both/|g|, written on counts.
    f1 = 2 * both / (F.size(g) + F.size(p))
    return F.struct(value(both / F.size(p)).alias("precision"), value(both / F.size(g)).alias("recall"), value(f1).alias("f1"))


def token_f1(gt: Column, pred: Column) -> Column:
    return token_scores_of(N.tokens(gt), N.tokens(pred))["f1"]


def numeric_exact(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    return (F.abs(a - b) <= tolerance).cast("double")


def relative_error(gt: Column, pred: Column) -> Column:
    """Null when the true value is zero and the other is not."""
    return F.when(gt == 0, F.when(pred == 0, 0.0)).otherwise(F.abs(gt - pred) / F.abs(gt))


def absolute_error(gt: Column, pred: Column) -> Column:
    return F.abs(gt - pred)


def key_information(c: Column) -> Column:
    """struct of the distinct pieces of each kind found in a text."""
    s = F.coalesce(c, F.lit(""))
    return F.struct(*(F.array_distinct(F.regexp_extract_all(s, F.lit(p), 0)).alias(k) for k, p in KEY_PATTERNS.items()))


def key_information_recall(gt: Column, pred: Column) -> Column:
    """Share of the true pieces that some predicted piece of its kind contains or
    is contained in; 1 if there is none to find."""
    plain = lambda c, k: F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(KEY_PATTERNS[k]), 0)), lambda x: F.coalesce(N.text(x), F.lit("")))

    def hits(kind: str) -> Column:
        """struct(found, total) of one kind."""
        inside = lambda g, p: F.struct(F.size(F.filter(g, lambda x: F.exists(p, lambda y: x.contains(y) | y.contains(x)))).alias("found"), F.size(g).alias("total"))
        return N.let(plain(gt, kind), lambda g: N.let(plain(pred, kind), lambda p: inside(g, p)))

    def share(all_hits: Column) -> Column:
        total = lambda f: F.aggregate(all_hits, F.lit(0), lambda s, h: s + h[f])
        return F.when(total("total") == 0, 1.0).otherwise(total("found") / total("total"))

    return N.let(F.array(*map(hits, KEY_PATTERNS)), share)


def hashed_ngrams(texts: list[str], dimension: int = 256) -> np.ndarray:
    """A plain stand-in for a sentence encoder: counts of hashed letter trigrams."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in zip(out, texts):
        for k in range(max(len(text) - 2, 1)):
            row[zlib.crc32(text[k : k + 3].encode()) % dimension] += 1
    return out


def embedding_similarity(pairs: DataFrame, a: str, b: str, out: str = "embedding", encode: Callable[[list[str]], np.ndarray] = hashed_ngrams) -> DataFrame:
    """pairs with the cosine of the encoded texts of two columns.

    Each distinct normalised text is encoded once, in batches, and joined back.
    An empty text is 0 to anything, equal texts are 1.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = np.asarray(encode(batch.column(0).to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], names=["_text", "_vector"])

    text = lambda c: F.coalesce(N.text(F.col(c)), F.lit(""))
    asked = pairs.withColumns({"_a": text(a), "_b": text(b)})
    open_ = asked.where((F.col("_a") != "") & (F.col("_b") != "") & (F.col("_a") != F.col("_b")))
    distinct = open_.select(F.explode(F.array("_a", "_b")).alias("_text")).distinct()
    vectors = distinct.mapInArrow(encoded, "_text string, _vector array<double>")
    side = lambda c: vectors.select(F.col("_text").alias(c), F.col("_vector").alias(f"{c}v"))
    joined = asked.join(side("_a"), "_a", "left").join(side("_b"), "_b", "left")
    value = F.when((F.col("_a") == "") | (F.col("_b") == ""), 0.0).when(F.col("_a") == F.col("_b"), 1.0).otherwise(cosine(F.col("_av"), F.col("_bv")))
    return joined.withColumn(out, value).select(*pairs.columns, out)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
