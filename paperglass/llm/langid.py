"""Operator 6, language identification by error-correcting output codes.

Each language has a codeword of bits; one linear classifier over hashed byte
n-grams predicts each bit.  Decoding is loss-weighted: the language whose
codeword has the least loss, each bit weighted by how reliably its classifier
gets that language right in training; when the runner-up is close the row is
flagged ambiguous.

Training uses a bounded sample: at most sample_per_language labelled rows of
each language, those of the smallest id hash, so the driver solves a system of
bounded size.  The features of the sample are computed on the executors over
whole texts.  Prediction is one map over the rows; the model (bits x features
floats) travels in the closure.

Defined results: a null text or one without a letter is `und` with score 0, as
is everything if there is no labelled row; null labels are not learned from;
rows with a null id are learned from and not held out; repeated rows get equal
answers; very long texts are counted whole; extra columns are ignored; an empty
table gives an empty table.  More than MOST_LANGUAGES labels are an error.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents
from ._text import blocks

FEATURES = 1 << 12
SAMPLE_PER_LANGUAGE = 400
MOST_LANGUAGES = 2_000
_ROWS_AT_ONCE = 256  # dense rows of features held at once
UNKNOWN = "und"

#: Letters and bytes beyond ASCII stay (A-Z lowered); all else counts as a space.
_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def ngram_features(column: pa.Array, features: int = FEATURES) -> Iterator[np.ndarray]:
    """Blocks of rows of n-gram features (n = 1 to 4), each row of length one."""
    bits = features.bit_length() - 1
    for block in blocks(column, most_rows=_ROWS_AT_ONCE):
        folded = _FOLD[block.data]
        doc = np.repeat(np.arange(block.n), np.diff(block.offsets))
        rows = np.zeros(block.n * features, np.float32)
        code = np.zeros(len(folded), np.uint32)
        for n in range(1, 5):
            if len(folded) < n:
                break
            size = len(folded) - n + 1
            code = code[:size] * np.uint32(257) + folded[n - 1 :]
            slot = ((code + np.uint32(n)) * np.uint32(2654435769)) >> np.uint32(32 - bits)
            whole = doc[:size] == doc[n - 1 :]
            rows += np.bincount((doc[:size] * features + slot)[whole], minlength=len(rows)).astype(np.float32)
        rows = np.sqrt(rows).reshape(block.n, features)
        yield rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k x bits matrix of -1 and 1: exhaustive up to seven languages, beyond
    that the random code of largest least distance among some."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 7:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1)][1:]
        return np.array(columns, np.float32).T
    random, best = np.random.default_rng(seed), None
    bits = int(np.ceil(15 * np.log2(k)))
    for _ in range(64):
        code = random.choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        apart = (bits - code @ code.T) / 2 + bits * np.eye(k)
        if best is None or apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray
    ambiguous_below: float = 0.2

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in 0..1 and ambiguity of each feature row."""
        margin = rows @ self.weights[:-1] + self.weights[-1]
        loss = np.log1p(np.exp(-4 * margin[:, None, :] * self.code[None]))
        total = (loss * self.trust[None]).sum(axis=2)
        share = np.exp(-2 * (total - total.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        top = np.sort(share, axis=1)
        runner = top[:, -2] if share.shape[1] > 1 else np.zeros(len(share))
        return best, share[np.arange(len(best)), best], top[:, -1] - runner < self.ambiguous_below


def fit_codes(rows: np.ndarray, labels: list[str], ridge: float = 0.05) -> CodeModel:
    """Fits one regularised linear classifier for each bit: in the dual, or in
    the primal where there are more rows than features (the same weights)."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    code = codewords(len(languages))
    bits = code[y].astype(np.float64)
    x = np.hstack([rows, np.ones((len(rows), 1), np.float32)]).astype(np.float64)
    balance = np.sqrt(1.0 / np.bincount(y, minlength=len(languages))[y])[:, None]
    xb = x * balance
    dual = len(xb) <= xb.shape[1]
    gram = xb @ xb.T if dual else xb.T @ xb
    gram[np.diag_indices_from(gram)] += ridge / max(len(languages), 1) ** 0.5 / 10
    weights = xb.T @ np.linalg.solve(gram, bits * balance) if dual else np.linalg.solve(gram, xb.T @ (bits * balance))
    right = (np.sign(x @ weights) == bits).astype(np.float64)
    trust = np.stack([right[y == c].mean(axis=0) for c in range(len(languages))]) + 1e-6
    return CodeModel(languages, code, weights.astype(np.float32), (trust / trust.sum(axis=1, keepdims=True) * code.shape[1] ** 0.5).astype(np.float32))


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> CodeModel | None:
    """The model of at most sample_per_language rows of each language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("langid")), F.lit(1 << 40)).alias("turn"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # A share of each language that holds more than the sample; the exact cut follows on the few left.
    share = {k: int((1 << 40) * min(1.0, (1.5 * sample_per_language + 50) / n)) for k, n in counts.items()}
    within = F.create_map(*(F.lit(x) for kv in share.items() for x in kv))
    rows = rows.where(F.col("turn") < within[F.col("lang")])
    # Rows that repeat share a turn, so the number is held in any case.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    rows = rows.withColumn("place", place).where(F.col("place") <= sample_per_language)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in ngram_features(batch.column(1)):
                dense = [r.astype(np.float16).tobytes() for r in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part)), pa.array(dense, pa.binary())], names=["lang", "turn", "x"])
                at += len(part)

    seen: dict[str, int] = {}
    labels, found = [], []
    for r in sorted(rows.select("lang", "text", "turn").mapInArrow(featured, "lang string, turn long, x binary").collect(), key=lambda r: (r["turn"], r["lang"], bytes(r["x"]))):
        if seen.setdefault(r["lang"], 0) < sample_per_language:
            seen[r["lang"]] += 1
            labels.append(r["lang"])
            found.append(np.frombuffer(bytes(r["x"]), np.float16).astype(np.float32))
    return fit_codes(np.stack(found), labels)


def _has_letter(column: pa.Array) -> np.ndarray:
    out = []
    for block in blocks(column):
        has = block.per_document(_LETTER[block.data]) > 0
        for k in np.flatnonzero(~has & (np.diff(block.offsets) > 0)):
            has[k] = any(c.isalpha() for c in bytes(block.data[block.offsets[k] : block.offsets[k + 1]]).decode("utf-8", "replace"))
        out.append(has)
    return np.concatenate(out) if out else np.zeros(0, bool)


def identify(docs: DataFrame, model: CodeModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for every row, from its text alone."""

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _has_letter(batch.column(1))
            if model is None:
                best, score, unsure = np.zeros(len(known), np.int64), np.zeros(len(known)), np.zeros(len(known), bool)
                known = np.zeros(len(known), bool)
            else:
                parts = [model.decode(x) for x in ngram_features(batch.column(1))]
                best, score, unsure = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
            names = [model.languages[int(b)] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0).astype(np.float64)), pa.array((unsure & known).astype(bool))], names=[id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col).mapInArrow(predicted, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def _held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.where(~_held_out(F.col("doc_id"))))
    got = identify(docs, model)
    return got.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
