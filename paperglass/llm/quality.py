"""Operator 1, quality rules: how much of a text stands inside repetitions.

Rolling hashes of several n-gram lengths, built in numpy from one hash per
word, find the n-grams that occur twice or more in the same document; the rules
measure the share of word characters inside such n-grams and inside repeated
lines.  A document is judged alone, so the operator is one map over the rows:
no shuffle, no state, memory bounded by a block of text.

Defined results: a null or empty text has no words and zero counts, and fails
the base rule, also where a whole batch is such texts; repeated rows get equal
answers; a null id is returned as it is; a very long text is its own block;
extra columns are ignored, or carried by ``keep_good`` whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents
from ._text import Block, PrefixHash, blocks, counts_of_equal, mix, symbol_ranges

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Thresholds; shares are of the word characters of the document."""

    least_words: int = 50
    repeat_words_percent: int = 50
    most_line_share: float = 0.40
    most_ngram_share: dict[int, float] = field(default_factory=lambda: {5: 0.45, 8: 0.40, 10: 0.35})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(rolling: PrefixHash, doc: np.ndarray, n: int) -> np.ndarray:
    """Flags of words inside an n-word window found twice or more in its document.

    rolling holds the running hash of the words, which any window length shares:
    the hash of a window is one difference, whatever its length.
    """
    windows = len(doc) - n + 1
    if windows < 1:
        return np.zeros(len(doc), bool)
    whole = np.flatnonzero(doc[:windows] == doc[n - 1 :])
    own = rolling.of(whole, whole + n) + doc[whole].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    twice = whole[counts_of_equal(mix(own)) > 1]
    step = np.zeros(len(doc) + 1, np.int32)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + n, -1)
    return np.cumsum(step[:-1]) > 0


def _measure(block: Block, rules: RepetitionRules) -> dict[str, np.ndarray]:
    data, n = block.data, block.n
    start, end, doc = block.words()
    ranges = PrefixHash(data)
    key = ranges.of(start, end)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[end] - points[start]

    def total(weight: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount(where, weight, n).astype(np.int64) if len(where) else np.zeros(n, np.int64)

    out = {"n_words": np.bincount(doc, minlength=n).astype(np.int64), "word_chars": total(chars, doc), "n_symbols": block.per_document(_SYMBOL[data])}

    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = np.append(data == 0x0A, False)[:-1] if len(data) else False
    edge[block.offsets[:-1]] = True
    edge[len(data)] = False
    first = np.flatnonzero(edge)
    last = np.append(first, len(data))[1:]
    in_doc = np.searchsorted(block.offsets, first, "right") - 1
    last = last - ((last > first) & (data[np.maximum(last - 1, 0)] == 0x0A)) if len(data) else last
    words_before = np.searchsorted(start, np.stack([first, last]))
    line_words = words_before[1] - words_before[0]
    char_sum = np.concatenate(([0], np.cumsum(chars)))
    line_chars = char_sum[words_before[1]] - char_sum[words_before[0]]
    real = np.flatnonzero(line_words > 0)
    line = mix(ranges.of(first[real], last[real]) + in_doc[real].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(line, kind="stable")
    ranked = line[order]
    again = np.zeros(len(line), bool)
    again[order[1:]] = ranked[1:] == ranked[:-1]
    out["n_dup_lines"] = np.bincount(in_doc[real[again]], minlength=n).astype(np.int64)
    out["dup_line_chars"] = total(line_chars[real[again]], in_doc[real[again]])

    rolling = symbol_ranges(key)
    repeated = _repeated_words(rolling, doc, 3)
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=n).astype(np.int64)
    for length in rules.most_ngram_share:
        repeated = _repeated_words(rolling, doc, length)
        out[f"dup_{length}gram_chars"] = total(chars[repeated], doc[repeated])

    size = np.maximum(out["word_chars"], 1)
    out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.repeat_words_percent * out["n_words"])
    good = ~out["base_failed"] & (out["dup_line_chars"] <= rules.most_line_share * size)
    for length, most in rules.most_ngram_share.items():
        good &= out[f"dup_{length}gram_chars"] <= most * size
    out["kept"] = good
    return out


def measure_texts(column: pa.Array, rules: RepetitionRules = RepetitionRules()) -> dict[str, np.ndarray]:
    """All measures of a column of texts, one array entry for each row."""
    parts = [_measure(b, rules) for b in blocks(column)] or [_measure(Block(0, np.zeros(0, np.uint8), np.zeros(1, np.int64)), rules)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row for each row of docs: its id, the measures, base_failed and kept."""
    names = [*MEASURES, "dup_line_chars", *(f"dup_{n}gram_chars" for n in rules.most_ngram_share)]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure_texts(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[n]) for n in [*names, "base_failed", "kept"])], names=[id_col, *names, "base_failed", "kept"])

    return docs.select(id_col, text_col).mapInArrow(measured, schema)


def keep_good(docs: DataFrame, text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """The rows of docs that the rules keep, all columns unchanged."""
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measure_texts(batch.column(at), rules)["kept"]))

    return docs.mapInArrow(kept, docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(documents(spark, sf_dir))
