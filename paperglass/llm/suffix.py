"""Operator 10, suffix-array dedup by prefix-free parsing.

Bytes covered by a string of 50 bytes that also starts in a document of smaller
id are removed.  The corpus is too large for one suffix array, so it is dealt
first (``_repeats``): every text is cut by the triggers of a rolling hash into
stretches, each running from the first to the last 50-byte string of its trigger,
so every string lies whole in exactly one of them and equal strings are dealt to
one group.  Stretches that occur whole before, or whose trigger occurs nowhere
else, are decided there and never travel.

The stretches that are left are put in corpus order group by group, by
prefix-free parsing (``corpus_order``): triggers cut them into phrases, the
suffixes of the dictionary of distinct phrases and those of the parse are ranked,
and both ranks together give the suffix array.  Neighbours in it that share 50
bytes (compared byte for byte) are equal strings; those that a document of
smaller id holds too are removed.

Defined results: null text is an empty text; rows with equal ids (and strings
repeated inside one document) remove nothing of each other; null ids count as
larger than all others; texts below 50 bytes are kept; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._repeats import Search, Shard, repeated_spans
from ._shared import documents
from ._text import PrefixHash

WINDOW = 50
GRAM = 24
TRIGGER = 6  # bytes whose hash may end a phrase
TRIGGER_SHARE = 16  # one in so many does
_SYMBOLS_AT_ONCE = 2_000_000


def _dictionary_ranks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of all suffixes of the phrases data[start:end], laid one after the
    other, and where each phrase begins among them: prefix doubling, in which a
    phrase's end sorts before every byte."""
    size = end - start
    begin = np.cumsum(size) - size
    total = int(size.sum())
    symbols = data[np.arange(total) + np.repeat(start - begin, size)].astype(np.uint64) + np.uint64(1)
    left = np.repeat(begin + size, size) - np.arange(total)  # symbols up to the phrase's end
    first, known = np.zeros(total, np.uint64), 7
    for k in range(known):
        at = np.minimum(np.arange(total) + k, max(total - 1, 0))
        first = (first << np.uint64(9)) | np.where(left > k, symbols[at], np.uint64(0))
    rank = np.unique(first, return_inverse=True)[1].astype(np.uint64)
    while known < int(size.max(initial=0)):
        at = np.minimum(np.arange(total) + known, max(total - 1, 0))
        second = np.where(left > known, rank[at] + np.uint64(1), np.uint64(0))
        rank = np.unique(rank * np.uint64(total + 2) + second, return_inverse=True)[1].astype(np.uint64)
        known *= 2
    return rank.astype(np.int64), begin


def _parse_ranks(phrase: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Ranks (from 1) of the suffixes of the parse: the phrase numbers of each
    entry, the end of an entry sorting first."""
    n = len(phrase)
    rank, known = np.unique(phrase, return_inverse=True)[1].astype(np.uint64) + np.uint64(1), 1
    most = int(np.bincount(entry).max(initial=0)) if n else 0
    while known < most:
        at = np.minimum(np.arange(n) + known, n - 1)
        goes_on = (np.arange(n) + known < n) & (entry[at] == entry)
        second = np.where(goes_on, rank[at], np.uint64(0))
        rank = np.unique(rank * np.uint64(n + 2) + second, return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
        known *= 2
    return rank.astype(np.int64)


def corpus_order(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array of the entries that data holds one after the other: the
    places of all bytes, ordered by what follows them in their entry.

    Prefix-free parsing: a rolling hash of TRIGGER bytes cuts entries into
    phrases that overlap by a trigger.  The suffixes of the distinct phrases are
    ranked, and those of the parse (the phrases' ranks in order); a byte's place
    follows from the rank of its phrase's suffix and, where that is equal, from
    the rank of the parse behind the phrase.  Since no phrase suffix longer than
    a trigger is the beginning of another, this is the order of the whole text.
    """
    total = len(data)
    if not total:
        return np.zeros(0, np.int64)
    bound = np.cumsum(size)
    entry_of = np.repeat(np.arange(len(size)), size)
    ranges = PrefixHash(data)
    at = np.arange(max(total - TRIGGER + 1, 0))
    cut = np.zeros(total, bool)
    cut[at] = (ranges.of(at, at + TRIGGER) % np.uint64(TRIGGER_SHARE) == 0) & (at + TRIGGER <= bound[entry_of[at]])
    cut[(bound - size)[size > 0]] = True
    start = np.flatnonzero(cut)
    entry = entry_of[start]
    after = np.append(start[1:], total)
    end = np.where(np.append(entry[1:], -1) == entry, np.minimum(after + TRIGGER, total), bound[entry])
    _, lead, which = np.unique(ranges.of(start, end), return_index=True, return_inverse=True)
    rank, begin = _dictionary_ranks(data, start[lead], end[lead])
    parse = np.append(_parse_ranks(rank[begin][which], entry), 0)
    own = np.searchsorted(start, np.arange(total), "right") - 1
    behind = np.where(np.append(entry[1:], -1)[own] == entry[own], own + 1, len(start))
    return np.lexsort((parse[behind], rank[begin[which[own]] + np.arange(total) - start[own]]))


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether length bytes from a and from b are equal, byte for byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data) + 1, np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(eight)]
    if length < 8:
        eight = eight >> np.uint64(64 - 8 * length)
    out = np.ones(len(a), bool)
    for k in sorted({*range(0, max(length - 8, 0), 8), max(length - 8, 0)}):
        out &= eight[a + k] == eight[b + k]
    return out


def _by_suffix_array(symbols, size, group, ids, shard, row, lo, search: Search):
    """Resolver: windows of the dictionary that a smaller document holds too."""
    w = search.window
    begin = np.cumsum(size) - size
    order = np.argsort(group, kind="stable")
    # Equal strings have one trigger, so groups can be sorted apart: some at a time.
    heads = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    reach = np.cumsum(size[order])
    entries, starts, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(order):
        limit = (reach[at - 1] if at else 0) + _SYMBOLS_AT_ONCE
        fits = heads[np.searchsorted(heads, at, "right") :]
        fits = fits[: int(np.searchsorted(reach[fits - 1], limit, "right"))] if len(fits) else fits
        after = heads[np.searchsorted(heads, at, "right") :]
        stop = int(fits[-1]) if len(fits) else int(after[0]) if len(after) else len(order)
        if reach[-1] <= limit:
            stop = len(order)
        own = order[at:stop]
        entry, inside = _repeated_windows(symbols, begin[own], size[own], ids[own], w)
        entries.append(own[entry])
        starts.append(lo[own[entry]] + inside)
        at = stop
    return np.concatenate(entries), np.concatenate(starts)


def _repeated_windows(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, ids: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, offset) of the windows that a phrase of smaller id holds too."""
    offset = np.cumsum(size) - size
    data = symbols[np.arange(int(size.sum())) + np.repeat(begin - offset, size)]
    entry = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(data)) - offset[entry]
    order = corpus_order(data, size)
    order = order[inside[order] + w <= size[entry[order]]]  # where a whole window starts
    same = _same(data, order[1:], order[:-1], w)
    run = np.cumsum(np.concatenate(([0], ~same))) if len(order) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], ~same))) if len(order) else np.zeros(0, np.int64)
    holder = ids[entry[order]]
    least = np.minimum.reduceat(holder, first) if len(order) else holder
    gone = order[holder > least[run]]
    return entry[gone], inside[gone]


def byte_search(window: int = WINDOW, gram: int = GRAM) -> Search:
    return Search("byte", window, min(gram, window), False, _by_suffix_array)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, spans, kept) for each row: the removed byte ranges and the
    bytes that remain."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def render(shard: Shard, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
        flags = np.zeros(len(shard.data) + 1, np.int32)
        np.add.at(flags, start, 1)
        np.add.at(flags, end, -1)
        keep = np.cumsum(flags[:-1]) == 0
        data = shard.data[keep]
        cuts = np.concatenate(([0], np.cumsum(keep)))[shard.offsets].tolist()
        own = shard.offsets[row]
        pairs = pa.StructArray.from_arrays([pa.array(start - own, pa.int64()), pa.array(end - own, pa.int64())], names=["start", "end"])
        spans = pa.array(np.searchsorted(row, np.arange(shard.n + 1)), pa.int32())
        return pa.Table.from_arrays(
            [shard.table.column(id_col), pa.array(np.diff(shard.offsets), pa.int64()), pa.ListArray.from_arrays(spans, pairs), pa.array([data[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=[id_col, "n_bytes", "spans", "kept"],
        )

    schema = f"`{id_col}` {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return repeated_spans(docs.select(id_col, text_col), byte_search(window, gram), render, schema, id_col, text_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_bytes(documents(spark, sf_dir))
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
