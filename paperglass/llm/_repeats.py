"""Exact repeated-window search over a whole corpus, shared by operators 4 and 10.

A corpus is a set of symbol sequences (bytes or words).  A window is ``window``
consecutive symbols of one document; the search finds the windows that also
start earlier, exactly, without moving anything of the size of all windows:

1. *parse*: a rolling hash of ``gram`` symbols triggers phrase boundaries where
   it is least among the grams of a window (leftmost on ties).  Every window
   holds exactly one trigger of its own, and equal windows hold it at the same
   place, so the windows of one trigger form a run and the symbols under that
   run are its phrase.  Per trigger 12 bytes travel: gram and phrase hash.
2. *classify*: where triggers of one gram meet, a phrase seen before removes all
   its windows at once; a gram met once removes none; only first phrases whose
   gram occurs in another phrase too go on.
3. those phrases travel whole, and a *resolver* (suffix automata, or the suffix
   array of the phrase dictionary) finds which of their windows occur earlier.
4. the spans go back to the documents.

Skew: within a shard only the first of equal phrases travels, so a passage that
a third of all documents share costs one row a shard.  A gram that has many
phrases inside one shard is hot: its triggers are dealt by phrase instead of by
gram, and in step 3 by single windows, so no task collects them.

Documents are dealt to shards by hash; each shard holds about shard_bytes of
text, whatever the size of the corpus, and all of a document.  The dealt texts
are one exchange that every step reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import shards_for, text_bytes
from ._text import Block, PrefixHash, mix, symbol_ranges, text_buffers

_POSITION = np.uint64((1 << 24) - 1)
_SEGMENT = 1 << 22  # symbols of a long document that are parsed at once
_PIECE = 1 << 20  # symbols parsed at once otherwise
_NO_ID = np.iinfo(np.int64).max

UNIQUE, REPEATED, FIRST, HOT = 0, 1, 2, 3


@dataclass(frozen=True)
class Search:
    unit: str  # "byte" or "word"
    window: int
    gram: int
    within: bool  # whether earlier starts of the same document count
    resolver: Callable
    hot_phrases: int = 256
    shard_bytes: int = 6 << 20
    bucket_bytes: int = 8 << 20


# what a shard holds ----------------------------------------------------------


class Shard:
    """The rows of a shard in a fixed order, as one array of symbols."""

    def __init__(self, table: pa.Table, id_col: str, text_col: str, unit: str):
        ids = table.column(id_col).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) and ids.num_chunks else ids
        known = pc.fill_null(pc.cast(ids, pa.int64()), _NO_ID).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
        order = np.argsort(known, kind="stable")
        if len(known) > 1 and (np.diff(known[order]) == 0).any():  # equal ids: by text, so that every step has one order
            texts = table.column(text_col).to_pylist()
            order = np.array(sorted(range(len(known)), key=lambda k: (known[k], texts[k] or "")), np.int64)
        self.table = table.take(pa.array(order))
        self.ids = known[order]
        self.data, self.byte_offsets = text_buffers(self.table.column(text_col))
        self.n = len(self.byte_offsets) - 1
        if unit == "byte":
            self.symbols, self.offsets = None, self.byte_offsets
        else:
            starts, ends, keys = [], [], []
            for a, b in self._pieces(self.byte_offsets, _PIECE):
                base = self.byte_offsets[a]
                block = Block(a, self.data[base : self.byte_offsets[b]], self.byte_offsets[a : b + 1] - base)
                s, e, _ = block.words()
                starts.append(s + base)
                ends.append(e + base)
                keys.append(PrefixHash(block.data).of(s, e))
            self.starts, self.ends, self.symbols = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((starts, np.int64), (ends, np.int64), (keys, np.uint64)))
            self.offsets = np.searchsorted(self.starts, self.byte_offsets)

    @staticmethod
    def _pieces(offsets: np.ndarray, most: int):
        """Ranges of rows of about most symbols."""
        a, n = 0, len(offsets) - 1
        while a < n:
            b = min(max(int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1, a + 1), n)
            yield a, b
            a = b

    def segments(self, window: int):
        """(first row, start, segment offsets) of symbol ranges to parse at once; a long
        document gives several that overlap by window - 1."""
        for a, b in self._pieces(self.offsets, _PIECE):
            lo, hi = int(self.offsets[a]), int(self.offsets[b])
            if hi - lo <= _SEGMENT:
                yield a, lo, self.offsets[a : b + 1] - lo
            else:
                for at in range(lo, max(hi - window + 1, lo + 1), _SEGMENT):
                    yield a, at, np.array([0, min(at + _SEGMENT + window - 1, hi) - at])


def parse(shard: Shard, search: Search) -> dict[str, np.ndarray]:
    """The triggers of a shard: row, first and last window start, gram, phrase."""
    w, q = search.window, search.gram
    span = w - q + 1
    out: list[tuple] = []
    for first_row, base, offsets in shard.segments(w):
        size = int(offsets[-1])
        if size < w:
            continue
        part = slice(base, base + size)
        ranges = PrefixHash(shard.data[part]) if shard.symbols is None else symbol_ranges(shard.symbols[part])
        grams = np.arange(size - q + 1)
        hashed = ranges.of(grams, grams + q)
        key = (hashed & ~_POSITION) | grams.astype(np.uint64)
        least, reach = key, 1
        while reach * 2 <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: size - w + 1], least[span - reach : span - reach + size - w + 1])
        lengths = np.diff(offsets)
        many = np.maximum(lengths - w + 1, 0)
        start = np.arange(int(many.sum())) + np.repeat(offsets[:-1] - (np.cumsum(many) - many), many)
        row = np.repeat(np.arange(len(lengths)), many)
        if not len(start):
            continue
        at = (least[start] & _POSITION).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]))))
        end = np.append(new[1:], len(start)) - 1
        first, last, trigger = start[new], start[end], at[new]
        shape = ((trigger - first) * w + (last - first)).astype(np.uint64)
        phrase = mix(ranges.of(first, last + w) ^ mix(shape + np.uint64(1)))
        out.append((row[new] + first_row, first + base, last + base, hashed[trigger], phrase))
    if not out:
        return dict(zip(("row", "first", "last", "gram", "phrase"), (np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))))
    return dict(zip(("row", "first", "last", "gram", "phrase"), (np.concatenate(x) for x in zip(*out))))


def route(shard: Shard, found: dict[str, np.ndarray], search: Search, buckets: int) -> dict[str, np.ndarray]:
    """Which triggers travel in step 1, and where to.

    ``lead`` is, for each trigger, the first of the same phrase in the shard;
    only leads travel.  ``own`` marks triggers that the lead does not remove.
    """
    n = len(found["phrase"])
    order = np.argsort(found["phrase"], kind="stable")  # stable: rows and starts rise
    ranked = found["phrase"][order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1])) if n else np.zeros(0, bool)
    lead = np.empty(n, np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(head, np.arange(n), 0))] if n else 0
    ids, rows = shard.ids[found["row"]], found["row"]
    own = ids[lead] == ids
    if search.within and n:
        again = np.zeros(n, bool)  # an earlier start of the same phrase in the same row
        again[order[1:]] = ~head[1:] & (rows[order[1:]] == rows[order[:-1]])
        own &= ~again
    leads = np.flatnonzero(lead == np.arange(n))
    by_gram = leads[np.argsort(found["gram"][leads], kind="stable")]
    ranked = found["gram"][by_gram]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(ranked)))
    hot = np.zeros(n, bool)
    hot[by_gram] = np.repeat(length >= search.hot_phrases, length)
    key = np.where(hot, found["phrase"], found["gram"])
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    marks = ranked[start[length >= search.hot_phrases]]
    return {"lead": lead, "own": own, "leads": leads, "hot": hot, "bucket": bucket, "marks": marks}


# what travels -----------------------------------------------------------------


def _packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64)
    return head.tobytes() + b"".join(x.tobytes() for x in arrays)


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


_TRAVEL = "key long, shard long, payload binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])


def _rows(made: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _shared_runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys each entry is in."""
    return np.cumsum(np.concatenate(([0], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


def _ids_with_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    return ids[start], np.diff(np.append(start, len(ids))).astype(np.uint32)


def _slices(sorted_keys: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """Where each of some keys stands among the sorted ones."""
    return list(zip(np.searchsorted(sorted_keys, keys).tolist(), np.searchsorted(sorted_keys, keys, "right").tolist()))


def _parse_step(search: Search, id_col: str, text_col: str, buckets: int):
    def step(key: tuple, table: pa.Table) -> pa.Table:
        shard = Shard(table, id_col, text_col, search.unit)
        found = parse(shard, search)
        way = route(shard, found, search, buckets)
        leads = way["leads"]
        order = leads[np.argsort(way["bucket"][leads], kind="stable")]
        bucket = way["bucket"][order]
        mark_bucket = (way["marks"] % np.uint64(buckets)).astype(np.int64)
        by_bucket = np.argsort(mark_bucket, kind="stable")
        marks, mark_bucket = (way["marks"][by_bucket] >> np.uint64(32)).astype(np.uint32), mark_bucket[by_bucket]
        met = np.union1d(bucket, mark_bucket)
        made = []
        for b, (x, y), (m, n) in zip(met.tolist(), _slices(bucket, met), _slices(mark_bucket, met)):
            sent = order[x:y]
            hot = way["hot"][sent]
            ids, counts = _ids_with_counts(shard.ids[found["row"][sent]])
            gram = (found["gram"][sent] >> np.uint64(32)).astype(np.uint32)
            made.append((b, key[0].as_py(), _packed(gram, found["phrase"][sent], np.packbits(hot), ids, counts, marks[m:n])))
        return _rows(made)

    return step


def _classify_step(key: tuple, table: pa.Table) -> pa.Table:
    shards = table.column("shard").to_pylist()
    parts = [_unpacked(p, np.uint32, np.uint64, np.uint8, np.int64, np.uint32, np.uint32) for p in map(bytes, table.column("payload").to_pylist())]
    sizes = [len(p[0]) for p in parts]
    gram = np.concatenate([p[0] for p in parts])
    phrase = np.concatenate([p[1] for p in parts])
    hot = np.concatenate([np.unpackbits(p[2], count=n).astype(bool) for p, n in zip(parts, sizes)])
    ids = np.concatenate([np.repeat(p[3], p[4]) for p in parts])
    marks = np.unique(np.concatenate([p[5] for p in parts]))
    flags = np.zeros(len(gram), np.uint8)
    order = np.lexsort((ids, phrase))
    run = _shared_runs(phrase[order])
    least = ids[order][np.searchsorted(run, run)]
    later = np.empty(len(gram), bool)
    later[order] = ids[order] > least
    # A gram with one phrase only, of which nothing is later, removes nothing.
    plain = np.flatnonzero(~hot)
    order = plain[np.lexsort((phrase[plain], gram[plain]))]
    group = _shared_runs(gram[order])
    phrases = np.bincount(group, np.concatenate(([1], (phrase[order][1:] != phrase[order][:-1]) | (group[1:] != group[:-1]))) if len(order) else None, minlength=1)
    several = np.zeros(len(gram), bool)
    several[order] = phrases[group] > 1
    flags[several] = FIRST
    flags[hot | np.isin(gram, marks)] = HOT
    flags[later] = REPEATED
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return _rows([(key[0].as_py(), s, flags[a:b].tobytes()) for s, a, b in zip(shards, cuts, cuts[1:])])


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans that are sorted by row and start; touching ones join."""
    if not len(row):
        return row, start, end
    shift = int(end.max()) + 2
    a, b = start + row * shift, end + row * shift
    reach = np.maximum.accumulate(b)
    new = np.concatenate(([True], a[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1] - row[at] * shift


def _select_step(search: Search, id_col: str, text_col: str, buckets: int):
    """Spans known to be repeated, and the phrases that need a resolver."""
    w = search.window

    def step(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _rows([])
        shard = Shard(table, id_col, text_col, search.unit)
        found = parse(shard, search)
        way = route(shard, found, search, buckets)
        leads = way["leads"]
        order = leads[np.argsort(way["bucket"][leads], kind="stable")]
        flags = np.zeros(len(found["row"]), np.uint8)
        for (x, y), payload in zip(_slices(way["bucket"][order], answers.column("key").to_numpy()), answers.column("payload").to_pylist()):
            flags[order[x:y]] = np.frombuffer(payload, np.uint8)
        flags = flags[way["lead"]]
        flags[~way["own"]] = REPEATED
        gone = np.flatnonzero(flags == REPEATED)
        row, start, end = _merged(found["row"][gone], found["first"][gone], found["last"][gone] + w)
        number = key[0].as_py()
        made = []
        if len(row):
            made.append((buckets + number, number, _packed(row, start, end)))
        symbols = shard.data if shard.symbols is None else shard.symbols
        first = np.flatnonzero(flags == FIRST)
        lo, size = found["first"][first], found["last"][first] - found["first"][first] + w
        bucket = (found["gram"][first] % np.uint64(buckets)).astype(np.int64)
        group = found["gram"][first]
        rows = found["row"][first]
        hot = np.flatnonzero(flags == HOT)
        if len(hot):  # single windows, dealt by their own hash
            many = found["last"][hot] - found["first"][hot] + 1
            at = np.arange(int(many.sum())) + np.repeat(found["first"][hot] - (np.cumsum(many) - many), many)
            ranges = PrefixHash(symbols) if shard.symbols is None else symbol_ranges(symbols)
            own = ranges.of(at, at + w)
            hot_rows = np.repeat(found["row"][hot], many)
            # of equal windows in the shard, the others are known to be repeated
            order = np.lexsort((at, own))
            run = _shared_runs(own[order])
            ahead = order[np.searchsorted(run, run)]
            lead = np.empty(len(at), np.int64)
            lead[order] = ahead
            later = shard.ids[hot_rows] > shard.ids[hot_rows[lead]]
            if search.within:
                again = np.zeros(len(at), bool)
                again[order[1:]] = (run[1:] == run[:-1]) & (hot_rows[order[1:]] == hot_rows[order[:-1]])
                later |= again
            if later.any():
                o = np.argsort(at[later], kind="stable")
                made.append((buckets + number, number, _packed(*_merged(hot_rows[later][o], at[later][o], at[later][o] + w))))
            keep = ~later
            lo, size = np.concatenate([lo, at[keep]]), np.concatenate([size, np.full(int(keep.sum()), w)])
            rows, group = np.concatenate([rows, hot_rows[keep]]), np.concatenate([group, own[keep]])
            bucket = np.concatenate([bucket, (own[keep] % np.uint64(buckets)).astype(np.int64)])
        order = np.argsort(bucket, kind="stable")
        met = np.unique(bucket)
        for b, (x, y) in zip(met.tolist(), _slices(bucket[order], met)):
            sent = order[x:y]
            n = size[sent]
            take = np.arange(int(n.sum())) + np.repeat(lo[sent] - (np.cumsum(n) - n), n)
            made.append((b, number, _packed(rows[sent], lo[sent], n.astype(np.uint32), shard.ids[rows[sent]], group[sent], symbols[take])))
        return _rows(made)

    return step


def _resolve_step(search: Search, buckets: int):
    kind = np.uint8 if search.unit == "byte" else np.uint64

    def step(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() >= buckets:
            return table
        shards = table.column("shard").to_pylist()
        parts = [_unpacked(bytes(p), np.int64, np.int64, np.uint32, np.int64, np.uint64, kind) for p in table.column("payload").to_pylist()]
        row, lo, size, ids, group, symbols = (np.concatenate([p[k] for p in parts]) for k in range(6))
        shard = np.repeat(np.array(shards, np.int64), [len(p[0]) for p in parts])
        entry, start = search.resolver(symbols, size.astype(np.int64), group, ids, shard, row, lo, search)
        made = []
        order = np.lexsort((start, row[entry], shard[entry]))
        entry, start = entry[order], start[order]
        for s in np.unique(shard[entry]).tolist():
            own = shard[entry] == s
            made.append((buckets + s, s, _packed(*_merged(row[entry[own]], start[own], start[own] + search.window))))
        return _rows(made)

    return step


def repeated_spans(docs: DataFrame, search: Search, render: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """render(shard, row, start, end) for every shard: the spans of symbols under
    repeated windows, merged and sorted by row and start."""
    size = text_bytes(docs, text_col)
    shards, buckets = shards_for(size, search.shard_bytes), shards_for(size, search.bucket_bytes)
    own = next(n for n in (f"shard{k}" for k in range(len(docs.columns) + 1)) if n.lower() not in {c.lower() for c in docs.columns})
    number = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(shards)).cast("long").alias(own)
    dealt = docs.select("*", number)
    dealt = dealt.repartition(shards, own)
    by_shard = dealt.groupBy(own)
    parsed = by_shard.applyInArrow(_parse_step(search, id_col, text_col, buckets), _TRAVEL)
    answers = parsed.repartition(buckets, "key").groupBy("key").applyInArrow(_classify_step, _TRAVEL)
    selected = dealt.groupBy(own).cogroup(answers.repartition(shards, "shard").groupBy("shard")).applyInArrow(_select_step(search, id_col, text_col, buckets), _TRAVEL)
    spans = selected.repartition(buckets, "key").groupBy("key").applyInArrow(_resolve_step(search, buckets), _TRAVEL)

    def finish(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        shard = Shard(table, id_col, text_col, search.unit)
        parts = [_unpacked(bytes(p), np.int64, np.int64, np.int64) for p in found.column("payload").to_pylist()]
        row, start, end = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        order = np.lexsort((start, row))
        return render(shard, *_merged(row[order], start[order], end[order]))

    return dealt.groupBy(own).cogroup(spans.repartition(shards, "shard").groupBy("shard")).applyInArrow(finish, schema)
