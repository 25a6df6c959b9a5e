"""Operator 2, LM scoring with an interpolated modified Kneser-Ney model.

The trigram model is counted in Spark over all training texts and stored as
sorted hash arrays in the shared checkpoint folder; workers open the buckets they
meet as memory maps and score whole texts.  Aggregations make it:

1. words: counts, and with them a dense id for each word;
2. trigrams (u, v, w), dealt by their middle word.  A bucket then holds all of a
   context (u, v) and all of a pair (v, w), so it can store the counts of its
   trigrams, what each context needs and how many words come before each pair,
   without a further exchange;
3. hot words (as many occurrences as a good part of a bucket) are split by u, and
   where u is hot too by w, so no task collects a hot word or word pair; the
   partial sums of their pairs and contexts meet in one more exchange;
4. per word id: the sums its contexts and continuations need.

Every step combines in the map task first and ships binary blocks, one row for
each task and bucket.  Nothing is cut off: all words and trigrams of the training
texts are in the model, whose size follows the corpus.  The driver holds some
numbers of each bucket of words, and the ids of the hot words.

Two begin marks stand before every text.  A word that the model does not know has
the probability that the uniform distribution over all words and one more leaves.

Defined results: null text is an empty text, which still has its end token;
without any training text every probability is the uniform one over the unknown
word; repeated rows each count in training and are each scored; rows with a null
id belong to the training part; extra columns are ignored; a very long text is
one row's work; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import checkpoint_folder, checkpointed, documents, shards_for, text_bytes
from ._tables import Opened, find, map_arrays, sorted_bucket, write_arrays
from ._text import BLOCK_BYTES, LOWER_AZ, PrefixHash, blocks, mix

_LOWER = np.frombuffer(LOWER_AZ, np.uint8)
_END = np.uint64(0x1F3D5B79A1C3E507)  # the end token's hash
_SMALL = [np.uint8, np.uint32, np.uint64]  # counts as bytes, places and values of larger ones
_INDEX = [np.uint32, np.uint32]
_WORD_TABLE = [*_INDEX, np.uint64]
_COUNT_TABLE = [*_INDEX, *_SMALL]
_CONTEXT_TABLE = [*_INDEX, *_SMALL * 3]  # the sum, those of 1, and those of 2 and of more as one number
_ID_TABLE = [np.uint64, np.uint64, np.uint64, np.uint64, np.uint64]
_TEXT_AT_ONCE = 4 << 20
_HOT_TOKENS = 16  # a word is hot with one occurrence for so many bytes of a bucket


class KneserNey(NamedTuple):
    """Where the model is and the numbers that all words share."""

    folder: str
    buckets: int
    ids_per_range: int
    base: tuple[int, ...]  # first word id of each bucket
    tokens: int
    words: int
    pairs: int
    triple_discount: tuple[float, float, float]
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    backoff: float  # mass of the uniform distribution


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts of the numbers of items seen 1 to 4
    times; each is kept between 0 and its count where a number is missing."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, of some of the text at a time: a hash does not depend on
    its word's place, and running sums of all bytes would be many times the text."""
    out, first = np.empty(len(start), np.uint64), 0
    while first < len(start):
        begin = start[first]
        last = max(int(np.searchsorted(end, begin + BLOCK_BYTES, "right")), first + 1)
        out[first:last] = PrefixHash(_LOWER[data[begin : end[last - 1]]]).of(start[first:last] - begin, end[first:last] - begin)
        first = last
    return out


def _tokens(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of a block (each document's end token last), the
    number of each document's tokens, and the place of its first."""
    start, end, doc = block.words()
    n = np.bincount(doc, minlength=block.n) + 1
    del doc
    words = _word_hashes(block.data, start, end)
    del start, end
    last = np.cumsum(n) - 1
    out = np.full(int(n.sum()), _END, np.uint64)
    own = np.ones(len(out), bool)
    own[last] = False
    out[own] = words
    return out, n, last - n + 1


def _counts8(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes, and place and value of those that need more."""
    large = np.flatnonzero(counts > 254)
    small = np.minimum(counts, 255).astype(np.uint8)
    return small, large.astype(np.uint32), counts[large].astype(np.uint64)


def _wide(small: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = small.astype(np.uint64)
    out[at] = value
    return out


def _taken(places: np.ndarray, small: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The counts at some places."""
    out = small[places].astype(np.float64)
    large = np.flatnonzero(out == 255)
    if len(large):
        out[large] = value[np.searchsorted(at, places[large].astype(np.uint32))]
    return out


def _pair(two: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Two counts as one number, below 225 if both are below 15.  A bucket has
    less than 2**31 entries, so any two have room."""
    wide = (two << np.uint64(32)) | more | np.uint64(1 << 63)
    return np.where((two < 15) & (more < 15), two * np.uint64(15) + more, wide)


def _pair_taken(places: np.ndarray, small: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counts at some places."""
    code = small[places]
    two, more = (x.astype(np.float64) for x in np.divmod(code, np.uint8(15)))
    large = np.flatnonzero(code == 255)
    if len(large):
        wide = value[np.searchsorted(at, places[large].astype(np.uint32))]
        two[large], more[large] = wide >> np.uint64(32) & np.uint64((1 << 31) - 1), wide & np.uint64((1 << 32) - 1)
    return two, more


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, the first bytes of all numbers first, so that
    the high bytes, which are mostly zero, are met together.  Compressed here,
    they are small in the exchange's files and in the memory of both its sides."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return np.array([x.nbytes for x in arrays], np.int64).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _arrays(blob: bytes | pa.Buffer, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds)).tolist()
    raw, at, out = pa.decompress(memoryview(blob)[8 * len(kinds) :], sum(sizes), "zstd"), 0, []
    for size, kind in zip(sizes, kinds):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind)[:, 0] if size else np.zeros(0, kind))
        at += size
    return out


def _block_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["key", "payload"])


_BLOCKS = "key long, payload binary"
_PARTS = "kind int, key long, payload binary, numbers array<long>"
_IDS, _PAIRS, _CONTEXTS, _NUMBERS = range(4)  # kinds of rows between the steps


def _parts(rows: list[tuple[int, int, bytes | None, list[int] | None]]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(("kind", "key", "payload", "numbers"), kinds))})


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in rows sorted by keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = _heads(ranked)
    return ranked[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def _dealt(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order by bucket, and the slice of each bucket that there is."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by radix
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    first = _heads(ranked)
    return order, [(b, slice(x, y)) for b, x, y in zip(ranked[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ranked)])]


def _count_words(buckets: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            words, counts = _sums(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            order, parts = _dealt((words % np.uint64(buckets)).astype(np.int64))
            words, counts = words[order], counts[order]
            return _block_rows([(b, _blob(words[s], *_counts8(counts[s]))) for b, s in parts])

        for batch in batches:
            for block in blocks(batch.column(0), _TEXT_AT_ONCE):
                got = np.unique(_tokens(block)[0], return_counts=True)
                held.append((got[0], got[1].astype(np.uint64)))
                size += len(got[0])
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return step


def _store_words(folder: str, hot_count: int):
    def step(key: tuple, table: pa.Table) -> pa.Table:
        parts = [_arrays(p, np.uint64, *_SMALL) for p in table.column("payload").to_pylist()]
        words, counts = _sums(np.concatenate([p[0] for p in parts]), np.concatenate([_wide(*p[1:]) for p in parts]))
        order, index = sorted_bucket(words)
        counts = counts[order]
        write_arrays(f"{folder}/words-{key[0].as_py()}", [*index, counts])
        hot = np.flatnonzero(counts >= hot_count)
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(words)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "hot": pa.array([hot.tolist()], pa.list_(pa.int64()))})

    return step


class Words:
    """Ids and counts of words by their hashes."""

    def __init__(self, folder: str, buckets: int, base: tuple[int, ...]):
        self.folder, self.buckets, self.base, self.open = folder, buckets, base, Opened()

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (or -1) and count of each hash."""
        ids, counts, back = self.of_distinct(hashes)
        return ids[back], counts[back]

    def of_distinct(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id and count of each distinct hash, and which of them each hash is."""
        distinct, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.uint64)
        order, parts = _dealt((distinct % np.uint64(self.buckets)).astype(np.int64))
        for b, s in parts:
            if self.base[b + 1] > self.base[b]:
                table, own = self.open.get(f"{self.folder}/words-{b}", _WORD_TABLE), order[s]
                at = find(table[0], table[1], distinct[own])
                hit = at >= 0
                ids[own[hit]] = at[hit] + self.base[b]
                counts[own[hit]] = table[2][at[hit]]
        return ids, counts, back


@lru_cache(2)
def _words(folder: str, buckets: int, base: tuple[int, ...]) -> Words:
    return Words(folder, buckets, base)


def _hashed(*ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids[0]), np.uint64)
    for at in range(0, len(out), 1 << 16):  # small parts, so that no step needs much memory
        part = out[at : at + (1 << 16)]
        for x in ids:
            part[:] = mix(part * np.uint64(0xC2B2AE3D27D4EB4F) + x[at : at + (1 << 16)].astype(np.uint64) + np.uint64(1))
    return out


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _triple_bucket(u: np.ndarray, v: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By the middle word; hot ones also by the first, and by the last if both are."""
    key = _hashed(v)
    split = np.flatnonzero(np.isin(v, hot))
    key[split] = _hashed(v[split], u[split])
    split = split[np.isin(u[split], hot)]
    key[split] = _hashed(v[split], u[split], w[split])
    return _bucket(key, buckets)


def _before(ids: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first] = begin
    return out


def _contexts(w: np.ndarray, first: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    v = _before(w, first, mark)
    return _before(v, first, mark), v


def _counted_triples(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct trigrams in order, and how often each occurs; of numbers
    below 2**32."""
    if len(w) and max(int(v.max()), int(u.max()), int(w.max())) < 1 << 21:
        key = (u.astype(np.uint64) << np.uint64(42)) | (v.astype(np.uint64) << np.uint64(21)) | w.astype(np.uint64)
        key.sort()
        new = _heads(key)
        counts = np.diff(np.append(new, len(key))).astype(np.uint64)
        key = key[new]
        return *((key >> np.uint64(at) & np.uint64((1 << 21) - 1)).astype(np.uint32) for at in (42, 21, 0)), counts
    uv = (u.astype(np.uint64) << np.uint64(32)) | v.astype(np.uint64)
    order = np.lexsort((w, uv))
    uv, w = uv[order], w[order]
    new = _heads(uv, w)
    return (uv[new] >> np.uint64(32)).astype(np.int64), (uv[new] & np.uint64(0xFFFFFFFF)).astype(np.int64), w[new], np.diff(np.append(new, len(w))).astype(np.uint64)


def _order(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """An order in which equal trigrams, and equal u and v, are neighbours."""
    if not len(w):
        return np.zeros(0, np.int64)
    few, rank = np.unique(v, return_inverse=True)  # a bucket has few middle words
    of_u, of_v, of_w = (int(x).bit_length() for x in (u.max(), len(few), w.max()))
    if of_u + of_v + of_w > 64:
        return np.lexsort((w, v, u))
    key = u.astype(np.uint64) << np.uint64(of_v + of_w)
    key |= rank.astype(np.uint64) << np.uint64(of_w)
    key |= w.astype(np.uint64)
    del rank
    return np.argsort(key)


def _count_triples(folder: str, buckets: int, base: tuple[int, ...], hot: np.ndarray):
    begin = base[-1]  # the id of the begin mark, which is only a context
    kind = np.uint32 if begin < 2**32 - 1 else np.uint64

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _words(folder, buckets, base)
        for batch in batches:
            for block in blocks(batch.column(0), _TEXT_AT_ONCE):
                hashes, _, first = _tokens(block)
                ids, _, back = table.of_distinct(hashes)
                del hashes
                ids, number = np.unique(np.append(ids, begin), return_inverse=True)
                # Numbers within the block, so that two, mostly three, fit in 64 bits.
                mark, w = number[-1], number.astype(np.uint32)[back]
                del back
                u, v = _contexts(w, first, mark)
                # By the middle word first, which then repeats and takes little room.
                v, u, w, counts = _counted_triples(v, u, w)
                ids = ids.astype(kind)
                u, v, w = ids[u], ids[v], ids[w]
                order, parts = _dealt(_triple_bucket(u, v, w, hot, buckets))
                u, v, w, counts = u[order], v[order], w[order], counts[order]
                rows = []
                for b, s in parts:
                    heads = _heads(u[s], v[s])
                    many = np.diff(np.append(heads, s.stop - s.start)).astype(np.uint32)
                    rows.append((b, _blob(u[s][heads], v[s][heads], many, w[s], *_counts8(counts[s]))))
                del u, v, w, counts, order
                yield _block_rows(rows)

    return step, kind


def _numbers(counts: np.ndarray) -> list[int]:
    """How many items were seen 1 to 4 times, and how many there are."""
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)] + [len(counts)]


def _kinds(counts: np.ndarray, heads: np.ndarray) -> list[np.ndarray]:
    """Sums by group: of the counts, and of those of 1, of 2 and of more."""
    return [np.add.reduceat(x.astype(np.uint64), heads) if len(heads) else np.zeros(0, np.uint64) for x in (counts, counts == 1, counts == 2, counts > 2)]


def _write_counts(uri: str, hashes: np.ndarray, *columns: np.ndarray) -> None:
    order, index = sorted_bucket(hashes)
    write_arrays(uri, [*index, *(x for c in columns for x in _counts8(c[order]))])


def _write_contexts(uri: str, hashes: np.ndarray, total: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> None:
    _write_counts(uri, hashes, total, one, _pair(two, more))


def _id_rows(kind, per_range: int, v: np.ndarray, sums: list[np.ndarray], w: np.ndarray, seen: np.ndarray) -> list[tuple]:
    """What word ids get: as contexts (v, distinct) and as continuations (w)."""
    made = []
    ranges = np.union1d(v // per_range, w // per_range)
    vs, ws = (list(zip(np.searchsorted(x // per_range, ranges).tolist(), np.searchsorted(x // per_range, ranges, "right").tolist())) for x in (v, w))
    for r, (a, b), (c, d) in zip(ranges.tolist(), vs, ws):
        made.append((_IDS, r, _blob(v[a:b].astype(kind), *(x[a:b] for x in sums), w[c:d].astype(kind), seen[c:d].astype(np.uint64)), None))
    return made


def _pair_results(v: np.ndarray, w: np.ndarray, seen: np.ndarray, uri: str, kind, per_range: int) -> list[tuple]:
    """Stores how many words come before each pair (v, w), whole and sorted."""
    _write_counts(uri, _hashed(v, w), seen)
    heads = _heads(v)
    followers, many = np.unique(w, return_counts=True)
    return [*_id_rows(kind, per_range, v[heads], _kinds(seen, heads), followers, many), (_NUMBERS, 1, None, _numbers(seen))]


def _store_triples(folder: str, kind, hot: np.ndarray, buckets: int, per_range: int):
    def step(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        # Ids keep their kind, and what is done with goes: this is the step that needs most memory.
        parts = [_arrays(p.as_buffer(), kind, kind, np.uint32, kind, *_SMALL) for p in table.column("payload")]
        u, v = (np.concatenate([np.repeat(p[k], p[2]) for p in parts]) for k in (0, 1))
        w = np.concatenate([p[3] for p in parts])
        counts = np.concatenate([_wide(*p[4:]) for p in parts])
        del parts
        order = _order(u, v, w)
        u, v, w = u[order], v[order], w[order]
        counts = counts[order]
        del order
        new = _heads(u, v, w)
        u, v, w, counts = u[new], v[new], w[new], np.add.reduceat(counts, new)
        del new
        _write_counts(f"{folder}/triples-{number}", _hashed(u, v, w), counts)
        made = [(_NUMBERS, 0, None, _numbers(counts))]
        # Contexts: whole, but for those of two hot words.
        heads = _heads(u, v)
        sums, cu, cv = _kinds(counts, heads), u[heads], v[heads]
        del u, counts
        split = np.isin(cv, hot) & np.isin(cu, hot)
        _write_contexts(f"{folder}/contexts-{number}", _hashed(cu, cv)[~split], *(x[~split] for x in sums))
        order, slices = _dealt(_bucket(_hashed(cu[split], cv[split]), buckets))
        for b, s in slices:
            own = np.flatnonzero(split)[order[s]]
            made.append((_CONTEXTS, b, _blob(cu[own].astype(kind), cv[own].astype(kind), *(x[own] for x in sums)), None))
        # Pairs: whole, but for those of a hot first word.
        del cu, cv, sums
        if kind == np.uint32:
            pv = (v.astype(np.uint64) << np.uint64(32)) | w
            pv.sort()
            pv, pw = (pv >> np.uint64(32)).astype(kind), pv.astype(kind)
        else:
            order = np.lexsort((w, v))
            pv, pw = v[order], w[order]
            del order
        del v, w
        heads = _heads(pv, pw)
        seen = np.diff(np.append(heads, len(pv))).astype(np.uint64)
        pv, pw = pv[heads], pw[heads]
        split = np.isin(pv, hot)
        made += _pair_results(pv[~split], pw[~split], seen[~split], f"{folder}/pairs-{number}", kind, per_range)
        order, slices = _dealt(_bucket(_hashed(pv[split], pw[split]), buckets))
        for b, s in slices:
            own = np.flatnonzero(split)[order[s]]
            made.append((_PAIRS, b, _blob(pv[own].astype(kind), pw[own].astype(kind), *_counts8(seen[own])), None))
        return _parts(made)

    return step


def _store_split(folder: str, kind, per_range: int):
    """The pairs and contexts that were split, put together."""

    def step(key: tuple, table: pa.Table) -> pa.Table:
        number, kinds, payload = key[0].as_py(), table.column("kind").to_numpy(), table.column("payload").to_pylist()
        made = []
        parts = [_arrays(payload[k], kind, kind, *_SMALL) for k in np.flatnonzero(kinds == _PAIRS)]
        if parts:
            v, w = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (0, 1))
            seen = np.concatenate([_wide(*p[2:]) for p in parts])
            order = np.lexsort((w, v))
            heads = _heads(v[order], w[order])
            made += _pair_results(v[order][heads], w[order][heads], np.add.reduceat(seen[order], heads), f"{folder}/hot-pairs-{number}", kind, per_range)
        parts = [_arrays(payload[k], kind, kind, *[np.uint64] * 4) for k in np.flatnonzero(kinds == _CONTEXTS)]
        if parts:
            u, v, *sums = (np.concatenate([p[k] for p in parts]) for k in range(6))
            order = np.lexsort((v, u))
            heads = _heads(u[order], v[order])
            _write_contexts(f"{folder}/hot-contexts-{number}", _hashed(u[order][heads], v[order][heads]), *(np.add.reduceat(x[order], heads) for x in sums))
        return _parts(made)

    return step


def _store_ids(folder: str, kind, per_range: int):
    def step(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        out = [np.zeros(per_range, k) for k in _ID_TABLE]
        for p in table.column("payload").to_pylist():
            v, *sums, w, seen = _arrays(p, kind, *[np.uint64] * 4, kind, np.uint64)
            at = v.astype(np.int64) - number * per_range  # distinct within a block
            for x, add in zip(out, sums):
                x[at] += add
            out[4][w.astype(np.int64) - number * per_range] += seen
        write_arrays(f"{folder}/ids-{number}", out)
        numbers = _numbers(out[4])[:4] + [int(np.count_nonzero(out[4]))]
        return _parts([(_NUMBERS, 2, None, numbers)])

    return step


def _totals(parts: DataFrame) -> dict[int, list[int]]:
    """The numbers of all buckets, by level: one row each."""
    rows = parts.where(F.col("kind") == _NUMBERS).groupBy("key").agg(*(F.sum(F.get("numbers", F.lit(k))).alias(f"n{k}") for k in range(5))).collect()
    return {r["key"]: [r[f"n{k}"] for k in range(5)] for r in rows}


def fit_kneser_ney(train: DataFrame, text_col: str = "text", bucket_bytes: int = 16 << 20, ids_per_range: int = 1 << 20) -> KneserNey:
    """Counts the model of the texts and stores it in the shared folder."""
    spark = train.sparkSession
    texts = train.select(text_col)
    folder = f"{checkpoint_folder(spark)}/kneser-ney-{uuid.uuid4().hex}"
    buckets = shards_for(text_bytes(texts, text_col), bucket_bytes)
    counted = texts.mapInArrow(_count_words(buckets), _BLOCKS).repartition(buckets, "key").groupBy("key")
    stored = counted.applyInArrow(_store_words(folder, max(bucket_bytes // _HOT_TOKENS, 1)), "key long, n long, total long, hot array<long>").collect()
    sizes, tokens = [0] * buckets, 0
    for r in stored:
        sizes[r["key"]], tokens = r["n"], tokens + r["total"]
    base = tuple(int(x) for x in np.concatenate(([0], np.cumsum(sizes))))
    words = base[-1]
    # The begin mark is before every document.
    hot = np.array(sorted([words, *(at + base[r["key"]] for r in stored for at in r["hot"])]), np.int64)
    write_arrays(f"{folder}/hot", [hot])
    count, kind = _count_triples(folder, buckets, base, hot)
    triples = texts.mapInArrow(count, _BLOCKS).repartition(buckets, "key").groupBy("key")
    whole = checkpointed(triples.applyInArrow(_store_triples(folder, kind, hot, buckets, ids_per_range), _PARTS))
    split = whole.where(F.col("kind").isin(_PAIRS, _CONTEXTS)).repartition(buckets, "key").groupBy("key")
    split = checkpointed(split.applyInArrow(_store_split(folder, kind, ids_per_range), _PARTS))
    every = whole.unionByName(split)
    of_ids = every.where(F.col("kind") == _IDS).repartition(shards_for(words + 1, ids_per_range), "key").groupBy("key")
    numbers = _totals(every) | _totals(of_ids.applyInArrow(_store_ids(folder, kind, ids_per_range), _PARTS))
    of_triples, of_pairs, of_words = (numbers.get(k, [0] * 5) for k in range(3))
    d = discounts(of_words[:4])
    more = of_words[4] - of_words[0] - of_words[1]
    mass = d[0] * of_words[0] + d[1] * of_words[1] + d[2] * more
    return KneserNey(folder, buckets, ids_per_range, base, tokens, words, of_pairs[4], discounts(of_triples[:4]), discounts(of_pairs[:4]), d, mass / of_pairs[4] if of_pairs[4] else 1.0)


class Scorer:
    """The stored model: probabilities of token sequences."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.words = _words(model.folder, model.buckets, model.base)
        self.open = Opened()
        self.hot = map_arrays(f"{model.folder}/hot", [np.int64])[0]

    def _looked_up(self, name: str, kinds: list, columns: int, bucket: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """columns x rows of counts from the tables of a name; 0 where there is none."""
        out = np.zeros((columns, len(hashes)))
        order, parts = _dealt(bucket)
        for b, s in parts:
            table = self.open.get(f"{self.model.folder}/{name}-{b}", kinds)
            if table is not None:
                own = order[s]
                at = find(table[0], table[1], hashes[own])
                hit = at >= 0
                for c in range(min(columns, 2)):
                    out[c, own[hit]] = _taken(at[hit], *table[2 + 3 * c : 5 + 3 * c])
                if columns == 4:
                    out[2, own[hit]], out[3, own[hit]] = _pair_taken(at[hit], *table[8:11])
        return out

    def _of_ids(self, ids: np.ndarray, columns: list[int]) -> list[np.ndarray]:
        out = [np.zeros(len(ids), np.float64) for _ in columns]
        order, parts = _dealt(ids // self.model.ids_per_range)
        for r, s in parts:
            table = self.open.get(f"{self.model.folder}/ids-{r}", _ID_TABLE)
            if table is not None:
                at = ids[order[s]] - r * self.model.ids_per_range
                for x, c in zip(out, columns):
                    x[order[s]] = table[c][at]
        return out

    def _discounted(self, count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.where(count > 0, count - np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)], 0.0)

    def _interpolated(self, count: np.ndarray, sums: list[np.ndarray], d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
        """The discounted share of a count in its context, and the lower order's
        probability for what the discounts leave; that alone in an unseen context."""
        total = np.maximum(sums[0], 1)
        mixed = self._discounted(count, d) / total + (d[0] * sums[1] + d[1] * sums[2] + d[2] * sums[3]) / total * lower
        return np.where(sums[0] > 0, mixed, lower)

    def word_probability(self, word: np.ndarray) -> np.ndarray:
        """Continuation probability of word ids; -1 is the unknown word."""
        m = self.model
        known = np.flatnonzero(word >= 0)
        seen = np.zeros(len(word))
        seen[known] = self._of_ids(word[known], [4])[0]
        return self._discounted(seen, m.word_discount) / max(m.pairs, 1) + m.backoff / (m.words + 1)

    def _by_split(self, names: tuple[str, str], kinds: list, columns: int, plain: np.ndarray, split: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Lookups in the tables of whole entries, or in those put together later."""
        out = np.zeros((columns, len(hashes)))
        for name, rows, bucket in ((names[0], ~split, plain), (names[1], split, _bucket(hashes, self.model.buckets))):
            out[:, rows] = self._looked_up(name, kinds, columns, bucket[rows], hashes[rows])
        return out

    def probability(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """P(w | u v) of ids; -1 is unknown, words is the begin mark."""
        m = self.model
        out = self.word_probability(w)
        at = np.flatnonzero(v >= 0)
        if not len(at):
            return out
        u, v, w = u[at], v[at], w[at]
        hot_v, hot_u = np.isin(v, self.hot), np.isin(u, self.hot)
        # second order
        sums = self._of_ids(v, [0, 1, 2, 3])
        seen = np.zeros(len(at))
        k = np.flatnonzero(w >= 0)
        seen[k] = self._by_split(("pairs", "hot-pairs"), _COUNT_TABLE, 1, _bucket(_hashed(v[k]), m.buckets), hot_v[k], _hashed(v[k], w[k]))[0]
        lower = self._interpolated(seen, sums, m.pair_discount, out[at])
        # third order
        k = np.flatnonzero(u >= 0)
        both = hot_u[k] & hot_v[k]
        place = np.where(hot_v[k], _hashed(v[k], u[k]), _hashed(v[k]))
        sums = self._by_split(("contexts", "hot-contexts"), _CONTEXT_TABLE, 4, _bucket(place, m.buckets), both, _hashed(u[k], v[k]))
        count = np.zeros(len(k))
        j = np.flatnonzero((w[k] >= 0) & (sums[0] > 0))
        t = k[j]
        count[j] = self._looked_up("triples", _COUNT_TABLE, 1, _triple_bucket(u[t], v[t], w[t], self.hot, m.buckets), _hashed(u[t], v[t], w[t]))[0]
        lower[k] = self._interpolated(count, list(sums), m.triple_discount, lower[k])
        out[at] = lower
        return out


@lru_cache(2)
def _scorer(model: KneserNey) -> Scorer:
    return Scorer(model)


def score_texts(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(model)
        for batch in batches:
            out = []
            for block in blocks(batch.column(1), _TEXT_AT_ONCE // 2):
                hashes, many, first = _tokens(block)
                doc = np.repeat(np.arange(block.n), many)
                word, count = scorer.words.find(hashes)
                v = _before(word, first, model.words)
                base = np.log10((count.astype(np.float64) + 1) / (model.tokens + 1 * (model.words + 1)))
                score = np.log10(scorer.probability(_before(v, first, model.words), v, word))
                out.append([np.bincount(doc, x, block.n) for x in (np.ones(len(doc)), count > 0, base, score)])
            n, known, base, score = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / np.maximum(n, 1)))], names=[id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double"
    return docs.select(id_col, text_col).mapInArrow(scored, schema)


def _held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_kneser_ney(docs.where(~_held_out(F.col("doc_id"))))
    return score_texts(docs, model).select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
