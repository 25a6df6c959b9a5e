"""Vectorised text primitives shared by the corpus operators.

Everything here works on the UTF-8 bytes of Arrow string columns.  The word
separators of all operators (space and TAB..CR) are ASCII, so words can be cut
on bytes without decoding; a document never shares a word, line or n-gram with
its neighbour in the batch because each document start is a forced boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once inside a batch; longer documents form a block alone.
BLOCK_BYTES = 1 << 20

IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Byte table lowering A-Z only, for ``bytes.translate`` and numpy alike.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, and 5 modulo 8
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    """Polynomial hashes of any byte range of a block from one prefix sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, end); equal bytes give equal hashes."""
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def symbol_ranges(symbols: np.ndarray) -> "PrefixHash":
    """The same for a sequence of 64-bit symbols instead of bytes."""
    out = PrefixHash.__new__(PrefixHash)
    power, out.inverse = powers(len(symbols))
    out.prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power[: len(symbols)], out=out.prefix[1:])
    return out


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type):
        column = pa.array([""] * len(column), pa.string())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Block:
    """Some neighbouring documents of a batch: bytes, and where each begins."""

    __slots__ = ("first", "data", "offsets", "n")

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.n = first, data, offsets, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end (bytes) of each word, and the document it is in."""
        size = len(self.data)
        if not size:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        inside = ~IS_SEPARATOR[self.data]
        before = np.empty(size, bool)  # the byte before is no part of the same word
        before[0] = True
        np.logical_not(inside[:-1], out=before[1:])
        after = np.empty(size, bool)
        after[-1] = True
        np.logical_not(inside[1:], out=after[:-1])
        edges = self.offsets[1:-1]
        before[edges[edges < size]] = True
        after[edges[edges > 0] - 1] = True
        start = np.flatnonzero(inside & before)
        end = np.flatnonzero(inside & after) + 1
        return start, end, np.searchsorted(self.offsets, start, "right") - 1

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each document."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES, most_rows: int | None = None) -> Iterator[Block]:
    """The column's texts in blocks of about block_bytes, whole documents each."""
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), n, first + (most_rows or n))
        yield Block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def run_lengths(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and its length."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
    return first, np.diff(np.append(first, len(sorted_keys)))


def counts_of_equal(keys: np.ndarray) -> np.ndarray:
    """For each key, how often it occurs among the keys."""
    order = np.argsort(keys)
    first, length = run_lengths(keys[order])
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(length, length)
    return out
