"""Sorted hash arrays in the shared folder, memory-mapped by the workers.

A table is cut into buckets by hash; a bucket is one file: 65,537 offsets by the
top 16 bits of a 48-bit key, the sorted 32-bit remainders, and columns of values.
Tasks write a bucket under a name of their own and rename it, so a repeated task
leaves the same file.  Where the folder is a plain path the file is mapped; any
other store is read into memory.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

_HEAD = 8


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """Arrays one after the other, each 8-byte aligned, behind their sizes."""
    system, path = _open(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as out:
        out.write(np.array([len(arrays), *(x.nbytes for x in arrays)], np.int64).tobytes())
        for x in arrays:
            out.write(x.tobytes())
            out.write(b"\0" * (-x.nbytes % _HEAD))
    system.move(own, path)


def map_arrays(uri: str, kinds: list) -> list[np.ndarray]:
    system, path = _open(uri)
    if isinstance(system, fs.LocalFileSystem):
        # A plain view of the map: indexing the map's own class costs more.
        raw = np.asarray(np.memmap(path, np.uint8, "r")) if os.path.getsize(path) else np.zeros(0, np.uint8)
    else:
        with system.open_input_file(path) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    sizes = raw[_HEAD : _HEAD * (len(kinds) + 1)].view(np.int64).tolist()
    at, out = _HEAD * (len(kinds) + 1), []
    for size, kind in zip(sizes, kinds):
        out.append(raw[at : at + size].view(kind))
        at += size + -size % _HEAD
    return out


class Opened:
    """Buckets opened when they are first met; the one unused for longest is
    closed when there are too many, or too many bytes in memory."""

    def __init__(self, most_files: int = 8192, most_bytes: int = 256 << 20):
        self.most_files, self.most_bytes = most_files, most_bytes
        self.held: OrderedDict[str, tuple[list[np.ndarray] | None, int]] = OrderedDict()
        self.bytes = 0

    def get(self, uri: str, kinds: list) -> list[np.ndarray] | None:
        """The arrays of a bucket, or None if it has no file (nothing is in it)."""
        if uri in self.held:
            self.held.move_to_end(uri)
            return self.held[uri][0]
        try:
            arrays = map_arrays(uri, kinds)
        except FileNotFoundError:
            arrays = None
        size = sum(0 if _mapped(x) else x.nbytes for x in arrays or [])
        self.held[uri] = arrays, size
        self.bytes += size
        while len(self.held) > 1 and (len(self.held) > self.most_files or self.bytes > self.most_bytes):
            self.bytes -= self.held.popitem(last=False)[1][1]
        return arrays


def _mapped(x: np.ndarray) -> bool:
    while x is not None and not isinstance(x, np.memmap):
        x = x.base if isinstance(x.base, np.ndarray) else None
    return x is not None


def key48(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)


def sorted_bucket(hashes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the (distinct) hashes in the bucket, and its two index arrays."""
    keys = key48(hashes)
    order = np.argsort(keys)
    ranked = keys[order]
    offsets = np.searchsorted(ranked >> np.uint64(32), np.arange(65537)).astype(np.uint32)
    return order, [offsets, (ranked & np.uint64(0xFFFFFFFF)).astype(np.uint32)]


def find(offsets: np.ndarray, remainders: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Position of each hash in a bucket, or -1: bisection of all at once."""
    keys = key48(hashes)
    top = (keys >> np.uint64(32)).astype(np.int64)
    want = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    low, high = offsets[top].astype(np.int64), offsets[top + 1].astype(np.int64)
    end = high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (remainders[np.minimum(middle, max(len(remainders) - 1, 0))] < want)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    if not len(remainders):
        return np.full(len(hashes), -1, np.int64)
    hit = (low < end) & (remainders[np.minimum(low, len(remainders) - 1)] == want)
    return np.where(hit, low, -1)
