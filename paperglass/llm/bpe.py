"""Operator 8, byte-level BPE encoding and decoding by monoid tree reduction.

Encodings of neighbouring texts form a monoid: the encoding of a concatenation
is the left part without a few elements at its end, the encoding of a window
around the boundary, and the right part without a few at its start.  Both levels
of the encoding are reduced that way, halves first, neighbours joined by
re-encoding a window that grows until what is outside provably cannot change:

* a text as a sequence of pieces (matches of the splitting pattern).  A match is
  settled on its left side if it holds a character that is no space and the text
  goes on for some characters behind it: the pattern looks no further.  The
  window runs from the last settled match of the left half into the right half,
  to a place where a match of the window and one of the right half begin
  together; matching depends only on what follows, so the rest stays;
* a piece as a sequence of tokens.  A token sequence is the encoding of its bytes
  if and only if each two neighbours encode, taken together, to just themselves;
  the window grows until that holds at both of its edges.

Short pieces are remembered in a table of bounded size.  Decoding concatenates the tokens' bytes
up the same kind of tree.

Rows are independent: one map, no shuffle.  Defined results: null text is an
empty text (no tokens); null ids are returned as they are; repeated rows get
equal answers; very long texts and pieces cost n log n; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents

LEAF_CHARS = 1 << 10
LEAF_BYTES = 1 << 7  # of a piece
#: What the splitting pattern may look at behind a match, with one to spare.
_LOOKS_AHEAD = 3
_REMEMBERED = 1 << 19


class TreeEncoder:
    """Encodes and decodes by the ranks in a file; see the module's text.

    The pattern's matches must cover the text, look behind nothing, and ahead at
    most _LOOKS_AHEAD characters beyond a run of spaces.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_id = {b: ranks[bytes([b])] for b in range(256) if bytes([b]) in ranks}
        self.shift = max(ranks.values()).bit_length()
        # What two neighbouring tokens merge into; its id is its rank.
        self.merged = {ranks[t[:k]] << self.shift | ranks[t[k:]]: i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair_ok = lru_cache(1 << 16)(self._pair_ok)
        self.known: dict[str, tuple[int, ...]] = {}

    # pieces -----------------------------------------------------------------

    def _merge(self, piece: bytes) -> list[int]:
        """The encoding of a short piece: lowest rank first, leftmost first."""
        if len(piece) > 2 * LEAF_BYTES:
            return self._merge_by_heap(piece)
        get, none, shift = self.merged.get, 1 << 60, self.shift
        part = list(map(self.byte_id.__getitem__, piece))
        rank = [get(x << shift | y, none) for x, y in zip(part, part[1:])]
        while rank and (least := min(rank)) < none:
            k = rank.index(least)
            part[k] = least
            del part[k + 1], rank[k]
            if k < len(rank):
                rank[k] = get(least << shift | part[k + 1], none)
            if k:
                rank[k - 1] = get(part[k - 1] << shift | least, none)
        return part

    def _merge_by_heap(self, piece: bytes) -> list[int]:
        """The same for a window of any size: n log n."""
        get, shift, n = self.merged.get, self.shift, len(piece)
        part = list(map(self.byte_id.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := get(part[k] << shift | part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            made, k, x, y = heapq.heappop(heap)
            j = after[k]
            if part[k] != x or j >= n or part[j] != y:
                continue  # one side was merged since
            part[k], part[j] = made, -1
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := get(made << shift | part[j])) is not None:
                    heapq.heappush(heap, (r, k, made, part[j]))
            i = before[k]
            if i >= 0 and (r := get(part[i] << shift | made)) is not None:
                heapq.heappush(heap, (r, i, part[i], made))
        return [p for p in part if p >= 0]

    def _pair_ok(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern, halved down to LEAF_BYTES."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) <= LEAF_BYTES:
            return self._merge(piece)
        half = 1 << (len(piece) - 1).bit_length() - 1  # runs of one symbol merge by powers of two
        return self._join_tokens(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        reach = 1
        while True:
            i, j = min(reach, len(left)), min(reach, len(right))
            inner = self._merge(b"".join(map(self.bytes_of.__getitem__, left[len(left) - i :] + right[:j])))
            if (i == len(left) or self.pair_ok(left[-i - 1], inner[0])) and (j == len(right) or self.pair_ok(inner[-1], right[j])):
                left[len(left) - i :] = inner
                left += right[j:]
                return left
            reach *= 2

    def _tokens(self, piece: str) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            got = tuple(self.encode_piece(piece.encode()))
            if len(piece) <= 64:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[piece] = got
        return got

    # texts ------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The pieces of a whole text, halved down to LEAF_CHARS."""
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        half = len(text) // 2
        return self._join_pieces(self.split(text[:half]), self.split(text[half:]))

    def _join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        kept, behind = len(left), 0
        while kept and not (behind >= _LOOKS_AHEAD and not left[kept - 1].isspace()):
            kept -= 1
            behind += len(left[kept])
        open_, reach = "".join(left[kept:]), 4
        while True:
            j = min(reach, len(right))
            window = open_ + "".join(right[:j])
            limit = len(window) if j == len(right) else len(window) - _LOOKS_AHEAD
            starts, at = {}, len(open_)  # where the pieces of the right half begin in the window
            for k in range(j):
                starts[at] = k
                at += len(right[k])
            if j == len(right):
                starts[at] = j
            pieces, at, settled = [], 0, True
            for piece in self.pattern.findall(window):
                if settled and at in starts:
                    break
                pieces.append(piece)
                at += len(piece)
                settled = at <= limit and (j == len(right) or not piece.isspace())
            if at in starts and settled:
                del left[kept:]
                left += pieces
                left += right[starts[at] :]
                return left
            reach *= 4

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return np.fromiter(chain.from_iterable(map(self._tokens, self.split(text))), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: halves decoded and concatenated up the tree."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(4)
def encoder(vocabulary: str, pattern: str) -> TreeEncoder:
    """The encoder of a rank file (base64 token and rank on each line)."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return TreeEncoder(ranks, pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): token ids and the bytes they decode to, for each row."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(vocabulary, pattern)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(at, 512)
                ids = [tree.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([tree.decode(x) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(encoded, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary")


def encoding_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, without moving the ids."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(vocabulary, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = tree.encode(text.as_py() or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(tree.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(digested, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
