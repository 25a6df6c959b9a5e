"""Operator 7, SimHash near-duplicates by multi-index hashing.

Each text becomes one 64-bit fingerprint: a majority vote, bit by bit, over the
XXH64 values of its word shingles.  Fingerprints that differ in few bits are
found by multi-index hashing: a fingerprint is cut into two 32-bit segments;
two fingerprints at distance d <= 3 agree in one segment up to one bit, so
every fingerprint is filed under each of its segments and probes the tables
with the Hamming ball of radius one around each segment.  A pair whose segments
differ in one bit meets once, because only the flips from 0 to 1 are probed.
Complete distances are then verified.

Scale: copies collapse to one fingerprint (map-side combined) before anything is
indexed, so the index holds 34 narrow rows for each *distinct* fingerprint on
average.  Within one table entry no pairs are emitted: a breadth-first search
takes verified neighbours out of the entry's set and emits a spanning forest,
fewer edges than members.  Components are joined by star contraction in
checkpointed rounds.

Near-duplicates of any similarity (``similar_groups``) use wider fingerprints
and more segments of the same kind for candidates, and an exact check.

Defined results: null text is an empty text, whose fingerprint is zero, linked
like any other; null doc_id rows get a fingerprint and the component of their
group, the smallest non-null doc_id in it (null if there is none); repeated rows
are all returned; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import checkpointed, connected_components, documents, shards_for
from ._shared import least_members as _least_members
from ._text import LOWER_AZ, mix, run_lengths, text_buffers

_SEED = 42
_SEGMENT_BITS = 32
_MOST_HASHES = 1 << 16  # shingle hashes turned into bits at once


def fingerprint(text: bytes, shingle_words: int) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle_words])).tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], _SEED) for s, e in zip(starts, stops, strict=True)], dtype="<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _MOST_HASHES):
        part = hashes[at : at + _MOST_HASHES]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            whole, cuts = data.tobytes(), offsets.tolist()
            got = [fingerprint(whole[a:b], shingle_words) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(hashed, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def _neighbours(members: np.ndarray, most_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Verified links that span the components of one table entry."""
    left = members
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= most_bits
            if near.any():
                found = left[near]
                left = left[~near]
                frontier.extend(found)
                yield at, found


def link_edges(distinct: DataFrame, fp_col: str = "fp", most_bits: int = 3) -> DataFrame:
    """(a, b): links that span the components of fingerprints within most_bits.

    distinct holds each fingerprint (long) once.  most_bits may be 0 to 3: that
    is what two segments with balls of radius one cover.
    """
    if not 0 <= most_bits <= 3:
        raise ValueError("two segments with balls of radius one cover 0 to 3 bits")
    fp = F.col(fp_col)
    bit = F.when(F.col("flip") >= 0, F.expr("shiftleft(1L, flip)")).otherwise(F.lit(0).cast("long"))
    segment = F.when(F.col("which") == 0, F.col("fp").bitwiseAND(F.lit((1 << _SEGMENT_BITS) - 1))).otherwise(F.shiftrightunsigned("fp", _SEGMENT_BITS))
    rows = (
        distinct.select(fp.alias("fp"))
        .select("fp", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("which"))
        .select("fp", "which", segment.alias("segment"))
        .select("fp", "which", "segment", F.explode(F.sequence(F.lit(-1), F.lit(_SEGMENT_BITS - 1))).alias("flip"))
        # Probes flip 0 to 1 only: the other of such a pair finds the same entry as its own.
        .where(F.col("segment").bitwiseAND(bit) == 0)
        .select((F.col("segment").bitwiseOR(bit) + F.col("which") * F.lit(1 << _SEGMENT_BITS)).alias("entry"), (F.col("flip") < 0).alias("own"), "fp")
    )

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()) for b in batches]
        if not held:
            return
        entry, own, fps = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(entry, kind="stable")
        entry, own, fps = entry[order], own[order], fps[order].view(np.uint64)
        first, length = run_lengths(entry)
        owners = np.add.reduceat(own.astype(np.int64), first)
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        pair = first[(length == 2) & (owners > 0)]  # most entries that matter: two members
        near = pair[np.bitwise_count(fps[pair] ^ fps[pair + 1]) <= most_bits]
        a.append(fps[near])
        b.append(fps[near + 1])
        for s, n in zip(*(x[(length > 2) & (owners > 0)].tolist() for x in (first, length)), strict=True):
            for at, found in _neighbours(fps[s : s + n], most_bits):
                a.append(np.full(len(found), at, np.uint64))
                b.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    # 34 rows a fingerprint, some hundred thousand to a task, whatever the table's size.
    return rows.repartition(shards_for(34 * distinct.count(), 400_000, 8), "entry").mapInArrow(linked, "a long, b long").distinct()


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, most_bits: int = 3) -> DataFrame:
    """(id, fp, component): every row with the smallest id of its group."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    parts = connected_components(link_edges(distinct, "fp", most_bits))
    # Only fingerprints with a link have a row in parts; any other is its own component.
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    groups = named.join(least, "root").select("fp", "component")
    return prints.join(groups, "fp").select(id_col, "fp", "component")


WIDE_BITS = 256
_WORDS = WIDE_BITS // 64
_CROWD = 256  # members of a cell that are compared all at once
_FOLD = np.random.default_rng(7).integers(0, 1 << 63, (2, _WORDS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """The distinct shingle hashes of one text, ascending; a shorter text is one
    shingle, one without words has none."""
    words = text.translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(len(words) - shingle_words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], _SEED) for s, e in zip(starts, stops, strict=True)], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a shingle set in WIDE_BITS bits: each hash is folded
    into several words, and each bit is the majority's."""
    votes = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte can count
        part = hashes[at : at + 255, None] * _FOLD[0] + _FOLD[1]
        part = mix(part).view(np.uint8).reshape(len(part), -1)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")


@dataclass(frozen=True)
class WideIndex:
    """Multi-index hashing of wide fingerprints.

    Two texts of similarity J differ in a bit with probability p (the angle
    between their votes, over pi).  A segment of ``bits`` bits is met if it
    differs in one bit at most; ``segments`` are as many as a pair at the
    threshold needs to be met with a probability of 0.999.  The first segments
    are disjoint, further ones take the bits in another fixed order.  Fingerprints
    whose complete distance is above ``most_bits`` (four standard deviations over
    the expected one) are no candidates.
    """

    bits: int
    segments: int
    most_bits: int

    @staticmethod
    def of(similarity: float, rows: int) -> "WideIndex":
        """Segments grow with the rows, so that a cell holds few; the probability
        that a pair is met is the same at any size."""
        p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
        bits = min(max(16, 2 * int(np.ceil((np.log2(max(rows, 2)) - 3) / 2))), 32)
        met = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
        segments = int(np.ceil(np.log(0.001) / np.log(1 - met))) if met < 1 else 1
        return WideIndex(bits, segments, int(WIDE_BITS * p + 4 * (WIDE_BITS * p * (1 - p)) ** 0.5))

    def cut(self, prints: np.ndarray) -> np.ndarray:
        """rows x segments values of fingerprints (rows x words)."""
        each = WIDE_BITS // self.bits
        bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
        out = []
        for first in range(0, self.segments, each):
            order = np.random.default_rng(first).permutation(WIDE_BITS) if first else np.arange(WIDE_BITS)
            for k in range(min(each, self.segments - first)):
                packed = np.packbits(bits[:, order[k * self.bits : (k + 1) * self.bits]], axis=1, bitorder="little")
                wide = np.zeros((len(prints), 8), np.uint8)
                wide[:, : packed.shape[1]] = packed
                out.append(wide.view("<u8")[:, 0])
        return np.stack(out, axis=1)


def _distance(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints a and b (places in prints)."""
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)


def _ranges(low: np.ndarray, high: np.ndarray, at_once: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for every place in [low, high) of every row, in parts."""
    size = np.maximum(high - low, 0)
    reach = np.cumsum(size)
    first = 0
    while first < len(size):
        last = max(int(np.searchsorted(reach, (reach[first - 1] if first else 0) + at_once, "right")), first + 1)
        n = size[first:last]
        row = np.repeat(np.arange(first, last), n)
        yield row, np.arange(int(n.sum())) + np.repeat(low[first:last] - (np.cumsum(n) - n), n)
        first = last


def cell_candidates(code: np.ndarray, node: np.ndarray, prints: np.ndarray, half: int, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that span the components of all candidates: rows whose codes
    (sorted) agree but for one of the low half bits, and whose complete distance
    is most_bits or less.  They are the one of the least node for each row, what
    joins the components that these leave apart, and in crowded cells those that a
    search from member to member finds."""
    first, length = run_lengths(code)
    size = np.repeat(length, length)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        near = _distance(prints, x, y) <= most_bits
        a.append(x[near])
        b.append(y[near])

    plain = np.flatnonzero(size <= _CROWD)
    own_end = np.repeat(first + length, length)
    for row, place in _ranges(plain + 1, own_end[plain]):
        keep(plain[row], place)
    for k in range(half):
        bit = np.int64(1 << k)
        asks = plain[code[plain] & bit == 0]
        low = np.searchsorted(code, code[asks] | bit)
        high = np.searchsorted(code, code[asks] | bit, "right")
        high = np.where(high - low <= _CROWD, high, low)  # crowded cells ask themselves
        for row, place in _ranges(low, high):
            keep(asks[row], place)
    x, y = np.concatenate([*a, *b]), np.concatenate([*b, *a])
    order = np.lexsort((node[y], x))
    x, y = x[order], y[order]
    lead = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    apart = _joining(x[lead], y[lead], x, y, len(code))
    a, b = [x[lead], x[apart]], [y[lead], y[apart]]
    for s, m in zip(first[length > _CROWD].tolist(), length[length > _CROWD].tolist()):
        cells = np.concatenate(([code[s]], code[s] ^ (np.int64(1) << np.arange(half, dtype=np.int64))))
        members = np.concatenate([np.arange(x, y) for x, y in zip(np.searchsorted(code, cells).tolist(), np.searchsorted(code, cells, "right").tolist())])

        def near(one: int, some: np.ndarray) -> np.ndarray:
            some = some[np.bitwise_count((code[some] ^ code[one]).view(np.uint64)) <= 1]
            return some[_distance(prints, np.full(len(some), one), some) <= most_bits]

        for at, found in _forest(members, near):
            a.append(np.full(len(found), at))
            b.append(found)
    return np.concatenate(a), np.concatenate(b)


def _joining(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the links x, y between rows 0 to n - 1 join the components that
    the links a, b leave apart: some that do, until none is left."""
    label, left, chosen = _labels(a, b, n), np.arange(len(x)), [np.zeros(0, np.int64)]
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return np.concatenate(chosen)
        one = left[np.unique(np.maximum(label[x[left]], label[y[left]]), return_index=True)[1]]
        chosen.append(one)
        label = _labels(label[x[one]], label[y[one]], n)[label]


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row of the component of each of n rows."""
    out = np.arange(n)
    member, root = _least_members(a, b)
    out[member] = root
    return out


def _with_set(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """pairs with the shingle set of the node in key; a node of many pairs is
    dealt in several parts."""
    busy = pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / 256).cast("long").alias("parts")).where("parts > 1")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    other = "b" if key == "a" else "a"
    dealt = pairs.join(busy, key, "left").withColumn("part", F.pmod(F.xxhash64(other), parts)).drop("parts")
    held = sets.join(busy.withColumnRenamed(key, "node"), "node", "left").select(F.col("node").alias(key), F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))).alias("part"), F.col("hashes").alias(f"set_{key}"))
    return dealt.join(held, [key, "part"]).drop("part")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that span the components of the pairs whose sets have that
    Jaccard similarity or more, compared exactly."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            left, right = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            both = np.fromiter((len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)), np.int64, batch.num_rows)
            total = np.fromiter((len(x) + len(y) for x, y in zip(left, right)), np.int64, batch.num_rows)
            near = both / np.maximum(total - both, 1) >= similarity
            a.append(batch.column(0).to_numpy()[near])
            b.append(batch.column(1).to_numpy()[near])
        member, root = _least_members(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(member)], names=["a", "b"])

    held = _with_set(_with_set(pairs, sets, "a"), sets, "b").select("a", "b", "set_a", "set_b")
    return checkpointed(held.mapInArrow(compared, "a long, b long").distinct())


#: Nodes of one family that one task compares, and their shingles.
_ASK_ROWS, _ASK_HASHES, _BLOCK_ROWS, _BLOCK_HASHES = 256, 100_000, 1024, 500_000


def _shared_counts(asks: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of asks shares with each of others: each hash of
    an other set counts for the asks that hold it."""
    hashes = np.concatenate([np.zeros(0, np.uint64), *asks])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], np.repeat(np.arange(len(asks)), [len(x) for x in asks])[order]
    out = np.zeros((len(asks), len(others)), np.int32)
    for k, x in enumerate(others):
        low = np.searchsorted(hashes, x)
        n = np.searchsorted(hashes, x, "right") - low
        place = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        out[:, k] = np.bincount(owner[place], minlength=len(asks))
    return out


def _verified_across(families: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): further links within families (node, family, n: candidates that
    hang together, and the size of their sets) between nodes that links do not
    yet join.

    In each family only pairs count that its largest class does not hold both of.
    The nodes outside of it are dealt into blocks, which meet blocks of all nodes
    of the family; a set travels once for each block that it meets, not for each
    pair, and all pairs of two blocks are compared exactly.
    """
    parts = connected_components(links)
    state = checkpointed(families.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = state.groupBy("family", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("hashes"))
    most = F.max_by(F.struct("root", "rows", "hashes"), F.struct("rows", "root"))
    sizes = classes.groupBy("family").agg(F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes"), most.alias("most")).where("rows > most.rows")
    blocks = lambda rows, most_rows, hashes, most_hashes: F.ceil(F.greatest(rows / most_rows, hashes / most_hashes)).cast("long")
    ask = blocks(F.col("rows") - F.col("most.rows"), _ASK_ROWS, F.col("hashes") - F.col("most.hashes"), _ASK_HASHES)
    sizes = sizes.select("family", F.col("most.root").alias("major"), ask.alias("ask_blocks"), blocks(F.col("rows"), _BLOCK_ROWS, F.col("hashes"), _BLOCK_HASHES).alias("all_blocks"))
    rows = state.join(sizes, "family")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    asks = rows.where("root != major").select("node", "root", "family", F.lit(True).alias("asks"), mine("ask_blocks").alias("ask_block"), upto("all_blocks").alias("block"))
    others = rows.select("node", "root", "family", F.lit(False).alias("asks"), upto("ask_blocks").alias("ask_block"), mine("all_blocks").alias("block"))
    dealt = asks.unionByName(others).join(sets, "node")

    def compared(table: pa.Table) -> pa.Table:
        node, root, asking = (table.column(c).to_numpy() for c in ("node", "root", "asks"))
        held = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = np.array([len(x) for x in held], np.int64)
        left, right = np.flatnonzero(asking), np.flatnonzero(~asking)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(left) and len(right):
            both = _shared_counts([held[k] for k in left], [held[k] for k in right])
            whole = size[left][:, None] + size[right][None] - both
            near = (both >= similarity * whole) & (root[left][:, None] != root[right][None])
            x, y = np.nonzero(near)
            a, b = node[left[x]], node[right[y]]
        member, least = _least_members(a, b)
        return pa.table({"a": pa.array(least, pa.int64()), "b": pa.array(member, pa.int64())})

    return checkpointed(dealt.groupBy("family", "ask_block", "block").applyInArrow(compared, "a long, b long").distinct())


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component): rows with an id, and the smallest id of the group of
    texts that similarity links.

    Candidates come from multi-index hashing of fingerprints of 256 bits
    (``WideIndex``); a row is filed twice for each segment, under either half of
    it, and the ball of radius one around the other half is enumerated among the
    rows that share the first.  A link is then decided by the exact Jaccard
    similarity of the two sets of shingle hashes.  Candidates that hang together are a
    family.  First one candidate of each row is compared, the one that most rows
    have: a large group then hangs on its centre.  What that leaves apart within a
    family is compared in blocks (``_verified_across``), so no link is missed for
    the first step's sake, and no group is paired with itself.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            whole, cuts = data.tobytes(), offsets.tolist()
            node, n, prints = [], [], [np.zeros((0, _WORDS), np.uint64)]
            for x, y in zip(cuts, cuts[1:]):
                one = shingle_set(whole[x:y], shingle_words)
                node.append(xxhash.xxh64_intdigest(one.tobytes(), _SEED))
                n.append(len(one))
                prints.append(wide_fingerprint(one)[None])
            words = np.concatenate(prints).view(np.int64).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(w)) for w in words)], names=["id", "node", "n", *names])

    names = [f"f{k}" for k in range(_WORDS)]
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = checkpointed(known.mapInArrow(hashed, "id long, node long, n long, " + ", ".join(f"{f} long" for f in names)))
    distinct = checkpointed(prints.groupBy("node").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), *(F.first(f).alias(f) for f in names)))
    rows = distinct.count()
    index = WideIndex.of(similarity, rows)
    half = index.bits // 2

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                cut = index.cut(np.ascontiguousarray(np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(_WORDS)], axis=1))).astype(np.int64)
                table = np.arange(index.segments, dtype=np.int64)
                # The half a row is filed under, then the half around which the ball is.
                low, high = cut & ((1 << half) - 1), cut >> half
                code = np.concatenate([((2 * table << half) + high << half) + low, ((2 * table + 1 << half) + low << half) + high], axis=1)
                row = pa.array(np.repeat(np.arange(batch.num_rows), code.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), pa.array((code >> half).ravel()), *(batch.column(k).take(row) for k in range(1 + _WORDS))], names=["code", "entry", "node", *names])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[x.column(k).to_numpy() for k in range(2 + _WORDS)] for x in batches if x.num_rows]
        if not held:
            return
        code, node, *words = (np.concatenate([h[k] for h in held]) for k in range(2 + _WORDS))
        order = np.lexsort((node, code))
        code, node = code[order], node[order]
        a, b = cell_candidates(code, node, np.stack([w[order].view(np.uint64) for w in words], axis=1), half, index.most_bits)
        once = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], names=["a", "b"])

    made = distinct.where("n > 0").select("node", *names).mapInArrow(filed, "code long, entry long, node long, " + ", ".join(f"{f} long" for f in names))
    dealt = made.repartition(shards_for(2 * index.segments * rows, 200_000, 8), "entry").select("code", "node", *names)
    first = checkpointed(dealt.mapInArrow(paired, "a long, b long").distinct())
    families = checkpointed(connected_components(first).withColumnRenamed("root", "family").join(distinct.select("node", "n"), "node"))
    touched = families.select("node")
    texts = prints.groupBy("node").agg(F.min("id").alias("id")).join(touched, "node")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            whole, cuts = data.tobytes(), offsets.tolist()
            got = [shingle_set(whole[x:y], shingle_words).tobytes() for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(x, _SEED) for x in got], np.uint64).view(np.int64)), pa.array(got, pa.binary())], names=["node", "hashes"])

    # A repeated id may stand for several texts: the set itself tells its node.
    sets = known.join(texts.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(as_sets, "node long, hashes binary")
    sets = checkpointed(sets.join(touched, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes")))
    either = first.union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wanted = either.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    lead = either.join(wanted, "b").groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    links = _verified(lead.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, similarity)
    more = _verified_across(families, links, sets, similarity)
    parts = connected_components(links.union(more))
    named = distinct.join(parts, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component"))
    return prints.select("id", "node").join(named.join(least, "root").select("node", "component"), "node").select(F.col("id").alias(id_col), "component")


def _forest(members: np.ndarray, near) -> Iterator[tuple[int, np.ndarray]]:
    """Candidates that span the components of one cell's candidates."""
    left = members
    while len(left) > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            found = near(at, left)
            if len(found):
                left = np.setdiff1d(left, found, assume_unique=True)
                frontier.extend(found.tolist())
                yield at, found


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without those similar to a document of smaller id, all
    columns unchanged.

    Rows that repeat an id count as one document and stay or go together; rows
    without an id stay.
    """
    groups = similar_groups(docs, id_col, text_col, shingle_words, similarity)
    gone = groups.where(F.col(id_col) > F.col("component")).select(id_col).distinct()
    return docs.join(gone, docs[id_col] == gone[id_col], "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
