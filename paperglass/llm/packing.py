"""Operator 3, best-fit packing into sequences of several permitted lengths.

Documents are sequences of tokens (words and one end token); longer ones than
the largest permitted length are cut into pieces.  Pieces are packed best fit,
longest first.  The permitted lengths are optimised jointly: when no open bin
has room, the size to open is the one of least cost for each token it can be
expected to hold, given what is still to be packed; at the end each bin shrinks
to the smallest permitted length that holds its contents.

Scale: pieces are dealt by a hash into shards of about shard_rows documents,
which are packed independently, so each task sees a bounded number of (id,
length) rows and never a text.  Waste from sharding is at most some bins a
shard.  The result does not depend on the number of tasks or executors.

Defined results: null or empty text has no tokens: one row, n_tokens 0, no bin;
null ids are packed like others; repeated rows are packed each; a text longer
than the largest length is several pieces; extra columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, shards_for
from ._text import blocks

CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 32  # what a bin costs besides its length, in tokens
SHARD_ROWS = 20_000
_COPIES = 1_000  # rows of one id and length that stay together


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin of each length, its offset in the bin, and the capacity of each bin.

    lengths must be in falling order, none above the largest capacity.
    """
    sizes = sorted(capacities)
    ascending = lengths[::-1]
    mass = np.concatenate(([0], np.cumsum(ascending, dtype=np.int64))).tolist()
    free_mask, free_bins = 0, {}  # bit r is set if a bin has room r left
    bin_of, offset, used, opened = [], [], [], []
    for k, n in enumerate(lengths):
        fits = free_mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free_bins[room].pop()
            if not free_bins[room]:
                free_mask ^= 1 << room
        else:
            left = len(lengths) - k - 1  # pieces still to come: the shortest ones
            best = None
            for c in sizes:
                if c >= n:
                    fill = min(c - n, mass[min(left, bisect_right(ascending, c - n))])
                    cost = (c + bin_cost) / (n + fill)
                    if best is None or cost < best[0]:
                        best = (cost, c)
            room, b = best[1], len(used)
            used.append(0)
            opened.append(room)
        bin_of.append(b)
        offset.append(used[b])
        used[b] += n
        room -= n
        if room:
            free_bins.setdefault(room, []).append(b)
            free_mask |= 1 << room
    return bin_of, offset, [next(c for c in sizes if c >= u) for u in used]


def _lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.bincount(b.words()[2], minlength=b.n) for b in blocks(batch.column(1))]
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.where(n > 0, n + 1, 0), pa.int64())], names=["id", "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(counted, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: (id, piece, start, n_tokens, bin_id, offset, capacity).

    start is the piece's first token in its document, offset its place in the
    bin; bin_id is unique over all shards.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    shards = shards_for(docs.count(), shard_rows)
    # Rows of one id and length travel as one with their number; many of them are
    # several parts, which are dealt apart.
    counted = _lengths(docs, id_col, text_col).groupBy("id", "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / _COPIES).cast("long"))))
    copies = F.least(F.lit(_COPIES).cast("long"), F.col("copies") - F.col("part") * _COPIES)
    rows = parts.select("id", "n_tokens", copies.alias("copies"), F.pmod(F.xxhash64("id", "n_tokens", "part"), F.lit(shards)).alias("shard"))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "n_tokens", "bin_id", "offset", "capacity"]

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        copies = pa.array(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy()))
        table = table.take(copies)
        order = table.column("id").combine_chunks() if table.num_rows else table.column("id")
        ranks = np.argsort(pa.compute.rank(order, "ascending", null_placement="at_end", tiebreaker="first").to_numpy())
        n = table.column("n_tokens").to_numpy()[ranks]
        pieces = np.maximum(1, -(-n // largest))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * largest
        length = np.minimum(n[row] - start, largest)
        falling = np.argsort(-length, kind="stable")
        falling = falling[: int((length > 0).sum())]
        bin_of, offset, size = pack(length[falling].tolist(), capacities, bin_cost)
        bin_id, place, capacity = (np.full(len(row), -1, np.int64) for _ in range(3))
        bin_id[falling] = bin_of
        place[falling] = offset
        capacity[falling] = np.array(size, np.int64)[bin_id[falling]] if size else 0
        none = bin_id < 0
        ids = table.column("id").take(pa.array(ranks[row]))
        made = (bin_id + (key[0].as_py() << 32), place, capacity)
        return pa.Table.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (piece, start, length)), *(pa.array(x, pa.int64(), mask=none) for x in made)], names=names)

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} long" for n in names[1:])
    return rows.groupBy("shard").applyInArrow(packed, schema)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
