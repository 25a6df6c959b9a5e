"""Operator 9, nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-rotations (three rounds of random signs
and a Hadamard transform) and hashed to the nearest signed axis; a table's code
joins one or more such hashes.  Every row is filed once in each table.  A query
probes, in each table, the codes its rotated vector comes closest to
(multiprobe).  Candidates that meet a query in a code are scored exactly, in
double precision on the original vectors, and the best over all tables win.

If norms differ, one coordinate is added that makes all stored vectors equally
long (and is zero for queries), so that the largest inner product is again the
smallest angle.

Scale: equal vectors are one entry with its smallest ids (more can never rank),
combined before the shuffle; codes with many entries are split into blocks that
queries visit each; a task keeps the queries of one block and streams the
entries, and emits no more than the answer's length for each query.  A query
that meets fewer candidates than asked for is answered by an exact scan in such
blocks.

Defined results: vectors that are null, zero, hold null or non-finite numbers,
or have another length than most take no part, as query or candidate; rows that
repeat an id and vector count once; null ids take no part; an empty table gives
an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from ._shared import checkpointed, shards_for

TABLES = 14
PROBES = 8
MORE_TABLES = 6
BLOCK_ROWS = 4096
_SALTS = 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """The hash family; equal parameters give equal codes everywhere."""

    def __init__(self, dimension: int, tables: int, hashes: int, longest: float | None, seed: int = 11):
        self.dimension, self.tables, self.hashes, self.longest = dimension, tables, hashes, longest
        self.size = 1 << max(1, (dimension + (longest is not None) - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.size))

    def _unit(self, x: np.ndarray, stored: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        out = np.zeros((len(x), self.size))
        if self.longest is None or not stored:
            out[:, : self.dimension] = x / norm
        else:
            out[:, : self.dimension] = x / self.longest
            out[:, self.dimension] = np.sqrt(np.maximum(0.0, 1 - (norm[:, 0] / self.longest) ** 2))
        return out

    def _signed(self, unit: np.ndarray, table: int, which: int) -> np.ndarray:
        for s in self.signs[table, which]:
            unit = hadamard(unit * s)
        return np.concatenate([unit, -unit], axis=1)

    def codes(self, x: np.ndarray, stored: bool, probes: int = 1) -> np.ndarray:
        """rows x (tables * probes) codes, the nearest ones of each table."""
        unit, out = self._unit(x, stored), []
        for t in range(self.tables):
            value, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
            for k in range(self.hashes):
                turned = self._signed(unit, t, k)
                n = min(probes, turned.shape[1])
                near = np.argpartition(-turned, n - 1, axis=1)[:, :n]
                v = np.take_along_axis(turned, near, 1)
                value = (value[:, :, None] + v[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * (2 * self.size) + near[:, None, :]).reshape(len(x), -1)
                if value.shape[1] > probes:
                    best = np.argpartition(-value, probes - 1, axis=1)[:, :probes]
                    value, code = np.take_along_axis(value, best, 1), np.take_along_axis(code, best, 1)
            out.append(code * self.tables + t)
        return np.concatenate(out, axis=1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dimension)


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def _best(query: np.ndarray, entry: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most best distinct entries of each query."""
    order = np.lexsort((-score, entry, query))
    query, entry, score = query[order], entry[order], score[order]
    new = np.concatenate(([True], (query[1:] != query[:-1]) | (entry[1:] != entry[:-1]))) if len(query) else np.zeros(0, bool)
    query, entry, score = query[new], entry[new], score[new]
    order = np.lexsort((entry, -score, query))
    query, entry, score = query[order], entry[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    keep = place < most
    return query[keep], entry[keep], score[keep]


def _scored(rows: DataFrame, dimension: int, most: int, partitions: int) -> DataFrame:
    """(query, entry, score) of rows (code, salt, is_entry, vid, vec): within a
    code and salt every query against every entry, the most best of each."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        now, queries, vectors = None, [], []

        def best():
            return _best(*(np.concatenate([h[k] for h in held]) for k in range(3)), most)

        for batch in batches:
            code, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            entry = batch.column(2).to_numpy(zero_copy_only=False)
            vid, x = batch.column(3).to_numpy(), _matrix(batch.column(4), dimension)
            cuts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (salt[1:] != salt[:-1]) | (entry[1:] != entry[:-1])))).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(code)]):
                key = (code[a], salt[a])
                if key != now:
                    now, queries, vectors = key, [], []
                if not entry[a]:
                    queries.append(vid[a:b])
                    vectors.append(x[a:b])
                    continue
                if not queries:
                    continue
                q, v = np.concatenate(queries), np.concatenate(vectors)
                queries, vectors = [q], [v]
                for s in range(a, b, BLOCK_ROWS):
                    e = min(s + BLOCK_ROWS, b)
                    for c in range(0, len(q), 512):
                        got = v[c : c + 512] @ x[s:e].T
                        n = min(most, e - s)
                        top = np.argpartition(-got, n - 1, axis=1)[:, :n]
                        held.append((np.repeat(q[c : c + 512], n), vid[s:e][top].ravel(), np.take_along_axis(got, top, 1).ravel()))
                        size += len(held[-1][0])
                        if size > 1_000_000:
                            held = [best()]
                            size = len(held[0][0])
                            if size > 500_000:
                                yield pa.RecordBatch.from_arrays([pa.array(k) for k in held[0]], names=["query", "entry", "score"])
                                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in best()], names=["query", "entry", "score"])

    dealt = rows.repartition(partitions, "code", "salt").sortWithinPartitions("code", "salt", "is_entry")
    return dealt.select("code", "salt", "is_entry", "vid", "vec").mapInArrow(score, "query long, entry long, score double")


def _entries(vectors: DataFrame, most: int) -> DataFrame:
    """(vid, ids, vec): one row for each distinct vector, with its smallest ids."""
    kind = vectors.schema["vec"].dataType.simpleString()

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least: dict[bytes, list] = {}
            rows, ids = [], batch.column(0).to_pylist()
            width = len(batch.column(1).flatten()) // max(batch.num_rows, 1)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, max(width, 1)) + 0.0  # -0.0 is 0.0
            for k, (i, raw) in enumerate(zip(ids, map(bytes, flat))):
                if raw not in least:
                    least[raw] = []
                    rows.append(k)
                least[raw].append(i)
            short = [heapq.nsmallest(most, set(x)) for x in least.values()]
            values = pa.array(flat[rows].ravel() if rows else flat[:0].ravel(), batch.schema.field(1).type.value_type)
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), values)], names=["ids", "vec"])

    def merged(df: DataFrame, *keys) -> DataFrame:
        return df.groupBy("vec", *keys).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))

    first = vectors.mapInArrow(combined, f"ids array<bigint>, vec {kind}")
    salted = merged(first.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(_SALTS))), "part")
    return merged(salted).select(F.col("ids")[0].alias("vid"), "ids", "vec")


def search(vectors: DataFrame, queries: Column, most: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, probes: int | None = None, hashes: int = 1) -> DataFrame:
    """(query_id, rank, id, score): the most nearest rows found for every row
    that queries selects, by largest inner product, nearest first.

    One hash a code, whatever the number of rows.  Each further hash multiplies
    the probes by PROBES and the tables by MORE_TABLES, which a neighbour needs
    to be met as often as before.
    """
    ship_package(vectors.sparkSession)
    known = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), queries.alias("asks")).where(F.col("id").isNotNull() & _usable(F.col("vec")))
    lengths = known.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("least"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).orderBy(F.desc("n"), F.desc("d")).first()
    empty = f"query_id long, rank int, `{id_col}` long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dimension, rows = lengths["d"], lengths["n"]
    known = known.where(F.size("vec") == dimension)
    longest = None if lengths["longest"] - lengths["least"] <= 1e-4 * lengths["longest"] else lengths["longest"]
    tables = TABLES * MORE_TABLES ** (hashes - 1) if tables is None else tables
    probes = PROBES**hashes if probes is None else probes
    family = CrossPolytope(dimension, tables, hashes, longest)
    deep = most + 1  # a query's own row is among its entries
    entries = checkpointed(_entries(known.select("id", "vec"), deep))
    asked = known.where("asks").select("id", "vec")
    # Equal queries are searched once: each distinct vector that asks.
    asking = checkpointed(_entries(asked, 1).select("vid", "vec"))

    def coded(stored: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    codes = family.codes(_matrix(part.column(1), dimension), stored, 1 if stored else probes)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(codes), pa.list_(pa.int64()))], names=["vid", "vec", "codes"])

        return step

    kind = entries.schema["vec"].dataType.simpleString()

    def filed(df: DataFrame, stored: bool) -> DataFrame:
        return df.select("vid", "vec").mapInArrow(coded(stored), f"vid long, vec {kind}, codes array<bigint>").select("vid", "vec", F.explode("codes").alias("code"))

    stored = filed(entries, True)
    crowded = stored.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_ROWS).select("code", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("salts"))
    crowded = checkpointed(crowded)
    salts = F.coalesce(F.col("salts"), F.lit(1))
    left = stored.join(crowded, "code", "left").select("code", F.pmod(F.xxhash64("vid"), salts).cast("int").alias("salt"), F.lit(True).alias("is_entry"), "vid", "vec")
    right = filed(asking, False).join(crowded, "code", "left").select("code", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("is_entry"), "vid", "vec")
    partitions = shards_for(rows * tables, 100_000, 8)
    found = _scored(left.unionByName(right), dimension, deep, partitions)

    def ranked(scored: DataFrame) -> DataFrame:
        one = scored.groupBy("query", "entry").agg(F.max("score").alias("score"))
        place = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
        return one.withColumn("place", F.row_number().over(place)).where(F.col("place") <= deep).drop("place")

    best = ranked(found).join(entries.select(F.col("vid").alias("entry"), "ids"), "entry")
    lists = checkpointed(best.select("query", "score", F.explode("ids").alias("id")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))), 1, deep).alias("near")))
    have = asking.select(F.col("vid").alias("query"), "vec").join(lists, "query", "left")
    distinct_ids = known.select("id").distinct().count() if rows <= deep else rows
    short = have.where(F.coalesce(F.size("near"), F.lit(0)) < min(deep, distinct_ids)).select("query", "vec")
    if not short.isEmpty():  # too few met it: scan all entries in blocks
        blocks = shards_for(rows, BLOCK_ROWS)
        every = entries.select(F.lit(0).cast("long").alias("code"), F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("salt"), F.lit(True).alias("is_entry"), "vid", "vec")
        those = short.select(F.lit(0).cast("long").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("salt"), F.lit(False).alias("is_entry"), F.col("query").alias("vid"), "vec")
        exact = ranked(_scored(every.unionByName(those), dimension, deep, shards_for(blocks, 1))).join(entries.select(F.col("vid").alias("entry"), "ids"), "entry")
        exact = exact.select("query", "score", F.explode("ids").alias("id")).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))), 1, deep).alias("near"))
        lists = checkpointed(lists.join(short.select("query"), "query", "left_anti").unionByName(exact))
    answers = asked.distinct().join(asking.select(F.col("vid").alias("query"), "vec"), "vec").join(lists, "query")
    others = answers.select(F.col("id").alias("query_id"), F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, most).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("at", "n")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias(id_col), (-F.col("n.far")).alias("score"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
