"""Session helpers of the corpus operators: checkpoints, sizes, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from ._text import mix


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, may it be
    unset; then a folder of this machine is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not named and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperglass-checkpoint-"))
    return context.getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, for sizing shards; one pass over one column."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def shards_for(size: int, per_shard: int, least: int = 1) -> int:
    return max(least, -(-size // per_shard))


def least_members(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the links that are
    not the least themselves: links of a group found in many places become the
    same few."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        if (least == label[x]).all() and (least == label[y]).all():
            break
        for side in (x, y):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def connected_components(edges: DataFrame, most_rounds: int = 60, task_links: int = 200_000) -> DataFrame:
    """Components of a graph: (node, root), root being the smallest node.

    edges has columns a and b (long, both directions need not be present).
    Each partition first makes stars of the components of its own links.  Then
    alternating large-star and small-star rounds; each round is two
    aggregations with map-side combining and a join, ends in a checkpoint, and
    no row set reaches the driver.  Partitions follow the number of links: each
    exchange of many small ones would cost more files than it has rows.  Nodes
    without an edge do not appear.
    """
    whole = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = shards_for(whole.count(), task_links, 8)

    def with_least(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return pairs.join(least, "u").coalesce(tasks)

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        return with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks)

    def small_star(e: DataFrame) -> DataFrame:
        joined = with_least(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        both = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
        return joined.select(both.alias("e")).select("e.a", "e.b").where("a != b").distinct().coalesce(tasks)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_members(*(np.concatenate(x) for x in zip(*held)))], names=["a", "b"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, digest = 0, np.uint64(0)
        for batch in batches:
            x, y = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
            rows += len(x)
            digest ^= np.bitwise_xor.reduce(mix(mix(x) + y)) if len(x) else np.uint64(0)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([digest]).cast(pa.int64(), safe=False)], names=["rows", "digest"])

    def state(e: DataFrame) -> tuple[int, int]:
        """Number and digest of the links, from two numbers a partition."""
        parts = e.mapInArrow(counted, "rows long, digest long").collect()
        return sum(r["rows"] for r in parts), reduce(lambda x, r: x ^ r["digest"], parts, 0)

    now = checkpointed(whole.coalesce(tasks).mapInArrow(stars, "a long, b long").distinct().coalesce(tasks))
    seen = state(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = checkpointed(small_star(large_star(now)))
        after = state(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(tasks)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
