"""Exact nearest vectors of a stated query set, in blocks.

Rows are dealt into blocks of bounded size; every query visits every block, where
one matrix product scores it against all rows, and only the best few of a block
leave it.  The work is queries times rows, which is what an exact answer needs;
no block, and no task, grows with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship_package

BLOCK_ROWS = 32_768


def nearest_cosine(rows: DataFrame, asks: Column, most: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, cosine, place): the most nearest other rows of each row that
    asks selects, nearest first, ties to the smaller id.  Null vectors take no
    part; a zero vector is 0 to any."""
    ship_package(rows.sparkSession)
    known = rows.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    blocks = max(1, -(-known.count() // block_rows))
    stored = known.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("block"))
    asked = known.where(asks).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    schema = "query_id long, id long, cosine double"

    def unit(table: pa.Table) -> np.ndarray:
        x = np.array(table.column("vec").to_pylist(), np.float64).reshape(table.num_rows, -1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        made = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids = right.column("id").to_numpy()
            order = np.argsort(ids)  # ties then go to the smaller id
            stored_unit, ids = unit(right)[order], ids[order]
            for at in range(0, left.num_rows, 512):
                part = left.slice(at, 512)
                query = part.column("id").to_numpy()
                score = unit(part) @ stored_unit.T
                score[query[:, None] == ids[None]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :most]
                made[0].append(np.repeat(query, best.shape[1]))
                made[1].append(ids[best].ravel())
                made[2].append(np.take_along_axis(score, best, 1).ravel())
        columns = [np.concatenate(x) for x in made]
        keep = np.isfinite(columns[2])
        return pa.table({n: c[keep] for n, c in zip(("query_id", "id", "cosine"), columns)})

    found = asked.groupBy("block").cogroup(stored.groupBy("block")).applyInArrow(scored, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("place", place).where(F.col("place") <= most).withColumnRenamed("id", id_col)
