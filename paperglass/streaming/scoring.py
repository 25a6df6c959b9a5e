"""Scoring predictions as they arrive, with the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.score import field_results
from ..plans.registry import Field


def score_stream(predictions: DataFrame, truth: DataFrame, out: str, checkpoint: str, fields: list[Field] | None = None) -> StreamingQuery:
    """Field results of every micro-batch, as Parquet in a folder of the batch, so
    that a repeated batch replaces its own output."""

    def score(batch: DataFrame, number: int) -> None:
        field_results(truth, batch, fields).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return predictions.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
