"""Incremental scoring of arriving structures: what the batch search does, file by file.

A checkpoint takes the place of a hand-written cursor: a restart goes on after the last finished batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ATOMS = "sid long, idx int, res int, role string, x double, y double, z double"


def score_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str, score: Callable[[DataFrame], DataFrame], schema: str = ATOMS) -> StreamingQuery:
    """Score all Parquet files that came to ``source`` since the last run and append the results to ``target``.
    A structure must lie whole in one file.  Batch numbers name the folders, so a repeated batch replaces its
    own output."""

    def batch(df: DataFrame, number: int) -> None:
        score(df).write.mode("overwrite").parquet(f"{target}/batch={number}")

    arrived = spark.readStream.schema(schema).parquet(source)
    return arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
