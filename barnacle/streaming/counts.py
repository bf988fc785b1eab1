"""Incremental counts: each batch of a stream of reads is counted by any counter and added to a table of sums.

Counts of reads add up, so a batch's counts need nothing of earlier reads. Sums are kept by batch in a folder; a batch that is run
again after a failure overwrites its own part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counters import CountResult


def stream_counts(reads: DataFrame, count: Callable[[DataFrame], CountResult], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start counting a streaming DataFrame of reads; total() reads what has been counted."""

    def batch(df: DataFrame, number: int) -> None:
        count(df).table.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def total(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("counts").cast("long").alias("counts"))
