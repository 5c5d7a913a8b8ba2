"""Grouped counts and sums kept up over a stream: each micro-batch adds its aggregate to the last result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import Op


def maintain(stream: DataFrame, keys: Sequence[str], ops: Sequence[Op], path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends each batch's aggregate under ``path``, one folder for each batch.

    A batch that runs again overwrites its own folder, so every row counts once.
    """

    def fold(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[o.column() for o in ops]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result(spark, keys: Sequence[str], ops: Sequence[Op], path: str) -> DataFrame:
    """The aggregate of all batches so far."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(o.name).alias(o.name) for o in ops])
