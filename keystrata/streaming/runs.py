"""Sorted runs from a stream of records, merged when they are read.

Each micro-batch is cut by fixed split points and sorted into run files of its
own; a batch that is repeated after a failure replaces its files. Reading merges
all runs range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sort import sort_records


def write_runs(stream: DataFrame, key: str, pivots: Sequence[bytes], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that writes each batch of `stream` as sorted runs below path/batch=N."""
    n = len(pivots) + 1

    def one(batch: DataFrame, number: int) -> None:
        sort_records(batch, key, n, pivots=pivots).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_merged(spark: SparkSession, path: str, key: str, pivots: Sequence[bytes], ties: Sequence[str] = ()) -> DataFrame:
    """All runs as sorted partitions, one for each range."""
    return sort_records(spark.read.parquet(path).drop("pid"), key, len(pivots) + 1, pivots=pivots, ties=ties)
