"""Keeping an index up to date with a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import IndexStore


def index_stream(rows: DataFrame, store: IndexStore, name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index each micro-batch as a segment named by its number: a batch that is run again replaces its own segment.

    Rows are dealt out to all cores before they are tokenized, as a batch of a few files of one row group each has few tasks.
    """

    def add(batch: DataFrame, number: int) -> None:
        tasks = max(store.spark.sparkContext.defaultParallelism, batch.rdd.getNumPartitions())
        store.append(name, batch.repartition(tasks), key=f"batch-{number}")

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def matching_stream(rows: DataFrame, condition) -> DataFrame:
    """Rows of a stream that pass a predicate; every predicate is a Column and so holds for streams as it does for tables."""
    return rows.filter(condition)
