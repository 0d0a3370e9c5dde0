"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that its scan would leave to fewer tasks than there are cores, such as one file of one row group.

    An input of over a quarter of what all cores read at once, by the size of its files, has tasks enough and stays as it is, so
    that nothing large is shuffled for this.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size * 4 <= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df
