"""Rows dealt over all tasks, for work that costs much a row over tables that take little room.

Spark cuts files by bytes and at row groups: a million short entries may be one task, however long each takes to parse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """`df` in as many even partitions as a shuffle has, or as tasks can run at a time if those are more."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
