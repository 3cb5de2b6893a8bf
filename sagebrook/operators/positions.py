"""Positions of rows in a whole table, without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.storage import written


def positions(df: DataFrame, order: list[str] | None = None, name: str = "position", start: int = 1) -> DataFrame:
    """``df`` with the position of each row, by ``order`` or, without it, by partition and place.

    Rows are range-partitioned and sorted, partitions counted, and each counts on from its own offset; the driver
    holds one number a partition.  Equal rows get neighbouring positions in no set order.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(df.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "placed")
    sizes = {r["__part"]: r["n"] for r in held.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], start - 1
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    first = F.broadcast(df.sparkSession.createDataFrame(offsets, "__part int, __first long"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__place"))
    return held.withColumn(name, rank).join(first, "__part").withColumn(name, F.col("__first") + F.col(name)).drop("__part", "__place", "__first")
