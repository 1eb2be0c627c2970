"""Numbers in an order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.lineage import cut


def numbered(rows: DataFrame, *order: str, name: str = "n", start: int = 0) -> DataFrame:
    """``rows`` with their number in the order, from ``start + 1``: sorted ranges, and the rows before each range."""
    runs = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    before, at = [], start
    for pid, count in sorted(map(tuple, runs.groupBy("_pid").count().collect())):  # a row for each partition
        before.append((pid, at))
        at += count
    offsets = rows.sparkSession.createDataFrame(before, "_pid int, _before long")
    number = F.col("_before") + F.col("_mid").bitwiseAND((1 << 33) - 1) + 1
    return runs.join(F.broadcast(offsets), "_pid").withColumn(name, number).drop("_pid", "_mid", "_before")
