"""Places of rows in one total order, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.storage import free_name, materialize


def _ranges(rows: DataFrame, order: list, part: str) -> DataFrame:
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    return materialize(ranged, "ranges")


def running_sum(rows: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to and with their own, in order. Ranges of the order are staged and summed; a row's sum is that within
    its range plus those of the ranges before. Rows equal in all order columns share a range; make the order unique where they
    are many."""
    part, own, within, before = (free_name(rows, n) for n in ("part", "own", "within", "before"))
    ranged = _ranges(rows.withColumn(own, value.cast("long")), order, part)
    sums = ranged.groupBy(part).agg(F.sum(own).alias("n"))
    # one row for each partition of the shuffle
    offsets = sums.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(before))
    upto = F.sum(own).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = ranged.withColumn(within, upto).join(F.broadcast(offsets), part)
    return summed.withColumn(name, F.col(before) + F.col(within)).drop(part, own, within, before)


def global_index(rows: DataFrame, order: list, name: str = "index") -> DataFrame:
    """rows with their place from 0 in order, by running_sum()."""
    return running_sum(rows, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
