"""Places in a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with their place, from 1, in an order that has no ties: sorted by range, then numbered inside each range."""
    ranges = cut_lineage(rows.orderBy(*order).withColumn("__range", F.spark_partition_id()))
    # One row for each range, so this window has no more rows than the sort had partitions.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.withColumn("__inside", inside).join(starts, "__range").withColumn("place", F.col("__start") + F.col("__inside")).drop("__range", "__start", "__inside")


def running(rows: DataFrame, amount: str, cell: Column, *order: Column | str) -> DataFrame:
    """rows with upto: the sum of amount over all rows up to and with each, by cells that agree with the order, then inside a cell."""
    celled = rows.withColumn("__cell", cell)
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = celled.groupBy("__cell").agg(F.sum(amount).alias("__sum")).select("__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(amount).over(Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return celled.withColumn("__inside", inside).join(cells, "__cell").withColumn("upto", F.col("__start") + F.col("__inside")).drop("__cell", "__start", "__inside")
