"""Mixing sources to target weights: capped water-filling, seeded repetitions.

Every source has a weight and a cap of ``max_epochs`` times its size. The budget is shared by
weight; sources whose share is above their cap are clamped to it and the rest is shared again by
weight among the others until no share is above its cap. Only sums of capped and open sources
come to the driver in a round, never the sources.

A source with target = r * size takes each document floor(r) whole times. The fraction that is
left takes documents in the order of a seeded hash until their sizes come to
(r - floor(r)) * size. The order is cut in two steps, sizes summed by hash cell and then document by document
in the one cell where the sum is reached, so a hot source is never sorted by one task.

Nulls: a null text has size 0; a null source is a source of its own, after all others; a null
doc_id is hashed like an id of its own. Rows with equal doc_id, source and size share their
place in the order and are taken alike. Empty tables, or tables without words, give targets
of 0. Extra columns are not read by ``targets``; ``mix`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

CELLS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(base.WORD)), F.lit(0)).cast("long").alias("size"))


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))


def _placed(sources: DataFrame, work: base.Scratch) -> DataFrame:
    """sources with their place by code point, null last: by range first, then inside each range."""
    order = F.col("source").asc_nulls_last()
    ranges = work.keep(sources.select("source", "source_size").orderBy(order).withColumn("range", F.spark_partition_id()), "ranges")
    # One row for each range, so this window has no more rows than the sort had partitions.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order))
    return ranges.withColumn("inside", inside).join(starts, "range").select("source", "source_size", (F.col("start") + F.col("inside")).alias("place"))


def targets(sources: DataFrame, work: base.Scratch, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """source, source_size and target of a table (source, source_size), one row for each source."""
    place = F.col("place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    table = work.keep(_placed(sources, work).select("source", "source_size", weight.alias("weight")), "weighted")
    cap = max_epochs * F.col("source_size")
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight, capped = budget, None, -1
    while True:
        over = F.lit(False) if open_weight is None else cap.cast("decimal(19,0)") * F.lit(open_weight) <= F.col("weight") * F.lit(rest).cast("decimal(19,0)")
        row = table.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        rest, open_weight = budget - (row[1] or 0), row[2] or 0
        if row[0] == capped or not open_weight:
            break
        capped = row[0]
    if not open_weight:
        return table.select("source", "source_size", cap.cast("double").alias("target"))
    # As a long: weights are ints and so is a literal below 2^31, but not their product.
    share = F.col("weight").cast("long") * F.lit(rest) / F.lit(open_weight)
    return table.select("source", "source_size", F.least(cap.cast("double"), share).alias("target"))


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and times (how often the mix takes the document)."""
    work = base.Scratch(docs.sparkSession, "mix")
    slim = work.keep(sized(docs).withColumn("order", _order(seed)), "sizes")
    slim = slim.withColumn("cell", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    cells = work.keep(slim.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    goal = work.keep(targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), work, weights, max_epochs), "targets")
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    # The cell of each source in which the running size reaches its part, and what is left of the part there.
    by_cell = Window.partitionBy("source").orderBy("cell")
    edge = (
        cells.withColumn("before", F.sum("cell_size").over(by_cell) - F.col("cell_size"))
        .join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .filter((F.col("before") <= F.col("part")) & (F.col("part") < F.col("before") + F.col("cell_size")))
        .select("source", F.col("cell").alias("edge"), (F.col("part") - F.col("before")).alias("left"))
    )
    goal = goal.join(edge.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    goal = work.keep(goal.withColumn("edge", F.coalesce("edge", F.lit(CELLS))).withColumnRenamed("source", "s"), "goal")
    docs = slim.join(goal, F.col("source").eqNullSafe(F.col("s")))
    # In the edge cell a document is taken if more than half of it fits.
    in_cell = Window.partitionBy("source", "cell").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = Window.partitionBy("source", "cell", "order")
    at_edge = docs.filter("cell = edge").withColumn("upto", F.sum("size").over(in_cell)).withColumn("own", F.sum("size").over(alike))
    # A source at its cap has no part left, so no document, not even an empty one, is taken once more.
    fits = ((F.col("part") > 0) & (F.col("upto") - F.col("own") / 2 <= F.col("left"))).cast("long")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    return (
        at_edge.select(*columns, (F.col("whole") + fits).alias("times"))
        .unionByName(docs.filter("cell <> edge").select(*columns, (F.col("whole") + (F.col("cell") < F.col("edge")).cast("long") * (F.col("part") > 0).cast("long")).alias("times")))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    times = taken(docs, weights, max_epochs, seed).filter("times > 0").groupBy(F.col("doc_id").alias("__tw_id"), F.col("source").alias("__tw_source"), F.col("size").alias("__tw_size")).agg(F.max("times").cast("int").alias("__tw_times"))
    size = F.coalesce(F.regexp_count("text", F.lit(base.WORD)), F.lit(0)).cast("long")
    return (
        docs.join(times, F.col("doc_id").eqNullSafe(F.col("__tw_id")) & F.col("source").eqNullSafe(F.col("__tw_source")) & (size == F.col("__tw_size")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__tw_times"))))
        .drop("__tw_id", "__tw_source", "__tw_size", "__tw_times")
    )
