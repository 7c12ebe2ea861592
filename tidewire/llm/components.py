"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are a partial aggregate (the least neighbour) and an equi-join back, so a node
with very many links is combined before the shuffle and split by the skew handling of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(links: DataFrame, work: base.Scratch, name: str) -> DataFrame:
    """node and component (its least reachable node) for every node that isn't its component's least."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = work.keep(edges, f"{name}-0")
    before, turn = _mark(edges), 0
    while before[0]:
        turn += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = work.keep(small, f"{name}-{turn}")
        after = _mark(edges)
        work.drop(f"{name}-{turn - 1}")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
