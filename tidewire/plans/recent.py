"""Newest articles first without a sort of all of them: a store partitioned by day, read in a growing ladder until the limit is full.

Days don't overlap, so all matches of a later day come before those of an earlier one: once the days read so far hold ``limit`` matches, no other day can
add one, ties included. Each rung reads the next days only, twice as many as the one before, and keeps at most ``limit`` rows in a written table, so a day is
read once and what the last rung reads too much is at most as much as all others. Articles without a date are in a
partition of their own, after all days. A search that finds little reads all days, as a plain one does.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .criteria import Criteria, predicate

_UNDATED = "none"


def write_days(articles: DataFrame, path: str) -> None:
    """Write articles (published_at, ...) by day; more can be added to the same path."""
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit(_UNDATED))
    # A day is split by id too, so that a day of very many articles is written by several tasks.
    dealt = articles.withColumn("day", day).repartition("day", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.sortWithinPartitions("day", F.desc("published_at")).write.mode("append").partitionBy("day").parquet(path)


def days(spark: SparkSession, path: str) -> list[str]:
    """The days of a store, newest first, and last what has no date."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    found = sorted((n.removeprefix("day=") for n in names if n.startswith("day=")), reverse=True)
    return [d for d in found if d != _UNDATED] + [d for d in found if d == _UNDATED]


def search_newest(spark: SparkSession, path: str, sources: DataFrame, c: Criteria, now: datetime, limit: int = 50, first: int = 1) -> tuple[DataFrame, list[str]]:
    """As ``criteria.search`` in order of time, over a store of days; and the days that were read."""
    schema = spark.read.parquet(path).schema
    rows = spark.read.schema(schema).parquet(path)
    left, step, read, held, kept = days(spark, path), first, [], 0, None
    order = [F.desc("published_at"), F.desc("id")]
    while True:
        rung, left = left[:step], left[step:]
        found = rows.filter(F.col("day").cast("string").isin(*rung)).join(sources, "source_id", "left")
        found = cut_lineage(found.filter(predicate(c, found.columns, now)).orderBy(*order).limit(limit - held))
        kept = found if kept is None else kept.unionByName(found)
        held, read, step = held + found.count(), read + rung, 2 * step
        if held >= limit or not left:
            return kept.drop("day").orderBy(*order).limit(limit), read
