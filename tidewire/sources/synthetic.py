"""A corpus of invented news for benches, of any size: every value is a hash of the row's number and a seed, so runs agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = "earthquake flood election protest strike verdict summit outage merger harvest storm wildfire festival budget ceasefire tariff vaccine launch"
ACTORS = "officials residents ministers workers judges farmers investors doctors engineers students"
VERBS = "respond gather resign warn agree march appeal recover deny expand"
PLACES = "Tokyo Osaka Lima Cairo Oslo Quito Lagos Delhi Seoul Berlin Madrid Nairobi Jakarta Toronto"
LANGUAGES = "en en en en ja es fr de"
COUNTRIES = "JP PE EG NO EC NG IN KR DE ES KE ID CA US"
CATEGORIES = "world politics business economy technology science health conflict disaster sports"


def _pick(words: str, seed: int, salt: str, *more: Column) -> Column:
    listed = words.split()
    at = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"), *more), F.lit(len(listed))) + 1
    return F.element_at(F.array(*map(F.lit, listed)), at.cast("int"))


def _number(n: int, seed: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n))


def articles(spark: SparkSession, n: int, sources: int = 600, days: int = 30, words: int = 120, end: str = "2024-01-31", seed: int = 1) -> DataFrame:
    """n articles of the last days before end, about a quarter as many events, and bodies of a number of words."""
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: _pick(f"{SUBJECTS} {ACTORS} {VERBS} {PLACES}", seed, "body", i)), " ")
    place, subject = _pick(PLACES, seed, "place"), _pick(SUBJECTS, seed, "subject")
    at = F.lit(end).cast("timestamp_ntz") - F.make_dt_interval(mins=_number(days * 24 * 60, seed, "at").cast("int"))
    rows = spark.range(n).select("id", body.alias("content"), place.alias("place"), subject.alias("subject"), at.alias("published_at"))
    return rows.select(
        "id", _number(sources, seed, "source").cast("int").alias("source_id"),
        F.concat(F.initcap("subject"), F.lit(" in "), "place", F.lit(": "), _pick(ACTORS, seed, "actor"), F.lit(" "), _pick(VERBS, seed, "verb")).alias("title"),
        F.concat(F.lit("Officials in "), "place", F.lit(" on the "), "subject", F.lit(". "), F.substring("content", 1, 200)).alias("summary"), "content",
        F.concat(F.lit("https://news.example/a/"), F.col("id").cast("string")).alias("url"), "published_at", _pick(LANGUAGES, seed, "language").alias("language"), _pick(COUNTRIES, seed, "country").alias("country"),
        F.array(_pick(CATEGORIES, seed, "category")).alias("categories"), (_number(86, seed, "importance") + 10).cast("int").alias("importance"), _number(max(1, n // 4), seed, "event").alias("event_id"),
    )
