"""The engine's tables, made deterministically from the generic test tables, in Spark and in SQL.

``SQL`` has a common table expression for each of them, so that an oracle reads the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import made_once, spread

#: The moment that stands for "now" over the test tables.
NOW = "2024-01-31 00:00:00"
#: Country of each language of the test documents.
COUNTRIES = {"en": "US", "fr": "FR", "de": "DE", "es": "ES"}


def now(value: str = NOW) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article table, adapted once an application, as a news store would hold it."""
    return made_once(spark, ("articles", sf_dir), lambda: adapted_articles(spark, sf_dir), f"{sf_dir}/documents.parquet")


def adapted_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article for each document: title is its first line, body the rest; of a first line over 120 characters
    the title has the start, and the body is the whole text, so no word is lost or split."""
    d = spread(table(spark, sf_dir, "documents"))
    at = F.instr("text", "\n")
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    country = F.element_at(F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv]), F.col("lang"))
    minutes = (F.col("doc_id") * 37) % (30 * 24 * 60)
    return (
        d.select("doc_id", "text", "lang", "n_chars", number.alias("source_id"), at.alias("cut"), country.alias("country"), minutes.alias("m"))
        .select(
            F.col("doc_id").alias("id"),
            F.substring(F.when(F.col("cut") > 0, F.expr("substring(text, 1, cut - 1)")).otherwise(F.col("text")), 1, 120).alias("title"),
            F.when(F.when(F.col("cut") > 0, F.col("cut") - 1).otherwise(F.length("text")) > 120, F.col("text")).when(F.col("cut") > 0, F.expr("substring(text, cut + 1)")).otherwise("").alias("content"),
            "source_id",
            F.col("lang").alias("language"),
            F.coalesce("country", F.lit("")).alias("country"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("m").cast("int"))).alias("published_at"),
            (F.col("doc_id") * 13 % 96 + 5).cast("int").alias("importance"),
            F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 97).alias("event_id"),
        )
        .withColumn("summary", F.substring("content", 1, 400))
        .withColumn("url", F.concat(F.lit("https://www.site"), F.col("source_id").cast("string"), F.lit(".example.com/a/"), F.col("id").cast("string")))
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of all articles."""
    return made_once(spark, ("sources", sf_dir), lambda: adapted_sources(spark, sf_dir), f"{sf_dir}/documents.parquet")


def adapted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("source_id")).distinct()
    n = F.col("source_id")
    return d.select(
        "source_id",
        F.concat(F.lit("outlet "), n.cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, ("international", "national", "local"))), n % 3 + 1).alias("scope"),
        (n % 3 + 1).cast("int").alias("tier"),
        F.when(n % 10 == 9, "reddit").otherwise("news").alias("platform"),
        F.concat(F.lit("site"), n.cast("string"), F.lit(".example.com")).alias("host"),
        (n % 7 != 3).alias("enabled"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events of the articles, restated from their members."""
    return made_once(spark, ("events", sf_dir), lambda: adapted_events(spark, sf_dir), f"{sf_dir}/documents.parquet")


def adapted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = articles(spark, sf_dir).filter("event_id IS NOT NULL")
    return a.groupBy("event_id").agg(
        F.count("*").alias("article_count"),
        F.max("importance").alias("event_importance"),
        F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("updated_at"),
        F.sort_array(F.collect_set("source_id")).alias("source_ids"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Air stations: one for each supplier, placed by its key."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("station_id"),
        ((k * 37 % 1800) / 10 - 90).alias("lat"),
        ((k * 53 % 3600) / 10 - 180).alias("lon"),
        F.element_at(F.array(*map(F.lit, ("airnow", "openaq", "purpleair"))), (k % 3 + 1).cast("int")).alias("provider"),
        (k * 29 % 320).cast("int").alias("aqi"),
    )


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hazards: one for each customer, placed by its key."""
    k = F.col("c_custkey")
    kinds = ("wildfire", "air_quality", "earthquake", "severe_weather", "storm", "flood")
    return table(spark, sf_dir, "customer").select(
        k.alias("hazard_id"),
        F.element_at(F.array(*map(F.lit, kinds)), (k % 6 + 1).cast("int")).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("wfigs", "airnow", "usgs", "nws", "gdacs", "gdacs"))), (k % 6 + 1).cast("int")).alias("provider"),
        ((k * 37 % 1800) / 10 - 90).alias("lat"),
        ((k * 53 % 3600) / 10 - 180).alias("lon"),
        (k * 17 % 101).cast("int").alias("severity"),
        (now() - F.make_dt_interval(hours=(k * 7 % 240).cast("int"))).alias("last_seen_at"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("location_id"),
        (((k + 3) * 37 % 1800) / 10 - 90).alias("lat"),
        (((k + 3) * 53 % 3600) / 10 - 180).alias("lon"),
        (F.lit(500.0) + k * 100).alias("fire_km"),
    )


SQL = {
    "articles": """lines AS (
  SELECT *, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS line FROM documents),
articles AS (
  SELECT *, substr(content, 1, 400) AS summary FROM (
    SELECT doc_id AS id, substr(line, 1, 120) AS title,
      CASE WHEN length(line) > 120 THEN text WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS content,
      regexp_extract(source, '([0-9]+)', 1)::INT AS source_id, lang AS language,
      CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'FR' WHEN 'de' THEN 'DE' WHEN 'es' THEN 'ES' ELSE '' END AS country,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes((doc_id * 37) % 43200) AS published_at,
      (doc_id * 13 % 96 + 5)::INT AS importance, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 97 END AS event_id,
      'https://www.site' || regexp_extract(source, '([0-9]+)', 1) || '.example.com/a/' || doc_id AS url
    FROM lines))""",
    "sources": """sources AS (
  SELECT source_id, 'outlet ' || source_id AS name, ['international', 'national', 'local'][source_id % 3 + 1] AS scope,
    (source_id % 3 + 1)::INT AS tier, CASE WHEN source_id % 10 = 9 THEN 'reddit' ELSE 'news' END AS platform,
    'site' || source_id || '.example.com' AS host, source_id % 7 <> 3 AS enabled
  FROM (SELECT DISTINCT regexp_extract(source, '([0-9]+)', 1)::INT AS source_id FROM documents))""",
    "stored": """stored AS (
  SELECT event_id, count(*) AS article_count, max(importance) AS event_importance, min(published_at) AS first_seen,
    max(published_at) AS updated_at, list_sort(list(DISTINCT source_id)) AS source_ids
  FROM articles WHERE event_id IS NOT NULL GROUP BY event_id)""",
    "stations": """stations AS (
  SELECT s_suppkey AS station_id, (s_suppkey * 37 % 1800) / 10 - 90 AS lat, (s_suppkey * 53 % 3600) / 10 - 180 AS lon,
    ['airnow', 'openaq', 'purpleair'][s_suppkey % 3 + 1] AS provider, (s_suppkey * 29 % 320)::INT AS aqi FROM supplier)""",
    "hazards": """hazards AS (
  SELECT c_custkey AS hazard_id, ['wildfire', 'air_quality', 'earthquake', 'severe_weather', 'storm', 'flood'][c_custkey % 6 + 1] AS kind,
    ['wfigs', 'airnow', 'usgs', 'nws', 'gdacs', 'gdacs'][c_custkey % 6 + 1] AS provider,
    (c_custkey * 37 % 1800) / 10 - 90 AS lat, (c_custkey * 53 % 3600) / 10 - 180 AS lon, (c_custkey * 17 % 101)::INT AS severity,
    TIMESTAMP '2024-01-31 00:00:00' - to_hours(c_custkey * 7 % 240) AS last_seen_at FROM customer)""",
    "locations": """locations AS (
  SELECT n_nationkey AS location_id, ((n_nationkey + 3) * 37 % 1800) / 10 - 90 AS lat, ((n_nationkey + 3) * 53 % 3600) / 10 - 180 AS lon,
    500.0::DOUBLE + n_nationkey * 100 AS fire_km FROM nation)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    """The WITH clause of these tables."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
