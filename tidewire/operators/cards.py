"""An article as its card in a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARCHIVE = "https://archive.ph/newest/"
SUMMARY_CHARS = 400


def cards(articles: DataFrame, sources: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """One row for each article: what a reader's card shows.

    articles: id, event_id, title, summary, url, published_at, language, country, importance, base_importance, viewed;
    sources: source_id, name, scope, paywall; translations into the reader's language: article_id, title, summary, one row for each
    article. A translation that failed has an empty title, so the original stays.
    """
    a = articles.join(sources.select("source_id", "name", "scope", "paywall"), "source_id", "left")
    if translations is not None:
        t = translations.select(F.col("article_id").alias("id"), F.col("title").alias("t_title"), F.col("summary").alias("t_summary"), F.lit(True).alias("tried"))
        a = a.join(t, "id", "left")
    else:
        a = a.withColumns({"t_title": F.lit(None).cast("string"), "t_summary": F.lit(None).cast("string"), "tried": F.lit(None).cast("boolean")})
    either = lambda new, old: F.coalesce(F.nullif(new, F.lit("")), old)
    walled = F.coalesce("paywall", F.lit(False))
    return a.select(
        "id", "event_id", "viewed", either("t_title", F.col("title")).alias("title"), F.substring(either("t_summary", F.col("summary")), 1, SUMMARY_CHARS).alias("summary"),
        F.when(F.coalesce("t_title", F.lit("")) != "", F.col("language")).alias("translated_from"),
        (F.coalesce("tried", F.lit(False)) & (F.coalesce("t_title", F.lit("")) == "")).alias("translation_unavailable"),
        "url", F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("published_at"), "language", "country", "importance",
        F.coalesce("base_importance", "importance").alias("base_importance"), walled.alias("paywall"),
        F.when(walled & F.col("url").startswith("http"), F.concat(F.lit(ARCHIVE), "url")).alias("archive_url"), F.col("name").alias("source"), "scope",
    )


def as_json(rows: DataFrame) -> DataFrame:
    """id and the card as JSON text."""
    return rows.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "id"])).alias("card"))
