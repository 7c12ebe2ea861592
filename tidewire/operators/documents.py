"""Documents and their topics: headings, themes, near places."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..runtime import ship

ALIKE_HEADINGS, MOST_THEMES = 0.6, 4


def heading_words(heading: str) -> set[str]:
    """Words of more than three letters without a plural or participle ending."""
    words = re.findall(r"[a-z0-9]+", (heading or "").lower())
    return {re.sub(r"(ing|ed|es|s)$", "", w) for w in words if len(w) > 3}


def merge_topics(topics: list[dict]) -> list[dict]:
    """Topics (heading, body, links) in order; one like an earlier one is folded into it: the longer body, all links."""
    kept: list[dict] = []
    for topic in topics:
        mine = heading_words(topic["heading"])
        for old in kept:
            other = heading_words(old["heading"])
            if mine and other and len(mine & other) / min(len(mine), len(other)) >= ALIKE_HEADINGS:
                old["body"] = max(old["body"] or "", topic["body"] or "", key=len)
                old["links"] = list(dict.fromkeys([*(old["links"] or []), *(topic["links"] or [])]))
                break
        else:
            kept.append({"heading": topic["heading"], "body": topic["body"] or "", "links": list(topic["links"] or [])})
    return kept


def topics(documents: DataFrame) -> DataFrame:
    """documents (id, topics) with like topics merged; the fold is in order, inside a document."""
    ship(documents.sparkSession)

    @F.pandas_udf("array<struct<heading:string,body:string,links:array<string>>>")
    def fold(column: pd.Series) -> pd.Series:
        return column.map(lambda t: merge_topics([dict(x) for x in (t if t is not None else [])]))

    return documents.withColumn("topics", fold("topics"))


def suggested_themes(text: Column, themes: list[dict], most: int = MOST_THEMES) -> Column:
    """The best themes (slug, name, keywords) of a text: 2 for each keyword in it, 3 for a name of more than four letters."""
    low, scored = F.lower(F.coalesce(text, F.lit(""))), []
    for place, theme in enumerate(themes):
        points = F.lit(0)
        for word in theme.get("keywords") or []:
            points = points + F.when(F.contains(low, F.lit(word.lower())), 2).otherwise(0)
        if len(theme["name"]) > 4:
            points = points + F.when(F.contains(low, F.lit(theme["name"].lower())), 3).otherwise(0)
        scored.append(F.struct(points.alias("points"), F.lit(-place).alias("place"), F.lit(theme["slug"]).alias("slug")))
    if not scored:
        return F.array().cast("array<string>")
    good = F.filter(F.array(*scored), lambda x: x["points"] > 0)
    return F.transform(F.slice(F.sort_array(good, asc=False), 1, most), lambda x: x["slug"])


def near_locations(places: Column, locations: list[dict]) -> Column:
    """Ids of a user's saved locations (id, lat, lon, radius_km) that a place of the article is near."""
    hits = [F.when(_near(places, x), F.lit(x["id"])) for x in locations]
    return F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<int>")


def _near(places: Column, location: dict) -> Column:
    circle = {"type": "Circle", "center": [location["lat"], location["lon"]], "radius_km": location["radius_km"]}
    return F.coalesce(F.exists(places, lambda p: geo.inside(p["lat"], p["lon"], circle)), F.lit(False))


def ring_badges(hits: DataFrame) -> DataFrame:
    """For each hazard the nearest location in whose ring it is, and how many others there are."""
    return hits.groupBy("hazard_id").agg(F.min_by("location_id", F.struct("distance_km", "location_id")).alias("nearest"), F.min("distance_km").alias("km"), (F.count("*") - 1).alias("others"))
