"""Queries of feed entries, translations, themes, badges and joined provider answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import ops
from ..operators.hazards import fire_ring
from ..sources import adapters as A
from ..sources import providers as P
from . import q_catalog as C
from . import q_providers as R
from .criteria import Criteria, predicate
from .q_search import NOW

#: Themes with words of the test texts.
THEMES = [
    {"slug": "first", "name": "ndtion", "keywords": ["the", "esat"]}, {"slug": "second", "name": "ated", "keywords": ["of"]},
    {"slug": "third", "name": "enes and", "keywords": ["enes", "und"]}, {"slug": "fourth", "name": "which", "keywords": ["que", "les"]}, {"slug": "fifth", "name": "other", "keywords": ["in"]},
]
SAVED = [{"id": 1, "lat": 48.0, "lon": 3.0, "radius_km": 200.0}, {"id": 2, "lat": 50.0, "lon": 8.0, "radius_km": 800.0}, {"id": 3, "lat": 0.0, "lon": 0.0, "radius_km": 50.0}]


def feed_rows(spark, sf_dir):
    """Feed entries as article rows: 80 of each source at most, http links, titles without markup, summaries without trailers."""
    a, k = A.articles(spark, sf_dir), F.col("id")
    tail = F.element_at(F.array(*map(F.lit, (" Read more here", " The post X appeared first on Y.", " Share this: a b", ""))), (k % 4 + 1).cast("int"))
    e = a.select(
        "source_id", F.concat(F.lit("<b>"), F.when(k % 11 == 0, "").otherwise(F.col("title")), F.lit("</b>")).alias("title"), F.concat(F.lit("<p>&nbsp;"), F.col("summary"), F.lit("</p>"), tail).alias("summary"),
        F.when(k % 7 == 0, F.concat(F.lit("ftp://x/"), k.cast("string"))).otherwise(F.col("url")).alias("link"), F.when(k % 3 == 0, k.cast("string")).alias("guid"), "published_at", k.alias("arrival"),
    )
    return ops.entries_to_articles(e)


def translated_texts(spark, sf_dir):
    """All translations of an article in one text, in order of language."""
    d, k = A.table(spark, sf_dir, "documents"), F.col("doc_id")
    t = d.select(F.floor(k / 3).alias("article_id"), F.concat("lang", (k % 3).cast("string")).alias("lang"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("title "), k.cast("string"))).alias("title"), F.when(k % 2 == 0, "sum").otherwise("").alias("summary"))
    return ops.translated_text(t)


def crit_translations(spark, sf_dir):
    """A search that also reads translations."""
    a = A.articles(spark, sf_dir)
    t = a.filter("id % 5 = 0").select(F.col("id").alias("article_id"), F.lit("xx").alias("lang"), F.lit("einhorn").alias("title"), F.lit("").alias("summary"))
    full = ops.with_translations(a, t)
    c = Criteria(keywords=("einhorn",), search_translations=True, passing_mentions=True, min_importance=20)
    return full.filter(predicate(c, full.columns, NOW)).select("id")


def theme_suggestions(spark, sf_dir):
    return A.articles(spark, sf_dir).select("id", F.array_join(D.suggested_themes(F.concat_ws(" ", "title", "summary"), THEMES), ",").alias("themes"))


def near_saved(spark, sf_dir):
    """The saved locations that a place of an article is near."""
    return C._placed(spark, sf_dir).select("id", F.array_join(D.near_locations(F.col("places"), SAVED).cast("array<string>"), ",").alias("near"))


def ring_badges(spark, sf_dir):
    """For each fire the nearest location in whose ring it is, and how many others there are."""
    found = fire_ring(A.locations(spark, sf_dir).withColumn("fire_km", F.col("fire_km") * 2), A.hazards(spark, sf_dir))
    return D.ring_badges(found)


def fire_shapes(spark, sf_dir):
    """The newest perimeter of each fire."""
    k = R._k()
    ring = F.array(*[F.array(R._lon(k) + i, R._lat(k) + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 0))])
    item = R._struct(properties=R._struct(attr_IrwinID=F.concat(F.lit("{c"), (k % 200).cast("string"), F.lit("}")), poly_DateCurrent=(F.lit(1_700_000_000_000) + k * 1000).cast("string")), geometry=R._struct(type=F.when(k % 9 == 0, "Point").otherwise("Polygon"), coordinates=F.array(ring)))
    return P.perimeters(R._pages(spark, sf_dir, item, R._features)).select("external_id", "geometry_at")


def all_providers(spark, sf_dir):
    """Rows of the providers that answered, by provider and kind."""
    pages = lambda item: R._pages(spark, sf_dir, item, R._features)
    k = R._k()
    quake = R._struct(id=k.cast("string"), geometry=R._point(), properties=R._struct(mag=F.lit(5.0), title=F.lit("m")))
    storm = R._struct(geometry=R._point(), properties=R._struct(eventtype=R._choose(k, "TC", "FL"), eventid=k.cast("string")))
    quakes, storms = P.usgs(pages(quake)), P.gdacs(pages(storm))
    rows, answered = P.fan_out({"usgs": quakes, "gdacs": storms, "nws": quakes.limit(0), "wfigs": None, "airnow": quakes.limit(0)})
    return rows.groupBy("provider", "kind").agg(F.count("*").alias("n")).withColumn("answered", F.lit(",".join(answered)))


QUERIES = {f.__name__: f for f in (feed_rows, translated_texts, crit_translations, theme_suggestions, near_saved, ring_badges, fire_shapes, all_providers)}


def _cleaned(text: str) -> str:
    for pattern in ops._TRAILERS:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'), ' -–—|·•')"


def _stripped(text: str) -> str:
    return f"trim(replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), ' ')"


def _points(theme: dict) -> str:
    parts = [f"CASE WHEN contains(t, '{w}') THEN 2 ELSE 0 END" for w in theme["keywords"]]
    return " + ".join([*parts, *([f"CASE WHEN contains(t, '{theme['name']}') THEN 3 ELSE 0 END"] if len(theme["name"]) > 4 else [])])


def _near(place: dict) -> list[str]:
    return [f for f, p in zip(("us_", "fr_", "de_"), C.PLACES) if C._km(place["lat"], place["lon"], p["lat"], p["lon"]) <= place["radius_km"]]


_SAVED_SQL = ", ".join(f"CASE WHEN {' OR '.join(_near(s)) or 'false'} THEN '{s['id']}' END" for s in SAVED)
_RING = f"""r AS (SELECT location_id, hazard_id, round({C._HAVERSINE.format(a='l.lat', b='h.lat', x='l.lon', y='h.lon')}, 3) AS km
  FROM locations l JOIN hazards h ON h.kind = 'wildfire' AND {C._HAVERSINE.format(a='l.lat', b='h.lat', x='l.lon', y='h.lon')} <= 2 * l.fire_km)"""

SQL = {
    "feed_rows": f"""{A.with_sql('articles')},
e AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n, {_stripped("'<b>' || CASE WHEN id % 11 = 0 THEN '' ELSE title END || '</b>'")} AS t,
  '<p>&nbsp;' || summary || '</p>' || [' Read more here', ' The post X appeared first on Y.', ' Share this: a b', ''][id % 4 + 1] AS s FROM articles)
SELECT source_id, url, t AS title, substr({_cleaned(_stripped('s'))}, 1, 2000) AS summary, CASE WHEN id % 3 = 0 THEN id::VARCHAR ELSE url END AS guid, published_at, id AS arrival FROM e WHERE n <= 80 AND id % 7 <> 0 AND t <> ''""",
    "translated_texts": """SELECT doc_id // 3 AS article_id, string_agg('title ' || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'sum' ELSE '' END, chr(10) ORDER BY encode(lang || doc_id % 3)) AS translated
FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1""",
    "crit_translations": f"{A.with_sql('articles')} SELECT id FROM articles WHERE id % 5 = 0 AND importance >= 20",
    "theme_suggestions": f"""{A.with_sql('articles')}, x AS (SELECT id, lower(concat_ws(' ', title, summary)) AS t FROM articles),
p AS ({" UNION ALL ".join(f"SELECT id, {i} AS place, '{t['slug']}' AS slug, {_points(t)} AS points FROM x" for i, t in enumerate(THEMES))}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, place) AS n FROM p WHERE points > 0)
SELECT x.id, coalesce(string_agg(slug, ',' ORDER BY n) FILTER (WHERE n <= 4), '') AS themes FROM x LEFT JOIN r ON x.id = r.id GROUP BY x.id""",
    "near_saved": f"{A.with_sql('articles', 'sources')}, {C._P} SELECT id, concat_ws(',', {_SAVED_SQL}) AS near FROM pl",
    "ring_badges": f"{A.with_sql('hazards', 'locations')}, {_RING} SELECT hazard_id, arg_min(location_id, (km, location_id)) AS nearest, min(km) AS km, count(*) - 1 AS others FROM r GROUP BY hazard_id",
    "fire_shapes": "SELECT 'C' || c_custkey % 200 AS external_id, make_timestamp((1700000000000 + max(c_custkey) * 1000) * 1000) AS geometry_at FROM customer WHERE c_custkey % 9 <> 0 GROUP BY 1",
    "all_providers": """SELECT 'usgs' AS provider, 'earthquake' AS kind, count(*) AS n, 'usgs,gdacs,nws' AS answered FROM customer
UNION ALL SELECT 'gdacs', CASE WHEN c_custkey % 2 = 0 THEN 'storm' ELSE 'flood' END, count(*), 'usgs,gdacs,nws' FROM customer GROUP BY 2""",
}
