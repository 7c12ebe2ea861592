"""Queries of the catalogue, of what users see, of exports and places, of retention by size, and of event merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..functions.similarity import STOP_WORDS
from ..operators import cards as C
from ..operators import catalog as K
from ..operators import clusters, coverage, ops
from ..operators.hazards import fire_ring
from ..sources import adapters as A
from ..sources import gazetteer, sinks
from ..streaming import alerts
from . import q_articles, q_ops, q_search
from .q_articles import _TOKENS, PLACES
from .criteria import Criteria, domain_of, home, predicate

CENTROIDS = {"US": (40.0, -100.0), "FR": (46.0, 2.0), "DE": (51.0, 9.0), "ES": (40.0, -4.0)}


def _minus(column, unit: str):
    return A.now() - F.make_dt_interval(**{unit: column.cast("int")})


# Catalogue


def _sources(spark, sf_dir):
    n = F.col("source_id")
    return A.sources(spark, sf_dir).withColumns({
        "last_fetched_at": F.when(n % 5 != 0, _minus(n, "hours")), "last_status": F.when(n % 7 == 3, F.when(n % 2 == 1, "retired: silent").otherwise("error: 404")).otherwise("ok"),
        "paywall": n % 4 == 1, "added_by": F.when(n % 2 == 0, "auto-discovered").otherwise("user"),
    })


def source_states(spark, sf_dir):
    return K.states(_sources(spark, sf_dir), A.articles(spark, sf_dir).filter("source_id % 6 <> 2"))


def _domains(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select(domain_of(F.col("url")).alias("domain"), "page_id")
    d = p.groupBy("domain").agg(F.min("page_id").alias("k"), F.count("*").alias("n"))
    return d.select("domain", F.element_at(F.array(*map(F.lit, ("added", "no-feed", "seen"))), (F.col("k") % 3 + 1).cast("int")).alias("status"), _minus(F.col("k") % 60, "days").alias("checked_at"), F.col("n").alias("sightings"))


def discovery_counts(spark, sf_dir):
    return K.discovery(_domains(spark, sf_dir)).withColumn("feedless", F.array_join("feedless", ","))


def probe_candidates(spark, sf_dir):
    d = _domains(spark, sf_dir)
    s = A.sources(spark, sf_dir).select(F.concat(F.lit("https://"), "host").alias("rss_url"), F.lit("").alias("homepage"))
    return K.probe_candidates(d, s, d, A.now())


def domain_sightings(spark, sf_dir):
    d = _domains(spark, sf_dir)
    seen = A.table(spark, sf_dir, "pages").filter("page_id % 2 = 0").select(domain_of(F.col("url")).alias("domain"))
    return K.sightings(d.filter("sightings % 3 <> 1"), seen, A.now()).select("domain", "status", "sightings")


def repairs(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("ok", "error: 404", "error: 4040", "error: 500", "error: not a feed", "parse error: x", "error: 451 y"))), (F.col("event_id") % 7 + 1).cast("int")).alias("status"))
    return e.select("event_id", K.needs_repair(F.col("status")).alias("repair"))


def seed_rows(spark, sf_dir):
    s = A.sources(spark, sf_dir).select("source_id", F.concat(F.lit("https://"), "host", F.lit("/rss")).alias("rss_url"))
    return K.seeded(s, s.filter("source_id % 3 = 0")).select("source_id", "rss_url")


def backfill_queue(spark, sf_dir):
    a = A.articles(spark, sf_dir)
    tried = a.filter("id % 2 = 0").select("id", _minus(F.col("id") % 12, "hours").alias("tried_at"))
    return K.to_backfill(a, _sources(spark, sf_dir), tried, A.now(), 500, hours=24 * 30).select("id")


def translation_totals(spark, sf_dir):
    d = F.col("doc_id")
    t = A.table(spark, sf_dir, "documents").select(d.alias("article_id"), F.when(d % 3 == 0, "fr").otherwise("de").alias("lang"), F.when(d % 5 == 0, "").otherwise("t").alias("title"), (d % 6).cast("int").alias("attempts"))
    return K.translation_totals(t, "fr")


def translated_well(spark, sf_dir):
    a = A.articles(spark, sf_dir)
    got = F.when(F.col("id") % 3 == 0, F.col("title")).when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("x "), "title"))
    return a.select("id", K.looks_translated(F.col("title"), got).alias("ok"))


# Who sees what


def visible_items(spark, sf_dir):
    """Items of users and groups: parts of the test data's suppliers and nations."""
    k = F.col("s_suppkey")
    items = A.table(spark, sf_dir, "supplier").select(k.alias("item_id"), (k % 13).alias("user_id"), F.when(k % 3 == 0, k % 5).alias("group_id"))
    members = A.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).cast("long").alias("group_id"), (F.col("n_nationkey") % 13).cast("long").alias("user_id"))
    return K.visible(items, members, "item_id")


def viewed_articles(spark, sf_dir):
    a = A.articles(spark, sf_dir).select("id", "event_id")
    opened = A.events(spark, sf_dir).filter("event_id % 4 = 1").select("event_id")
    return K.viewed(a, opened, a.filter("id % 8 = 0").select("id")).select("id", "viewed")


def active_devices(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("seen_at"))
    return K.active_devices(e, A.now(), 2 * 24 * 3600)


def article_cards(spark, sf_dir):
    a = A.articles(spark, sf_dir).withColumns({"base_importance": F.when(F.col("id") % 2 == 0, F.col("importance") + 5), "viewed": F.col("id") % 3 == 0})
    t = A.articles(spark, sf_dir).filter("id % 4 < 2").select(F.col("id").alias("article_id"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("fr "), "title")).alias("title"), F.lit("").alias("summary"))
    return C.cards(a, _sources(spark, sf_dir), t)


def export_table(spark, sf_dir):
    """The eleven columns of a full export of the newest German articles."""
    a = A.articles(spark, sf_dir).withColumn("categories", F.when(F.col("id") % 2 == 0, F.array(F.lit("world"), F.lit("politics"))).otherwise(F.array().cast("array<string>")))
    found = a.filter("language = 'de'").join(A.sources(spark, sf_dir), "source_id", "left").orderBy(F.desc("published_at"), F.desc("id")).limit(sinks.EXPORT_LIMIT)
    return sinks.export_table(found)


# Searches


def _placed(spark, sf_dir):
    a = A.articles(spark, sf_dir).join(A.sources(spark, sf_dir), "source_id", "left")
    return gazetteer.with_places(a.withColumn("text", F.concat_ws("\n", "title", "summary", "content")), PLACES)


def places(spark, sf_dir):
    """Places of all articles in the gazetteer's order."""
    return _placed(spark, sf_dir).select("id", F.array_join(F.transform("places", lambda p: p["name"]), ",").alias("names"))


def _criteria(*columns, **raw):
    c = Criteria(passing_mentions=True, **raw)

    def run(spark, sf_dir):
        found = _placed(spark, sf_dir).withColumn("categories", F.array(F.element_at(F.array(*map(F.lit, ("politics", "sports", "world"))), (F.col("id") % 3 + 1).cast("int"))))
        return found.filter(predicate(c, found.columns, q_search.NOW, CENTROIDS)).select("id", *columns)

    return run


def home_columns(spark, sf_dir):
    """The seven columns of the home view: column and the ids it shows."""
    a = A.articles(spark, sf_dir).withColumn("categories", F.array(F.element_at(F.array(*map(F.lit, ("politics", "conflict", "business", "science", "disaster"))), (F.col("id") % 5 + 1).cast("int"))))
    out = None
    for name, found in home(a, A.sources(spark, sf_dir), q_search.NOW).items():
        rows = found.select(F.lit(name).alias("column"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


def breaking_all(spark, sf_dir):
    """The built-in terms of all languages over titles that hold one each, made from the test data's ids."""
    names = sorted(t for t in scoring.ALL_BREAKING if t.isascii() and "'" not in t)
    term = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return A.table(spark, sf_dir, "events").select("event_id", scoring.breaking_signal(F.concat(F.lit("Zz "), F.upper(term), F.lit(", zz")), portable=True).alias("signal"))


# Feeds, retention, coverage


def _entries(spark, sf_dir):
    a, n = A.articles(spark, sf_dir), F.col("source_id")
    part = F.element_at(F.array(*map(F.lit, ("events", "shop", "jobs", "news"))), (F.when(n % 3 == 0, n % 4).otherwise(F.col("id") % 4) + 1).cast("int"))
    return a.select(
        "source_id", F.col("id").alias("arrival"), (F.col("published_at") + F.make_dt_interval(days=F.when(n % 4 == 0, 20).otherwise(0).cast("int"))).alias("published_at"),
        F.concat(F.lit("https://site.example/"), part, F.lit("/"), F.col("id").cast("string")).alias("link"), "title",
        F.concat("title", F.when((n % 5 == 0) | (F.col("id") % 9 == 0), " Buy tickets now").when(F.col("id") % 7 == 0, " apply now").otherwise("")).alias("summary"),
    )


def feed_verdicts(spark, sf_dir):
    return ops.feed_verdict(_entries(spark, sf_dir), A.now())


def over_budget(spark, sf_dir):
    a = A.articles(spark, sf_dir).select("id", "published_at", F.length("content").cast("long").alias("bytes"))
    return ops.over_budget(a, 1_000_000, A.now())


def coverage_grid(spark, sf_dir):
    e = q_ops._entries(spark, sf_dir)
    return ops.coverage_grid(e, ["quality-0", "quality-1", "toxic-1", "unused"], F.date_format(F.date_trunc("week", "at"), "yyyy-MM-dd"))


def source_flags(spark, sf_dir):
    """Every source with whether it has produced."""
    made = A.articles(spark, sf_dir).filter("source_id % 6 <> 2").select("source_id").distinct().withColumn("made", F.lit(True))
    return A.sources(spark, sf_dir).join(made, "source_id", "left").select("source_id", "name", F.coalesce("made", F.lit(False)).alias("has_produced"))


def event_states(spark, sf_dir):
    """Events merged from their members, lists as text."""
    a = q_articles.tokens(spark, sf_dir).filter("event_id IS NOT NULL").withColumn("categories", F.array(F.element_at(F.array(*map(F.lit, ("politics", "sports", "world"))), (F.col("id") % 3 + 1).cast("int"))))
    m = clusters.merged(a)
    return m.select("event_id", "article_count", "importance", "updated_at", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("countries", "source_ids", "categories", "tokens")])


def story_beside(spark, sf_dir):
    """What is shown beside event 5: similar stories, then stories of the same region."""
    e = q_articles._event_tokens(spark, sf_dir).withColumn("importance", F.col("event_importance")).withColumn("countries", F.array((F.col("event_id") % 4).cast("string")))
    return coverage.beside(e, 5, A.now(), days=30, least=0.1)


def linked_events(spark, sf_dir):
    """The linked restatement of clusters: components of similar headlines at most 72 hours apart."""
    return clusters.linked(q_articles.tokens(spark, sf_dir))


def place_digests(spark, sf_dir):
    """One message for each saved place: hazards in its ring, the five worst listed."""
    found = fire_ring(A.locations(spark, sf_dir), A.hazards(spark, sf_dir))
    d = alerts.place_digests(found, 5)
    return d.select("location_id", "hits", F.array_join(F.col("worst").cast("array<string>"), ",").alias("worst"))


def alert_digests(spark, sf_dir):
    """One message for each alert: the number of hits and the three newest ids."""
    hits = alerts.evaluate(A.articles(spark, sf_dir), {1: Criteria(languages=("de",), min_importance=60), 2: Criteria(languages=("fr",))}, q_search.NOW)
    return alerts.digests(hits, 3).select("alert_id", "hits", F.array_join(F.transform("newest", lambda x: x["id"].cast("string")), ",").alias("newest"))


def location_ids(spark, sf_dir):
    """Hazards near saved locations of a user, by great circles of their radius."""
    h = A.hazards(spark, sf_dir)
    circles = [(1, 10.0, 20.0, 2500.0), (2, -35.0, -60.0, 4000.0)]
    hit = [F.when(geo.inside(F.col("lat"), F.col("lon"), {"type": "Circle", "center": [y, x], "radius_km": r}), F.lit(str(k))) for k, y, x, r in circles]
    return h.select("hazard_id", F.concat_ws(",", *hit).alias("near"))


QUERIES = {f.__name__: f for f in (
    source_states, discovery_counts, probe_candidates, domain_sightings, repairs, seed_rows, backfill_queue, translation_totals, translated_well, visible_items,
    viewed_articles, active_devices, article_cards, export_table, places, home_columns, breaking_all, feed_verdicts, over_budget, coverage_grid, source_flags,
    event_states, story_beside, linked_events, place_digests, alert_digests, location_ids,
)} | {
    "crit_categories": _criteria(categories=("sports", "world")), "crit_place": _criteria(geos=({"name": "esat", "country": "US"},)),
    "crit_circle": _criteria(geos=({"type": "Circle", "center": [48.8, 2.3], "radius_km": 300},)), "crit_place_country": _criteria(countries=("DE",)),
    "crit_geo_and_word": _criteria(geo={"type": "Circle", "center": [52.0, 10.0], "radius_km": 400}, keywords=("the",)),
}

_NOW = f"TIMESTAMP '{A.NOW}'"
_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
_S = """src AS (SELECT *, CASE WHEN source_id % 5 <> 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(source_id) END AS last_fetched_at,
  CASE WHEN source_id % 7 = 3 THEN CASE WHEN source_id % 2 = 1 THEN 'retired: silent' ELSE 'error: 404' END ELSE 'ok' END AS last_status, source_id % 4 = 1 AS paywall FROM sources)"""
_D = f"""dom AS (SELECT domain, ['added', 'no-feed', 'seen'][k % 3 + 1] AS status, {_NOW} - to_days((k % 60)::INT) AS checked_at, n AS sightings
  FROM (SELECT {_DOMAIN} AS domain, min(page_id) AS k, count(*) AS n FROM pages GROUP BY 1))"""
_HEADTEXT, _ALLTEXT = "concat_ws(chr(10), title, summary)", "concat_ws(chr(10), title, summary, content)"


def _in(text: str, *names: str) -> str:
    return rf"regexp_matches({text}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(names)})(?:$|[^\p{{L}}\p{{N}}_])')"


_P = f"""pl AS (SELECT a.*, name AS outlet, scope, platform, {_in(_ALLTEXT, 'ndtion')} AS us_, {_in(_ALLTEXT, 'esat', 'enes')} AS fr_, {_in(_ALLTEXT, 'ated')} AS de_
  FROM articles a LEFT JOIN sources USING (source_id))"""


def _km(lat: float, lon: float, y: float, x: float) -> float:
    from math import asin, cos, radians, sin, sqrt

    a = sin(radians(y - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(y)) * sin(radians(x - lon) / 2) ** 2
    return 2 * 6371.0 * asin(min(1.0, sqrt(a)))


def _circle(lat: float, lon: float, km: float) -> str:
    """Articles with a place in a circle; one without any place stands at its country's middle."""
    inside = [f for f, p in zip(("us_", "fr_", "de_"), PLACES) if _km(lat, lon, p["lat"], p["lon"]) <= km]
    home_ = [f"'{c}'" for c, (y, x) in CENTROIDS.items() if _km(lat, lon, y, x) <= km]
    alone = f"(NOT (us_ OR fr_ OR de_) AND country IN ({', '.join(home_)}))" if home_ else "false"
    return "(" + " OR ".join([*inside, alone]) + ")"


_PART = "['events', 'shop', 'jobs', 'news'][CASE WHEN source_id % 3 = 0 THEN source_id % 4 ELSE id % 4 END + 1]"
_WORDS = f"list_filter(list_distinct(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) > 2)"
_SIM = "greatest(i / (n + m - i), i / least(n, m))"
_BREAKING = sorted(t for t in scoring.ALL_BREAKING if t.isascii() and "'" not in t)
_SIGNALS = [min(30, sum(w for t, w in scoring.ALL_BREAKING.items() if f" {t} " in f" zz {name} zz ".replace(",", " "))) for name in _BREAKING]
_HOME_CATEGORY = "['politics', 'conflict', 'business', 'science', 'disaster'][id % 5 + 1]"


def _home(name: str, where: str, order: str = "", limit: int = 40) -> str:
    return f"(SELECT '{name}' AS \"column\", id FROM h WHERE {where} ORDER BY {order} published_at DESC, id DESC LIMIT {limit})"


_HAVERSINE = "2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({y} - {x}) / 2), 2))))"
_AT = lambda y, x: _HAVERSINE.format(a="lat", b=f"{y}::DOUBLE", x="lon", y=f"{x}::DOUBLE")

SQL = {
    "source_states": f"""{A.with_sql('articles', 'sources')}, {_S}, made AS (SELECT DISTINCT source_id AS made FROM articles WHERE source_id % 6 <> 2)
SELECT count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(*) FILTER (WHERE last_fetched_at IS NULL) AS never_polled, count(made) AS producing,
  count(*) FILTER (WHERE enabled AND last_fetched_at IS NOT NULL AND made IS NULL) AS silent, count(*) FILTER (WHERE NOT enabled AND last_status LIKE 'retired:%') AS retired
FROM src LEFT JOIN made ON source_id = made""",
    "discovery_counts": f"""WITH {_D}
SELECT count(*) AS probed, count(*) FILTER (WHERE status = 'added') AS with_a_feed, count(*) FILTER (WHERE status = 'no-feed') AS without_a_feed,
  (SELECT string_agg(domain, ',' ORDER BY checked_at DESC, domain) FROM (SELECT * FROM dom WHERE status = 'no-feed' ORDER BY checked_at DESC, domain LIMIT 12)) AS feedless FROM dom""",
    "probe_candidates": f"""{A.with_sql('sources')}, {_D}
SELECT domain FROM dom WHERE domain NOT IN (SELECT host FROM sources) AND domain NOT IN (SELECT domain FROM dom WHERE status = 'added' OR (status <> 'seen' AND checked_at >= {_NOW} - INTERVAL 30 DAY))""",
    "domain_sightings": f"""WITH {_D}, m AS (SELECT {_DOMAIN} AS domain, count(*) AS more FROM pages WHERE page_id % 2 = 0 GROUP BY 1), st AS (SELECT * FROM dom WHERE sightings % 3 <> 1)
SELECT coalesce(st.domain, m.domain) AS domain, CASE WHEN more IS NULL OR status IN ('added', 'no-feed') THEN status ELSE 'seen' END AS status,
  (coalesce(sightings, 0) + coalesce(more, 0))::BIGINT AS sightings FROM st FULL JOIN m ON st.domain = m.domain""",
    "repairs": "SELECT event_id, event_id % 7 IN (1, 4, 5, 6) AS repair FROM events",
    "seed_rows": f"{A.with_sql('sources')} SELECT source_id, 'https://' || host || '/rss' AS rss_url FROM sources WHERE source_id % 3 <> 0",
    "backfill_queue": f"""{A.with_sql('articles', 'sources')}, {_S}
SELECT id FROM articles JOIN src USING (source_id) WHERE content = '' AND published_at >= {_NOW} - INTERVAL 720 HOUR AND NOT paywall AND (id % 2 <> 0 OR {_NOW} - to_hours((id % 12)::INT) < {_NOW} - INTERVAL 6 HOUR)
ORDER BY published_at DESC, id DESC LIMIT 500""",
    "translation_totals": "SELECT count(*) FILTER (WHERE doc_id % 5 <> 0) AS cached, count(*) FILTER (WHERE doc_id % 5 = 0) AS failing, count(*) FILTER (WHERE doc_id % 5 = 0 AND doc_id % 6 >= 4) AS given_up FROM documents WHERE doc_id % 3 = 0",
    "translated_well": rf"{A.with_sql('articles')} SELECT id, CASE id % 3 WHEN 0 THEN trim(title, ' ') <> '' AND len(regexp_extract_all(title, '\S+')) <= 2 WHEN 1 THEN false ELSE true END AS ok FROM articles",
    "visible_items": """WITH i AS (SELECT s_suppkey AS item_id, s_suppkey % 13 AS user_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 END AS group_id FROM supplier),
m AS (SELECT n_nationkey % 5 AS group_id, (n_nationkey % 13)::BIGINT AS user_id FROM nation),
v AS (SELECT user_id, item_id, true AS mine FROM i UNION ALL SELECT m.user_id, item_id, false FROM i JOIN m ON i.group_id = m.group_id WHERE m.user_id <> i.user_id)
SELECT user_id, item_id, bool_or(mine) AS mine FROM v GROUP BY ALL""",
    "viewed_articles": f"{A.with_sql('articles')} SELECT id, CASE WHEN event_id IS NOT NULL THEN event_id % 4 = 1 ELSE id % 8 = 0 END AS viewed FROM articles",
    "active_devices": f"SELECT user_id, count(*) AS active FROM events WHERE ts >= {_NOW} - INTERVAL 2 DAY GROUP BY user_id",
    "article_cards": f"""{A.with_sql('articles', 'sources')}, {_S}
SELECT id, event_id, id % 3 = 0 AS viewed, CASE WHEN id % 4 = 1 THEN 'fr ' || title ELSE title END AS title, substr(summary, 1, 400) AS summary, CASE WHEN id % 4 = 1 THEN language END AS translated_from,
  id % 4 = 0 AS translation_unavailable, url, strftime(published_at, '%Y-%m-%dT%H:%M:%SZ') AS published_at, language, country, importance,
  (CASE WHEN id % 2 = 0 THEN importance + 5 ELSE importance END)::INT AS base_importance, paywall, CASE WHEN paywall THEN 'https://archive.ph/newest/' || url END AS archive_url, name AS source, scope
FROM articles LEFT JOIN src USING (source_id)""",
    "export_table": rf"""{A.with_sql('articles', 'sources')},
f AS (SELECT * FROM articles LEFT JOIN sources USING (source_id) WHERE language = 'de' ORDER BY published_at DESC, id DESC LIMIT 2000),
c AS (SELECT *, regexp_replace(coalesce(title, ''), '[\x00-\x09\x0b-\x1f]', '', 'g') AS t, regexp_replace(coalesce(summary, ''), '[\x00-\x09\x0b-\x1f]', '', 'g') AS s FROM f)
SELECT trim(t, ' ' || chr(10)) AS title, strftime(published_at, '%Y-%m-%d %H:%M') AS published_at, name AS source, country, CASE WHEN id % 2 = 0 THEN 'world, politics' ELSE '' END AS categories,
  importance::VARCHAR AS importance, scope, language, coalesce(event_id::VARCHAR, '') AS event_id, trim(s, ' ' || chr(10)) AS summary, url FROM c""",
    "places": f"{A.with_sql('articles', 'sources')}, {_P} SELECT id, concat_ws(',', CASE WHEN us_ THEN 'Ndtion' END, CASE WHEN fr_ THEN 'Esat' END, CASE WHEN de_ THEN 'Ated' END) AS names FROM pl",
    "crit_categories": f"{A.with_sql('articles')} SELECT id FROM articles WHERE id % 3 IN (1, 2)",
    "crit_place": f"{A.with_sql('articles', 'sources')}, {_P} SELECT id FROM pl WHERE {_in(_HEADTEXT, 'esat')} AND NOT (country <> '' AND country <> 'US')",
    "crit_circle": f"{A.with_sql('articles', 'sources')}, {_P} SELECT id FROM pl WHERE {_circle(48.8, 2.3, 300)}",
    "crit_place_country": f"{A.with_sql('articles', 'sources')}, {_P} SELECT id FROM pl WHERE de_ OR country = 'DE'",
    "crit_geo_and_word": f"{A.with_sql('articles', 'sources')}, {_P} SELECT id FROM pl WHERE {_circle(52.0, 10.0, 400)} AND {_in('concat_ws(chr(10), title, summary, content)', 'the')}",
    "home_columns": f"""{A.with_sql('articles', 'sources')}, h AS (SELECT a.*, platform, {_HOME_CATEGORY} AS category FROM articles a LEFT JOIN sources USING (source_id))
{" UNION ALL ".join([
    _home('top', 'importance >= 55', 'importance DESC,', 200), _home('breaking', f'published_at >= {_NOW} - INTERVAL 6 HOUR AND importance >= 40', 'importance DESC,'),
    _home('conflict', "category IN ('conflict', 'disaster')", '', 200), _home('politics', "category = 'politics'"), _home('business', "category IN ('business', 'economy')"),
    _home('scitech', "category IN ('science', 'technology')"), _home('social', "platform IN ('reddit', 'mastodon', 'bluesky', 'youtube')")])}""",
    "breaking_all": f"SELECT event_id, {_SIGNALS}[event_id % {len(_SIGNALS)} + 1]::INT AS signal FROM events",
    "feed_verdicts": f"""{A.with_sql('articles')},
e AS (SELECT source_id, id, published_at + CASE WHEN source_id % 4 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END AS at_, {_PART} AS part,
  lower(title || ' ' || title || CASE WHEN source_id % 5 = 0 OR id % 9 = 0 THEN ' Buy tickets now' WHEN id % 7 = 0 THEN ' apply now' ELSE '' END) AS text, {_WORDS} AS words FROM articles),
k AS (SELECT *, CASE {" ".join("WHEN " + " OR ".join(f"contains(text, '" + w.replace("'", "''") + "')" for w in ops.PHRASES[g].split("|")) + f" THEN '{g}'" for g in ("events", "commerce", "jobs"))} END AS word FROM e),
g AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE at_ > {_NOW} + INTERVAL 36 HOUR) AS ahead, count(*) FILTER (WHERE part = 'events') AS pe, count(*) FILTER (WHERE part = 'shop') AS pc, count(*) FILTER (WHERE part = 'jobs') AS pj,
  count(*) FILTER (WHERE trim(text) <> '') AS texts, count(*) FILTER (WHERE word = 'events') AS we, count(*) FILTER (WHERE word = 'commerce') AS wc, count(*) FILTER (WHERE word = 'jobs') AS wj FROM k GROUP BY source_id),
b AS (SELECT source_id, words, lag(words) OVER (PARTITION BY source_id ORDER BY id) AS before FROM k WHERE len(words) > 0),
c AS (SELECT *, len(list_intersect(words, before))::DOUBLE AS i, len(words) AS n, len(before) AS m FROM b),
t AS (SELECT source_id, count(*) AS titles, quantile_cont(CASE WHEN before IS NULL THEN NULL ELSE {_SIM} END, 0.5) AS median FROM c GROUP BY source_id),
r AS (SELECT g.source_id, CASE WHEN n >= 3 THEN ahead / n ELSE 0.0 END AS f, CASE WHEN n >= 4 THEN (pe + pc + pj) / n ELSE 0.0 END AS p, CASE WHEN texts >= 4 THEN (we + wc + wj) / texts ELSE 0.0 END AS w,
  CASE WHEN pe >= pc AND pe >= pj THEN 'events' WHEN pc >= pj THEN 'commerce' ELSE 'jobs' END AS pk, CASE WHEN we >= wc AND we >= wj THEN 'events' WHEN wc >= wj THEN 'commerce' ELSE 'jobs' END AS wk,
  CASE WHEN titles >= 6 THEN coalesce(median, 0.0) ELSE 0.0 END AS t FROM g LEFT JOIN t ON g.source_id = t.source_id),
s AS (SELECT *, (CASE WHEN f >= 0.5 THEN 2 ELSE 0 END + (p >= 0.6)::INT + (w >= 0.5)::INT + (t >= 0.45)::INT)::INT AS score FROM r)
SELECT source_id, round(f, 6) AS future_share, round(p, 6) AS path_share, round(w, 6) AS word_share, round(t, 6) AS template, score,
  CASE WHEN score < 2 THEN 'news' WHEN p >= 0.6 THEN pk WHEN f >= 0.5 THEN 'events' WHEN w >= 0.5 THEN wk ELSE 'news' END AS kind, score >= 2 AS rejected FROM s""",
    "over_budget": f"""{A.with_sql('articles')},
o AS (SELECT id, length(content) AS b, sum(length(content)) OVER (ORDER BY published_at, id) AS upto FROM articles WHERE published_at < {_NOW} - INTERVAL 2 DAY)
SELECT id FROM o WHERE upto - b < (SELECT sum(length(content)) FROM articles) - 1000000""",
    "coverage_grid": f"""{A.with_sql('articles')},
e AS (SELECT strftime(date_trunc('week', published_at), '%Y-%m-%d') AS period, ['quality-' || quality, 'toxic-' || toxic] AS themes FROM labels JOIN articles ON id = doc_id),
x AS (SELECT period, unnest(themes) AS theme FROM e),
c AS (SELECT theme, period, count(*) AS n FROM x WHERE theme IN ('quality-0', 'quality-1', 'toxic-1', 'unused') GROUP BY ALL),
g AS (SELECT t.theme, p.period FROM (SELECT unnest(['quality-0', 'quality-1', 'toxic-1', 'unused']) AS theme) t, (SELECT DISTINCT period FROM e) p)
SELECT g.theme, g.period, coalesce(c.n, 0) AS n, coalesce((SELECT sum(n) FROM c c2 WHERE c2.theme = g.theme), 0)::BIGINT AS total, (SELECT max(n) FROM c) AS largest, (SELECT count(*) FROM e) AS entries
FROM g LEFT JOIN c ON g.theme = c.theme AND g.period = c.period""",
    "source_flags": f"{A.with_sql('articles', 'sources')} SELECT source_id, name, source_id IN (SELECT source_id FROM articles WHERE source_id % 6 <> 2) AS has_produced FROM sources",
    "event_states": f"""{A.with_sql('articles')}, {_TOKENS}, e AS (SELECT *, ['politics', 'sports', 'world'][id % 3 + 1] AS category FROM toks WHERE event_id IS NOT NULL),
n AS (SELECT event_id, count(*) AS article_count, max(importance) AS importance, max(published_at) AS updated_at, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM e GROUP BY event_id),
c AS (SELECT event_id, string_agg(country, ',' ORDER BY p, i) AS countries FROM (SELECT event_id, country, arg_min(published_at, (published_at, id)) AS p, arg_min(id, (published_at, id)) AS i FROM e WHERE country <> '' GROUP BY ALL) GROUP BY event_id),
s AS (SELECT event_id, array_to_string(list(source_id ORDER BY p, i)[1:100], ',') AS source_ids FROM (SELECT event_id, source_id, arg_min(published_at, (published_at, id)) AS p, arg_min(id, (published_at, id)) AS i FROM e GROUP BY ALL) GROUP BY event_id),
t AS (SELECT event_id, array_to_string(list_sort(list(DISTINCT w))[1:18], ',') AS tokens FROM (SELECT event_id, unnest(tokens) AS w FROM e) GROUP BY event_id)
SELECT n.event_id, article_count, importance, updated_at, coalesce(countries, '') AS countries, source_ids, categories, coalesce(tokens, '') AS tokens
FROM n LEFT JOIN c ON n.event_id = c.event_id LEFT JOIN s ON n.event_id = s.event_id LEFT JOIN t ON n.event_id = t.event_id""",
    "story_beside": f"""{A.with_sql('articles', 'stored')}, {_TOKENS},
e AS (SELECT event_id, list_sort(list(DISTINCT w))[1:18] AS tokens FROM (SELECT event_id, unnest(tokens) AS w FROM toks WHERE event_id IS NOT NULL) GROUP BY event_id),
pool AS (SELECT e.event_id, tokens, event_importance FROM e JOIN stored USING (event_id) WHERE e.event_id <> 5 AND updated_at >= {_NOW} - INTERVAL 30 DAY ORDER BY updated_at DESC, event_id LIMIT 500),
x AS (SELECT pool.event_id, event_importance, len(list_intersect(pool.tokens, o.tokens))::DOUBLE AS i, len(pool.tokens) AS n, len(o.tokens) AS m FROM pool, (SELECT tokens FROM e WHERE event_id = 5) o),
s AS (SELECT *, round({_SIM}, 6) AS similarity FROM x),
r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, event_id) AS k FROM s),
w AS (SELECT *, CASE WHEN k <= 5 AND similarity >= 0.1 THEN 'similar story' WHEN event_id % 4 = 1 THEN 'same region' END AS why FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY why DESC, CASE WHEN why = 'similar story' THEN -similarity ELSE -event_importance END, event_id)::INT AS place FROM w WHERE why IS NOT NULL)
SELECT event_id, why, place FROM p WHERE place <= 5""",
    "linked_events": f"""{A.with_sql('articles', recursive=True)}, {_TOKENS},
x AS (SELECT id, published_at AS at_, len(tokens) AS n, unnest(tokens) AS token FROM toks),
p AS (SELECT a.id AS u, b.id AS v, a.n, b.n AS m, count(*)::DOUBLE AS i FROM x a JOIN x b ON a.token = b.token AND a.id <> b.id AND b.at_ <= a.at_ AND b.at_ >= a.at_ - INTERVAL 72 HOUR GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE i >= 2 AND {_SIM} >= 0.5), both_ AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach(id, other) AS (SELECT id, id FROM articles UNION SELECT r.id, both_.v FROM reach r JOIN both_ ON r.other = both_.u)
SELECT id, min(other) AS event FROM reach GROUP BY id""",
    "place_digests": f"""{A.with_sql('hazards', 'locations')},
r AS (SELECT location_id, hazard_id, severity, round({_HAVERSINE.format(a='l.lat', b='h.lat', x='l.lon', y='h.lon')}, 3) AS km FROM locations l JOIN hazards h ON h.kind = 'wildfire' AND {_HAVERSINE.format(a='l.lat', b='h.lat', x='l.lon', y='h.lon')} <= l.fire_km),
w AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY severity DESC, km, hazard_id) AS k FROM r)
SELECT location_id, count(*) AS hits, string_agg(hazard_id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 5) AS worst FROM w GROUP BY location_id""",
    "alert_digests": f"""{A.with_sql('articles')},
a AS (SELECT 1 AS alert_id, id, published_at FROM articles WHERE language = 'de' AND importance >= 60 UNION ALL SELECT 2, id, published_at FROM articles WHERE language = 'fr'),
w AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY published_at DESC, id DESC) AS k FROM a)
SELECT alert_id, count(*) AS hits, string_agg(id::VARCHAR, ',' ORDER BY k) FILTER (WHERE k <= 3) AS newest FROM w GROUP BY alert_id""",
    "location_ids": f"{A.with_sql('hazards')} SELECT hazard_id, concat_ws(',', CASE WHEN {_AT(10.0, 20.0)} <= 2500 THEN '1' END, CASE WHEN {_AT(-35.0, -60.0)} <= 4000 THEN '2' END) AS near FROM hazards",
}
