"""Queries of hazards, air quality and places."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import air, geo
from ..operators import geofence, ops
from ..operators import hazards as H
from ..operators.lineage import shared_folder
from ..sources import adapters as A
from ..sources import paged, store

POLYGON = {"type": "Polygon", "coordinates": [[[-60, -40], [70, -30], [50, 55], [-50, 45], [-60, -40]], [[-10, -10], [10, -10], [10, 10], [-10, 10], [-10, -10]]]}
#: Corners of fences, in radii around their middle.
OUTER = ((-1.0, -0.5), (0.0, -1.0), (1.0, -0.3), (0.5, 1.0), (-0.5, 0.5), (-0.75, 0.25))
HOLE = ((-0.2, -0.2), (0.2, -0.2), (0.2, 0.2), (-0.2, 0.2))
CIRCLE = {"type": "Circle", "center": [20.0, 10.0], "radius_km": 3000.0}


def _hazards(spark, sf_dir):
    return A.hazards(spark, sf_dir)


def geofence_circle(spark, sf_dir):
    return _hazards(spark, sf_dir).filter(geo.inside(F.col("lat"), F.col("lon"), CIRCLE)).select("hazard_id")


def geofence_polygon(spark, sf_dir):
    return _hazards(spark, sf_dir).filter(geo.inside(F.col("lat"), F.col("lon"), POLYGON)).select("hazard_id")


def nearest_vertex(spark, sf_dir):
    return A.locations(spark, sf_dir).select("location_id", F.round(geo.nearest_vertex_km(F.col("lat"), F.col("lon"), POLYGON), 3).alias("km"))


def hazard_bbox(spark, sf_dir):
    h = _hazards(spark, sf_dir).filter(geo.box(F.col("lat"), F.col("lon"), 60, 50, -60, -50) & F.col("kind").isin("wildfire", "storm"))
    return h.orderBy(F.desc("severity"), F.desc("last_seen_at"), "hazard_id").limit(1000).select("hazard_id", "severity")


def fire_ring(spark, sf_dir):
    return H.fire_ring(A.locations(spark, sf_dir), _hazards(spark, sf_dir)).select("location_id", "hazard_id", F.round("distance_km", 1).alias("km"), "bucket")


def fire_ring_again(spark, sf_dir):
    """Fires that speak again: hits exist for two thirds of the hazards, at a severity that is 25 less or more."""
    h = _hazards(spark, sf_dir)
    loc = A.locations(spark, sf_dir)
    before = H.fire_ring(loc, h).filter("hazard_id % 3 <> 0").select("location_id", "hazard_id", (F.col("severity") + F.when(F.col("hazard_id") % 2 == 0, -25).otherwise(25)).alias("severity_at_alert"))
    return H.fire_ring(loc, h, before).select("location_id", "hazard_id", "bucket")


def air_reading(spark, sf_dir):
    return H.air_readings(A.locations(spark, sf_dir), A.stations(spark, sf_dir), near_km=600.0, far_km=3000.0)


def station_worst(spark, sf_dir):
    r = A.table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("station_id"), F.floor("value").cast("int").alias("aqi"), F.col("event_type").alias("pollutant"), F.col("event_id").alias("arrival"))
    return H.worst_per_station(r)


def aqi_from_conc(spark, sf_dir):
    names = list(air.BREAKPOINTS)
    e = A.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).cast("int").alias("k"), (F.col("event_id") * 7 % 4000 / F.lit(10.0)).alias("value"))
    e = e.withColumn("parameter", F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1))
    e = e.withColumn("unit", F.when(F.col("k") < 2, "µg/m³").when(F.col("event_id") % 2 == 0, "ppb").otherwise("ug/m3"))
    return e.select("event_id", "parameter", air.aqi(F.col("parameter"), F.col("value"), F.col("unit")).alias("aqi"))


def severities(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id")
    return e.select(
        "event_id",
        air.fire_severity((k * 13 % 120000).cast("double"), (k % 11 * 10).cast("double")).alias("fire"),
        air.quake_severity((k % 90) / 10.0, F.element_at(F.array(*map(F.lit, ("", "green", "RED", "blue", "yellow"))), (k % 5 + 1).cast("int"))).alias("quake"),
        air.category((k % 400).cast("double")).alias("category"), air.label((k % 400).cast("double")).alias("label"), air.severity((k % 400).cast("double")).alias("air"),
        F.round(air.corrected_pm25((k % 300).cast("double"), (k % 120).cast("double")), 6).alias("pm25"),
        air.alert_bucket((k % 101).cast("int"), F.element_at(F.array(*map(F.lit, ("wildfire", "air_quality", "flood"))), (k % 3 + 1).cast("int"))).alias("bucket"),
    )


def provider_cap(spark, sf_dir):
    return H.capped(_hazards(spark, sf_dir), 50).select("provider", "hazard_id")


def _polls(spark, sf_dir):
    h = _hazards(spark, sf_dir)
    stored = h.filter("hazard_id % 5 <> 0").select("provider", F.col("hazard_id").alias("external_id"), "kind", "lat", "lon", "severity", F.col("last_seen_at").alias("first_seen_at"), "last_seen_at")
    polled = h.filter("hazard_id % 3 <> 0").select("provider", F.col("hazard_id").alias("external_id"), "kind", "lat", "lon", (F.col("severity") + F.col("hazard_id") % 40 - 15).cast("int").alias("severity"))
    return stored, polled


def hazard_merge(spark, sf_dir):
    return H.merge(*_polls(spark, sf_dir), A.now()).select("provider", "external_id", "severity", "status", "escalated", "first_seen_at", "last_seen_at")


def hazard_counters(spark, sf_dir):
    return H.counters(H.merge(*_polls(spark, sf_dir), A.now()))


def hazard_prune(spark, sf_dir):
    return H.pruned(_hazards(spark, sf_dir), ["wfigs", "usgs", "gdacs"], A.now()).select("hazard_id", "kind")


def watch_boxes(spark, sf_dir):
    return H.watch_boxes(A.stations(spark, sf_dir).withColumnRenamed("station_id", "location_id"), cell=30.0, most=40)


def fences(spark, sf_dir):
    """A fence for each part: a six-sided polygon by its key, every third with a hole, some across the date line or up to a pole."""
    k = F.col("p_partkey")
    x, y, r = (k * 53 % 3600) / F.lit(10.0) - 180, (k * 37 % 1700) / F.lit(10.0) - 85, F.lit(0.5) + (k % 23) * F.lit(0.75)
    ring = lambda *points: F.array(*[F.struct((x + a * r).alias("x"), (y + b * r).alias("y")) for a, b in points])
    rings = F.when(k % 3 == 0, F.array(ring(*OUTER), ring(*HOLE))).otherwise(F.array(ring(*OUTER)))
    return A.table(spark, sf_dir, "part").select(k.alias("fence_id"), F.array(rings).alias("polygons"))


def geofence_join(spark, sf_dir):
    """All fences by all hazards."""
    return geofence.join(_hazards(spark, sf_dir).select("hazard_id", "lat", "lon"), fences(spark, sf_dir)).select("fence_id", "hazard_id")


def _store(spark):
    return store.Snapshots(spark, f"{shared_folder(spark).rstrip('/')}/tidewire-store-{uuid.uuid4().hex}")


def stored_hazards(spark, sf_dir):
    """The stored table after a poll that is handed in twice."""
    kept, (stored, polled) = _store(spark), _polls(spark, sf_dir)
    kept.create("hazards", stored, ["provider", "external_id"])
    for _ in range(2):
        store.merge_hazards(kept, polled, A.now(), stream="polls", batch_id=0)
    return kept.read("hazards").select("provider", "external_id", "severity", "first_seen_at", "last_seen_at", F.lit(kept.manifest()["version"]).cast("int").alias("version"))


def stored_cascade(spark, sf_dir):
    """Four tables after the articles past retention went with all that points at them, in one commit."""
    kept, a = _store(spark), A.articles(spark, sf_dir).select("id", "published_at", "title")
    hits = a.filter("id % 3 = 0").select((F.col("id") % 5).alias("alert_id"), F.col("id").alias("article_id"))
    seen = a.filter("id % 2 = 0").select((F.col("id") % 7).alias("user_id"), F.col("id").alias("article_id"))
    texts = a.filter("id % 4 = 1").select(F.col("id").alias("article_id"), F.lit("xx").alias("lang"), "title")
    for name, rows, key in (("articles", a, ["id"]), ("hits", hits, ["alert_id", "article_id"]), ("seen", seen, ["user_id", "article_id"]), ("translations", texts, ["article_id", "lang"])):
        kept.create(name, rows, key)
    gone = ops.doomed(kept.read("articles"), A.now(), days=20, most=None)
    store.delete_articles(kept, gone, {"articles": "id", "hits": "article_id", "seen": "article_id", "translations": "article_id"})
    out = None
    for name, column in (("articles", "id"), ("hits", "article_id"), ("seen", "article_id"), ("translations", "article_id")):
        rows = kept.read(name).select(F.lit(name).alias("name"), F.col(column).alias("article_id"))
        out = rows if out is None else out.unionByName(rows)
    return out


def paged_stations(spark, sf_dir):
    """Stations by way of recorded pages; the poll of one provider lacks a page and gives none."""
    path = f"{shared_folder(spark).rstrip('/')}/tidewire-pages-{uuid.uuid4().hex}"
    s = A.stations(spark, sf_dir).withColumn("poll", F.lit("0001"))
    body = F.to_json(F.struct("station_id", "lat", "lon", "aqi"))
    paged.register(spark)
    paged.record(s.filter("provider <> 'purpleair'").select("provider", "poll", body.alias("body")), path, size=9)
    # Of this provider only the first of two pages was kept.
    torn = s.filter("provider = 'purpleair'").groupBy("provider", "poll").agg(F.to_json(F.struct(F.lit(1).alias("page"), F.lit(2).alias("pages"), F.array(F.min("station_id")).alias("results"))).alias("value"))
    torn.select("provider", "poll", "value").write.mode("append").partitionBy("provider", "poll").text(path)
    found = spark.read.format("tw-pages").load(path)
    row = F.from_json("body", "station_id long, lat double, lon double, aqi int")
    return found.select("provider", row.alias("r")).select("provider", "r.station_id", "r.lat", "r.lon", "r.aqi")


QUERIES = {f.__name__: f for f in (
    stored_hazards, stored_cascade, paged_stations, geofence_join, geofence_circle, geofence_polygon, nearest_vertex, hazard_bbox, fire_ring, fire_ring_again, air_reading, station_worst, aqi_from_conc, severities,
    provider_cap, hazard_merge, hazard_counters, hazard_prune, watch_boxes,
)}


def _km(lat1, lon1, lat2, lon2) -> str:
    return f"2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"


def _ring(ring) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            parts.append(f"((({y1} > lat) <> ({y2} > lat)) AND lon < {float(x2 - x1)}::DOUBLE * (lat - {float(y1)}::DOUBLE) / {float(y2 - y1)}::DOUBLE + {float(x1)}::DOUBLE)::INT")
    return f"(({' + '.join(parts)}) % 2 = 1)"


_INSIDE = f"({_ring(POLYGON['coordinates'][0])} AND NOT {_ring(POLYGON['coordinates'][1])})"
_POINTS = [p for r in POLYGON["coordinates"] for p in r]
_BUCKET = lambda s: f"CASE WHEN {s} >= 80 THEN 4 WHEN {s} >= 60 THEN 3 WHEN {s} >= 40 THEN 2 WHEN {s} >= 20 THEN 1 ELSE 0 END"
_AIR = lambda s: "CASE " + " ".join(f"WHEN {s} <= {v} THEN {i}" for i, v in enumerate(air.SEVERITIES)) + " ELSE 5 END"
_ANY = lambda s, k: f"CASE WHEN {k} = 'wildfire' THEN {_BUCKET(s)} WHEN {k} = 'air_quality' THEN {_AIR(s)} ELSE floor({s} / 20)::INT END"
_RING = f"ring AS (SELECT l.location_id, h.hazard_id, {_km('l.lat', 'l.lon', 'h.lat', 'h.lon')} AS d, severity, {_BUCKET('severity')} AS bucket FROM locations l JOIN hazards h ON h.kind = 'wildfire' AND {_km('l.lat', 'l.lon', 'h.lat', 'h.lon')} <= l.fire_km)"
_CASE = lambda v, bands, other: "CASE " + " ".join(f"WHEN {v} >= {a} THEN {b!r}" for a, b in bands) + f" ELSE {other!r} END"


def _aqi() -> str:
    arms = []
    for name, (unit, decimals, bands) in air.BREAKPOINTS.items():
        v = "value"
        if name in ("pm25", "pm10"):
            conc = v
        else:
            ppm = f"CASE WHEN unit = 'ppb' THEN {v} / 1000.0::DOUBLE ELSE {v} * {air.LITRES_PER_MOLE}::DOUBLE / {air.MOLAR_MASS[name]}::DOUBLE / 1000.0::DOUBLE END"
            conc = f"({ppm})" if unit == "ppm" else f"CASE WHEN unit = 'ppb' THEN {v} ELSE ({ppm}) * 1000.0::DOUBLE END"
        ten = f"{float(10**decimals)}::DOUBLE"
        cut = f"(floor(({conc}) * {ten}) / {ten})"
        lines = " ".join(
            f"WHEN {cut} <= {float(h)}::DOUBLE THEN CASE WHEN {cut} < {float(lo)}::DOUBLE THEN {a} ELSE round_even({(b - a) / (h - lo)!r}::DOUBLE * ({cut} - {float(lo)}::DOUBLE) + {a}, 0)::INT END"
            for lo, h, a, b in bands
        )
        arms.append(f"WHEN parameter = '{name}' THEN CASE {lines} ELSE {bands[-1][3]} END")
    return "CASE " + " ".join(arms) + " END"


SQL = {
    "geofence_join": f"""{A.with_sql('hazards')},
f AS (SELECT p_partkey AS k, (p_partkey * 53 % 3600) / 10 - 180 AS x, (p_partkey * 37 % 1700) / 10 - 85 AS y, 0.5::DOUBLE + (p_partkey % 23) * 0.75::DOUBLE AS r FROM part),
e AS ({" UNION ALL ".join(f"SELECT k, {hole} AS hole, x + {a}::DOUBLE * r AS x1, y + {b}::DOUBLE * r AS y1, x + {c}::DOUBLE * r AS x2, y + {d}::DOUBLE * r AS y2 FROM f WHERE {hole} = 0 OR k % 3 = 0" for hole, side in enumerate((OUTER, HOLE)) for (a, b), (c, d) in zip(side, (*side[1:], side[0])))}),
m AS (SELECT *, max(x1) OVER (PARTITION BY k) > 180 AS east, min(x1) OVER (PARTITION BY k) < -180 AS west FROM e),
s AS (SELECT k, hole, x1, y1, x2, y2 FROM m UNION ALL SELECT k, hole, x1 - 360, y1, x2 - 360, y2 FROM m WHERE east UNION ALL SELECT k, hole, x1 + 360, y1, x2 + 360, y2 FROM m WHERE west),
c AS (
  SELECT k, hazard_id, hole, count(*) AS n FROM s JOIN hazards h ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT k AS fence_id, hazard_id FROM c GROUP BY ALL HAVING coalesce(max(n) FILTER (WHERE hole = 0), 0) % 2 = 1 AND coalesce(max(n) FILTER (WHERE hole = 1), 0) % 2 = 0""",
    "geofence_circle": f"{A.with_sql('hazards')} SELECT hazard_id FROM hazards WHERE {_km('lat', 'lon', '20.0::DOUBLE', '10.0::DOUBLE')} <= 3000.0",
    "geofence_polygon": f"{A.with_sql('hazards')} SELECT hazard_id FROM hazards WHERE {_INSIDE}",
    "nearest_vertex": f"{A.with_sql('locations')} SELECT location_id, round(CASE WHEN {_INSIDE} THEN 0.0::DOUBLE ELSE least({', '.join(_km('lat', 'lon', f'{float(y)}::DOUBLE', f'{float(x)}::DOUBLE') for x, y in _POINTS)}) END, 3) AS km FROM locations",
    "hazard_bbox": f"{A.with_sql('hazards')} SELECT hazard_id, severity FROM hazards WHERE lat BETWEEN -50 AND 50 AND lon BETWEEN -60 AND 60 AND kind IN ('wildfire', 'storm') ORDER BY severity DESC, last_seen_at DESC, hazard_id LIMIT 1000",
    "fire_ring": f"{A.with_sql('hazards', 'locations')}, {_RING} SELECT location_id, hazard_id, round(round(d, 3), 1) AS km, bucket FROM ring",
    "fire_ring_again": f"""{A.with_sql('hazards', 'locations')}, {_RING},
hits AS (SELECT location_id, hazard_id, severity + CASE WHEN hazard_id % 2 = 0 THEN -25 ELSE 25 END AS s FROM ring WHERE hazard_id % 3 <> 0)
SELECT r.location_id, r.hazard_id, r.bucket FROM ring r LEFT JOIN hits h ON r.location_id = h.location_id AND r.hazard_id = h.hazard_id WHERE h.s IS NULL OR r.bucket > {_BUCKET('h.s')}""",
    "air_reading": f"""{A.with_sql('stations', 'locations')},
p AS (SELECT location_id, station_id, provider, aqi, CASE provider WHEN 'purpleair' THEN 1 ELSE 0 END AS rank, {_km('l.lat', 'l.lon', 's.lat', 's.lon')} AS d FROM locations l, stations s),
q AS (SELECT * FROM p WHERE d <= 3000),
near AS (SELECT location_id, provider FROM q WHERE d <= 600 QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY rank, d, station_id) = 1),
mean AS (SELECT q.location_id, q.provider, round_even(avg(aqi), 0)::INT AS aqi, count(*) AS n FROM q JOIN near ON q.location_id = near.location_id AND q.provider = near.provider WHERE d <= 600 GROUP BY ALL),
far AS (SELECT location_id, provider, aqi, 1::BIGINT AS n FROM q WHERE location_id NOT IN (SELECT location_id FROM near) QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY d, station_id) = 1),
u AS (SELECT location_id, aqi, n, provider FROM mean UNION ALL SELECT location_id, aqi, n, provider FROM far)
SELECT location_id, aqi, n AS stations, provider, {_CASE('aqi', air.CATEGORIES, 'Good')} AS label FROM u""",
    "station_worst": """SELECT user_id % 40 AS station_id, floor(value)::INT AS aqi, event_type AS pollutant, event_id AS arrival FROM events
QUALIFY row_number() OVER (PARTITION BY user_id % 40 ORDER BY floor(value) DESC, event_id) = 1""",
    "aqi_from_conc": f"""WITH e AS (SELECT event_id, ['pm25', 'pm10', 'o3', 'no2', 'so2', 'co'][event_id % 6 + 1] AS parameter, (event_id * 7 % 4000)::DOUBLE / 10.0::DOUBLE AS value,
  CASE WHEN event_id % 2 = 0 THEN 'ppb' ELSE 'ug' END AS unit FROM events)
SELECT event_id, parameter, {_aqi()} AS aqi FROM e""",
    "severities": f"""WITH e AS (SELECT event_id, (event_id * 13 % 120000)::DOUBLE AS acres, (event_id % 11 * 10)::DOUBLE AS c, (event_id % 90)::DOUBLE / 10.0::DOUBLE AS mag,
  ['', 'green', 'red', 'blue', 'yellow'][event_id % 5 + 1] AS col, (event_id % 400)::DOUBLE AS a, (event_id % 300)::DOUBLE AS pa, least(100.0, (event_id % 120))::DOUBLE AS rh,
  (event_id % 101)::INT AS s, ['wildfire', 'air_quality', 'flood'][event_id % 3 + 1] AS k FROM events),
f AS (SELECT *, 0.0862::DOUBLE * rh AS damp, pa / 20.0::DOUBLE - 1.5::DOUBLE AS lo, pa / 50.0::DOUBLE - 4.2::DOUBLE AS hi FROM e)
SELECT event_id, greatest(5, round_even({_CASE('acres', air.ACRES, 5)} * (1.0::DOUBLE - 0.6::DOUBLE * (c / 100.0::DOUBLE)), 0)::INT) AS fire,
  CASE col WHEN 'red' THEN 95 WHEN 'orange' THEN 80 WHEN 'yellow' THEN 55 WHEN 'green' THEN 30 ELSE {_CASE('mag', air.MAGNITUDES, 20)} END AS quake,
  {_CASE('a', tuple((x, 5 - i) for i, (x, _) in enumerate(air.CATEGORIES)), 0)} AS category, {_CASE('a', air.CATEGORIES, 'Good')} AS label,
  {_CASE('a', tuple((x, air.SEVERITIES[5 - i]) for i, (x, _) in enumerate(air.CATEGORIES)), 10)} AS air,
  round(greatest(0.0::DOUBLE, CASE WHEN pa < 30 THEN 0.524::DOUBLE * pa - damp + 5.75::DOUBLE WHEN pa < 50 THEN (0.786::DOUBLE * lo + 0.524::DOUBLE * (1 - lo)) * pa - damp + 5.75::DOUBLE
    WHEN pa < 210 THEN 0.786::DOUBLE * pa - damp + 5.75::DOUBLE
    WHEN pa < 260 THEN (0.69::DOUBLE * hi + 0.786::DOUBLE * (1 - hi)) * pa - damp * (1 - hi) + 2.966::DOUBLE * hi + 5.75::DOUBLE * (1 - hi) + 8.84e-4::DOUBLE * hi * pa * pa
    ELSE 0.69::DOUBLE * pa + 8.84e-4::DOUBLE * pa * pa + 2.97::DOUBLE END), 6) AS pm25, {_ANY('s', 'k')} AS bucket FROM f""",
    "provider_cap": f"{A.with_sql('hazards')} SELECT provider, hazard_id FROM hazards QUALIFY row_number() OVER (PARTITION BY provider ORDER BY severity DESC, last_seen_at DESC, hazard_id) <= 50",
    "hazard_prune": f"""{A.with_sql('hazards')} SELECT hazard_id, kind FROM hazards WHERE provider NOT IN ('wfigs', 'usgs', 'gdacs')
  OR last_seen_at >= TIMESTAMP '{A.NOW}' - CASE kind WHEN 'air_quality' THEN INTERVAL 6 HOUR WHEN 'earthquake' THEN INTERVAL 24 HOUR WHEN 'severe_weather' THEN INTERVAL 12 HOUR ELSE INTERVAL 168 HOUR END""",
    "watch_boxes": f"""{A.with_sql('stations')}
SELECT station_id AS location_id, floor(lat / 30.0)::BIGINT AS cy, floor(lon / 30.0)::BIGINT AS cx FROM stations QUALIFY row_number() OVER (PARTITION BY floor(lat / 30.0), floor(lon / 30.0) ORDER BY station_id) = 1 ORDER BY cy, cx LIMIT 40""",
}
_MERGED = f"""{A.with_sql('hazards')},
s AS (SELECT provider, hazard_id AS external_id, kind, severity, last_seen_at FROM hazards WHERE hazard_id % 5 <> 0),
p AS (SELECT provider, hazard_id AS external_id, kind, (severity + hazard_id % 40 - 15)::INT AS severity FROM hazards WHERE hazard_id % 3 <> 0),
m AS (SELECT coalesce(p.provider, s.provider) AS provider, coalesce(p.external_id, s.external_id) AS external_id, coalesce(p.severity, s.severity) AS severity,
  CASE WHEN s.external_id IS NULL THEN 'added' WHEN p.external_id IS NULL THEN 'kept' ELSE 'updated' END AS status,
  CASE WHEN s.external_id IS NULL THEN true WHEN p.external_id IS NULL THEN false ELSE {_ANY('p.severity', 'p.kind')} > {_ANY('s.severity', 'p.kind')} END AS escalated,
  coalesce(s.last_seen_at, TIMESTAMP '{A.NOW}') AS first_seen_at, CASE WHEN p.external_id IS NULL THEN s.last_seen_at ELSE TIMESTAMP '{A.NOW}' END AS last_seen_at
  FROM s FULL JOIN p ON s.provider = p.provider AND s.external_id = p.external_id)"""
SQL["hazard_merge"] = f"{_MERGED} SELECT * FROM m"
SQL["hazard_counters"] = f"{_MERGED} SELECT count(*) FILTER (WHERE status <> 'kept') AS seen, count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE escalated) AS escalated FROM m"
SQL["stored_hazards"] = f"{_MERGED} SELECT provider, external_id, severity, first_seen_at, last_seen_at, 2 AS version FROM m"
SQL["stored_cascade"] = f"""{A.with_sql('articles')},
k AS (SELECT id FROM articles WHERE NOT coalesce(published_at < TIMESTAMP '{A.NOW}' - INTERVAL 20 DAY, false))
SELECT 'articles' AS name, id AS article_id FROM k UNION ALL SELECT 'hits', id FROM k WHERE id % 3 = 0
UNION ALL SELECT 'seen', id FROM k WHERE id % 2 = 0 UNION ALL SELECT 'translations', id FROM k WHERE id % 4 = 1"""
SQL["paged_stations"] = f"{A.with_sql('stations')} SELECT provider, station_id, lat, lon, aqi FROM stations WHERE provider <> 'purpleair'"
