"""Queries of the hazard providers: payloads made from the test tables, read by the normalisers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import air
from ..sources import adapters as A
from ..sources import providers as P
from .q_hazards import _CASE, _aqi

#: Rows of one payload.
PAGE = 50
_COLUMNS = ["kind", "provider", "external_id", "name", "round(lat, 6) AS lat", "round(lon, 6) AS lon", "country", "cast(severity AS int) AS severity", "started_at"]


def _lat(k: Column) -> Column:
    return (k * 37 % 1800) / 10 - 90


def _lon(k: Column) -> Column:
    return (k * 53 % 3600) / 10 - 180


def _pages(spark, sf_dir, item: Column, whole, per: str = "customer", key: str = "c_custkey") -> DataFrame:
    """Payloads of PAGE items of a table each, as JSON text; item uses the column k."""
    k = A.table(spark, sf_dir, per).select(F.col(key).cast("long").alias("k"))
    listed = F.sort_array(F.collect_list(F.struct("k", item.alias("item"))))
    return k.groupBy(F.floor(F.col("k") / PAGE)).agg(F.transform(listed, lambda x: x["item"]).alias("items")).select(F.to_json(whole(F.col("items"))).alias("payload"))


def _features(items: Column) -> Column:
    return F.struct(items.alias("features"))


def _struct(**c: Column) -> Column:
    return F.struct(*[v.alias(n) for n, v in c.items()])


def _choose(k: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _k() -> Column:
    """The number of an item."""
    return F.col("k")


def _ms() -> Column:
    return (F.lit(1_700_000_000_000) + _k() * 1000).cast("double")


def wfigs_rows(spark, sf_dir):
    a = _struct(IrwinID=F.concat(F.lit("{c"), _k().cast("string"), F.lit("}")), IncidentName=F.concat(F.lit("OLD fire "), _k().cast("string")), IncidentSize=F.when(_k() % 4 != 0, (_k() * 13 % 120000).cast("double")), DiscoveryAcres=(_k() % 900).cast("double"), PercentContained=(_k() % 11 * 10).cast("double"), FireDiscoveryDateTime=_ms())
    return P.wfigs(_pages(spark, sf_dir, _struct(attributes=a, geometry=_struct(x=_lon(_k()), y=_lat(_k()))), _features)).selectExpr(*_COLUMNS)


def airnow_rows(spark, sf_dir):
    """Two pollutants for each station; the worse one stands."""
    one = lambda n, name: _struct(Latitude=_lat(_k()), Longitude=_lon(_k()), AQI=(_k() * n % 320).cast("double"), Parameter=F.lit(name), SiteName=F.concat(F.lit("site "), _k().cast("string")), FullAQSCode=_k().cast("string"))
    pages = _pages(spark, sf_dir, F.array(one(29, "PM2.5"), one(31, "O3")), F.flatten)
    return P.airnow(pages).selectExpr(*_COLUMNS)


def openaq_rows(spark, sf_dir):
    """Stations with two sensors, fine dust and ozone, and the readings of each."""
    sensor = lambda n, name, unit: _struct(id=_k() * 10 + n, parameter=_struct(name=F.lit(name), units=F.lit(unit)))
    station = _struct(id=_k(), name=F.concat(F.lit("place "), _k().cast("string")), country=_struct(code=_choose(_k(), "IN", "US", "FR")), coordinates=_struct(latitude=_lat(_k()), longitude=_lon(_k())), sensors=F.array(sensor(1, "pm25", "µg/m³"), sensor(2, "o3", "ppb")))
    results = lambda items: _struct(results=items)
    reading = lambda n, value: _struct(sensorsId=_k() * 10 + n, value=value)
    latest = _pages(spark, sf_dir, reading(1, (_k() * 7 % 4000) / F.lit(10.0)), results).withColumn("parameter", F.lit("pm25"))
    latest = latest.unionByName(_pages(spark, sf_dir, reading(2, (_k() * 3 % 2000) / F.lit(10.0)), results).withColumn("parameter", F.lit("o3")))
    return P.openaq(_pages(spark, sf_dir, station, results), latest, drop_us=True).selectExpr(*_COLUMNS)


def purpleair_rows(spark, sf_dir):
    """Outdoor sensors of enough confidence, corrected for damp."""
    fields = ("sensor_index", "name", "latitude", "longitude", "pm2.5_cf_1", "humidity", "confidence", "location_type", "last_seen")
    row = F.array(*[v.cast("string") for v in (_k(), F.concat(F.lit("s"), _k().cast("string")), _lat(_k()), _lon(_k()), (_k() * 3 % 300).cast("double"), (_k() % 100).cast("double"), _k() % 50 + 51, _k() % 2, _ms() / 1000)])
    return P.purpleair(_pages(spark, sf_dir, row, lambda items: _struct(fields=F.array(*map(F.lit, fields)), data=items))).selectExpr(*_COLUMNS)


def _point() -> Column:
    return _struct(type=F.lit("Point"), coordinates=F.array(_lon(_k()), _lat(_k()), (_k() % 70).cast("double")))


def gdacs_rows(spark, sf_dir):
    p = _struct(eventtype=_choose(_k(), "EQ", "TC", "FL", "VO", "DR", "WF", "ZZ"), eventid=_k().cast("string"), alertlevel=_choose(_k(), "Red", "Orange", "Green", "none"), iso3=_choose(_k(), "PHL", "USA", None), name=F.concat(F.lit("event "), _k().cast("string")), fromdate=F.lit("2024-01-05T06:07:08"))
    return P.gdacs(_pages(spark, sf_dir, _struct(geometry=_point(), properties=p), _features)).selectExpr(*_COLUMNS)


def usgs_rows(spark, sf_dir):
    p = _struct(mag=(_k() % 90) / F.lit(10.0), place=F.lit("near"), time=_ms(), alert=_choose(_k(), None, "green", "RED", "yellow"), tsunami=F.lit(0), title=F.concat(F.lit("M "), _k().cast("string")))
    return P.usgs(_pages(spark, sf_dir, _struct(id=F.concat(F.lit("u"), _k().cast("string")), geometry=_point(), properties=p), _features)).selectExpr(*_COLUMNS)


def nws_rows(spark, sf_dir):
    """Warnings with a polygon; the marker is the middle of its box."""
    x, y = _lon(_k()), _lat(_k())
    ring = F.array(F.array(x, y), F.array(x + 2, y), F.array(x + 1, y + 4), F.array(x, y))
    shape = _struct(type=F.when(_k() % 5 == 0, "Point").otherwise("Polygon"), coordinates=F.array(ring))
    p = _struct(event=F.concat(F.lit("storm "), _k().cast("string")), severity=_choose(_k(), "Extreme", "Severe", "Moderate", "Minor", "odd"), effective=F.lit("2024-01-05T06:07:08Z"))
    return P.nws(_pages(spark, sf_dir, _struct(id=F.concat(F.lit("n"), _k().cast("string")), geometry=shape, properties=p), _features)).selectExpr(*_COLUMNS)


QUERIES = {f.__name__: f for f in (wfigs_rows, airnow_rows, openaq_rows, purpleair_rows, gdacs_rows, usgs_rows, nws_rows)}

_K = "k AS (SELECT c_custkey AS k, (c_custkey * 37 % 1800) / 10 - 90 AS lat, (c_custkey * 53 % 3600) / 10 - 180 AS lon, make_timestamp((1700000000000 + c_custkey * 1000) * 1000) AS started FROM customer)"
_SEVERITY = _CASE("aqi", tuple((x, air.SEVERITIES[5 - i]) for i, (x, _) in enumerate(air.CATEGORIES)), 10)


def _sql(kind: str, provider: str, source: str, **c: str) -> str:
    parts = {"name": "''", "lat": "lat", "lon": "lon", "country": "''", "started_at": "NULL::TIMESTAMP"} | c
    where = parts.pop("where", "true")
    return f"""WITH {_K}{source}
SELECT {kind} AS kind, '{provider}' AS provider, {parts['external_id']} AS external_id, {parts['name']} AS name, round({parts['lat']}, 6) AS lat, round({parts['lon']}, 6) AS lon, {parts['country']} AS country,
  ({parts['severity']})::INT AS severity, {parts['started_at']} AS started_at FROM {'s' if source else 'k'} WHERE {where}"""


SQL = {
    "wfigs_rows": _sql(
        "'wildfire'", "wfigs", f", s AS (SELECT *, CASE WHEN k % 4 <> 0 THEN (k * 13 % 120000)::DOUBLE ELSE (k % 900)::DOUBLE END AS acres, (k % 11 * 10)::DOUBLE AS c FROM k)", external_id="'C' || k", name="'Old Fire ' || k", country="'US'",
        severity=f"greatest(5, round_even({_CASE('acres', air.ACRES, 5)} * (1.0::DOUBLE - 0.6::DOUBLE * (c / 100.0::DOUBLE)), 0)::INT)", started_at="started",
    ),
    "airnow_rows": _sql("'air_quality'", "airnow", ", s AS (SELECT *, greatest(k * 29 % 320, k * 31 % 320) AS aqi FROM k)", external_id="k::VARCHAR", name="'site ' || k", country="'US'", severity=_SEVERITY),
    "openaq_rows": _sql(
        "'air_quality'", "openaq", f""", e AS (SELECT k, 'pm25' AS parameter, (k * 7 % 4000)::DOUBLE / 10.0::DOUBLE AS value, 'ug' AS unit FROM k UNION ALL SELECT k, 'o3', (k * 3 % 2000)::DOUBLE / 10.0::DOUBLE, 'ppb' FROM k),
q AS (SELECT k, max({_aqi()}) AS aqi FROM e GROUP BY k), s AS (SELECT k.*, aqi FROM k JOIN q ON k.k = q.k)""",
        external_id="k::VARCHAR", name="'place ' || k", country="['IN', 'US', 'FR'][k % 3 + 1]", severity=_SEVERITY, where="k % 3 <> 1",
    ),
    "purpleair_rows": _sql(
        "'air_quality'", "purpleair", f""", r AS (SELECT *, (k * 3 % 300)::DOUBLE AS pa, (k % 100)::DOUBLE AS rh FROM k WHERE k % 50 + 51 >= 70 AND k % 2 <> 1),
f AS (SELECT *, 0.0862::DOUBLE * rh AS damp, pa / 20.0::DOUBLE - 1.5::DOUBLE AS lo, pa / 50.0::DOUBLE - 4.2::DOUBLE AS hi FROM r),
v AS (SELECT *, 'pm25' AS parameter, 'ug' AS unit, greatest(0.0::DOUBLE, CASE WHEN pa < 30 THEN 0.524::DOUBLE * pa - damp + 5.75::DOUBLE WHEN pa < 50 THEN (0.786::DOUBLE * lo + 0.524::DOUBLE * (1 - lo)) * pa - damp + 5.75::DOUBLE
    WHEN pa < 210 THEN 0.786::DOUBLE * pa - damp + 5.75::DOUBLE
    WHEN pa < 260 THEN (0.69::DOUBLE * hi + 0.786::DOUBLE * (1 - hi)) * pa - damp * (1 - hi) + 2.966::DOUBLE * hi + 5.75::DOUBLE * (1 - hi) + 8.84e-4::DOUBLE * hi * pa * pa
    ELSE 0.69::DOUBLE * pa + 8.84e-4::DOUBLE * pa * pa + 2.97::DOUBLE END) AS value FROM f), s AS (SELECT *, {_aqi()} AS aqi FROM v)""",
        external_id="k::VARCHAR", name="'s' || k", severity=_SEVERITY, started_at="started",
    ),
    "gdacs_rows": _sql(
        "['earthquake', 'storm', 'flood', 'volcano', 'drought', 'wildfire'][k % 7 + 1]", "gdacs", "", external_id="['EQ', 'TC', 'FL', 'VO', 'DR', 'WF'][k % 7 + 1] || ':' || k", name="'event ' || k", country="coalesce(['PH', 'US', ''][k % 3 + 1], '')",
        severity="[90, 60, 25, 25][k % 4 + 1]", started_at="TIMESTAMP '2024-01-05 06:07:08'", where="k % 7 <> 6 AND NOT (k % 7 = 5 AND k % 3 = 1)",
    ),
    "usgs_rows": _sql(
        "'earthquake'", "usgs", ", s AS (SELECT *, (k % 90) / 10.0::DOUBLE AS mag FROM k)", external_id="'u' || k", name="'M ' || k", started_at="started",
        severity=f"CASE k % 4 WHEN 1 THEN 30 WHEN 2 THEN 95 WHEN 3 THEN 55 ELSE {_CASE('mag', air.MAGNITUDES, 20)} END",
    ),
    "nws_rows": _sql(
        "'severe_weather'", "nws", "", external_id="'n' || k", name="'storm ' || k", lat="lat + 2", lon="lon + 1", country="'US'", severity="[90, 70, 45, 25, 45][k % 5 + 1]", started_at="TIMESTAMP '2024-01-05 06:07:08'", where="k % 5 <> 0",
    ),
}
