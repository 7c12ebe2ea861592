"""Payloads of hazard providers as rows of one schema.

Each function takes a DataFrame with the payload's JSON text in ``payload`` (one row for each answer)
and returns kind, provider, external_id, name, lat, lon, country, severity, started_at and raw (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import air
from ..operators.hazards import worst_per_station

COLUMNS = ["kind", "provider", "external_id", "name", "lat", "lon", "country", "severity", "started_at", "raw"]
MOST_SHAPE_BYTES, LEAST_CONFIDENCE, MOST_SENSORS = 32_768, 70, 80
#: Kinds of the global disaster feed and severities of its colours; of weather warnings. Fixed values.
GDACS_KINDS = {"EQ": "earthquake", "TC": "storm", "FL": "flood", "VO": "volcano", "DR": "drought", "WF": "wildfire"}
GDACS_LEVELS = {"red": 90, "orange": 60, "green": 25}
NWS_LEVELS = {"extreme": 90, "severe": 70, "moderate": 45, "minor": 25}


def _map(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _rows(df: DataFrame, kind, provider: str, **c: Column) -> DataFrame:
    base = {"name": F.lit(""), "country": F.lit(""), "started_at": F.lit(None).cast("timestamp_ntz"), "raw": F.lit("{}")} | c
    kind = F.lit(kind) if isinstance(kind, str) else kind
    out = df.select(kind.alias("kind"), F.lit(provider).alias("provider"), *[base[k].alias(k) for k in COLUMNS[2:]])
    return out.filter("external_id IS NOT NULL AND external_id <> '' AND lat IS NOT NULL AND lon IS NOT NULL")


def _features(payloads: DataFrame, schema: str) -> DataFrame:
    parsed = F.from_json("payload", f"struct<features:array<{schema}>>")
    return payloads.select(F.explode(parsed["features"]).alias("f"))


def wfigs(payloads: DataFrame) -> DataFrame:
    """Wildfire incidents."""
    f = _features(payloads, "struct<attributes:struct<IrwinID:string,IncidentName:string,IncidentSize:double,DiscoveryAcres:double,PercentContained:double,POOState:string,POOCounty:string,FireCause:string,FireDiscoveryDateTime:double>,geometry:struct<x:double,y:double>>")
    a = F.col("f.attributes")
    acres, contained = F.coalesce(a["IncidentSize"], a["DiscoveryAcres"], F.lit(0.0)), F.coalesce(a["PercentContained"], F.lit(0.0))
    raw = F.to_json(F.struct(acres.alias("acres"), contained.alias("containment"), a["POOState"].alias("state"), a["POOCounty"].alias("county"), a["FireCause"].alias("cause")))
    return _rows(f, "wildfire", "wfigs", external_id=F.upper(F.regexp_replace(a["IrwinID"], "[{}]", "")), name=F.initcap(F.coalesce(a["IncidentName"], F.lit(""))), lat=F.col("f.geometry.y"), lon=F.col("f.geometry.x"), country=F.lit("US"), severity=air.fire_severity(acres, contained), started_at=air.from_millis(a["FireDiscoveryDateTime"]), raw=raw)


def perimeters(payloads: DataFrame) -> DataFrame:
    """external_id and geometry (GeoJSON text) of fire perimeters: polygons of bounded size only."""
    f = _features(payloads, "struct<properties:struct<attr_IrwinID:string,poly_DateCurrent:string>,geometry:struct<type:string,coordinates:string>>")
    shape = F.concat(F.lit('{"type":"'), F.col("f.geometry.type"), F.lit('","coordinates":'), F.col("f.geometry.coordinates"), F.lit("}"))
    out = f.filter(F.col("f.geometry.type").isin("Polygon", "MultiPolygon")).select(F.upper(F.regexp_replace("f.properties.attr_IrwinID", "[{}]", "")).alias("external_id"), shape.alias("geometry"), air.moment(F.col("f.properties.poly_DateCurrent")).alias("geometry_at"))
    w = Window.partitionBy("external_id").orderBy(F.desc_nulls_last("geometry_at"), "geometry")
    return out.filter((F.octet_length("geometry") <= MOST_SHAPE_BYTES) & (F.col("external_id") != "")).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def attach_perimeters(fires: DataFrame, shapes: DataFrame) -> DataFrame:
    """fires with the geometry of their perimeter where there is one; perimeters never add fires."""
    return fires.join(shapes, "external_id", "left")


def airnow(payloads: DataFrame) -> DataFrame:
    """Air stations: of each the pollutant with the highest index."""
    parsed = F.from_json("payload", "array<struct<Latitude:double,Longitude:double,AQI:double,Parameter:string,SiteName:string,AgencyName:string,FullAQSCode:string,UTC:string>>")
    s = payloads.select(F.posexplode(parsed).alias("arrival", "s")).filter("s.AQI >= 0")
    station = F.coalesce(F.nullif("s.FullAQSCode", F.lit("")), F.concat_ws(",", "s.Latitude", "s.Longitude"))
    s = worst_per_station(s.select(station.alias("station_id"), F.col("s.AQI").alias("aqi"), "arrival", "s"))
    raw = F.to_json(F.struct("aqi", F.col("s.Parameter").alias("pollutant"), F.col("s.AgencyName").alias("agency")))
    return _rows(s, "air_quality", "airnow", external_id=F.col("station_id"), name=F.coalesce("s.SiteName", F.lit("")), lat=F.col("s.Latitude"), lon=F.col("s.Longitude"), country=F.lit("US"), severity=air.severity(F.col("aqi")), started_at=F.try_to_timestamp("s.UTC").cast("timestamp_ntz"), raw=raw)


def openaq(locations: DataFrame, latest: DataFrame, drop_us: bool = False) -> DataFrame:
    """Readings joined with sensors; of each station the pollutant with the highest index.

    locations has the payloads of stations, latest (parameter, payload) those of readings.
    """
    parsed = F.from_json("payload", "struct<results:array<struct<id:long,name:string,country:struct<code:string>,coordinates:struct<latitude:double,longitude:double>,sensors:array<struct<id:long,parameter:struct<name:string,units:string>>>>>>")
    sensors = locations.select(F.explode(parsed["results"]).alias("l")).select("l.*", F.explode("l.sensors").alias("sensor"))
    sensors = sensors.select(F.col("id").cast("string").alias("station_id"), "name", F.col("country.code").alias("code"), "coordinates", F.col("sensor.id").alias("sensor_id"), F.col("sensor.parameter.units").alias("unit"))
    readings = F.from_json("payload", "struct<results:array<struct<sensorsId:long,value:double,datetime:struct<utc:string>>>>")
    r = latest.select("parameter", F.posexplode(readings["results"]).alias("arrival", "r")).select("parameter", "arrival", F.col("r.sensorsId").alias("sensor_id"), F.col("r.value").alias("value"), F.col("r.datetime.utc").alias("at"))
    s = sensors.join(r, "sensor_id").withColumn("aqi", air.aqi(F.col("parameter"), F.col("value"), F.col("unit"))).filter("aqi IS NOT NULL")
    if drop_us:
        s = s.filter("code IS NULL OR code <> 'US'")
    s = worst_per_station(s)
    return _rows(s, "air_quality", "openaq", external_id=F.col("station_id"), name=F.coalesce("name", F.lit("")), lat=F.col("coordinates.latitude"), lon=F.col("coordinates.longitude"), country=F.coalesce("code", F.lit("")), severity=air.severity(F.col("aqi")), started_at=F.try_to_timestamp("at").cast("timestamp_ntz"), raw=F.to_json(F.struct("aqi", F.col("parameter").alias("pollutant"))))


def purpleair(payloads: DataFrame) -> DataFrame:
    """Column-oriented sensor payloads: outdoor sensors of enough confidence, corrected, the worst of each box."""
    parsed = F.from_json("payload", "struct<fields:array<string>,data:array<array<string>>>")
    p = payloads.withColumn("box", F.monotonically_increasing_id()).select("box", parsed.alias("p")).select("box", "p.fields", F.explode("p.data").alias("row"))
    get = lambda name: F.get("row", F.array_position("fields", F.lit(name)).cast("int") - 1)
    s = p.select("box", get("sensor_index").alias("id"), get("name").alias("name"), get("latitude").cast("double").alias("lat"), get("longitude").cast("double").alias("lon"), get("pm2.5_cf_1").cast("double").alias("pm"), get("humidity").cast("double").alias("rh"), get("confidence").cast("double").alias("confidence"), get("location_type").alias("inside"), get("last_seen").cast("double").alias("seen"))
    s = s.filter((F.coalesce("confidence", F.lit(0.0)) >= LEAST_CONFIDENCE) & (F.coalesce("inside", F.lit("0")) != "1") & F.col("pm").isNotNull())
    s = s.withColumn("fine", air.corrected_pm25(F.col("pm"), F.col("rh"))).withColumn("aqi", air.aqi(F.lit("pm25"), F.col("fine"), F.lit("ug/m3")))
    w = Window.partitionBy("box").orderBy(F.desc("aqi"), "id")
    s = s.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= MOST_SENSORS)
    return _rows(s, "air_quality", "purpleair", external_id=F.col("id"), name=F.coalesce("name", F.lit("")), lat=F.col("lat"), lon=F.col("lon"), severity=air.severity(F.col("aqi")), started_at=air.from_millis(F.col("seen") * 1000), raw=F.to_json(F.struct("aqi", F.round("fine", 2).alias("pm25"))))


def gdacs(payloads: DataFrame) -> DataFrame:
    """Global disaster events: points of known kinds, but no fires of the US, which have their own provider."""
    f = _features(payloads, "struct<geometry:struct<type:string,coordinates:array<double>>,properties:struct<eventtype:string,eventid:string,alertlevel:string,iso3:string,name:string,fromdate:string,severitydata:struct<severity:double,severitytext:string>>>")
    p = F.col("f.properties")
    kind = _map(GDACS_KINDS, F.upper(p["eventtype"]))
    f = f.filter((F.col("f.geometry.type") == "Point") & kind.isNotNull() & ~((kind == "wildfire") & (F.coalesce(p["iso3"], F.lit("")) == "USA")))
    return _rows(f, kind, "gdacs", external_id=F.concat(F.upper(p["eventtype"]), F.lit(":"), p["eventid"]), name=F.coalesce(p["name"], F.lit("")), lat=F.col("f.geometry.coordinates")[1], lon=F.col("f.geometry.coordinates")[0], country=F.upper(F.substring(F.coalesce(p["iso3"], F.lit("")), 1, 2)), severity=F.coalesce(_map(GDACS_LEVELS, F.lower(F.trim(p["alertlevel"]))), F.lit(25)), started_at=F.try_to_timestamp(p["fromdate"]).cast("timestamp_ntz"), raw=F.to_json(p))


def usgs(payloads: DataFrame) -> DataFrame:
    """Earthquakes."""
    f = _features(payloads, "struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<mag:double,place:string,time:double,alert:string,tsunami:int,title:string>>")
    p = F.col("f.properties")
    raw = F.to_json(F.struct(p["mag"].alias("magnitude"), F.get("f.geometry.coordinates", F.lit(2)).alias("depth_km"), p["alert"].alias("pager"), p["tsunami"].alias("tsunami")))
    return _rows(f, "earthquake", "usgs", external_id=F.col("f.id"), name=F.coalesce(p["title"], p["place"], F.lit("")), lat=F.col("f.geometry.coordinates")[1], lon=F.col("f.geometry.coordinates")[0], severity=air.quake_severity(F.coalesce(p["mag"], F.lit(0.0)), p["alert"]), started_at=air.from_millis(p["time"]), raw=raw)


def nws(payloads: DataFrame) -> DataFrame:
    """Weather warnings with a polygon; the marker is the middle of its box."""
    f = _features(payloads, "struct<id:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<event:string,severity:string,urgency:string,certainty:string,areaDesc:string,effective:string,expires:string>>")
    f = f.filter("f.geometry.type = 'Polygon'").withColumn("points", F.flatten("f.geometry.coordinates"))
    p, at = F.col("f.properties"), lambda i: F.transform("points", lambda x: x[i])
    middle = lambda i: (F.array_min(at(i)) + F.array_max(at(i))) / 2
    return _rows(f, "severe_weather", "nws", external_id=F.col("f.id"), name=F.coalesce(p["event"], F.lit("")), lat=middle(1), lon=middle(0), country=F.lit("US"), severity=F.coalesce(_map(NWS_LEVELS, F.lower(F.trim(p["severity"]))), F.lit(45)), started_at=F.try_to_timestamp(p["effective"]).cast("timestamp_ntz"), raw=F.to_json(p))


def fan_out(answers: dict[str, DataFrame | None], may_be_empty: tuple[str, ...] = ("nws",)) -> tuple[DataFrame | None, list[str]]:
    """All rows of the providers that answered, and their names. None is no answer; no rows are a failure but for some."""
    rows, answered = None, []
    for name, df in answers.items():
        if df is None or (name not in may_be_empty and df.isEmpty()):
            continue
        answered.append(name)
        rows = df if rows is None else rows.unionByName(df)
    return rows, answered


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row for each JSON file under path."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")
