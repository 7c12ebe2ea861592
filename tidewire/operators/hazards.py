"""Hazards: upsert of polls, pruning, caps, alerts around places, air readings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import air, geo

#: Days that each kind survives its provider's silence, fixed values.
RETENTION_DAYS = {"wildfire": 7.0, "air_quality": 0.25, "earthquake": 1.0, "severe_weather": 0.5, "storm": 7.0, "flood": 7.0, "volcano": 7.0, "drought": 7.0}
MOST_PER_PROVIDER = 15_000
#: Preference of air providers, kilometres of an average and of a single station; fixed values.
AIR_RANK = {"airnow": 0, "openaq": 0, "purpleair": 1}
NEAR_KM, FAR_KM = 5.0, 100.0


def merge(stored: DataFrame, polled: DataFrame, at: Column) -> DataFrame:
    """The stored hazards after a poll, on (provider, external_id).

    status: added, updated or kept; escalated: new, or its alert bucket rose. A kept row stays as it is.
    """
    keys = ["provider", "external_id"]
    new = polled.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("severity"), "lat", "lon"))).filter("n = 1")
    s = stored.select(*keys, *[F.col(c).alias(f"s_{c}") for c in ("kind", "lat", "lon", "severity", "first_seen_at", "last_seen_at")], F.lit(True).alias("was"))
    p = new.select(*keys, *[F.col(c).alias(f"p_{c}") for c in ("kind", "lat", "lon", "severity")], F.lit(True).alias("now"))
    both = s.join(p, keys, "full_outer")
    pick = lambda c: F.coalesce(f"p_{c}", f"s_{c}").alias(c)
    rose = air.alert_bucket(F.col("p_severity"), F.col("p_kind")) > air.alert_bucket(F.col("s_severity"), F.col("p_kind"))
    return both.select(
        *keys, pick("kind"), pick("lat"), pick("lon"), pick("severity"),
        F.coalesce("s_first_seen_at", at).alias("first_seen_at"), F.when(F.col("now"), at).otherwise(F.col("s_last_seen_at")).alias("last_seen_at"),
        F.when(F.col("was").isNull(), "added").when(F.col("now"), "updated").otherwise("kept").alias("status"),
        F.coalesce(F.when(F.col("was").isNull(), F.lit(True)).when(F.col("now"), rose), F.lit(False)).alias("escalated"),
    )


def counters(merged: DataFrame) -> DataFrame:
    return merged.agg(
        F.count_if(F.col("status") != "kept").alias("seen"), F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "updated").alias("updated"), F.count_if("escalated").alias("escalated"),
    )


def pruned(hazards: DataFrame, answered: list[str], now: Column, expires: str | None = None) -> DataFrame:
    """What stays: rows of providers that didn't answer, and those seen within their kind's retention; expired rows go anyway."""
    days = F.lit(RETENTION_DAYS["wildfire"])
    for kind, n in RETENTION_DAYS.items():
        days = F.when(F.col("kind") == kind, n).otherwise(days)
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_seen_at").cast("timestamp"))) / 86400.0
    keep = ~F.col("provider").isin(*answered) | (age <= days)
    if expires:
        keep = keep & (F.col(expires).isNull() | (F.col(expires) >= now))
    return hazards.filter(keep)


def capped(hazards: DataFrame, most: int = MOST_PER_PROVIDER, id_column: str = "hazard_id") -> DataFrame:
    """The most severe, then latest, rows of each provider up to a cap that is part of the feature."""
    w = Window.partitionBy("provider").orderBy(F.desc("severity"), F.desc("last_seen_at"), id_column)
    return hazards.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("place")


def worst_per_station(readings: DataFrame) -> DataFrame:
    """Of a station's pollutants the one with the highest index; the first reading wins a tie."""
    w = Window.partitionBy("station_id").orderBy(F.desc("aqi"), "arrival")
    return readings.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


#: Kilometres of a degree of latitude, a little less than the truth, so that no cell is missed; finest and coarsest grid.
KM_PER_DEGREE, COARSEST, FINEST = 111.0, 2, 12


def _cell(degrees: Column, level: Column) -> Column:
    return F.floor(degrees * F.pow(F.lit(2.0), level) / 360.0).cast("int")


def within(locations: DataFrame, points: DataFrame, km: Column) -> DataFrame:
    """Pairs of locations and points at most km apart, with distance_km. Rows without a place or a distance have no pairs.

    A grid of level k has cells of 360 / 2^k degrees. Each location takes the finest grid whose cells are as
    high as its own distance, so its circle covers three rows of cells and as many columns as it spans there, around the
    date line and the poles. Points are dealt out to the few levels in use, and both sides meet by an equi-join on cells.
    """
    a = locations.withColumn("__km", km.cast("double")).filter("__km >= 0 AND lat IS NOT NULL AND lon IS NOT NULL")
    degrees = F.col("__km") / KM_PER_DEGREE
    level = F.greatest(F.lit(COARSEST), F.least(F.lit(FINEST), F.floor(F.log2(360.0 / F.greatest(degrees, F.lit(1e-3)))))).cast("int")
    a = a.withColumn("__level", level)
    # A circle's half-width in longitude; all the way round where it holds a pole.
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(degrees)) / F.cos(F.radians("lat")))))
    wide = F.when((F.abs("lat") + degrees >= 90) | (degrees >= 90), 180.0).otherwise(reach)
    columns = F.pow(F.lit(2.0), F.col("__level")).cast("int")
    west, east = _cell(F.col("lon") + 180 - wide, F.col("__level")), _cell(F.col("lon") + 180 + wide, F.col("__level"))
    cx = F.array_distinct(F.transform(F.sequence(west, F.least(east, west + columns - 1)), lambda x: F.pmod(x, columns)))
    cy = F.sequence(_cell(F.col("lat") - degrees, F.col("__level")), _cell(F.col("lat") + degrees, F.col("__level")))
    levels = sorted(r[0] for r in a.select("__level").distinct().collect())  # eleven at most
    a = a.withColumn("__cx", F.explode(cx)).withColumn("__cy", F.explode(cy))
    b = points.withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"}).filter("p_lat IS NOT NULL AND p_lon IS NOT NULL")
    b = b.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    side = F.pow(F.lit(2.0), F.col("__level")).cast("int")
    b = b.withColumns({"__cx": F.pmod(_cell(F.col("p_lon") + 180, F.col("__level")), side), "__cy": _cell(F.col("p_lat"), F.col("__level"))})
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    near = a.join(b, ["__level", "__cx", "__cy"]).withColumn("distance_km", d).filter(F.col("distance_km") <= F.col("__km"))
    return near.drop("__km", "__level", "__cx", "__cy")


def fire_ring(locations: DataFrame, fires: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Fires inside a location's ring that speak: no hit yet, or their alert bucket is above that of the hit."""
    found = within(locations, fires.filter("kind = 'wildfire'"), F.col("fire_km"))
    bucket = air.alert_bucket(F.col("severity"), F.lit("wildfire"))
    found = found.select("location_id", "hazard_id", F.round("distance_km", 3).alias("distance_km"), "severity", bucket.alias("bucket"))
    if hits is None:
        return found
    told = hits.select("location_id", "hazard_id", air.alert_bucket(F.col("severity_at_alert"), F.lit("wildfire")).alias("told"))
    return found.join(told, ["location_id", "hazard_id"], "left").filter(F.col("told").isNull() | (F.col("bucket") > F.col("told"))).drop("told")


def air_readings(locations: DataFrame, stations: DataFrame, near_km: float = NEAR_KM, far_km: float = FAR_KM) -> DataFrame:
    """The reading of each location: the average of the best provider's stations nearby, else the nearest station, else no row."""
    pairs = within(locations.select("location_id", "lat", "lon"), stations, F.lit(far_km))
    rank = F.lit(9)
    for name, n in AIR_RANK.items():
        rank = F.when(F.col("provider") == name, n).otherwise(rank)
    pairs = pairs.withColumn("rank", rank).withColumn("close", F.col("distance_km") <= near_km)
    order = F.struct("rank", "distance_km", "station_id", "provider")
    chosen = pairs.groupBy("location_id").agg(
        F.min(F.when(F.col("close"), order)).alias("near"), F.min_by("aqi", F.struct("distance_km", "station_id")).alias("far_aqi"),
        F.min_by("provider", F.struct("distance_km", "station_id")).alias("far_provider"),
    )
    mean = (
        pairs.filter("close").join(chosen.filter("near IS NOT NULL").select("location_id", F.col("near.provider").alias("provider")), ["location_id", "provider"])
        .groupBy("location_id").agg(F.bround(F.avg("aqi")).cast("int").alias("mean"), F.count("*").alias("n"))
    )
    reading = F.coalesce("mean", "far_aqi")
    return chosen.join(mean, "location_id", "left").select(
        "location_id", reading.alias("aqi"), F.coalesce("n", F.lit(1)).alias("stations"), F.coalesce("near.provider", "far_provider").alias("provider"), air.label(reading).alias("label")
    )


def watch_boxes(locations: DataFrame, cell: float = 0.05, most: int = 40) -> DataFrame:
    """One location for each grid cell, the first by id, up to a number of boxes in the order of cells."""
    grid = locations.withColumns({"cy": F.floor(F.col("lat") / cell), "cx": F.floor(F.col("lon") / cell)})
    w = Window.partitionBy("cy", "cx").orderBy("location_id")
    return grid.withColumn("n", F.row_number().over(w)).filter("n = 1").orderBy("cy", "cx").limit(most).select("location_id", "cy", "cx")


def since(now: datetime, hours: float) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
