"""Distances and areas on the globe as Spark expressions. GeoJSON points are (lon, lat), circles (lat, lon)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points; the arcsine's argument is held to 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_ring(lat: Column, lon: Column, ring: list) -> Column:
    """Ray casting over the edges of a literal ring: an odd number of crossings is inside."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)
        edge = F.lit(float(x2 - x1)) * (lat - F.lit(float(y1))) / F.lit(float(y2 - y1)) + F.lit(float(x1))
        crossings = crossings + (spans & (lon < edge)).cast("int")
    return crossings % 2 == 1


def in_polygon(lat: Column, lon: Column, rings: list) -> Column:
    out = in_ring(lat, lon, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(lat, lon, hole)
    return out


def inside(lat: Column, lon: Column, shape: dict) -> Column:
    """Whether a point is in a GeoJSON shape, feature, collection or circle."""
    kind = (shape or {}).get("type")
    if kind == "Feature":
        return inside(lat, lon, shape["geometry"])
    if kind in ("FeatureCollection", "GeometryCollection"):
        out = F.lit(False)
        for part in shape.get("features") or shape.get("geometries") or []:
            out = out | inside(lat, lon, part)
        return out
    if kind == "Circle":
        y, x = shape.get("center") or shape["coordinates"]
        return haversine(lat, lon, F.lit(float(y)), F.lit(float(x))) <= F.lit(float(shape["radius_km"]))
    if kind == "Polygon":
        return in_polygon(lat, lon, shape["coordinates"])
    if kind == "MultiPolygon":
        out = F.lit(False)
        for rings in shape["coordinates"]:
            out = out | in_polygon(lat, lon, rings)
        return out
    return F.lit(False)


def parts_of(shape: dict) -> list[dict]:
    """The circles and polygons of a shape as rows: lat, lon and km of a circle, the edges of a polygon's rings (level ones never cross)."""
    kind = (shape or {}).get("type")
    if kind == "Feature":
        return parts_of(shape["geometry"])
    if kind in ("FeatureCollection", "GeometryCollection"):
        return [p for part in shape.get("features") or shape.get("geometries") or [] for p in parts_of(part)]
    if kind == "Circle":
        y, x = shape.get("center") or shape["coordinates"]
        return [{"lat": float(y), "lon": float(x), "km": float(shape["radius_km"]), "rings": []}]
    polygons = [shape["coordinates"]] if kind == "Polygon" else shape["coordinates"] if kind == "MultiPolygon" else []
    edges = lambda ring: [{"x1": float(a[0]), "y1": float(a[1]), "x2": float(b[0]), "y2": float(b[1])} for a, b in zip(ring, [*ring[1:], ring[0]]) if a[1] != b[1]]
    return [{"lat": None, "lon": None, "km": None, "rings": [edges(r) for r in rings]} for rings in polygons]


def in_edges(lat: Column, lon: Column, edges: Column) -> Column:
    """As ``in_ring``, over a column of edges."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e).cast("int")) % 2 == 1


def in_parts(lat: Column, lon: Column, parts: Column) -> Column:
    """Whether a point is in one of the parts that ``parts_of`` gives."""

    def one(p: Column) -> Column:
        outer = F.coalesce(in_edges(lat, lon, F.get(p["rings"], F.lit(0))), F.lit(False))
        holes = F.filter(p["rings"], lambda r, i: (i > 0) & in_edges(lat, lon, r))
        return F.when(p["km"].isNotNull(), haversine(lat, lon, p["lat"], p["lon"]) <= p["km"]).otherwise(outer & (F.size(holes) == 0))

    return F.coalesce(F.exists(parts, one), F.lit(False))


def places_in_parts(parts: Column, centroids: dict[str, tuple[float, float]]) -> Column:
    """As ``places_inside``, over a column of parts."""
    any_place = F.coalesce(F.exists("places", lambda p: in_parts(p["lat"], p["lon"], parts)), F.lit(False))
    if not centroids:
        return any_place
    points = F.create_map(*[x for k, (y, z) in centroids.items() for x in (F.lit(k), F.struct(F.lit(float(y)).alias("lat"), F.lit(float(z)).alias("lon")))])
    at = F.element_at(points, F.col("country"))
    return F.when(F.coalesce(F.size("places"), F.lit(0)) <= 0, in_parts(at["lat"], at["lon"], parts)).otherwise(any_place)


def points_of(shape: dict) -> list:
    """All (lon, lat) of a shape's rings."""
    kind = (shape or {}).get("type")
    if kind == "Feature":
        return points_of(shape["geometry"])
    if kind in ("FeatureCollection", "GeometryCollection"):
        return [p for part in shape.get("features") or shape.get("geometries") or [] for p in points_of(part)]
    if kind == "Polygon":
        return [p for ring in shape["coordinates"] for p in ring]
    if kind == "MultiPolygon":
        return [p for rings in shape["coordinates"] for ring in rings for p in ring]
    return []


def nearest_vertex_km(lat: Column, lon: Column, shape: dict) -> Column:
    """0 inside, else kilometres to the nearest vertex, null without a ring."""
    points = points_of(shape)
    if not points:
        return F.lit(None).cast("double")
    each = [haversine(lat, lon, F.lit(float(y)), F.lit(float(x))) for x, y, *_ in points]
    return F.when(inside(lat, lon, shape), 0.0).otherwise(F.array_min(F.array(*each)))


def box_centre(shape: dict) -> tuple[float, float] | None:
    """(lat, lon) of the middle of a shape's bounding box."""
    points = points_of(shape)
    if not points:
        return None
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return (min(ys) + max(ys)) / 2, (min(xs) + max(xs)) / 2


def places_inside(shape: dict, centroids: dict[str, tuple[float, float]]) -> Column:
    """Whether any of ``places`` is inside; an article without places stands at its country's centroid."""
    any_place = F.coalesce(F.exists("places", lambda p: inside(p["lat"], p["lon"], shape)), F.lit(False))
    if not centroids:
        return any_place
    points = F.create_map(*[x for k, (y, z) in centroids.items() for x in (F.lit(k), F.struct(F.lit(float(y)).alias("lat"), F.lit(float(z)).alias("lon")))])
    at = F.element_at(points, F.col("country"))
    empty = F.coalesce(F.size("places"), F.lit(0)) <= 0
    return F.when(empty, F.coalesce(inside(at["lat"], at["lon"], shape), F.lit(False))).otherwise(any_place)


def box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    """Between the sides of a box, held to the globe and turned round if inverted."""
    held = lambda v, most: max(-most, min(most, float(v)))
    y, x = sorted((held(south, 90), held(north, 90))), sorted((held(west, 180), held(east, 180)))
    return lat.between(*y) & lon.between(*x)
