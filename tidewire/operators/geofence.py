"""Points in polygons as an equi-join: polygons are covered by cells of a quadtree of latitudes and longitudes.

A polygon starts with the cells of its bounding box, 5 by 5 at most, at a level that fits its size. Cells that no edge touches are inside or outside
as a whole, told by one of their points; the others are split in four, ``SPLITS`` times. Points meet the cells of all levels in use by an equi-join:
an inside cell accepts them, in a border cell the polygon's edges are asked. So a pair costs work only where a point is near a
polygon, however many of either there are.

Polygons are planar, in degrees, as ``functions.geo.inside`` reads them: a point is in a polygon if a ray crosses the first ring an odd number of times and no
hole; with wrap, a polygon that reaches beyond the date line also holds the points on its other side. Nulls: a point
without latitude or longitude is in nothing, and so is a fence without rings. Repeated rows give repeated pairs of points, but a fence_id is one fence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from .lineage import cut_lineage

SPLITS, WIDEST, DEEPEST = 2, 256.0, 28
#: What a cell is to a fence.
OUTSIDE, INSIDE, BORDER = 0, 1, 2
#: Fences, and cells by edges, that a worker covers at a time, about.
FENCES, PAIRS = 2000, 1 << 20
CELL = ["fence_id", "level", "cx", "cy", "inside"]
#: Fences of one task.
DEALT = 5000
#: Points for each place from which on a place is looked up once for all of its points.
SHARED = 4
#: polygons -> rings -> points
SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def _edges(ring: Column) -> Column:
    """The edges of a ring, closed if it isn't."""
    return F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, (i + 1) % F.size(ring))["x"].alias("x2"), F.get(ring, (i + 1) % F.size(ring))["y"].alias("y2")))


def _crossed(lat: Column, lon: Column, edges: Column) -> Column:
    crosses = lambda e: F.coalesce(((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]), F.lit(False))
    return F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e).cast("int")) % 2 == 1


def edged(polygons: Column) -> Column:
    """Polygons by the edges of their rings."""
    return F.transform(polygons, lambda rings: F.transform(rings, _edges))


def holds(lat: Column, lon: Column, polygons: Column) -> Column:
    """Whether a point is in one of the polygons, which are ``edged``."""
    one = lambda rings: F.coalesce(_crossed(lat, lon, F.get(rings, F.lit(0))), F.lit(False)) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: _crossed(lat, lon, r))
    return F.exists(polygons, one)


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(WIDEST) / F.pow(F.lit(2.0), level)))


class _Shapes:
    """The edges of a batch of fences, flat, with the ring, polygon and fence of each."""

    def __init__(self, polygons: pa.ListArray):
        rings = polygons.flatten().flatten()
        count = lambda listed: listed.value_lengths().to_numpy(zero_copy_only=False)
        per_fence, per_polygon, per_ring = count(polygons), count(polygons.flatten()), count(rings)
        ring = np.repeat(np.arange(len(rings)), per_ring)
        first = np.zeros(len(rings), bool)  # the first ring of its polygon
        first[(np.cumsum(per_polygon) - per_polygon)[per_polygon > 0]] = True
        self.polygon = np.repeat(np.arange(len(per_polygon)), per_polygon)[ring]
        self.ring, self.outer = ring, first[ring]
        fence = np.repeat(np.arange(len(per_fence)), per_fence)[self.polygon]
        self.count = np.bincount(fence, minlength=len(per_fence))
        self.start = np.cumsum(self.count) - self.count
        # Nulls are NaN here, of which no comparison holds.
        self.x1, self.y1, self.x2, self.y2 = (c.to_numpy(zero_copy_only=False).astype(float) for c in rings.flatten().flatten())

    def told(self, fence: np.ndarray, step: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        """OUTSIDE, INSIDE or BORDER (an edge touches it, or nearly so) of each cell, about PAIRS cells by edges at a time."""
        blocks = np.cumsum(self.count[fence]) // PAIRS
        ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(fence)]
        return np.concatenate([self._told(fence[i:j], step[i:j], cx[i:j], cy[i:j]) for i, j in zip(ends, ends[1:])])

    def _told(self, fence: np.ndarray, step: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        n, count = len(fence), self.count[fence]
        cell = np.repeat(np.arange(n), count)
        e = np.arange(len(cell)) + np.repeat(self.start[fence] - (np.cumsum(count) - count), count)
        x1, y1, x2, y2 = self.x1[e], self.y1[e], self.x2[e], self.y2[e]
        slack = step * 1e-6
        left, low = (cx * step - slack)[cell], (cy * step - slack)[cell]
        right, high = left + (step + 2 * slack)[cell], low + (step + 2 * slack)[cell]
        apart = (np.fmax(x1, x2) < left) | (np.fmin(x1, x2) > right) | (np.fmax(y1, y2) < low) | (np.fmin(y1, y2) > high)
        side = lambda x, y: np.sign((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1))
        touched = ~apart & (np.abs(side(left, low) + side(left, high) + side(right, low) + side(right, high)) < 4)
        lat, lon = ((cy + 0.5) * step)[cell], ((cx + 0.5) * step)[cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)

        def runs(*keys: np.ndarray) -> np.ndarray:
            """Where a run of equal keys begins."""
            changes = np.zeros(len(keys[0]), bool)
            changes[:1] = True
            for k in keys:
                changes[1:] |= k[1:] != k[:-1]
            return np.flatnonzero(changes)

        state = np.zeros(n, np.int8)
        if len(e):
            at = runs(cell, self.ring[e])  # edges lie by cell, polygon and ring
            odd, outer, polygon, owner = np.add.reduceat(crosses.astype(np.int64), at) % 2 == 1, self.outer[e][at], self.polygon[e][at], cell[at]
            to = runs(owner, polygon)
            held = np.logical_or.reduceat(odd & outer, to) & ~np.logical_or.reduceat(odd & ~outer, to)
            state[owner[to][held]] = INSIDE
            state[cell[touched]] = BORDER
        return state


def _covered(batches):
    """Batches (fence_id, polygons, level, x0, x1, y0, y1: the first and last cells of the bounding box) as cells."""
    for batch in (b.slice(i, FENCES) for b in batches for i in range(0, b.num_rows, FENCES)):
        shapes = _Shapes(batch.column("polygons"))
        level, x0, x1, y0, y1 = (batch.column(c).to_numpy().astype(np.int64) for c in ("level", "x0", "x1", "y0", "y1"))
        wide, many = x1 - x0 + 1, (x1 - x0 + 1) * (y1 - y0 + 1)
        fence = np.repeat(np.arange(len(level)), many)
        k = np.arange(len(fence)) - np.repeat(np.cumsum(many) - many, many)
        level, cx, cy = level[fence], x0[fence] + k % wide[fence], y0[fence] + k // wide[fence]
        for turn in range(SPLITS + 1):
            state = shapes.told(fence, WIDEST / 2.0**level, cx, cy)
            border = state == BORDER
            kept = state != OUTSIDE if turn == SPLITS else state == INSIDE
            yield pa.RecordBatch.from_arrays([batch.column("fence_id").take(pa.array(fence[kept])), pa.array(level[kept], pa.int32()), pa.array(cx[kept]), pa.array(cy[kept]), pa.array(state[kept] == INSIDE)], CELL)
            quarter = np.tile(np.arange(4), border.sum())
            fence, level, cx, cy = (np.repeat(v[border], 4) for v in (fence, level, cx, cy))
            level, cx, cy = level + 1, 2 * cx + quarter // 2, 2 * cy + quarter % 2


def cover(fences: DataFrame) -> DataFrame:
    """fence_id, level, cx, cy and inside of the cells that cover each fence (fence_id, polygons ``edged``)."""
    ship(fences.sparkSession)
    points = F.flatten(F.flatten("polygons"))
    xs, ys = F.transform(points, lambda p: p["x1"]), F.transform(points, lambda p: p["y1"])
    ends = {"lowx": F.array_min(xs), "highx": F.array_max(xs), "lowy": F.array_min(ys), "highy": F.array_max(ys)}
    rows = fences.withColumns(ends).filter("lowx IS NOT NULL AND lowy IS NOT NULL")
    span = F.greatest(F.col("highx") - F.col("lowx"), F.col("highy") - F.col("lowy"), F.lit(1e-6))
    rows = rows.withColumn("level", F.least(F.greatest(F.floor(F.log2(4 * WIDEST / span)), F.lit(0)), F.lit(DEEPEST)).cast("int"))
    first = {"x0": "lowx", "x1": "highx", "y0": "lowy", "y1": "highy"}
    rows = rows.select("fence_id", "polygons", "level", *[_cell(F.col(c), F.col("level")).alias(name) for name, c in first.items()])
    kind = fences.select("fence_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(_covered, f"fence_id {kind}, level int, cx bigint, cy bigint, inside boolean")


def _shifted(polygons: Column, by: float) -> Column:
    move = lambda p: F.struct((p["x"] + by).alias("x"), p["y"].alias("y"))
    return F.transform(polygons, lambda rings: F.transform(rings, lambda ring: F.transform(ring, move)))


def _wrapped(fences: DataFrame) -> DataFrame:
    """Fences and, of those that reach beyond the date line, what is there on its other side."""
    beyond = lambda test: F.exists(F.flatten(F.flatten("polygons")), test)
    parts = [fences, fences.filter(beyond(lambda p: p["x"] > 180)).withColumn("polygons", _shifted(F.col("polygons"), -360.0)), fences.filter(beyond(lambda p: p["x"] < -180)).withColumn("polygons", _shifted(F.col("polygons"), 360.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def join(points: DataFrame, fences: DataFrame, wrap: bool = True) -> DataFrame:
    """The columns of points (lat, lon, ...) with fence_id of each fence (fence_id, polygons: SHAPE) that holds them."""
    sides = fences.select("fence_id", F.col("polygons").cast(SHAPE).alias("polygons"))
    # Small files of small polygons can be much work, so their number deals them out, not their bytes.
    tasks = max(fences.sparkSession.sparkContext.defaultParallelism, -(-fences.count() // DEALT))
    sides = ((_wrapped(sides) if wrap else sides).repartition(tasks).withColumnRenamed("fence_id", "fence").withColumn("fence_id", F.struct("fence", F.monotonically_increasing_id().alias("part"))))
    sides = cut_lineage(sides.withColumn("polygons", edged(F.col("polygons"))))
    cells = cut_lineage(cover(sides))
    levels = [r[0] for r in cells.select("level").distinct().orderBy("level").collect()]  # DEEPEST + SPLITS at most
    known = points.filter("lat IS NOT NULL AND lon IS NOT NULL")
    # Points at one place are in the same fences.
    places = known.select("lat", "lon").distinct()
    shared = known.count() >= SHARED * places.count()
    asked = places if shared else known
    columns = asked.columns
    at = [F.struct(F.lit(k).alias("level"), _cell(F.col("lon"), F.lit(k)).alias("cx"), _cell(F.col("lat"), F.lit(k)).alias("cy")) for k in levels]
    asked = asked.withColumn("__at", F.explode(F.array(*at) if at else F.array().cast("array<struct<level:int,cx:bigint,cy:bigint>>")))
    met = asked.select(*columns, "__at.*").join(cells, ["level", "cx", "cy"]).select(*columns, "fence_id", "inside")
    sure = met.filter("inside").select(*columns, F.col("fence_id.fence").alias("fence_id"))
    near = met.filter("NOT inside").join(sides.select("fence_id", "polygons"), "fence_id").filter(holds(F.col("lat"), F.col("lon"), F.col("polygons")))
    found = sure.unionByName(near.select(*columns, F.col("fence_id.fence").alias("fence_id")))
    return known.join(found, ["lat", "lon"]).select(*points.columns, "fence_id") if shared else found
