"""Standing queries as data against one predicate for each; polygons by cells, and copies of headlines, against brute force."""

import json
import random
import re
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators import clusters, coverage, geofence
from tidewire.plans import percolate
from tidewire.plans.criteria import Criteria, predicate
from tidewire.streaming import alerts

NOW = datetime(2024, 1, 31)
SCHEMA = """id long, title string, summary string, content string, source_id int, name string, scope string, platform string, language string, country string,
published_at timestamp_ntz, importance int, event_id long, source_ids array<int>, article_count long, updated_at timestamp_ntz, categories array<string>,
places array<struct<name:string,country:string,lat:double,lon:double,kind:string>>, url string, translated string"""
BITS = ["quake", "Quakes", "town", "dead", "the", "größe", "地震", "東京で", "KELVIN", "ıstanbul", "prüfung", "oil", "oil-field", "foo_bar", "u.s.", "12", "день", "ДЕНЬ", "c++", "x", ".", "\n"]


def article(rng, i):
    some = lambda k: " ".join(rng.choice(BITS) for _ in range(rng.randrange(k)))
    known = rng.random() < 0.8
    place = [("Paris", "FR", 48.8, 2.3, "city")] if rng.random() < 0.3 else rng.choice([None, []])
    return (
        i, some(5), some(6), rng.choice([None, some(20)]), rng.randrange(4), "outlet 7" if known else None, rng.choice(["national", "local"]) if known else None, rng.choice([None, "", "reddit"]) if known else None,
        rng.choice(["en", "de", None]), rng.choice(["FR", "US", ""]), rng.choice([None, NOW - timedelta(hours=rng.randrange(200))]), rng.randrange(100), rng.choice([None, 1]), rng.choice([None, [1], [1, 2, 3]]), 2,
        NOW - timedelta(hours=rng.randrange(150)), rng.choice([None, [], ["politics"], ["sports", "world"]]), place, f"https://www.site{i % 3}.example.com/a", rng.choice([None, "einhorn town"]),
    )


ALERTS = [
    {"keywords": ["quake"]}, {"keywords": ["quake", "oil-field"], "passing_mentions": True}, {"keywords": ["地震"]}, {"keywords": ["größe"]}, {"keywords": ["kelvin", "istanbul"]}, {"keywords": ["c++", "u.s."]},
    {"query": "quake AND (town OR dead)"}, {"query": "town NOT quake", "passing_mentions": True}, {"query": "NOT quake"}, {"query": "qua* AND t?wn"}, {"query": "quake NEAR/2 town"}, {"query": "oil ONEAR/3 dead OR 地震 NEAR/4 東京"},
    {"query": "title:town -title:quake"}, {"query": 'site:site1.example.com OR source:"outlet 7"'}, {"query": "body:dead lede:town"}, {"query": '"the town"'}, {"queries": ["quake dead", "12"], "query": "(("}, {"query": "(("},
    {"keywords": ["день"], "exclude_keywords": ["quake", "the"]}, {"keywords": ["foo_bar"]}, {"keywords": ["einhorn"], "search_translations": True, "passing_mentions": True}, {"keywords": ["einhorn"], "passing_mentions": True},
    {"languages": ["de"], "min_importance": 60}, {"countries": ["FR"]}, {"categories": ["sports", "politics"]}, {"scopes": ["national"]}, {"platforms": ["news"]}, {"platforms": ["reddit"], "keywords": ["town"]}, {"source_ids": [1, 2]},
    {"hours": 50}, {"hours": 20.5, "keywords": ["the"]}, {"min_sources": 2}, {"hide_stale": True, "stale_hours": 40}, {"keywords": ["quake", "town"], "min_mentions": 3}, {},
    {"geo": {"type": "Circle", "center": [48.8, 2.3], "radius_km": 50}}, {"geos": [{"name": "town", "country": "US"}, {"name": "x", "geometry": {"type": "Polygon", "coordinates": [[[0, 45], [5, 45], [5, 50], [0, 50], [0, 45]], [[1, 46], [2, 46], [2, 47], [1, 46]]]}}]},
]


def test_alerts_equal_their_predicates(spark):
    rng = random.Random(41)
    rows = [article(rng, i) for i in range(250)]
    rows.append(rows[0])  # a repeated row is tested like any other
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    criteria = {k: Criteria.from_json(raw) for k, raw in enumerate(ALERTS)}
    centroids = {"FR": (48.8, 2.3), "US": (40.0, -100.0)}
    got = alerts.evaluate(d, criteria, NOW, centroids).select("alert_id", "id").collect()
    each = F.filter(F.array(*[F.when(predicate(c, d.columns, NOW, centroids), F.lit(k)) for k, c in criteria.items()]), lambda x: x.isNotNull())
    want = d.select("id", F.explode(each).alias("alert_id")).collect()
    pairs = lambda found: sorted((r.alert_id, r.id) for r in found)
    for k, raw in enumerate(ALERTS):
        assert [p for p in pairs(got) if p[0] == k] == [p for p in pairs(want) if p[0] == k], raw
    assert {r.alert_id for r in got} >= set(range(len(ALERTS))) - {5, 17, 21}


def test_what_an_alert_lets_pass(spark):
    """Without a date all days are right; without a source no platform is."""
    row = article(random.Random(1), 1)
    rows = [(*row[:5], None, None, None, *row[8:10], None, *row[11:])]
    d = spark.createDataFrame(rows, SCHEMA)
    found = alerts.evaluate(d, {1: Criteria(date_from="2024-01-05", date_to="2024-01-06"), 2: Criteria(platforms=("news",)), 3: Criteria(hours=3)}, NOW)
    assert sorted(r.alert_id for r in found.collect()) == [1, 3]
    assert d.filter(predicate(Criteria(platforms=("news",)), d.columns, NOW)).count() == 0


def test_the_plan_does_not_grow_with_the_alerts(spark):
    d = spark.createDataFrame([article(random.Random(2), i) for i in range(20)], SCHEMA)

    def size(n):
        table = spark.range(n).select(F.col("id").alias("alert_id"), F.concat(F.lit('{"query": "quake AND w'), F.col("id").cast("string"), F.lit(' NOT town"}')).alias("criteria"))
        return len(re.sub(r"[#_]\d+L?|[0-9a-f]{32}", "", percolate.matched(d, percolate.compiled(table), NOW)._jdf.queryExecution().optimizedPlan().toString()))

    assert abs(size(10) - size(3000)) < 200


def test_the_longest_necessary_word_is_looked_up():
    tokens = lambda **raw: percolate.program(1, Criteria.from_json(json.dumps(raw)))["tokens"]
    assert tokens(query="a AND earthquake NOT the") == ["earthquake"] and tokens(query="quake OR 地震") == ["quake", "震"]
    assert tokens(query="NOT quake", languages=["de"]) == ["language:de"] and tokens(query="qua*") == ["*"] and tokens(query='"qua* town"') == ["town"]
    assert tokens(keywords=["one", "two three"], query="longest") == ["longest"] and tokens(query="site:x.com") == ["*"]


# Polygons


def crossed(lat, lon, ring):
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            n += 1
    return n % 2 == 1


def test_polygons_equal_brute_force(spark):
    rng = random.Random(42)
    fences = []
    for k in range(60):
        x, y, r = rng.uniform(-185, 185), rng.uniform(-88, 88), rng.choice([0.001, 0.5, 4, 30])
        if k % 10 == 0:
            x, y = rng.choice([179.5, -179.5]), rng.choice([80.0, 0.0])
        box = lambda s: [(x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s)]
        star = [(x + rng.uniform(0.2, 1) * r * a, y + rng.uniform(0.2, 1) * r * b) for a, b in ((-1, 0), (-0.7, -0.7), (0, -1), (0.7, -0.7), (1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7))]
        rings = [box(r), box(r / 3)] if k % 3 == 0 else [star]
        fences.append((k, [rings, [[(x + 2 * r, y), (x + 3 * r, y), (x + 2 * r, y + r)]]] if k % 4 == 0 else [rings]))
    fences += [(60, [[[(-180.0, 70.0), (180.0, 70.0), (180.0, 90.0), (-180.0, 90.0)]]]), (61, []), (62, None)]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(400)]
    for k, polygons in fences[:60]:
        x, y = polygons[0][0][rng.randrange(len(polygons[0][0]))]
        points.append((1000 + k, max(-90.0, min(90.0, y + rng.uniform(-0.2, 0.2))), (x + rng.uniform(-0.2, 0.2) + 180) % 360 - 180))
    points += [(2000, None, 1.0), (2001, 1.0, None), (2002, 90.0, 180.0), (2003, -90.0, -180.0)]
    got = geofence.join(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(fences, f"fence_id long, polygons {geofence.SHAPE}"))
    want = set()
    for k, polygons in fences:
        for i, lat, lon in points:
            if lat is None or lon is None:
                continue
            for turn in (0, 360, -360):
                moved = [[[(x - turn, y) for x, y in ring] for ring in rings] for rings in polygons or []]
                if turn and not any((x > 180) if turn > 0 else (x < -180) for rings in polygons or [] for ring in rings for x, _ in ring):
                    continue
                if any(crossed(lat, lon, rings[0]) and not any(crossed(lat, lon, h) for h in rings[1:]) for rings in moved):
                    want.add((k, i))
    found = [(r.fence_id, r.id) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 60


def test_points_at_shared_places(spark):
    """Many points at few places, repeated rows and -0.0 included, give each of them its fences."""
    square = lambda x, y, r: [[[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]]]
    fences = [(1, square(0.0, 0.0, 3.0)), (2, square(1.0, 1.0, 1.5)), (3, square(50.0, 50.0, 1.0)), (4, None), (5, [[]]), (6, [[[]]])]
    points = [(i, (0.0, -0.0, 2.0, None)[i % 4], 0.25 * (i % 2)) for i in range(200)]
    points += points[:9]
    got = geofence.join(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(fences, f"fence_id long, polygons {geofence.SHAPE}"))
    want = [(i, k) for i, lat, lon in points for k, polygons in fences[:3] if lat is not None and crossed(lat, lon, polygons[0][0])]
    assert got.columns == ["id", "lat", "lon", "fence_id"]
    assert sorted((r.id, r.fence_id) for r in got.collect()) == sorted(want)


def test_many_fences_are_covered_in_time(spark):
    """Covers are worked out batch by batch: 8 ms of a core for each fence, as once, would take 40 s on four cores."""
    k = F.col("id")
    corner = lambda a, b: F.struct((k % 300 - 150 + a).cast("double").alias("x"), (k % 140 - 70 + b).cast("double").alias("y"))
    ring = F.array(*[corner(a, b) for a, b in ((-2.0, 0.0), (-1.0, -1.7), (1.0, -1.7), (2.0, 0.1), (1.0, 1.7), (-1.0, 1.7))])
    fences = spark.range(20_000).repartition(4).select(k.alias("fence_id"), geofence.edged(F.array(F.array(ring))).alias("polygons"))
    began = time.monotonic()
    sides = geofence.cover(fences).groupBy("fence_id").agg(F.count_if("inside").alias("whole"), F.count_if(~F.col("inside")).alias("border"))
    assert sides.filter("whole > 0 AND border > 0").count() == 20_000
    assert time.monotonic() - began < 20


# Copies of headlines


def headlines(rng, n):
    words = ["quake", "town", "dead", "oil", "fire", "vote", "rain"]
    return [(i, rng.choice([None, 1, 2, 3, 4]), rng.choice([None, *[datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000)) for _ in range(9)]]), sorted(rng.sample(words, rng.choice([0, 1, 2, 2, 3, 3])))) for i in range(n)]


def alike(a, b, least=1):
    both = len(set(a) & set(b))
    return bool(a and b) and both >= least and both / min(len(a), len(b)) >= 0.5


def test_corroboration_with_copies_by_brute_force(spark):
    rows = headlines(random.Random(43), 300)
    d = spark.createDataFrame(rows, "id long, source_id int, published_at timestamp_ntz, tokens array<string>")
    for hours, earlier in ((12, None), (3, d.filter("id % 2 = 0"))):
        got = {r.id: r.corroborating for r in coverage.corroboration(d, hours=hours, earlier=earlier).collect()}
        for i, room, at, tokens in rows:
            others = {r for j, r, t, w in rows if (earlier is None or j % 2 == 0) and None not in (at, t, room, r) and r != room and at - timedelta(hours=hours) <= t <= at and alike(tokens, w)}
            assert got[i] == len(others), (i, hours)


def test_linked_events_with_copies_by_brute_force(spark):
    rows = headlines(random.Random(44), 150)
    d = spark.createDataFrame(rows, "id long, source_id int, published_at timestamp_ntz, tokens array<string>")
    got = {r.id: r.event for r in clusters.linked(d, 4).collect()}
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i, _, t, a in rows:
            for j, _, u, b in rows:
                if i < j and None not in (t, u) and abs(t - u) <= timedelta(hours=4) and alike(a, b, 2):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == label


def test_copies_cost_no_pairs(spark):
    n = 30_000
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 13 % 43_000).cast("int"))
    d = spark.range(n).select("id", (F.col("id") % 7).cast("int").alias("source_id"), at.alias("published_at"), F.array(F.lit("dead"), F.lit("quake"), F.lit("town")).alias("tokens"))
    assert [(r.corroborating, r["count"] > n * 0.99) for r in coverage.corroboration(d).groupBy("corroborating").count().orderBy(F.desc("count")).limit(1).collect()] == [(6, True)]
    assert clusters.linked(d).select("event").distinct().count() == 1
    pairs, members, _ = coverage.similar_classes(d, d)
    assert pairs.count() == 1 and members.count() == n
