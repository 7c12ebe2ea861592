import json
import zipfile
from datetime import datetime
from io import BytesIO

from pyspark.sql import functions as F

from tidewire.operators import hazards as H
from tidewire.operators import ops
from tidewire.sources import gazetteer, html, providers, sinks


def payload(spark, *values):
    return spark.createDataFrame([(json.dumps(v),) for v in values], "payload string")


def test_providers(spark):
    fires = providers.wfigs(payload(spark, {"features": [{"attributes": {"IrwinID": "{ab-1}", "IncidentName": "BIG", "IncidentSize": 60000, "PercentContained": 50, "FireDiscoveryDateTime": 1.7e12}, "geometry": {"x": -120.5, "y": 40.1}}, {"attributes": {"IrwinID": None}, "geometry": {"x": 1, "y": 2}}]}))
    assert [(r.external_id, r.name, r.severity) for r in fires.collect()] == [("AB-1", "Big", 59)]
    shapes = providers.perimeters(payload(spark, {"features": [{"properties": {"attr_IrwinID": "{ab-1}", "poly_DateCurrent": 1.7e12}, "geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6], [1, 2]]]}}]}))
    assert json.loads(providers.attach_perimeters(fires, shapes).first().geometry)["coordinates"][0][0] == [1, 2]
    station = {"Latitude": 1.0, "Longitude": 2.0, "SiteName": "A", "FullAQSCode": "x", "UTC": "2024-01-01T00:00"}
    air = providers.airnow(payload(spark, [station | {"AQI": 50, "Parameter": "PM2.5"}, station | {"AQI": 120, "Parameter": "O3"}, station | {"AQI": 120, "Parameter": "NO2"}]))
    assert [(r.severity, json.loads(r.raw)["pollutant"]) for r in air.collect()] == [(45, "O3")]
    places = {"results": [{"id": 7, "name": "L", "country": {"code": "IN"}, "coordinates": {"latitude": 1.5, "longitude": 2.5}, "sensors": [{"id": 70, "parameter": {"name": "pm25", "units": "µg/m³"}}]}]}
    latest = spark.createDataFrame([("pm25", json.dumps({"results": [{"sensorsId": 70, "value": 40.0}, {"sensorsId": 99, "value": 4.0}]}))], "parameter string, payload string")
    assert [(r.external_id, json.loads(r.raw)["aqi"]) for r in providers.openaq(payload(spark, places), latest).collect()] == [("7", 112)]
    fields = ["sensor_index", "latitude", "longitude", "pm2.5_cf_1", "humidity", "confidence", "location_type", "last_seen"]
    assert [r.external_id for r in providers.purpleair(payload(spark, {"fields": fields, "data": [[1, 1.0, 2.0, 60.0, 40, 90, 0, 1.7e9], [2, 1.0, 2.0, 60.0, 40, 50, 0, 1.7e9], [3, 1.0, 2.0, 60.0, 40, 90, 1, 1.7e9]]})).collect()] == ["1"]
    point = lambda **p: {"geometry": {"type": "Point", "coordinates": [10, 20]}, "properties": p}
    events = providers.gdacs(payload(spark, {"features": [point(eventtype="TC", eventid=5, alertlevel="Orange", iso3="PHL"), point(eventtype="WF", eventid=6, iso3="USA"), point(eventtype="ZZ", eventid=7)]}))
    assert [(r.external_id, r.kind, r.severity, r.lat) for r in events.collect()] == [("TC:5", "storm", 60, 20.0)]
    quakes = providers.usgs(payload(spark, {"features": [{"id": "u1", "geometry": {"coordinates": [10, 20, 30]}, "properties": {"mag": 6.1, "title": "M6", "time": 1.7e12}}]}))
    warnings = providers.nws(payload(spark, {"features": [{"id": "n1", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 4], [0, 0]]]}, "properties": {"event": "Flood", "severity": "Severe"}}, {"id": "n2", "properties": {}}]}))
    assert (warnings.first().lat, warnings.first().lon, warnings.first().severity) == (2.0, 1.0, 70)
    rows, answered = providers.fan_out({"usgs": quakes, "gdacs": None, "wfigs": fires.limit(0), "nws": warnings.limit(0)})
    assert answered == ["usgs", "nws"] and rows.count() == 1


def test_html():
    page = "<body><nav><p>menu</p></nav><p>First <a href=x>link</a> here<p>Second<ul><li><a href=y>only link</a><li>item</ul><p>We use cookies</p></body>"
    assert html.extract(page) == "First link here Second item"
    assert html.extract(None) == "" and html.extract("<p>unclosed <b>text") == "unclosed text"
    assert html.extract("<div>a block of more than ten words that is not a paragraph at all</div>").startswith("a block")


def test_places(spark):
    places = [
        {"name": "France", "country": "FR", "lat": 46.0, "lon": 2.0, "aliases": [], "kind": "country"},
        {"name": "United States", "country": "US", "lat": 38.0, "lon": -97.0, "aliases": ["US"], "kind": "country"},
        {"name": "Tokyo", "country": "JP", "lat": 35.7, "lon": 139.7, "aliases": ["東京"], "kind": "city"},
    ]
    df = spark.createDataFrame([(1, "give us tokyo and FRANCE"), (2, "東京で地震 US"), (3, None)], "id int, text string")
    got = {r.id: [p.name for p in r.places] for r in gazetteer.with_places(df, places).collect()}
    assert got == {1: ["France", "Tokyo"], 2: ["United States", "Tokyo"], 3: []}
    assert [p["name"] for p in gazetteer.search_places(places, "to")] == ["Tokyo"]


def test_exports(spark):
    df = spark.createDataFrame([(1, "a\x01b", "n", "u", "US", "en", 5, datetime(2024, 1, 2, 3, 4), "s,\n\"x\"")], "id int, title string, name string, url string, country string, language string, importance int, published_at timestamp_ntz, summary string")
    rows = sinks.export_rows(df)
    assert rows.first().title == "ab" and rows.first().published == "2024-01-02 03:04"
    assert sinks.to_csv(rows).startswith(b"\xef\xbb\xbfid,title") and b"\r\n" in sinks.to_csv(rows)
    assert json.loads(sinks.to_json("f", rows, datetime(2024, 1, 1)))["count"] == 1
    assert "## [ab](u)" in sinks.to_markdown("f", rows)
    for data, part in ((sinks.to_xlsx(rows), "xl/worksheets/sheet1.xml"), (sinks.to_docx("f", rows), "word/document.xml")):
        assert b"ab" in zipfile.ZipFile(BytesIO(data)).read(part)


def test_feed_entries_and_summaries(spark):
    df = spark.createDataFrame([(1, "<b>T</b>", "Text. Read more here", "https://x/1", None, datetime(2024, 1, 1), 1), (1, "", "s", "https://x/2", None, None, 2), (1, "t", "s", "ftp://x", None, None, 3)], "source_id int, title string, summary string, link string, guid string, published_at timestamp_ntz, arrival long")
    got = ops.entries_to_articles(df).collect()
    assert [(r.title, r.summary, r.guid) for r in got] == [("T", "Text.", "https://x/1")]
    t = spark.createDataFrame([(1, "fr", "b", "c"), (1, "de", "a", ""), (1, "es", "", "x")], "article_id int, lang string, title string, summary string")
    assert ops.translated_text(t).first().translated == "a\n\nb\nc"
    assert ops.slug("Été à  Paris!") == "ete-a-paris"


def test_merge_twice_adds_nothing(spark):
    now = F.lit("2024-01-02").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "provider string, external_id string, kind string, lat double, lon double, severity int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    polled = spark.createDataFrame([("p", "1", "wildfire", 1.0, 2.0, 50), ("p", "1", "wildfire", 1.0, 2.0, 40)], "provider string, external_id string, kind string, lat double, lon double, severity int")
    first = H.merge(empty, polled, now)
    assert [(r.status, r.escalated, r.severity) for r in first.collect()] == [("added", True, 50)]
    again = H.merge(first.drop("status", "escalated"), polled, now)
    assert [(r.status, r.escalated) for r in again.collect()] == [("updated", False)]
    assert tuple(H.counters(again).first()) == (1, 0, 1, 0)
