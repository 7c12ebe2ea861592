from pyspark.sql import functions as F

from tidewire.operators import documents
from tidewire.sources import feeds


def test_topics_fold(spark):
    t = lambda h, b, links: {"heading": h, "body": b, "links": links}
    merged = documents.merge_topics([t("Flooding rivers", "a", ["u"]), t("Rivers flooded", "longer", ["v", "u"]), t("Other thing", "", None)])
    assert [(x["body"], x["links"]) for x in merged] == [("longer", ["u", "v"]), ("", [])]
    df = spark.createDataFrame([(1, [("Flooding rivers", "a", ["u"]), ("Rivers flooded", "bb", ["v"])]), (2, None)], "id int, topics array<struct<heading:string,body:string,links:array<string>>>")
    assert {r.id: len(r.topics) for r in documents.topics(df).collect()} == {1: 1, 2: 0}


def test_themes_and_places(spark):
    themes = [{"slug": "w", "name": "Water", "keywords": ["river", "flood"]}, {"slug": "f", "name": "Fire", "keywords": ["fire"]}]
    df = spark.createDataFrame([("River flood and water",), ("a fire",), (None,)], "t string")
    assert [r[0] for r in df.select(documents.suggested_themes(F.col("t"), themes)).collect()] == [["w"], ["f"], []]
    p = spark.createDataFrame([([("x", 48.8, 2.3)],), (None,)], "places array<struct<name:string,lat:double,lon:double>>")
    assert [r[0] for r in p.select(documents.near_locations(F.col("places"), [{"id": 4, "lat": 48.8, "lon": 2.3, "radius_km": 10}])).collect()] == [[4], []]
    h = spark.createDataFrame([(1, 7, 3.0), (2, 7, 1.0)], "location_id int, hazard_id int, distance_km double")
    assert tuple(documents.ring_badges(h).first()) == (7, 2, 1.0, 1)


def test_feeds(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T</title><description>D</description><link>https://x/1</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate></item></channel></rss>")
    row = feeds.rss(spark, str(tmp_path / "a.xml")).first()
    assert (row.title, row.summary, row.guid, str(row.published_at)) == ("T", "D", "https://x/1", "2024-01-02 03:04:05")
    df = spark.createDataFrame([(304, "", None), (429, "", 99999), (200, " <!DOCTYPE html>", None), (200, "<rss>", None), (500, "", None)], "c int, b string, r int")
    got = [(r.s.status, r.s.wait) for r in df.select(feeds.fetch_status(F.col("c"), F.col("b"), F.col("r")).alias("s")).collect()]
    assert got == [("ok: unchanged", 0), ("back off", 3600), ("error: not a feed", 0), ("ok", 0), ("error: 500", 0)]
    page = "<table><tr><td>X is generally reliable</td><td><a href='https://www.x.com/'>x</a></td></tr><tr><td>X deprecated</td><td><a href='https://x.com/a'>x</a></td></tr></table>"
    df = spark.createDataFrame([(page,)], "html string")
    assert [tuple(r) for r in feeds.reliability(df, least=1).collect()] == [("x.com", 4, "deprecated")]
    assert feeds.reliability(df) is None
