from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import air, geo, lang, scoring, similarity


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_similarity_and_tokens(spark):
    a, b = F.array(*map(F.lit, ["x", "y", "z"])), F.array(*map(F.lit, ["x", "y"]))
    assert one(spark, similarity.similarity(a, b)) == 1.0
    assert one(spark, similarity.similarity(a, F.array().cast("array<string>"))) == 0.0
    assert one(spark, similarity.cluster_tokens(F.lit("The big Quake of 2024 kills 120"), F.lit("M6,8 quake, 120 dead in 2024"))) == ["120", "2024", "6.8", "big", "kills", "quake"]
    assert one(spark, similarity.anchors(F.lit("マグニチュード6.8 and 5 of 12345"))) == ["6.8"]


def test_scores(spark):
    s = scoring.importance(F.lit("international"), F.lit(1), scoring.breaking_signal(F.lit("Breaking: war"), None), F.lit(2), F.lit(5))
    assert one(spark, s) == 100
    for base, hours, expected in [(80, 3.0, 80), (80, 54.0, 56), (3, 1000.0, 5), (80, 10000.0, 32), (80, -5.0, 80)]:
        assert one(spark, scoring.decayed(F.lit(base), F.lit(hours))) == expected
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, scoring.decay_reference(t("2024-01-01"), t("2024-01-02"), t("2024-06-01"))) == datetime(2024, 1, 15)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("the war of the worlds and that is it", "en"), ("der Mann ist nicht auf dem Berg", "de"), ("こんにちは世界のみなさん", "ja"), ("Большой пожар в городе", "ru"), ("Велика пожежа в місті Київ", "uk"), ("大地震发生在中国北京市", "zh"), ("hi", "xx"), ("", "xx"), (None, "xx")],
)
def test_languages(spark, text, expected):
    assert one(spark, lang.detect(F.lit(text).cast("string"), F.lit("xx"))) == expected


def test_air(spark):
    index = lambda p, v, u: one(spark, air.aqi(F.lit(p), F.lit(v), F.lit(u)))
    assert index("pm25", 9.09, "µg/m³") == 50
    assert index("pm25", 0.04, "mg/m3") == 112
    assert index("o3", 0.0705, "ppm") == 100
    assert index("pm25", 9999.0, "ug/m3") == 500
    assert index("pm25", -1.0, "ug/m3") is None and index("pm25", 1.0, "ppm") is None and index("xx", 1.0, "ppm") is None
    assert one(spark, air.fire_severity(F.lit(60000.0), F.lit(50.0))) == 59
    assert one(spark, air.quake_severity(F.lit(6.1), F.lit("Green "))) == 30


def test_geo(spark):
    assert one(spark, F.round(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)), 0)) == 20015
    square = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}
    at = lambda lat, lon: one(spark, geo.inside(F.lit(float(lat)), F.lit(float(lon)), square))
    assert at(1, 1) and not at(5, 5) and not at(11, 1)
    assert geo.box_centre(square) == (5.0, 5.0)
    assert one(spark, geo.nearest_vertex_km(F.lit(1.0), F.lit(1.0), square)) == 0
