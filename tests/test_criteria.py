from datetime import datetime

from pyspark.sql import functions as F

from tidewire.plans.criteria import Criteria, coverage_queries, domain_of, host_of, predicate, prominent
from tidewire.functions import terms

NOW = datetime(2024, 1, 31)
PLACES = "array<struct<name:string,country:string,lat:double,lon:double,kind:string>>"


def rows(spark):
    data = [
        (1, "Flood hits town", "water rising", "The flood grew. flood again.", 1, "en", "US", datetime(2024, 1, 30), 80, ["disaster"], [("Paris", "FR", 48.8, 2.3, "city")], "local", "news"),
        (2, "Market news", "stocks", "a flood of data", 2, "en", "GB", datetime(2024, 1, 10), 40, ["business"], [], "national", ""),
        (3, None, None, None, 3, "de", "DE", None, 10, [], None, None, None),
    ]
    return spark.createDataFrame(data, f"id int, title string, summary string, content string, source_id int, language string, country string, published_at timestamp_ntz, importance int, categories array<string>, places {PLACES}, scope string, platform string")


def ids(spark, **c):
    df = rows(spark)
    return [r.id for r in df.filter(predicate(Criteria.from_json(c), df.columns, NOW, {"DE": (51.0, 9.0)})).orderBy("id").collect()]


def test_predicates(spark):
    assert ids(spark) == [1, 2, 3]
    assert ids(spark, keywords=["flood"]) == [1]
    assert ids(spark, keywords=["flood"], passing_mentions=True) == [1, 2]
    assert ids(spark, keywords=["flood"], exclude_keywords=["data"], passing_mentions=True) == [1]
    assert ids(spark, hours=48) == [1, 3]
    assert ids(spark, date_from="2024-01-05", date_to="2024-01-10") == [2]
    assert ids(spark, date_from="nonsense", date_to="2024-01-10") == [1, 2, 3]
    assert ids(spark, date_from="2024-01-20", date_to="nonsense") == [1]
    assert ids(spark, countries=["FR"]) == [1]
    assert ids(spark, platforms=["news"]) == [1, 2, 3]
    assert ids(spark, scopes=["local"]) == [1]
    assert ids(spark, categories=["business", "sports"]) == [2]
    assert ids(spark, query="title:flood") == [1]
    assert ids(spark, query="a AND") == []
    assert ids(spark, geos=[{"type": "Circle", "center": [48.8, 2.3], "radius_km": 50}]) == [1]
    assert ids(spark, geo={"type": "Circle", "center": [51.0, 9.0], "radius_km": 50}) == [3]
    assert ids(spark, geo={"name": "town", "country": "US"}) == [1]
    assert ids(spark, geo={"name": "town", "country": "FR"}) == []
    assert ids(spark, keywords=["flood"], min_mentions=4) == []


def test_prominence_by_brute_force(spark):
    import itertools
    import re

    plain = [("ab", terms.keyword("ab")), ("cd ef", terms.keyword("cd ef"))]
    texts = ["", "ab", "ab ab", "cd ef", "ab cd ef", "zz"]
    data = [(i, h, b) for i, (h, b) in enumerate(itertools.product(texts, texts))]
    df = spark.createDataFrame(data, "i int, h string, b string")
    got = {r.i for r in df.filter(prominent(plain, F.col("h"), F.col("b"), F.concat_ws("\n", "h", "b"), 2)).collect()}

    def slow(h, b):
        count = lambda p, s: len(re.findall(p, s, re.I))
        if any(count(p, h) for _, p in plain):
            return True
        held = [(t, p) for t, p in plain if count(p, b)]
        if not held:
            return True
        return " " in held[0][0] or count(held[0][1], b) >= 2 or len(held) > 1

    assert got == {i for i, h, b in data if slow(h, b)}


def test_hosts_and_trackers(spark):
    df = spark.createDataFrame([("https://www.A.example.com:8080/x",), ("bad",), (None,)], "u string")
    assert [tuple(r) for r in df.select(host_of(F.col("u")), domain_of(F.col("u"))).collect()] == [("a.example.com", "a.example.com:8080"), ("", ""), ("", "")]
    assert coverage_queries(Criteria(query="(a OR b) AND c NOT d")) == ["a OR b c -d"]
