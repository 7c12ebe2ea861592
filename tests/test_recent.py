"""The ladder of days against a full sort."""

import random
from datetime import datetime, timedelta

from tidewire.plans import recent
from tidewire.plans.criteria import Criteria, search

NOW = datetime(2024, 3, 1)
SCHEMA = "id long, title string, summary string, content string, source_id int, language string, country string, published_at timestamp_ntz, importance int"


def test_newest_articles_equal_a_full_sort(spark, tmp_path):
    rng = random.Random(61)
    rows = [(i, f"word{i % 7} title", "s", None, i % 3, rng.choice(["en", "de"]), "US", rng.choice([None, *[datetime(2024, 1, 1) + timedelta(hours=6 * rng.randrange(200)) for _ in range(12)]]), i % 50) for i in range(400)]
    d = spark.createDataFrame(rows, SCHEMA)
    sources = spark.createDataFrame([(0, "a"), (1, "b")], "source_id int, name string")
    path = str(tmp_path / "days")
    recent.write_days(d.filter("id < 300"), path)
    recent.write_days(d.filter("id >= 300"), path)  # more articles, of old days too
    known = recent.days(spark, path)
    assert known[-1] == "none" and known[:-1] == sorted(known[:-1], reverse=True) and len(known) > 40
    for c, limit in ((Criteria(keywords=("word3",), passing_mentions=True), 10), (Criteria(languages=("de",)), 1), (Criteria(), 60), (Criteria(keywords=("word9",)), 5), (Criteria(min_importance=49), 1000)):
        found, read = recent.search_newest(spark, path, sources, c, NOW, limit)
        full = search(d, sources, c, NOW, "newest", limit)
        assert [r.id for r in found.collect()] == [r.id for r in full.collect()] and found.columns == full.columns
        assert read == known[: len(read)]
        if limit <= 10 and c.keywords != ("word9",):
            assert len(read) < len(known) / 2  # what is older was not read
        if limit == 1000 or c.keywords == ("word9",):
            assert read == known
