"""Operators against slow restatements: distances, headlines, events, terms, catalogue, streams."""

import json
import math
import random
import re
import time
import unicodedata
import zipfile
from datetime import datetime, timedelta
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from tidewire.functions import air, categories, lang, scoring, terms
from tidewire.operators import catalog, clusters, coverage, hazards, ops, ranks
from tidewire.operators.documents import topics
from tidewire.plans import bql, criteria
from tidewire.sources import backup, feeds, gazetteer, html, reports, sinks, synthetic
from tidewire.streaming import alerts, ingest

NOW = datetime(2024, 1, 31)


def ntz(moment=NOW):
    return F.lit(moment).cast("timestamp_ntz")


# Distances


def km(a, b):
    (y, x), (q, p) = (map(math.radians, v) for v in (a, b))
    h = math.sin((q - y) / 2) ** 2 + math.cos(y) * math.cos(q) * math.sin((p - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def test_pairs_within_any_distance_by_brute_force(spark):
    rng = random.Random(1)
    spot = lambda: (rng.choice([90.0, -90.0, 89.9, 0.0, rng.uniform(-90, 90)]), rng.choice([180.0, -180.0, 179.9, -179.9, 0.0, rng.uniform(-180, 180)]))
    locations = [(i, *spot(), rng.choice([0.0, 3.0, 50.0, 700.0, 3000.0, 9000.0, 25000.0])) for i in range(60)]
    points = [(i, *spot()) for i in range(150)] + [(1000 + i, a[1] + rng.uniform(-0.02, 0.02) if abs(a[1]) < 89 else a[1], a[2]) for i, a in enumerate(locations)]
    a = spark.createDataFrame([*locations, (99, None, 1.0, 5.0), (98, 1.0, 1.0, None)], "loc int, lat double, lon double, ring double")
    b = spark.createDataFrame([*points, (5000, None, None)], "pt int, lat double, lon double")
    found = [(r["loc"], r.pt) for r in hazards.within(a, b, F.col("ring")).collect()]
    want = {(i, j) for i, y, x, ring in locations for j, q, p in points if km((y, x), (q, p)) <= ring - 1e-6}
    assert len(found) == len(set(found)) and want <= set(found)
    assert all(km(locations[i][1:3], next(p[1:] for p in points if p[0] == j)) <= locations[i][3] + 1e-6 for i, j in found)


# Headlines


def alike(a, b):
    n = len(a & b)
    return max(n / len(a | b), n / min(len(a), len(b))) if n else 0.0


def headlines(n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        tokens = {"hot"} | {f"t{rng.randrange(25)}" for _ in range(rng.randrange(6))} if i % 3 else {f"t{rng.randrange(25)}" for _ in range(rng.randrange(1, 6))}
        rows.append((i, i % 7, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(0, 4000)), sorted(tokens)))
    return [*rows, (500, 1, datetime(2024, 1, 1), [])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, source_id int, published_at timestamp_ntz, tokens array<string>")


@pytest.mark.parametrize("least", [1, 2])
def test_similar_pairs_by_brute_force(spark, least):
    rows = headlines()
    t = frame(spark, rows)
    got = {(r.id, r.other): (r.shared, round(r.similarity, 9)) for r in coverage.similar_pairs(t, t, least).collect()}
    sets = {r[0]: set(r[3]) for r in rows}
    want = {(i, j): (len(sets[i] & sets[j]), round(alike(sets[i], sets[j]), 9)) for i in sets for j in sets if i != j and len(sets[i] & sets[j]) >= least and alike(sets[i], sets[j]) >= 0.5}
    assert got == want and len(got) > 100


def test_corroboration_by_brute_force(spark):
    rows = headlines()
    rooms = spark.createDataFrame([(1, 0), (2, 0)], "source_id int, newsroom int")
    room = lambda s: 0 if s in (1, 2) else s
    got = {r.id: r.corroborating for r in coverage.corroboration(frame(spark, rows), rooms).collect()}
    for i, s, at, tokens in rows:
        near = {room(q) for j, q, then, other in rows if j != i and room(q) != room(s) and timedelta(0) <= at - then <= timedelta(hours=12) and alike(set(tokens), set(other)) >= 0.5}
        assert got[i] == len(near)


def slow_events(rows, window):
    """The fold without an index, over (id, at, tokens) in order."""
    events, out = [], {}
    for i, at, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        tokens, best, top = set(tokens), None, 0.0
        for e in events:
            n = len(tokens & e["tokens"])
            if len(tokens) >= 2 and n >= 2 and e["at"] >= at - window and alike(tokens, e["tokens"]) > top:
                best, top = e, alike(tokens, e["tokens"])
        if top < 0.5:
            best = {"id": len(events), "tokens": tokens, "at": at}
            events.append(best)
        else:
            best["tokens"] = set(sorted(best["tokens"] | tokens)[:18])
            best["at"] = max(best["at"], at)
        out[i] = best["id"]
    return out


def test_events_by_a_fold_without_an_index(spark):
    rows = headlines(200)
    got = {r.id: r.event for r in clusters.cluster(frame(spark, rows), 6).collect()}
    seconds = lambda at: int((at - datetime(1970, 1, 1)).total_seconds())
    assert got == slow_events([(i, seconds(at), t) for i, _, at, t in rows], 6 * 3600) and 10 < len(set(got.values())) < 190
    fold = clusters.EventFold(3600)
    for i in range(50):
        fold.place({f"a{i}", f"b{i}"}, i * 100_000)
    assert len(fold.events) == 1 and len(fold.holders) == 2
    again = clusters.EventFold.from_json(fold.to_json(), 3600)
    assert again.place({"a49", "b49"}, 49 * 100_000) == 49


def test_events_with_common_words(spark):
    """Headlines that share common words with very many events are placed in time, alike with and without counts of the words; several batches of Arrow."""
    rng = random.Random(5)
    common = ["said", "town", "year", "vote", "rain", "fire"]
    rows = [(i, i * 5 // 2, [*rng.sample(common, 3), *(f"w{rng.randrange(60_000)}" for _ in range(6))]) for i in range(12_000)]
    rows += [(12_000 + i, at, tokens[: 4 + i % 5]) for i, (_, at, tokens) in enumerate(rng.sample(rows, 100))]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(seconds=at), t) for i, at, t in rows], "id long, published_at timestamp_ntz, tokens array<string>")
    began = time.monotonic()
    got = {r.id: r.event for r in clusters.cluster(df, 72).collect()}
    assert time.monotonic() - began < 15
    assert len(got) == 12_100 and 6_000 < len(set(got.values())) < 12_050
    few = [r for r in rows if r[0] % 30 == 0]
    again = clusters.EventFold(3600)
    assert {i: again.place(set(t), at) for i, at, t in sorted(few, key=lambda r: (r[1], r[0]))} == slow_events([(i, at, t) for i, at, t in few], 3600)


def test_linked_events_are_components(spark):
    rows = headlines()
    got = {r.id: r.event for r in clusters.linked(frame(spark, rows), 24).collect()}
    top = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i, _, at, t in rows:
            for j, _, then, u in rows:
                if len(set(t) & set(u)) >= 2 and alike(set(t), set(u)) >= 0.5 and abs(at - then) <= timedelta(hours=24):
                    top[i] = top[j] = min(top[i], top[j])
    assert got == top


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "u long, v long")
    got = {r.id: r.least for r in clusters.components(links, spark.range(1000)).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[901] == 900 and got[500] == 500


def test_merged_events_keep_the_order_of_members(spark):
    rows = [(i, 1, datetime(2024, 1, 1, 9 - i % 5), ("US", "", "FR", None)[i % 4], i % 3, ["b", "a"][: i % 3], [f"t{k}" for k in range(i)]) for i in range(25)]
    a = spark.createDataFrame([(r[0], r[1], r[2], r[3], 120 - r[4], r[5], r[6]) for r in rows], "id long, event_id int, published_at timestamp_ntz, country string, source_id int, categories array<string>, tokens array<string>").withColumn("importance", F.col("id").cast("int"))
    got = clusters.merged(a).first()
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got.countries == list(dict.fromkeys(r[3] for r in ordered if r[3])) and got.source_ids == list(dict.fromkeys(120 - r[4] for r in ordered))
    assert got.categories == ["a", "b"] and got.tokens == sorted({t for r in rows for t in r[6]})[:18] and got.article_count == 25 and got.importance == 24


# Terms and scores


TEXTS = ["BREAKING: Air strike near the İstanbul hotel", "a tsunami 津波 came", "Überschwemmung und Krieg", "выборы и война", "striKe ſtrike STRIKE", "state of  emergency\nnow", "", None, "coup d'état", "election, recall; default"]


def test_listed_terms_equal_one_pattern_each(spark):
    t = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    each = sum((F.when(F.col("t").rlike(terms.FLAGS + terms.keyword(term)), w).otherwise(0) for term, w in scoring.ALL_BREAKING.items()), F.lit(0))
    rows = t.select(scoring.breaking_signal(F.col("t")).alias("got"), F.least(F.lit(30), each).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and max(r.got for r in rows) == 30 and sum(r.got > 0 for r in rows) >= 7
    found = t.select(terms.one_of(F.col("t"), "strike").alias("a"), F.col("t").rlike(terms.FLAGS + terms.keyword("strike")).alias("b")).collect()
    assert [r.a for r in found] == [r.b for r in found]


def test_categories_of_all_languages(spark):
    rows = [("Erdbeben in der Stadt", "", []), ("Nothing", "the parliament and a vote", []), ("Nothing", "the parliament", []), ("x", "y", ["Politik", "sport"]), ("球", "地震", []), ("who", "hospital", [])]
    t = spark.createDataFrame(rows, "title string, text string, tags array<string>")
    got = [r.c for r in t.select(categories.classify(F.col("title"), F.col("text"), None, F.array().cast("array<string>"), F.col("tags")).alias("c")).collect()]
    assert got == [["disaster"], ["politics"], ["world"], ["politics", "sports"], ["disaster"], ["health"]]


def test_languages_by_script_and_words(spark):
    texts = {"ja": "これは日本語のテキストです", "ru": "это обычный русский текст для проверки", "uk": "це звичайний український текст її", "el": "αυτό είναι ελληνικό κείμενο", "zh": "这是一个用于测试的中文文本", "de": "der Hund und die Katze mit dem Ball", "en": "one two three"}
    t = spark.createDataFrame(list(texts.items()), "want string, t string")
    assert all(r.want == r.got for r in t.select("want", lang.detect(F.col("t"), F.lit("en")).alias("got")).collect())


def test_explanations_by_brute_force(spark):
    rng, words = random.Random(5), ["quake", "town", "sea", "quakes", "Quake", "old-quake", "the"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(i, say(3), say(6), say(30)) for i in range(80)]
    a = spark.createDataFrame(rows, "id int, title string, summary string, content string")
    got = {(r.id, r.term): r for r in ops.explain(a, criteria.Criteria(keywords=("quake",), query="sea OR title:town")).collect()}
    for i, *fields in rows:
        for term in ("quake", "sea", "town"):
            find = re.compile(rf"\b{term}\b", re.I)
            first = next((name for name, text in zip(("title", "summary", "content"), fields) if find.search(text)), None)
            r = got.get((i, term))
            assert (r is None) == (first is None)
            if r:
                assert r.field == first and r.times == min(9, sum(len(find.findall(t)) for t in fields)) and find.search(r.snippet)


def test_whole_pages_are_read_unless_told_otherwise():
    page = "<p>" + "word " * 400_000 + "</p><p>the very last words of a very long page are read</p>"
    assert html.extract(page).endswith("are read") and len(html.extract(page, most_text=20_000)) == 20_000
    assert not html.extract(page, most_input=1_500_000).endswith("are read")


def test_a_query_on_plain_text_has_no_other_fields(spark):
    t = spark.createDataFrame([("quake in town",)], "t string")
    fields = bql.plain(F.col("t"))
    got = [t.select(bql.query_column(q, fields)).first()[0] for q in ("quake", "text:quake", "title:quake", "quake AND town", "quake AND sea", "NOT sea")]
    assert got == [True, True, False, True, False, True]


def test_home_columns_are_warm_for_two_minutes(spark, tmp_path):
    written = criteria.warm({"a": spark.range(3), "b": spark.range(1)}, str(tmp_path))
    assert {k: v.count() for k, v in written.items()} == {"a": 3, "b": 1}
    assert criteria.fresh(NOW, NOW + timedelta(seconds=120)) and not criteria.fresh(NOW, NOW + timedelta(seconds=121))
    assert criteria.bounded("search", 900) == 200 and criteria.bounded("groups", 0) == 1


# Places


def test_found_places_equal_the_plain_search():
    places = [{"name": n, "country": "X", "lat": 1.0, "lon": 2.0, "aliases": a, "kind": "city"} for n, a in (("New York", ["NYC"]), ("York", []), ("US", ["USA"]), ("Москва", ["Moscow"]), ("東京", []), ("İzmir", []), ("Kilo", []), ("Paris", ["Lutetia"]))]
    find, slow = gazetteer.Finder(places), gazetteer.compiled(places)
    for text in ("From New York to york", "us and US and USA", "в Москве и Moscow", "在東京都", "izmir, İZMİR", "Kilo paris", "", None, "comparison yorkshire"):
        assert find(text) == gazetteer.extract(text, places, slow)


def test_gazetteers_are_joined(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"countries": [{"iso2": "JP", "name": "Japan", "lat": 1.0, "lon": 2.0, "aliases": []}], "cities": [{"name": "Osaka", "country": "JP", "aliases": ["O"], "lat": None, "lon": None}]}))
    got = gazetteer.load(spark, str(tmp_path / "g.json"), [{"name": "osaka", "country": "JP", "aliases": ["Oz"]}, {"name": "Kobe", "country": "JP"}], {"Osaka": ["大阪"]})
    assert [(p["name"], p["lat"], p["aliases"]) for p in got] == [("Japan", 1.0, []), ("Osaka", 1.0, ["O", "Oz", "大阪"]), ("Kobe", 1.0, [])]


# Orders


def test_places_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(50), rng.randrange(9)) for i in range(500)]
    d = spark.createDataFrame(rows, "id int, at int, amount int").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert {r.id: r.place for r in ranks.placed(d, "at", "id").collect()} == {r[0]: k + 1 for k, r in enumerate(ordered)}
    total, want = 0, {}
    for i, _, amount in ordered:
        want[i] = total = total + amount
    assert {r.id: r.upto for r in ranks.running(d, "amount", F.floor(F.col("at") / 5), "at", "id").collect()} == want


def test_passes_of_retention(spark):
    a = spark.createDataFrame([(i, NOW - timedelta(days=i), 10) for i in range(60)], "id int, published_at timestamp_ntz, bytes int")
    gone, more = ops.prune_pass(a, ntz(), 30, 5)
    assert {r.id for r in gone.collect()} == {55, 56, 57, 58, 59} and more
    assert ops.prune_pass(a, ntz(), 30, 500)[1] is False
    assert {r.id for r in ops.over_budget(a, 455, ntz()).collect()} == set(range(45, 60))
    assert {r.id for r in ops.over_budget(a, 0, ntz()).collect()} == set(range(3, 60))
    assert {r.id for r in ops.over_budget(a, 0, ntz(), most=2).collect()} == {58, 59}


def test_pivots(spark):
    e = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", ["z"])], "at string, themes array<string>")
    rows = ops.pivoted(ops.coverage_grid(e, ["x", "y", "none"], F.col("at")), ["a", "b"]).collect()
    assert {r.theme: tuple(r)[1:] for r in rows} == {"x": (2, 0, 2), "y": (1, 0, 1), "none": (0, 0, 0)}


# Catalogue


def test_slugs(spark):
    names = ["Réputation", "Reputation", "reputation-2", "  ", "A" * 80, "reputation!"]
    d = spark.createDataFrame([(i, 1, n) for i, n in enumerate(names)], "i int, g int, name string")
    got = [r.slug for r in catalog.unique_slugs(d, "g", "name", "i").orderBy("i").collect()]
    assert got == ["reputation", "reputation-3", "reputation-2", "untitled", "a" * 60, "reputation-4"]
    assert all(unicodedata.normalize("NFKD", s).isascii() and re.fullmatch("[a-z0-9-]+", s) for s in got)


def test_entries_and_lists(spark):
    e = spark.createDataFrame([(1, 0, "t", "", ["a", "z", "a", " b "]), (1, 1, " ", None, ["a"]), (1, 500, "late", "", [])], "document_id int, position int, title string, body string, themes array<string>")
    assert [r.themes for r in catalog.themed(e, ["a", "b"]).collect()] == [["a", "b"]] and [r.themes for r in catalog.themed(e, ["a", "b"], most=1).collect()] == [["a"]]
    assert spark.range(1).select(catalog.ordered_union(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1), F.lit(2)))).first()[0] == [3, 1, 2]
    places = lambda *xs: spark.createDataFrame([(n, y, 1.0) for n, y in xs], "name string, lat double, lon double")
    assert [r.name for r in catalog.only_remote(places(("near", 1.0001), ("far", 2.0)), places(("here", 1.0))).collect()] == ["far"]
    users = spark.createDataFrame([("Ann", "x@y"), ("Bob", "ann@z"), ("Cy", None)], "name string, email string")
    assert sorted(r.name for r in catalog.found_users(users, " ANN ").collect()) == ["Ann", "Bob"] and catalog.found_users(users, "").count() == 3


def test_source_states_after_polls(spark):
    d = spark.createDataFrame([(4, 2, False, 0, False, "auto"), (4, 2, False, 0, True, "auto"), (4, 0, False, 0, False, "user"), (3, 1, True, 2, True, "auto"), (0, 1, True, 0, True, "auto")], "f int, idle int, ok boolean, new int, made boolean, by string")
    s = feeds.next_state(F.col("f"), F.col("idle"), F.col("ok"), F.col("new"), F.col("made"), F.col("by"))
    assert [tuple(r.s) for r in d.select(s.alias("s")).collect()] == [(5, 2, "remove"), (5, 2, "disable"), (5, 0, "disable"), (0, 0, "keep"), (0, 2, "keep")]


def test_retries_and_expiry(spark):
    t = spark.createDataFrame([(1,), (2,), (3,), (4,)], "n int")
    waits = [(r.at - NOW).total_seconds() if r.at else None for r in t.select(ops.retry_at(ntz(), F.col("n")).alias("at")).orderBy("n").collect()]
    assert waits == [300, 600, 1200, None]
    h = spark.createDataFrame([(1, "p", "flood", NOW, NOW - timedelta(1)), (2, "p", "flood", NOW, NOW + timedelta(1)), (3, "p", "flood", NOW, None), (4, "q", "air_quality", NOW - timedelta(hours=7), None), (5, "p", "air_quality", NOW - timedelta(hours=7), None)], "hazard_id int, provider string, kind string, last_seen_at timestamp_ntz, expires timestamp_ntz")
    assert {r.hazard_id for r in hazards.pruned(h, ["p"], ntz(), "expires").collect()} == {2, 3, 4}


def test_access_and_moments(spark):
    day = lambda n: NOW + timedelta(days=n)
    u = spark.createDataFrame([(1, True, None, None), (2, False, day(0.5), day(9)), (3, False, day(-1), day(2)), (4, False, day(-1), day(-2)), (5, False, None, None)], "user_id int, comped boolean, paid_until timestamp_ntz, trial_ends_at timestamp_ntz")
    assert [tuple(r)[1:] for r in catalog.access(u, ntz()).orderBy("user_id").collect()] == [("comped", None, None), ("paid", day(0.5), 1), ("trial", day(2), 2), ("expired", day(-2), 0), ("expired", None, 0)]
    assert {r.state for r in catalog.access(u, ntz(), charged=False).collect()} == {"open"}
    t = spark.createDataFrame([("1700000000000",), ("2023-11-14T22:13:20Z",), ("2023-11-14T22:13:20",), ("soon",), ("0",), ("",), (None,)], "t string")
    assert [r.m for r in t.select(air.moment(F.col("t")).alias("m")).collect()] == [datetime(2023, 11, 14, 22, 13, 20)] * 3 + [None] * 4


def test_translations_are_searched(spark):
    a = spark.createDataFrame([(1, "quake", "", "", NOW), (2, "flut", "", "", NOW)], "id int, title string, summary string, content string, published_at timestamp_ntz")
    t = spark.createDataFrame([(2, "en", "flood", "in town")], "article_id int, lang string, title string, summary string")
    full = ops.with_translations(a, t)
    found = lambda on: [r.id for r in full.filter(criteria.predicate(criteria.Criteria(query="flood AND town", search_translations=on, passing_mentions=True), full.columns, NOW)).collect()]
    assert found(True) == [2] and found(False) == []


def test_switched_off_sources(spark):
    s = spark.createDataFrame([(1, "auto-discovered"), (2, "user"), (3, "auto-discovered")], "source_id int, added_by string")
    v = spark.createDataFrame([(1, True), (2, True), (3, False)], "source_id int, rejected boolean")
    assert [r.source_id for r in ops.switched_off(s, v).collect()] == [1]


# Sources and sinks


def test_full_exports_have_eleven_columns(spark):
    row = (1, "T", NOW, "Outlet", "FR", ["a", "b"], 50, "local", "fr", None, " s\x01 ", "http://x")
    d = spark.createDataFrame([row], "id int, title string, published_at timestamp_ntz, name string, country string, categories array<string>, importance int, scope string, language string, event_id long, summary string, url string")
    t = spark.createDataFrame([(1, "Translated", "")], "article_id int, title string, summary string")
    table = sinks.export_table(d, t)
    assert tuple(table.first()) == ("Translated", "2024-01-31 00:00", "Outlet", "FR", "a, b", "50", "local", "fr", "", "s", "http://x")
    assert sinks.to_csv(table).decode("utf-8-sig").splitlines()[0] == "Title,Published (UTC),Outlet,Country,Categories,Importance,Scope,Language,Story,Summary,Link"
    assert "## [Translated](http://x)\n*Outlet · 2024-01-31 00:00 · FR · a, b · importance 50*" in sinks.to_markdown("f", table)
    assert b"Published (UTC)" in zipfile.ZipFile(BytesIO(sinks.to_xlsx(table))).read("xl/worksheets/sheet1.xml")


def test_reports_become_topics(spark, tmp_path):
    rows = spark.createDataFrame([("Weekly report", "o", "p", "s")], "title string, source string, published string, summary string").select("title", "source", "published", F.lit("").alias("country"), "summary")
    (tmp_path / "a.docx").write_bytes(sinks.to_docx("The harbour is closed again", rows))
    (tmp_path / "b.txt").write_text("Summary\n**The river floods the old town**\nWater rose. https://x.example/1\n\n**Rivers flood old towns again**\nMore.\n**A second heading of a report**\nOther words.")
    (tmp_path / "c.docx").write_bytes(b"not a word file")
    got = {r.path.split("/")[-1]: r.topics for r in topics(reports.reports(spark, str(tmp_path))).collect()}
    assert [t.heading for t in got["b.txt"]] == ["The river floods the old town", "A second heading of a report"] and got["b.txt"][0].links == ["https://x.example/1"]
    assert [t.heading for t in got["a.docx"]] == ["The harbour is closed again"] and got["c.docx"] == []


def test_backups_come_back_whole(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", None), (2, None, NOW)], "id int, name string, taken_at timestamp_ntz")
    told = backup.back_up({"a": a, "b": a.limit(0)}, str(tmp_path / "one"))
    assert told == backup.digest({"b": a.limit(0), "a": a.orderBy(F.desc("id")).select("name", "taken_at", "id").withColumn("taken_at", F.lit(None).cast("timestamp_ntz"))})
    assert told != backup.digest({"a": a.withColumn("name", F.lit("x")), "b": a.limit(0)}) != backup.digest({"a": a.union(a), "b": a.limit(0)})
    back = backup.restore(spark, str(tmp_path / "one"), {"a": a.limit(0), "b": a.limit(0)}, told)
    assert sorted(map(tuple, back["a"].collect())) == sorted(map(tuple, a.collect())) and back["b"].count() == 0
    with pytest.raises(ValueError, match="aren't empty: a"):
        backup.restore(spark, str(tmp_path / "one"), {"a": a, "b": a.limit(0)})
    with pytest.raises(ValueError, match="digest"):
        backup.restore(spark, str(tmp_path / "one"), {"a": a.limit(0), "b": a.limit(0)}, "other")


def test_the_invented_corpus_is_the_same_each_time(spark):
    a, b = (synthetic.articles(spark, 400, words=20, seed=s).orderBy("id").collect() for s in (1, 1))
    assert a == b and len({r.title for r in a}) > 100 and {len(r.content.split()) for r in a} == {20} and len({r.event_id for r in a}) <= 100
    assert min(r.published_at for r in a) >= NOW - timedelta(days=30)


# Streams and messages


def test_digests_list_the_first_few(spark):
    hits = spark.createDataFrame([(1 + (i > 90), i, NOW + timedelta(minutes=i % 40), f"t{i}") for i in range(100)], "alert_id int, id int, published_at timestamp_ntz, title string")
    got = {r.alert_id: r for r in alerts.digests(hits, 3).collect()}
    assert got[1].hits == 91 and [x.id for x in got[1].newest] == [79, 39, 78] and got[2].hits == 9


def test_upserts_add_what_is_new(spark):
    b = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    assert [r.url for r in ingest.upsert(b, b.filter("url = 'a'")).collect()] == ["b"]


def stream(spark, folder, batches, schema):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        import os

        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def told(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


POLL = "provider string, external_id string, severity int, bucket int, seen long"


def test_many_polls_of_one_hazard_keep_their_order(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(25_000):
        rows.append({"provider": "p", "external_id": "1", "severity": i, "bucket": i // 10_000, "seen": 1_700_000_000 + i})
    rng.shuffle(rows)
    got = told(ingest.hazard_steps(stream(spark, tmp_path / "in", [rows], POLL)), "many")
    assert sorted((r.bucket, r.seen - 1_700_000_000) for r in got) == [(0, 0), (1, 10_000), (2, 20_000)]


def test_a_silent_hazard_is_told_anew(spark, tmp_path):
    poll = lambda day, bucket, key="1": {"provider": "p", "external_id": key, "severity": 1, "bucket": bucket, "seen": 1_700_000_000 + day * 86400}
    batches = [[poll(0, 2)], [poll(5, 2)], [poll(11, 2)], [poll(30, 0, "2")], [poll(40, 1)]]
    got = told(ingest.hazard_steps(stream(spark, tmp_path / "in", batches, POLL)), "silent")
    assert sorted((r.external_id, r.bucket, (r.seen - 1_700_000_000) // 86400) for r in got) == [("1", 1, 40), ("1", 2, 0), ("2", 0, 30)]


def test_rings_speak_once_for_each_bucket(spark, tmp_path):
    fire = lambda i, severity, seen, lat=10.0: {"hazard_id": i, "kind": "wildfire", "lat": lat, "lon": 20.0, "severity": severity, "seen": seen}
    places = spark.createDataFrame([(7, 10.1, 20.0, 50.0), (8, -40.0, 20.0, 50.0)], "location_id long, lat double, lon double, fire_km double")
    fires = stream(spark, tmp_path / "in", [[fire(1, 30, 1), fire(2, 90, 1, 60.0)], [fire(1, 35, 2)], [fire(1, 85, 3)]], "hazard_id long, kind string, lat double, lon double, severity int, seen long")
    assert sorted((r.location_id, r.hazard_id, r.bucket) for r in told(ingest.ring_steps(fires, places), "rings")) == [(7, 1, 1), (7, 1, 4)]


def test_streams_corroborate_with_all_earlier_batches(spark, tmp_path):
    at = lambda h: f"2024-01-01T{h:02}:00:00"
    row = lambda i, source, h, *tokens: {"id": i, "source_id": source, "published_at": at(h), "tokens": tokens}
    batches = [[row(1, 1, 0, "quake", "town")], [row(2, 2, 5, "quake", "town"), row(3, 3, 6, "quake", "town")], [row(4, 4, 17, "quake", "town"), row(5, 4, 17, "other")]]
    source = stream(spark, tmp_path / "in", batches, "id long, source_id int, published_at timestamp_ntz, tokens array<string>")
    got = {}
    q = ingest.corroborated(source, str(tmp_path / "store"), lambda found, k: got.update({r.id: r.corroborating for r in found.collect()}), str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got == {1: 0, 2: 1, 3: 2, 4: 2, 5: 0}


def test_triggers_ramp_up():
    assert [ingest.ramped(40, s) for s in (-5, 0, 150, 300, 900)] == [10, 10, 25, 40, 40] and ingest.ramped(8, 0) == 8
