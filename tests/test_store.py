"""Snapshots and recorded pages: commits, replays, conflicts, torn pages and restarts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.sources import feeds, paged, store
from tidewire.streaming import ingest

NOW = datetime(2024, 1, 31)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_and_deletes_equal_a_dictionary(spark, tmp_path):
    rng, kept, want, seen = random.Random(51), store.Snapshots(spark, str(tmp_path / "s"), buckets=5), {}, []
    kept.create("t", spark.createDataFrame([], "k long, v string"), ["k"])
    for batch in range(6):
        if batch % 3 == 2:
            gone = {rng.choice([None, *range(30)]) for _ in range(8)}
            kept.cascade({"t": spark.createDataFrame([(k,) for k in gone], "k long")})
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            new = {rng.choice([None, *range(30)]): f"{batch}-{i}" for i in range(9)}
            kept.upsert("t", spark.createDataFrame([*new.items(), *list(new.items())[:2]], "k long, v string"), stream="s", batch_id=batch)
            want |= new
        assert rows(kept.read("t")) == sorted(want.items(), key=repr)
        seen.append((kept.manifest()["version"], dict(want)))
    for version, then in seen:
        assert rows(kept.read("t", version)) == sorted(then.items(), key=repr)
    last = kept.manifest()
    assert kept.upsert("t", spark.createDataFrame([(99, "again")], "k long, v string"), stream="s", batch_id=4) == last["version"]
    assert kept.upsert("t", spark.createDataFrame([], "k long, v string")) == last["version"] + 1
    kept.clean(keep=1)
    assert rows(kept.read("t")) == sorted(want.items(), key=repr) and len(kept.versions()) == 1
    used = {f.split("/")[1] for f in kept.manifest()["tables"]["t"]["folders"].values()}
    assert {p.name for p in (tmp_path / "s" / "t").iterdir() if not p.name.startswith(".")} == used


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = store.Snapshots(spark, str(tmp_path / "s"), buckets=16)
    kept.create("t", spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v")), ["k"])
    before = kept.manifest()["tables"]["t"]["folders"]
    kept.upsert("t", spark.createDataFrame([(7, "b")], "k long, v string"))
    after = kept.manifest()["tables"]["t"]["folders"]
    assert sum(before[b] != after[b] for b in after) == 1 and kept.read("t").filter("v = 'b'").count() == 1 and kept.read("t").count() == 200


def test_a_killed_batch_runs_again_and_leaves_one_version(spark, tmp_path, monkeypatch):
    kept = store.Snapshots(spark, str(tmp_path / "s"), buckets=4)
    kept.create("t", spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])
    batch = spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string")
    with monkeypatch.context() as m:
        m.setattr(store.Snapshots, "_put", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            kept.upsert("t", batch, stream="s", batch_id=0)
    assert rows(kept.read("t")) == [(1, "a")]
    assert kept.upsert("t", batch, stream="s", batch_id=0) == kept.upsert("t", batch, stream="s", batch_id=0) == 2
    assert rows(kept.read("t")) == [(1, "b"), (2, "c")]


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    one, two = (store.Snapshots(spark, str(tmp_path / "s"), buckets=4) for _ in range(2))
    one.create("t", spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])
    put, first = store.Snapshots._put, []

    def late(self, manifest):
        if self is two and not first:
            first.append(1)
            one.upsert("t", spark.createDataFrame([(5, "one")], "k long, v string"))
        put(self, manifest)

    monkeypatch.setattr(store.Snapshots, "_put", late)
    assert two.upsert("t", spark.createDataFrame([(6, "two")], "k long, v string")) == 3
    assert rows(two.read("t")) == [(1, "a"), (5, "one"), (6, "two")] and rows(one.read("t", 2)) == [(1, "a"), (5, "one")]


def test_articles_go_with_all_that_points_at_them(spark, tmp_path):
    kept = store.Snapshots(spark, str(tmp_path / "s"), buckets=4)
    kept.create("articles", spark.range(20).select("id"), ["id"])
    kept.create("hits", spark.range(60).select((F.col("id") % 3).alias("alert_id"), (F.col("id") % 20).alias("article_id")), ["alert_id", "article_id"])
    version = store.delete_articles(kept, spark.range(5, 12).toDF("id"), {"articles": "id", "hits": "article_id"})
    left = {*range(5), *range(12, 20)}
    assert version == 3 and {r.id for r in kept.read("articles").collect()} == left
    assert {r.article_id for r in kept.read("hits").collect()} == left and kept.read("hits").count() == 39
    with pytest.raises(ValueError, match="outside the change"):
        kept.commit({"articles": store.Change(spark.range(1).toDF("id"), lambda old: old.sparkSession.range(100).toDF("id"))})


def test_hazards_are_merged_in_a_stream(spark, tmp_path):
    """Micro-batches handed in once more after a restart change nothing."""
    kept = store.Snapshots(spark, str(tmp_path / "s"), buckets=4)
    schema = "provider string, external_id long, kind string, lat double, lon double, severity int"
    empty = spark.createDataFrame([], f"{schema}, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz")
    kept.create("hazards", empty, ["provider", "external_id"])
    for batch, severity in ((0, 10), (1, 60), (1, 60), (0, 10)):
        polled = spark.createDataFrame([("p", 1, "flood", 1.0, 2.0, severity), ("p", batch, "flood", 1.0, 2.0, severity)], schema)
        store.merge_hazards(kept, polled, F.lit(NOW).cast("timestamp_ntz"), stream="polls", batch_id=batch)
    assert rows(kept.read("hazards").select("external_id", "severity")) == [(0, 10), (1, 60)] and kept.manifest()["version"] == 3


def test_a_link_is_seen_once_for_good(spark, tmp_path):
    """After 60 days, in one batch, and in a batch that is run again."""
    links = store.Snapshots(spark, str(tmp_path / "s"), buckets=8)
    links.create("links", spark.createDataFrame([], "link string, batch long"), ["link"])
    batch = lambda *urls: spark.createDataFrame([(u, NOW + timedelta(days=60 * i)) for i, u in enumerate(urls)], "link string, published_at timestamp_ntz")
    got = lambda urls, n: sorted(r.link for r in ingest.unseen_links(batch(*urls), links, "s", n).collect())
    assert got(["http://a", "http://b", "http://a", "ftp://c", None], 0) == ["http://a", "http://b"]
    assert got(["http://b", "http://d"], 1) == ["http://d"] and got(["http://b", "http://d"], 1) == ["http://d"]
    assert got(["http://a"], 2) == [] and links.read("links").count() == 3


# Pages


def write(folder, provider, poll, pages, total=None):
    at = folder / provider / poll
    at.mkdir(parents=True, exist_ok=True)
    for n, results in enumerate(pages, 1):
        text = json.dumps({"page": n, "pages": total or len(pages), "results": results})
        (at / f"page-{n}.json").write_text(text if results != "torn" else text[:20])


def test_polls_are_read_whole_or_not_at_all(spark, tmp_path):
    paged.register(spark)
    write(tmp_path, "a", "001", [[{"s": 1}, {"s": 2}], [{"s": 3}]])
    write(tmp_path, "b", "001", [[{"s": 4}]], total=2)
    write(tmp_path, "c", "001", [[{"s": 5}], "torn"])
    write(tmp_path, "d", "001", [[], []])
    found = spark.read.format("tw-pages").load(str(tmp_path))
    assert rows(found) == [("a", "001", 1, 0, '{"s":1}'), ("a", "001", 1, 1, '{"s":2}'), ("a", "001", 2, 0, '{"s":3}')]
    assert spark.read.format("tw-pages").load(str(tmp_path / "none")).count() == 0


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    paged.register(spark)
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        stream = spark.readStream.format("tw-pages").load(str(source))
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
        return [(r.provider, r.poll, r.body) for r in sorted(spark.read.parquet(out).collect())]

    write(source, "a", "001", [[1], [2]])
    write(source, "b", "001", [[3]], total=2)
    first = [("a", "001", "1"), ("a", "001", "2")]
    assert run() == first and run() == first
    write(source, "b", "001", [[3], [4]])
    write(source, "a", "002", ["torn"])
    write(source, "a", "003", [[5]])
    assert run() == [*first, ("a", "003", "5"), ("b", "001", "3"), ("b", "001", "4")]


def test_recordings_come_back(spark, tmp_path):
    paged.register(spark)
    d = spark.range(25).select(F.lit("p").alias("provider"), F.lit("1").alias("poll"), F.to_json(F.struct("id")).alias("body"))
    paged.record(d, str(tmp_path / "r"), size=10)
    found = spark.read.format("tw-pages").load(str(tmp_path / "r"))
    assert rows(found.select("body")) == rows(d.select("body")) and found.select("page").distinct().count() == 3


def test_rows_of_nested_and_unclosed_tables():
    page = """<table><tr><td>One &amp; <a href="http://a.example/x?a=1&amp;b=2">a</a> generally reliable<tr><td>Two<!-- <tr> --> <a name=x href='http://b.example'>b</a>
      <table><tr><td>inner <a href=http://c.example>c</a></td></tr></table> deprecated</td></tr></table> after <a href="http://d.example">d</a>"""
    got = [(r["text"], r["links"]) for r in feeds.table_rows(page)]
    assert got == [("One & a generally reliable", ["http://a.example/x?a=1&b=2"]), ("inner c", ["http://c.example"]), ("Two b deprecated", ["http://b.example"])]
    assert feeds.table_rows(None) == []
