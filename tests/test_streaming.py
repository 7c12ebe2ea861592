import json
from datetime import datetime

from tidewire.operators.coverage import cluster
from tidewire.plans.criteria import Criteria
from tidewire.streaming import alerts, ingest


def entry(i, link, title="Quake hits town", at="2024-01-01T00:00:00"):
    return {"source_id": 1, "title": title, "summary": "s", "link": link, "guid": link, "published_at": at, "arrival": i}


def test_entries_are_seen_once_and_alerts_fire(spark, tmp_path):
    source, check = tmp_path / "in", tmp_path / "check"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(entry(i, f"https://x/{i % 3}")) for i in range(6)))
    hits = []

    def write(found, batch_id):
        hits.extend((r.alert_id, r.url) for r in found.select("alert_id", "url").collect())

    def run():
        stream = ingest.deduplicated(ingest.entries(spark, str(source)))

        def batch(rows, batch_id):
            a = ingest.articles(rows).selectExpr("*", "'' AS content", "50 AS importance", "'en' AS language")
            write(alerts.evaluate(a, {7: Criteria(keywords=("quake",)), 8: Criteria(keywords=("flood",))}, datetime(2024, 1, 2)), batch_id)

        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sorted(hits) == [(7, "https://x/0"), (7, "https://x/1"), (7, "https://x/2")]
    (source / "b.json").write_text("\n".join(json.dumps(entry(i, f"https://x/{i}")) for i in (1, 9)))
    run()  # a restart goes on where it was
    assert len(hits) == 4 and hits[-1] == (7, "https://x/9")


def test_hazard_steps_speak_once_for_each_bucket(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    polls = [("p", "1", 30, 1, 1), ("p", "1", 50, 2, 2), ("p", "1", 45, 2, 3), ("p", "2", 10, 0, 1)]
    names = ["provider", "external_id", "severity", "bucket", "seen"]
    (source / "a.json").write_text("\n".join(json.dumps(dict(zip(names, p))) for p in polls))
    stream = spark.readStream.schema("provider string, external_id string, severity int, bucket int, seen long").json(str(source))
    q = ingest.hazard_steps(stream).writeStream.format("memory").queryName("steps").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r)[1:4:2] for r in spark.table("steps").collect()) == [("1", 1), ("1", 2), ("2", 0)]


def test_clusters_of_stream_and_batch_agree(spark, tmp_path):
    words = ["quake", "tokyo", "flood", "paris", "vote", "strike", "storm"]
    rows = [(i, i * 3600, sorted({words[i % 7], words[i * 3 % 7], words[i * 5 % 4]})) for i in range(40)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(dict(zip(["id", "at", "tokens"], r))) for r in rows))
    stream = spark.readStream.schema("id long, at long, tokens array<string>").json(str(source))
    q = ingest.cluster_stream(stream).writeStream.format("memory").queryName("clusters").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: r.event for r in spark.table("clusters").collect()}
    batch = spark.createDataFrame(rows, "id long, at long, tokens array<string>").selectExpr("id", "timestamp_seconds(at) AS published_at", "tokens")
    assert got == {r.id: r.event for r in cluster(batch).collect()}
    assert len(set(got.values())) < 40
