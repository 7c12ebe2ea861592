"""Structured Streaming: entries to deduplicated, enriched, clustered articles, and hazards with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.air import alert_bucket
from ..functions.similarity import cluster_tokens
from ..operators.coverage import corroboration
from ..operators.hazards import within
from ..operators.ops import entries_to_articles, is_http
from ..runtime import ship
from ..sources.store import Change, Snapshots

ENTRY = "source_id int, title string, summary string, link string, guid string, published_at timestamp, arrival long"


def entries(spark: SparkSession, path: str, per_trigger: int = 10) -> DataFrame:
    """A stream of feed entries from JSON files."""
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", per_trigger).json(path)


def deduplicated(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each link once, while its first sight is within the watermark."""
    ok = stream.filter(is_http(F.col("link")))
    return ok.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["link"])


def articles(batch: DataFrame) -> DataFrame:
    """A micro-batch of entries as articles with their cluster tokens."""
    rows = entries_to_articles(batch)
    return rows.withColumn("tokens", cluster_tokens(F.col("title"), F.concat_ws(" ", "title", "summary")))


def upsert(batch: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    """The rows of a batch that the store lacks."""
    return batch.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


#: Seconds after which a silent hazard is forgotten.
FORGET_S = 7 * 24 * 3600


def steps(polls: DataFrame, keys: tuple[str, ...], kept: tuple[str, ...] = ("severity",)) -> DataFrame:
    """Each row whose bucket rose above all that its keys have told, by keyed state over event time.

    polls: the keys, int columns kept, bucket, seen (epoch seconds, long). The state of a key is its highest bucket and
    latest sight; a row seen more than a week after that starts anew. The watermark lies a week back, so
    later polls than that are not read, and states that no poll can reach any more are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told, latest = state.get if state.exists else (-1, None)
        out = []
        for row in pd.concat(list(frames)).sort_values(["seen", "bucket"]).itertuples():
            if latest is not None and row.seen - latest > FORGET_S:
                told = -1
            latest = int(row.seen) if latest is None else max(latest, int(row.seen))
            if row.bucket > told:
                told = int(row.bucket)
                out.append((*key, *(int(getattr(row, c)) for c in kept), told, int(row.seen)))
        state.update((told, latest))
        state.setTimeoutTimestamp((latest + FORGET_S + 1) * 1000)
        yield pd.DataFrame(out, columns=[*keys, *kept, "bucket", "seen"])

    types = dict(polls.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{c} int" for c in kept), "bucket int", "seen long"])
    timed = polls.select(*keys, *kept, "bucket", "seen", F.timestamp_seconds("seen").alias("at")).withWatermark("at", f"{FORGET_S} seconds")
    return timed.groupBy(*keys).applyInPandasWithState(step, schema, "told int, latest long", "append", "EventTimeTimeout")


def hazard_steps(polls: DataFrame) -> DataFrame:
    """Each poll row of a hazard that is new or whose bucket rose above all told before.

    polls: provider, external_id, severity, bucket, seen (long).
    """
    return steps(polls, ("provider", "external_id"))


def ring_steps(fires: DataFrame, locations: DataFrame) -> DataFrame:
    """Fires inside a location's ring, once for each location, fire and bucket.

    fires: a stream of hazard_id, kind, lat, lon, severity, seen; locations: a table of location_id, lat, lon, fire_km.
    """
    found = within(locations, fires.filter("kind = 'wildfire'"), F.col("fire_km"))
    bucket = alert_bucket(F.col("severity"), F.lit("wildfire")).alias("bucket")
    return steps(found.select("location_id", "hazard_id", "severity", bucket, "seen"), ("location_id", "hazard_id"))


def corroborated(stream: DataFrame, store: str, write, checkpoint: str, hours: int = 12, keep_hours: int | None = None):
    """Each micro-batch of articles (id, source_id, published_at, tokens) with its corroborating newsrooms, given to write(found, batch_id).

    The headlines are kept in the folder store by cells of time and batch, so a batch looks in all earlier ones and itself, and lists and reads
    only the cells that its own articles can see. A batch that is run again replaces its own parts. With keep_hours, cells that are older than that
    behind the newest one are deleted; articles that come later than that find less.
    """
    window = hours * 3600

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark, slim = rows.sparkSession, rows.select("id", "source_id", "published_at", "tokens")
        cell = F.floor(F.unix_seconds(F.col("published_at").cast("timestamp")) / window)
        parts = slim.filter("published_at IS NOT NULL").withColumns({"cell": cell, "batch": F.lit(batch_id)})
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell", "batch").parquet(store)
        first, last = parts.agg(F.min("cell"), F.max("cell")).first()
        if first is None:
            return
        at = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        cells = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(at) if f.getPath().getName().startswith("cell=")]
        near = [f"{store}/cell={c}" for c in cells if first - 1 <= c <= last]
        held = spark.read.schema(slim.schema.add("cell", "long").add("batch", "long")).option("basePath", store).parquet(*near).filter(F.col("batch") <= batch_id)
        write(corroboration(slim, hours=hours, earlier=held.drop("cell", "batch")), batch_id)
        for c in cells:
            if keep_hours is not None and c < max(cells) - -(-keep_hours // hours):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{store}/cell={c}"), True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def unseen_links(rows: DataFrame, links: Snapshots, stream: str, batch_id: int) -> DataFrame:
    """The rows of a batch whose link no earlier batch had, however long ago, each link once.

    links has a table ``links`` (link, batch) with key link, dealt into buckets: only those that the batch's links fall into are read and written. The batch is
    named in the commit, so a batch that is run again gets the rows it got before.
    """
    once = rows.filter(is_http(F.col("link"))).dropDuplicates(["link"])
    new = once.select("link", F.lit(batch_id).cast("long").alias("batch"))
    links.commit({"links": Change(new, lambda old: old.unionByName(new.join(old, "link", "left_anti")))}, stream, batch_id)
    mine = links.read("links").filter(F.col("batch") == batch_id).select("link")
    return once.join(mine, "link", "left_semi")


def deduplicated_for_good(stream: DataFrame, links: Snapshots, write, checkpoint: str, name: str = "entries"):
    """Each link once over all batches, given to write(rows, batch_id)."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: write(unseen_links(rows, links, name, batch_id), batch_id)).option("checkpointLocation", checkpoint)


def ramped(full: int, since_start_s: float, first: int = 10, ramp_s: float = 300.0) -> int:
    """How many sources a trigger takes: a few at the start, all after the ramp, in proportion between."""
    share = min(1.0, max(0.0, since_start_s) / ramp_s)
    return full if full <= first else round(first + (full - first) * share)


def cluster_stream(stream: DataFrame, window_hours: int = 72) -> DataFrame:
    """id and event of each article by the exact greedy fold with keyed state; one key, as each step depends on all before.

    Columns: id, at (seconds), tokens. The state is the fold's live events; it is as large as the window, whatever has run through.
    """
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        from tidewire.operators.clusters import EventFold

        window = window_hours * 3600
        fold = EventFold.from_json(state.get[0], window) if state.exists else EventFold(window)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        placed = [fold.place(set(tokens.split()), int(at)) for tokens, at in zip(rows["tokens"], rows["at"])]
        state.update((fold.to_json(),))
        yield pd.DataFrame({"id": rows["id"].astype("int64"), "event": placed})

    keyed = stream.select("id", "at", F.array_join("tokens", " ").alias("tokens"), F.lit(0).alias("one"))
    return keyed.groupBy("one").applyInPandasWithState(step, "id long, event long", "live string", "append", "NoTimeout")
