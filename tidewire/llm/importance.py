"""Importance resampling towards a target distribution, over hashed runs of words.

Each text is scanned once, as a stream of words: a ring keeps the running CRC-32 states of the last n starts, each word
extends every state by a space and itself and begins one of its own, and each state so reached is the hash of a run of 1 to n words;
modulo the number of buckets it is a feature. A row's features are kept as bytes, two for each, in a table of
the shared folder, so no text is scanned twice. Corpus and target are counted by bucket (all rows of both), a
bucket's gain is 1000 times the log of its smoothed share in the target over that in the corpus, and a document weighs the floored
mean of the gains of its features. Weight plus seeded Gumbel noise is its score; of the documents with at least
``least_words`` words the share ``percent`` with the highest scores is drawn. That draws without replacement, in proportion to the
weights, and the places come from a sort by ranges.

Only the two tables of counts come to the driver: ``buckets`` rows each, whatever the input.

Nulls: a null text has no features. A null doc_id is hashed as '-' and comes after all others in ties. Repeated rows are
documents of their own, alike in score and next to each other in rank. An empty corpus gives an empty result, an empty target gains
that prefer rare buckets. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import placed
from . import base

BUCKETS = 10_000
_FEATURES = "doc_id long, n_words long, features binary"
#: Digits, letters in lower case and all bytes beyond ASCII stay, A-Z are lower-cased, all else parts words.
_CLEAN = bytes(c if c > 127 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))


def scan(text: bytes | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """Words of a text and the buckets of all its runs of 1 to n words."""
    words = (text or b"").translate(_CLEAN).split()
    crc, found, ring = zlib.crc32, [], []
    add, older = found.extend, n - 1
    for word in words:
        longer = b" " + word
        ring = [crc(longer, state) for state in ring[-older:]] if older else []
        ring.append(crc(word))
        add(ring)
    return len(words), np.array(found, dtype=np.uint32) % np.uint32(buckets)


def features(docs: DataFrame, n: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and features (buckets as little-endian integers of two bytes) of each row."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket takes two bytes")
    base.python_ready(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("features", pa.binary())])

    def run(batches):
        for batch in batches:
            counts, held = [], []
            for text in batch.column(1):
                words, found = scan(text.as_py(), n, buckets)
                counts.append(words)
                held.append(found.astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(held, pa.binary())], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _FEATURES)


def counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; each task counts its own first."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for held in batch.column(0):
                total += np.bincount(np.frombuffer(held.as_py(), dtype="<u2"), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths of a nat."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of rows of features."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for batch in batches:
            sizes, weights = [], []
            for held in batch.column(2):
                found = np.frombuffer(held.as_py(), dtype="<u2")
                sizes.append(len(found))
                weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], schema=kinds)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of each row of docs; target has a column text."""
    work = base.Scratch(docs.sparkSession, "importance")
    rows = work.keep(features(docs, n, buckets), "features")
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
    slim = weighed(rows, gains(counts(rows, buckets), counts(goal, buckets)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    slim = work.keep(slim.withColumn("score", F.col("weight") + noise), "scores")
    work.drop("features")
    able = F.col("n_words") >= least_words
    drawn = percent * slim.filter(able).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("n_words").asc()]
    ranked = placed(slim.filter(able), *order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")).cast("long")).drop("place")
    return ranked.unionByName(slim.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """The drawn rows of docs, whole; of rows that share a doc_id all are drawn if one is."""
    ids = resampled(docs, target, percent, least_words, n, buckets, seed).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__tw_id")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("__tw_id")), "left_semi")
