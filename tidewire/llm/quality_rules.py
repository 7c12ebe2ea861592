"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, all in Spark expressions.

Words and pairs of neighbouring words fall into ``BUCKETS`` hashed buckets. Two multinomials over the
buckets are counted, one over a trusted target and one over the whole raw corpus. A text's score is the sum
of log p_target - log p_raw over its n-grams divided by their number, and every text whose
score is below a fixed threshold is rejected. Raw counts cover every document; the target is at
most ``max_trusted`` documents that labels mark as good, those of smallest hashed id.

Base counts follow the contract: windows of five words are compared by hash inside their text;
a word counts as repeated if any window over it occurs twice or more. Arrays that are read several times are
columns of their own projections, so they are made once.

Nulls: a null text has no words and fails the base rules; a null doc_id is judged like any other.
Texts without n-grams score 0. Repeated rows are counted and judged each. Without trusted
documents the ratio is 0 for all, and only the base rules decide. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

BUCKETS, WINDOW = 16384, 5
THRESHOLD = -0.12
#: Pseudo-count of every bucket in both multinomials.
SMOOTHING = 1.0


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, and h: the hash of each word."""
    words = docs.select("doc_id", "text", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(base.WORD), F.lit(0)).alias("words"))
    return words.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))


def buckets(h: str = "h") -> Column:
    """Buckets of all words and pairs of neighbours."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.transform(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.pmod(F.xxhash64(F.get(h, i - 1), F.get(h, i)), F.lit(BUCKETS)).cast("int"))
    return F.when(F.size(h) > 1, F.concat(one, two)).otherwise(one)


def base_counts(worded: DataFrame) -> DataFrame:
    """worded with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    n = F.size("h")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit(base.BLANKS))) > 0)
    step = worded.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count("text", F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "lines": lines,
        "windows": F.when(
            n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(WINDOW)]))
        ).otherwise(F.array().cast("array<bigint>")),
    }).drop("words", "text")
    step = step.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    step = step.withColumn(
        "placed",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("at"))))),
    ).drop("windows")
    again = lambda x, i: F.coalesce(F.get("placed", i + 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get("placed", i - 1)["w"] == x["w"], F.lit(False))
    step = step.withColumn("places", F.sort_array(F.transform(F.filter("placed", again), lambda x: x["at"]))).drop("placed")
    # A repeated window covers its five words, less what the one before it has covered.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("places", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("places")


def weights(worded: DataFrame, labels: DataFrame, max_trusted: int = 20_000) -> list[float]:
    """log p_target - log p_raw of each bucket; all 0 if nothing is trusted."""
    trusted = (
        labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
        .orderBy(F.xxhash64("id"), "id").limit(max_trusted).withColumn("trusted", F.lit(1))
    )
    counted = (
        worded.select("doc_id", buckets().alias("b"))
        .join(F.broadcast(trusted), F.col("doc_id") == F.col("id"), "left")
        # The outer form, as explode() lets the optimiser push size(b) > 0 below and make b once for each element.
        .select(F.explode_outer("b").alias("b"), "trusted").filter(F.col("b").isNotNull())
        .groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
    )
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counted.collect():  # one row for each bucket at most
        raw[row["b"]], target[row["b"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * BUCKETS
    t, r = sum(target) + SMOOTHING * BUCKETS, sum(raw) + SMOOTHING * BUCKETS
    return [round(math.log((a + SMOOTHING) / t) - math.log((b + SMOOTHING) / r), 6) for a, b in zip(target, raw)]


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_trusted: int = 20_000) -> DataFrame:
    """The base counts, base_failed, llr and kept of each document."""
    worded = with_words(docs)
    table = F.split(F.lit(",".join(map(str, weights(worded, labels, max_trusted)))), ",").cast("array<double>")
    mean = F.aggregate(buckets(), F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.greatest(2 * F.size("h") - 1, F.lit(1))
    counted = base_counts(worded.withColumn("llr", mean))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.drop("h").withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold))
