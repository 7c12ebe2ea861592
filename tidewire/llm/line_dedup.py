"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` is a store of runs. A run has one row for each line key of a batch: its 128-bit hash,
the number of documents that hold it and, if no earlier run knew the key, the largest document
holding it; rows are dealt into buckets by hash and sorted in each. A new batch is reduced to its keys,
merge-joined with the runs (a key that none of them has is the batch's own and gets an
owner; a known key only adds its count) and written as a run of level 0. When a level has
``fanout`` runs they are merged into one of the next level, so a batch meets few runs. All runs have the same
buckets, so joins with them and merges of them exchange nothing; only a new batch is dealt out.
A batch is a fixed share of the documents (a quarter): every further batch reads all runs once more,
so few large batches cost least, and a batch needs no more memory than its own shuffle.

Batches come in falling order of doc_id, so the owner of a key is the largest document with it.
A key of at least ``min_chars`` code points, found in at least ``min_docs`` documents, then loses
its lines everywhere but in its owner.

Nulls: a null or empty text is one empty line. Rows with a null doc_id keep all their lines and
count for no key. Repeated rows of a doc_id count as one document, and the owner's rows all keep
the line. Empty tables give empty results. Extra columns pass through ``dedup_lines`` unread, but for those
named n_lines and n_dropped, which its counts replace.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

_RUN = "key binary, n_docs long, owner long"


def _hash(line: str, min_chars: int) -> bytes | None:
    core = line.strip(base.BLANKS)
    if len(core) < min_chars:
        return None
    return xxhash.xxh3_128_digest(core.encode("utf-8", "replace").lower())


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key) for each distinct key of each row, of lines of at least min_chars code points."""
    base.python_ready(docs.sparkSession)
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {_hash(line, min_chars) for line in (text or "").split("\n")} - {None}
                ids += [doc] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, key binary")


class LineRuns:
    """Levelled sorted runs of line hashes in the shared scratch folder, all dealt into the same buckets."""

    def __init__(self, spark: SparkSession, work: base.Scratch, fanout: int = 3):
        self.spark, self.work, self.fanout = spark, work, fanout
        # A run has one sorted file for each bucket; with this, its scan says so, and merges don't sort it again.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self._made = 0

    def _write(self, rows: DataFrame, level: int) -> tuple[str, DataFrame]:
        self._made += 1
        name = f"run-{level}-{self._made}"
        return name, self.work.bucketed(rows.select("key", "n_docs", "owner"), name, self.buckets, "key")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One row for each key of the runs; as they have the same buckets, nothing is exchanged."""
        rows = reduce(DataFrame.unionByName, runs)
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (doc_id, key) whose documents are smaller than all before."""
        batch = keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("owner"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            batch = batch.join(run.select("key", F.lit(True).alias(f"in_{i}")).hint("merge"), "key", "left")
            known = known | F.col(f"in_{i}").isNotNull()
        batch = batch.withColumn("owner", F.when(~known, F.col("owner")))
        self.levels[0].append(self._write(batch, 0))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.merged([run for _, run in old]), level + 1))
            self.levels[level] = []
            self.work.drop(*(name for name, _ in old))
            level += 1

    def keys(self) -> DataFrame:
        """(key, n_docs, owner), one row for each key."""
        return self.merged(self.runs()) if self.runs() else self.spark.createDataFrame([], _RUN)


def dropped_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc_id, gone): the keys whose lines a document loses; documents that lose nothing have no row."""
    spark = docs.sparkSession
    work = base.Scratch(spark, "lines")
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + F.when(F.col("doc_id") > cut, 1).otherwise(0)
    keys = work.keep(line_keys(docs, min_chars).withColumn("batch", batch), "keys", ("batch",))
    runs = LineRuns(spark, work, fanout)
    for i in range(len(set(cuts)), -1, -1):
        runs.add(keys.filter(F.col("batch") == i).select("doc_id", "key"))
    shared = runs.keys().filter(F.col("n_docs") >= min_docs).select("key", "owner")
    return (
        keys.join(shared, "key")
        .filter("doc_id <> owner")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("gone"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3, counts: bool = True) -> DataFrame:
    """docs with text replaced by the kept lines; counts adds n_lines and n_dropped (replacing columns of that name)."""
    gone = dropped_keys(docs, min_chars, min_docs, batches, fanout).withColumnsRenamed({"doc_id": "__tw_id", "gone": "__tw_gone"})

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops):
            lines = (text or "").split("\n")
            kept = lines
            if drop is not None:
                drop = {bytes(k) for k in drop}
                kept = [x for x in lines if _hash(x, min_chars) not in drop]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    names = ("text", "n_lines", "n_dropped") if counts else ("text",)
    return (
        docs.join(gone, F.col("doc_id").cast("long") == F.col("__tw_id"), "left")
        .withColumn("__tw_cut", cut("text", "__tw_gone"))
        .withColumns({name: F.col(f"__tw_cut.{name}") for name in names})
        .drop("__tw_id", "__tw_gone", "__tw_cut")
    )
