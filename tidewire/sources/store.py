"""Stored tables that change by whole commits: copy-on-write buckets under a versioned manifest.

A table's rows are dealt into a fixed number of buckets by a hash of its key; a bucket is a folder of Parquet files that is never changed. A
commit reads only the buckets that its keys fall into, writes them anew in one Spark job for each table, and then puts one manifest in place: for every table,
the folder of each bucket. The manifest's name is its version and is made by a rename that fails if it exists, so of two writers one
starts again, and readers see all tables before or all after. The manifest also holds the last batch of each stream: a batch that is
handed in again, after a crash for example, changes nothing. What a crash leaves behind is in no manifest; ``clean`` deletes it.

Folders and manifest are bounded by the number of buckets, not by the rows. A hot key is one row; rows without a key (null) are
keys of their own like any other value.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit has taken the version."""


@dataclass(frozen=True)
class Change:
    """What happens to a table: keys (rows of the key columns) tell the buckets, then makes their new rows of their old ones."""

    keys: DataFrame
    then: Callable[[DataFrame], DataFrame]


def same_key(left: DataFrame, right: DataFrame, key: tuple[str, ...]) -> Column:
    """Equal keys, nulls too."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in key])


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 32):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        at = self._path(self.root)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())

    # Manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/_manifest/{version:010}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, the last if none is given; version 0 has no tables."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "tables": {}, "batches": {}}
        text = self.spark.read.text(self._manifest(version), wholetext=True).first()[0]
        return json.loads(text)

    def _put(self, manifest: dict) -> None:
        final, draft = self._manifest(manifest["version"]), f"{self.root}/_draft/{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(f"{self.root}/_manifest"))
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(draft), self._path(final), none)
        except Exception as e:
            self._fs.delete(self._path(draft), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is taken") from e
            raise

    # Tables

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version), table)

    def _rows(self, manifest: dict, table: str, only: set[int] | None = None) -> DataFrame:
        known = manifest["tables"][table]
        schema = StructType.fromJson(known["schema"])
        folders = [f"{self.root}/{f}" for b, f in known["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, key: list[str]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _written(self, table: str, rows: DataFrame, key: list[str]) -> dict[str, str]:
        folder = f"{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn("__bucket", self._bucket(key))
        dealt.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        found = self._fs.listStatus(self._path(f"{self.root}/{folder}"))
        names = [f.getPath().getName() for f in found if f.isDirectory()]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("__bucket=")}

    def create(self, table: str, rows: DataFrame, key: list[str]) -> int:
        """A new table, or all rows of one anew."""
        return self._commit(lambda now: {table: {"schema": json.loads(rows.schema.json()), "key": key, "folders": self._written(table, rows, key)}})

    def commit(self, changes: dict[str, Change] | Callable[[dict], dict[str, Change]], stream: str | None = None, batch_id: int | None = None, tries: int = 5) -> int:
        """Apply changes to several tables at once; the version that holds them. A batch that a stream has handed in before changes nothing.

        changes may be a function of the manifest that the commit is based on, for changes that read what is stored.
        """

        def make(now: dict) -> dict:
            out = {}
            for table, change in (changes(now) if callable(changes) else changes).items():
                known = now["tables"][table]
                key = known["key"]
                touched = {r[0] for r in change.keys.select(self._bucket(key)).distinct().collect()}  # at most the number of buckets
                if not touched:
                    continue
                old = self._rows(now, table, touched)
                written = self._written(table, change.then(old).select(*old.columns), key)
                if strange := set(map(int, written)) - touched:
                    raise ValueError(f"rows of {table} have keys outside the change: buckets {sorted(strange)}")
                out[table] = known | {"folders": {b: f for b, f in known["folders"].items() if int(b) not in touched} | written}
            return out

        return self._commit(make, stream, batch_id, tries)

    def _commit(self, make: Callable[[dict], dict], stream: str | None = None, batch_id: int | None = None, tries: int = 5) -> int:
        while True:
            now = self.manifest()
            if stream is not None and now["batches"].get(stream, -1) >= batch_id:
                return now["version"]
            after = {"version": now["version"] + 1, "tables": now["tables"] | make(now), "batches": now["batches"] | ({} if stream is None else {stream: batch_id})}
            try:
                self._put(after)
                return after["version"]
            except Conflict:
                tries -= 1
                if not tries:
                    raise

    # Changes

    def upsert(self, table: str, rows: DataFrame, stream: str | None = None, batch_id: int | None = None) -> int:
        """Rows replace those of equal keys and are added where there are none; of rows with equal keys the largest one counts."""
        key = self.manifest()["tables"][table]["key"]
        newest = rows.groupBy(*key).agg(F.max(F.struct(*[c for c in rows.columns if c not in key])).alias("__row")).select(*key, "__row.*")

        def then(old: DataFrame) -> DataFrame:
            return old.join(newest, same_key(old, newest, key), "left_anti").unionByName(newest.select(*old.columns))

        return self.commit({table: Change(newest, then)}, stream, batch_id)

    def cascade(self, gone: dict[str, DataFrame], stream: str | None = None, batch_id: int | None = None) -> int:
        """Delete from each table the rows with these keys, all in one commit."""

        def without(keys: DataFrame) -> Change:
            return Change(keys, lambda old: old.join(keys, same_key(old, keys, keys.columns), "left_anti"))

        return self.commit({table: without(keys) for table, keys in gone.items()}, stream, batch_id)

    def clean(self, keep: int = 1) -> None:
        """Delete manifests but the last ones, and all folders that no manifest left names. Not while a commit runs."""
        versions = self.versions()
        for v in versions[: len(versions) - keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        used = {f.rsplit("/", 1)[0] for v in versions[len(versions) - keep :] for t in self.manifest(v)["tables"].values() for f in t["folders"].values()}
        for table in [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)) if f.isDirectory() and not f.getPath().getName().startswith("_")]:
            for f in self._fs.listStatus(self._path(f"{self.root}/{table}")):
                if f"{table}/{f.getPath().getName()}" not in used:
                    self._fs.delete(f.getPath(), True)
        self._fs.delete(self._path(f"{self.root}/_draft"), True)


def delete_articles(store: Snapshots, ids: DataFrame, tables: dict[str, str], stream: str | None = None, batch_id: int | None = None) -> int:
    """Remove articles (ids: id) and, in the same commit, the rows of other tables that point at them; tables: the column of each table that names an article.

    A table whose key isn't its article column is read for the keys of such rows.
    """

    def changes(now: dict) -> dict[str, Change]:
        out = {}
        for table, column in tables.items():
            key = now["tables"][table]["key"]
            named = ids.select(F.col("id").alias(column))
            keys = named if key == [column] else store._rows(now, table).join(named, column, "left_semi").select(*key).distinct()
            out[table] = Change(keys, lambda old, named=named, column=column: old.join(named, column, "left_anti"))
        return out

    return store.commit(changes, stream, batch_id)


def merge_hazards(store: Snapshots, polled: DataFrame, at: Column, table: str = "hazards", stream: str | None = None, batch_id: int | None = None) -> int:
    """The upsert of a poll into the stored hazards, on (provider, external_id)."""
    from ..operators.hazards import merge

    return store.commit({table: Change(polled.select("provider", "external_id"), lambda old: merge(old, polled, at))}, stream, batch_id)
