"""What the corpus operators share: table access, the scratch folder, fixed hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_folder, spread
from ..runtime import ship

#: White space of a word boundary, as characters and as a Java/RE2 character class.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch that is sent to a Python worker.
ARROW_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def python_ready(spark: SparkSession) -> None:
    """Send this package to the workers, once a context, and hold Arrow batches to a small size."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def crc_mod(key: Column, n: int) -> Column:
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % n


_TRACKED: list[list["Scratch"]] = []


@contextmanager
def released():
    """Deletes, at its end, the tables that operators made inside: for callers who have written their result by then."""
    _TRACKED.append([])
    try:
        yield
    finally:
        for work in _TRACKED.pop():
            work.drop("")


class Scratch:
    """Tables in the shared folder named by spark.checkpoint.dir.

    They cut the lineage, so a lost executor costs a reread of files that every
    executor sees. Only where the setting is missing and Spark runs on one machine is a folder of our own set.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tables = spark, {}
        self.root = f"{shared_folder(spark).rstrip('/')}/tidewire-{tag}-{uuid.uuid4().hex}"
        for opened in _TRACKED[-1:]:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}".rstrip("/")

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Write df and return it as read from the written files."""
        path, schema = self.path(name), df.schema
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
        """Write df, already dealt by keys into n partitions, as n sorted buckets; joins and groups by keys then need no exchange."""
        table = self.tables[name] = f"tw_{uuid.uuid4().hex}"
        df.write.option("path", self.path(name)).bucketBy(n, *keys).sortBy(*keys).format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Delete tables that no result reads any more; "" is all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in [self.tables.pop(n) for n in list(self.tables) if n in names or "" in names]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
