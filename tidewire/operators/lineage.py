"""The shared folder of a session: cutting the lineage of iterative operators, and tables that are made once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewire-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or _own_folder()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as written to a table in the shared folder: made once, and read again if an executor is lost."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark).rstrip('/')}/tidewire-made-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


#: Tables of more bytes than this, at most, are left as they are by ``spread``.
SPREAD_BYTES = 4 << 30


def _bytes(text: str) -> int:
    """A size of Spark's settings, such as 16m."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)i?b?\s*", text.lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def spread(scan: DataFrame) -> DataFrame:
    """A small scanned table on as many partitions as there are cores at least.

    A small file of one row group would otherwise be one task in all that follows; tables of many splits, or of splits that may hold more than
    SPREAD_BYTES together, stay as they are.
    """
    spark = scan.sparkSession
    cores, splits = spark.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    small = splits * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= SPREAD_BYTES
    return scan.repartition(cores) if splits < cores and small else scan


def stamp(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of the files at a path: changes whenever the table there is written anew."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


_MADE: dict[tuple, tuple] = {}


def made_once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], source: str | None = None) -> DataFrame:
    """A table that is written to the shared folder when it is first asked for in an application, and read from there.

    Its columns are real ones, so filters and column pruning reach the scan. If source, the path that it is made of, has other files
    than before, it is made anew.
    """
    key = (spark.sparkContext.applicationId, *key)
    now = stamp(spark, source) if source else ()
    if key not in _MADE or _MADE[key][2] != now:
        df, path = _written(make())
        _MADE[key] = path, df.schema, now
    path, schema, _ = _MADE[key]
    return spark.read.schema(schema).parquet(path)


def release_made(spark: SparkSession) -> None:
    """Delete all tables of ``made_once`` in this application."""
    for key in [k for k in _MADE if k[0] == spark.sparkContext.applicationId]:
        at = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop(key)[0])
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
