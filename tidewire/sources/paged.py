"""The data source ``tw-pages``: recorded answers of paged providers, each poll all or nothing.

A recording is ``path/provider/poll/page``: one JSON file for each page of a poll, with its number (``page``, from 1), the number of pages
(``pages``) and its ``results``. Reading gives a row for each result, but only of polls that are whole: if a page is missing, torn or counts
otherwise, the poll gives no row at all, as half a list of stations would make the others look gone.

    spark.dataSource.register(PagedAnswers)
    spark.read.format("tw-pages").load(path)         # a partition for each poll
    spark.readStream.format("tw-pages").load(path)   # offsets: the last poll read of each provider

A task checks a poll page by page, then reads it again row by row, so it holds one page. In a stream a poll is read once it is whole, and polls of a
provider in the order of their names; one that is not whole is waited for until a later poll of the provider is whole, then it is passed over.
"""

from __future__ import annotations

import json
import re

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "provider string, poll string, page int, place int, body string"


def _store(path: str):
    from pyarrow import fs

    if re.match(r"file:/[^/]", path):
        path = path.replace("file:", "file://", 1)
    return fs.FileSystem.from_uri(path)


def _folders(store, path: str) -> list[str]:
    from pyarrow import fs

    return sorted(f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.type == fs.FileType.Directory and not f.base_name.startswith(("_", ".")))


def _pages(store, folder: str):
    """The pages of a poll in order of their numbers, one at a time; ValueError if one isn't as it should be."""
    from pyarrow import fs

    files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", "."))]
    at = {}
    for file in files:
        with store.open_input_stream(file) as f:
            found = json.loads(f.read())
        if not isinstance(found, dict) or not isinstance(found.get("results"), list):
            raise ValueError(f"{file} is no page")
        at[found.get("page")] = file, found.get("pages")
        del found
    if not at or sorted(at, key=str) != sorted(range(1, len(files) + 1), key=str) or {n for _, n in at.values()} != {len(files)}:
        raise ValueError(f"{folder} isn't whole")
    for page in range(1, len(files) + 1):
        with store.open_input_stream(at[page][0]) as f:
            yield page, json.loads(f.read())["results"]


def whole(store, folder: str) -> bool:
    try:
        next(_pages(store, folder))
    except (ValueError, OSError):
        return False
    return True


def _label(folder: str) -> str:
    """The name that a folder stands for; Spark's writers put the column's name before it."""
    return folder.partition("=")[2] or folder


class Poll(InputPartition):
    def __init__(self, path: str, provider: str, poll: str):
        super().__init__(f"{provider}/{poll}")
        self.path, self.provider, self.poll = path, provider, poll

    def rows(self):
        store, path = _store(self.path)
        folder = f"{path}/{self.provider}/{self.poll}"
        if not whole(store, folder):
            return
        for page, results in _pages(store, folder):
            for place, body in enumerate(results):
                yield _label(self.provider), _label(self.poll), page, place, json.dumps(body, ensure_ascii=False, separators=(",", ":"))


_NOTHING = InputPartition("")


def _polls(path: str) -> dict[str, list[str]]:
    store, root = _store(path)
    return {p.rsplit("/", 1)[-1]: [f.rsplit("/", 1)[-1] for f in _folders(store, p)] for p in _folders(store, root)}


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Poll(self.path, provider, poll) for provider, polls in _polls(self.path).items() for poll in polls] or [_NOTHING]

    def read(self, partition):
        return partition.rows() if isinstance(partition, Poll) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = _store(self.path)
        out = {}
        for provider, polls in _polls(self.path).items():
            done = next((p for p in reversed(polls) if whole(store, f"{root}/{provider}/{p}")), None)
            if done is not None:
                out[provider] = done
        return out

    def partitions(self, start: dict, end: dict):
        known = _polls(self.path)
        return [Poll(self.path, provider, poll) for provider, last in sorted(end.items()) for poll in known.get(provider, []) if start.get(provider, "") < poll <= last] or [_NOTHING]

    def read(self, partition):
        return partition.rows() if isinstance(partition, Poll) else iter(())

    def commit(self, end: dict) -> None:
        """Recordings stay where they are."""


class PagedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tw-pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark) -> None:
    from ..runtime import ship

    ship(spark)
    spark.dataSource.register(PagedAnswers)


def record(results, path: str, size: int = 1000) -> None:
    """Write rows (provider, poll, body) as a recording, in pages of size results; body is JSON. Results keep no order but that of their text."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    each = Window.partitionBy("provider", "poll").orderBy("body")
    placed = results.withColumn("page", F.floor((F.row_number().over(each) - 1) / size) + 1)
    pages = placed.groupBy("provider", "poll", "page").agg(F.sort_array(F.collect_list("body")).alias("results"))
    total = placed.groupBy("provider", "poll").agg(F.max("page").alias("pages"))
    text = F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit(',"pages":'), F.col("pages").cast("string"), F.lit(',"results":['), F.array_join("results", ","), F.lit("]}"))
    pages.join(total, ["provider", "poll"]).repartition("provider", "poll", "page").select("provider", "poll", text.alias("value")).write.option("maxRecordsPerFile", 1).partitionBy("provider", "poll").text(path)
