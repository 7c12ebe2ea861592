"""Feeds: RSS files as entries, fetch outcomes, reliability pages."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import ship

ITEM = "title string, description string, link string, guid string, pubDate string"
#: Seconds that a busy server is left alone, fixed values.
LEAST_BACK_OFF, MOST_BACK_OFF = 900, 3600
#: Phrases of a reliability list, worst rank last; fewer rated domains than LEAST_DOMAINS are a failed reading.
STATUS_RANKS = (("generally reliable", 1), ("no consensus", 2), ("generally unreliable", 3), ("deprecated", 4), ("blacklisted", 5))
LEAST_DOMAINS = 100
#: Hosts that a list cites in every row without rating them, fixed values.
UNRATED = ("wikipedia.org", "wikimedia.org", "wikidata.org", "wiktionary.org", "wikinews.org", "wikiquote.org", "wikisource.org", "archive.org", "web.archive.org", "doi.org", "worldcat.org", "google.com")


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files: source file, title, summary, link, guid, published_at, in document order."""
    items = spark.read.format("xml").schema(ITEM).option("rowTag", "item").load(path).select("*", F.col("_metadata.file_path").alias("file"))
    at = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")).cast("timestamp_ntz")
    return items.select("file", "title", F.col("description").alias("summary"), "link", F.coalesce("guid", "link").alias("guid"), at.alias("published_at"), F.monotonically_increasing_id().alias("arrival"))


def fetch_status(code: Column, body: Column, retry_after: Column) -> Column:
    """(status, wait): what an answer means and for how many seconds to leave the host alone."""
    page = F.lower(F.substring(F.ltrim(body), 1, 15)).rlike("^<(!doctype html|html)")
    wait = F.greatest(F.lit(LEAST_BACK_OFF), F.least(F.lit(MOST_BACK_OFF), F.coalesce(retry_after, F.lit(0))))
    status = F.when(code == 304, "ok: unchanged").when(code == 403, "retry as browser").when(code == 429, "back off").when(code >= 400, F.concat(F.lit("error: "), code.cast("string"))).when(page, "error: not a feed").otherwise("ok")
    return F.struct(status.alias("status"), F.when(code == 429, wait).otherwise(0).alias("wait"))


def next_state(failures: Column, idle: Column, ok: Column, new_items: Column, produced: Column, added_by: Column, most_failures: int = 5) -> Column:
    """A source after a poll: failures, idle polls, and keep, disable or remove after too many failures."""
    after = F.when(ok, 0).otherwise(failures + 1)
    fate = F.when(after < most_failures, "keep").when(~produced & (added_by != "user"), "remove").otherwise("disable")
    return F.struct(after.alias("failures"), F.when(ok & (new_items > 0), 0).when(ok, idle + 1).otherwise(idle).alias("idle"), fate.alias("fate"))


#: Comments, the tags that make rows and links, other tags, text.
_MARKUP = re.compile(r"<!--.*?-->|<(?P<end>/?)(?P<tag>table|tr|a)\b(?P<rest>[^>]*)>|</?[a-z!?][^>]*>|(?P<text>[^<]+|<)", re.I | re.S)
_LINK = re.compile(r"""(?<![\w-])href\s*=\s*(?:"(http[^"]*)"|'(http[^']*)'|(http[^\s>]*))""", re.I)


def table_rows(page: str | None) -> list[dict]:
    """Text and links of each table row; a row ends with its mark, the next row of its table or the table, and a table inside a row has rows of its own."""
    done: list[dict] = []
    tables: list[dict | None] = [None]  # the open row of each table around a place; the first is for rows outside tables

    def close() -> None:
        if (row := tables[-1]) is not None:
            done.append({"text": " ".join(unescape("".join(row["text"])).split()), "links": row["links"]})
            tables[-1] = None

    for m in _MARKUP.finditer(page or ""):
        tag, row = (m["tag"] or "").lower(), tables[-1]
        if tag == "table" and not m["end"]:
            tables.append(None)
        elif tag == "table":
            close()
            if len(tables) > 1:
                tables.pop()
        elif tag == "tr":
            close()
            if not m["end"]:
                tables[-1] = {"text": [], "links": []}
        elif row is not None and tag == "a" and not m["end"]:
            row["links"] += [unescape(next(filter(None, found))) for found in _LINK.findall(m["rest"])]
        elif row is not None and m["text"]:
            row["text"].append(m["text"])
    return done


def reliability(pages: DataFrame, least: int = LEAST_DOMAINS) -> DataFrame | None:
    """domain, rank and status of the linked domains of a list's table rows, the worst status winning; None if too few."""
    from ..operators.ops import blocked
    from ..plans.criteria import domain_of

    ship(pages.sparkSession)

    @F.pandas_udf("array<struct<text:string,links:array<string>>>")
    def rows(html: pd.Series) -> pd.Series:
        return html.map(table_rows)

    flat = pages.select(F.explode(rows("html")).alias("r")).select(F.lower("r.text").alias("text"), F.explode("r.links").alias("url"))
    rank, status = F.lit(None).cast("int"), F.lit(None).cast("string")
    for phrase, n in STATUS_RANKS:
        rank, status = F.when(F.contains("text", F.lit(phrase)), n).otherwise(rank), F.when(F.contains("text", F.lit(phrase)), phrase).otherwise(status)
    flat = flat.select(domain_of(F.col("url")).alias("domain"), rank.alias("rank"), status.alias("status")).filter("domain <> '' AND rank IS NOT NULL")
    flat = flat.filter(~blocked(F.col("domain"), list(UNRATED)))
    w = Window.partitionBy("domain").orderBy(F.desc("rank"))
    found = flat.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return found if found.limit(least).count() == least else None
