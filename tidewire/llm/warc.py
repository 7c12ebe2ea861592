"""Content-addressed WARC archive.

An archive is two tables in a shared folder. ``payloads`` holds the bytes of each distinct payload
once, under its SHA-256; ``headers`` holds the exact head of each record (its WARC header block and the HTTP
head that begins its content) and the SHA-256 of its payload. A record is put together again by joining
both: head, payload (none for a revisit), two line ends. On reading, every payload is
hashed again and a digest that doesn't match stops the job; ``read_back`` takes a response's payload out of
the rebuilt record, by the lengths the record states, and hashes that.

Records follow WARC/1.1: each has a date and an id of its own, responses and revisits hold an HTTP
response, revisits name the response's record, target and date. The page's id is kept in a field of our own, X-Page-ID.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is
the response and the others are revisits that refer to it; records with smaller payloads are all
responses.

Nulls: a null html is an empty payload, a null url the target about:blank; a null page_id ranks below
all others and is written as an empty id, which reads back as null. Repeated rows are records of
their own: copies of the response are responses. Empty tables give empty archives. Extra columns
are not read. Line ends inside a url are written as spaces.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CRLF = "\r\n"
#: The alphabet of Java's base 32 and, digit for digit, that of RFC 4648.
_FROM, _TO = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits, so four digits, at a time."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.upper(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _FROM, _TO)


def _head(kind: Column, date: str) -> Column:
    """The WARC header block and the HTTP head of a record."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    page = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record = lambda c: F.concat(F.lit("<urn:uuid:"), F.col(c), F.lit(">"))
    size = F.col("size").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + _CRLF), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", size), F.lit(_CRLF))
    content = F.octet_length(http) + F.when(kind == "revisit", F.lit(0)).otherwise(F.col("size"))
    refers = F.concat(
        line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", record("owner_record")), line("WARC-Refers-To-Target-URI", F.col("owner_url")),
        line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page-ID", page("owner")),
    )
    return F.concat(
        F.lit("WARC/1.1" + _CRLF), line("WARC-Type", kind), line("WARC-Record-ID", record("record_id")), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")), line("X-Page-ID", page("page_id")), F.when(kind == "revisit", refers).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", content.cast("string")), F.lit(_CRLF), http,
    )


def write(pages: DataFrame, root: str, least: int = 0, date: str | None = None) -> None:
    """Write pages (page_id, url, html) as an archive under root; date is that of the capture, else the present."""
    spark = pages.sparkSession
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), "[\r\n]+", " ")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    full.select("sha256", "payload").groupBy("sha256").agg(F.first("payload").alias("payload")).write.parquet(f"{root}/payloads")
    # Ids are drawn once and written, so that revisits can name them.
    slim = full.select("page_id", "url", "sha256", F.length("payload").cast("long").alias("size"), sha1_base32(F.col("payload")).alias("sha1"), F.uuid().alias("record_id"))
    schema = slim.schema
    slim.write.parquet(f"{root}/_records")
    slim = spark.read.schema(schema).parquet(f"{root}/_records")
    top = F.max(F.struct("page_id", "record_id", "url"))
    owners = slim.filter(F.col("size") >= least).groupBy("sha256").agg(top.alias("top"), F.count("*").alias("copies")).filter("copies > 1")
    owners = owners.select("sha256", F.lit(True).alias("shared"), F.col("top.page_id").alias("owner"), F.col("top.record_id").alias("owner_record"), F.col("top.url").alias("owner_url"))
    revisits = F.col("shared").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    kind = F.when(revisits, "revisit").otherwise("response")
    slim.join(owners, "sha256", "left").select("sha256", F.encode(_head(kind, date), "UTF-8").alias("header")).write.parquet(f"{root}/headers")


def payloads(spark: SparkSession, root: str) -> DataFrame:
    """(sha256, payload) with each payload's digest checked."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{root}/payloads")
    bad = F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.col("sha256")))
    return stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(bad.cast("binary")))


def headers(spark: SparkSession, root: str) -> DataFrame:
    """The head of each record and what it says."""
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return spark.read.schema("sha256 string, header binary").parquet(f"{root}/headers").select(
        "sha256", "header",
        number(field("X-Page-ID", "(-?\\d*)")).alias("page_id"),
        field("WARC-Target-URI", "([^\\r\\n]*)").alias("url"),
        field("WARC-Type", "(\\w+)").alias("record_type"),
        number(field("X-Refers-To-Page-ID", "(-?\\d*)")).alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("stated_digest"),
        field("Content-Length", "(\\d+)").cast("long").alias("content_length"),
    )


def _rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """headers, the payload each record stands for, and record: its exact bytes."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers(spark, root).join(payloads(spark, root), "sha256").withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))


def records(spark: SparkSession, root: str) -> DataFrame:
    """page_id and the exact bytes of each record."""
    return _rebuilt(spark, root).select("page_id", "record")


def read_back(spark: SparkSession, root: str) -> DataFrame:
    """What the archive says of each page: a response's payload is cut out of its rebuilt record, a revisit's is the stored one."""
    # The content is what the record's length states before the two line ends; the HTTP head inside ends at an empty line.
    content = F.expr("substring(record, length(record) - 4 - cast(content_length AS int) + 1, cast(content_length AS int))")
    http = F.locate(_CRLF * 2, F.decode(F.substring("content", 1, 200), "ISO-8859-1"))
    inside = F.expr("substring(content, http + 4)")
    whole = _rebuilt(spark, root).withColumn("content", F.when(F.col("record_type") == "response", content)).withColumn("http", http)
    whole = whole.withColumn("payload", F.when(F.col("record_type") == "response", inside).otherwise(F.col("payload")))
    whole = whole.select("page_id", "url", F.length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("digest"), "record_type", "refers_to", "stated_digest")
    bad = F.raise_error(F.concat(F.lit("a record states another digest than its payload's: "), F.col("stated_digest")))
    return whole.select(
        "page_id", "url", "payload_bytes",
        F.when(F.col("stated_digest") == F.col("digest"), F.col("digest")).otherwise(bad.cast("string")).alias("payload_digest"),
        "record_type", "refers_to",
    )
