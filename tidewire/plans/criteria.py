"""Criteria: a set of optional predicates, all of which must hold, compiled to one Spark predicate."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, terms
from . import bql

LEDE_WORDS = 60


@dataclass(frozen=True)
class Criteria:
    keywords: tuple = ()
    exclude_keywords: tuple = ()
    query: str = ""
    queries: tuple = ()
    countries: tuple = ()
    scopes: tuple = ()
    platforms: tuple = ()
    categories: tuple = ()
    languages: tuple = ()
    source_ids: tuple = ()
    min_importance: int = 0
    min_mentions: int = 0
    min_sources: int = 0
    search_translations: bool = False
    passing_mentions: bool = False
    hours: float = 0
    date_from: str = ""
    date_to: str = ""
    hide_stale: bool = False
    stale_hours: float = 72
    geo: dict | None = None
    geos: tuple = ()
    auto_coverage: bool = False
    portable: bool = field(default=False, compare=False)

    @classmethod
    def from_json(cls, text: str | dict) -> Criteria:
        """Criteria of a JSON object; keys it doesn't know are left out."""
        raw = json.loads(text) if isinstance(text, str) else text
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known and v is not None})

    def all_queries(self) -> list[str]:
        return [q for q in (*self.queries, self.query) if q and q.strip()]


#: Canned criteria of the home view: name, criteria, order, grouped; fixed values.
HOME = (
    ("top", {"min_importance": 55}, "importance", True),
    ("breaking", {"hours": 6, "min_importance": 40}, "importance", False),
    ("conflict", {"categories": ["conflict", "disaster"]}, "newest", True),
    ("politics", {"categories": ["politics"]}, "newest", False),
    ("business", {"categories": ["business", "economy"]}, "newest", False),
    ("scitech", {"categories": ["science", "technology"]}, "newest", False),
    ("social", {"platforms": ["reddit", "mastodon", "bluesky", "youtube"]}, "newest", False),
)


def _joined(*columns: str) -> Column:
    return F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns])


def lede(content: Column) -> Column:
    words = F.slice(F.regexp_extract_all(content, F.lit(r"(\S+)"), F.lit(1)), 1, LEDE_WORDS)
    return F.array_join(words, " ")


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def domain_of(url: Column) -> Column:
    """The network place of a URL, port and user kept, without a leading www."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", ""), F.lit(""))


def text_fields(columns: list[str], translations: bool = False) -> dict[str, Column]:
    """The searched texts of an article with these columns."""
    extra = ("translated",) if translations and "translated" in columns else ()
    return {
        "all": _joined("title", "summary", "content", *extra),
        "headline": _joined("title", "summary", *extra),
        "text": _joined("content", *extra),
        "lede": F.concat_ws("\n", _joined("title", "summary"), lede(F.coalesce("content", F.lit(""))), *[F.col(c) for c in extra]),
        "source": F.coalesce("name", F.lit("")) if "name" in columns else F.lit(""),
        "site": host_of(F.col("url")) if "url" in columns else F.lit(""),
    }


def _day(text: str) -> datetime | None:
    return datetime.fromisoformat(text[:10]) if text else None


def predicate(c: Criteria, columns: list[str], now: datetime, centroids: dict | None = None) -> Column:
    """One predicate over articles joined with sources (and events, translations where asked for).

    Cheap conditions come first, as the author's order is usually kept; nothing depends on it.
    """
    texts, parts = text_fields(columns, c.search_translations), []
    published = F.col("published_at")
    if c.hours:
        parts.append(published.isNull() | (published >= F.lit(now - timedelta(hours=c.hours)).cast("timestamp_ntz")))
    try:  # a malformed first day leaves the last one unread too
        if first := _day(c.date_from):
            parts.append(published >= F.lit(first).cast("timestamp_ntz"))
        if last := _day(c.date_to):
            parts.append(published < F.lit(last + timedelta(days=1)).cast("timestamp_ntz"))
    except ValueError:
        pass
    if c.min_importance:
        parts.append(F.col("importance") >= c.min_importance)
    if c.source_ids:
        parts.append(F.col("source_id").isin(*c.source_ids))
    if c.scopes:
        parts.append(F.coalesce(F.col("scope").isin(*c.scopes), F.lit(False)))
    if c.platforms:
        # A source without a platform is news; a row without a source is of none.
        sourced = F.lit(False)
        for name in ("platform", "name", "scope"):
            sourced = sourced | F.col(name).isNotNull() if name in columns else sourced
        parts.append(sourced & F.coalesce(F.nullif("platform", F.lit("")), F.lit("news")).isin(*c.platforms))
    if c.languages:
        parts.append(F.col("language").isin(*c.languages))
    if c.countries:
        if "places" in columns:
            held = F.transform(F.coalesce("places", F.array().cast("array<struct<name:string,country:string,lat:double,lon:double,kind:string>>")), lambda p: p["country"])
            parts.append(F.arrays_overlap(F.array_union(held, F.array("country")), F.array(*map(F.lit, c.countries))))
        else:
            parts.append(F.col("country").isin(*c.countries))
    if c.categories:
        parts.append(F.arrays_overlap("categories", F.array(*map(F.lit, c.categories))))
    if c.min_sources > 1:
        enough = F.when(F.col("source_ids").isNull(), F.coalesce("article_count", F.lit(1))).otherwise(F.size("source_ids")) >= c.min_sources
        parts.append(F.col("event_id").isNotNull() & enough)
    if c.hide_stale:
        parts.append(F.col("event_id").isNull() | (F.col("updated_at") >= F.lit(now - timedelta(hours=c.stale_hours)).cast("timestamp_ntz")))
    keywords, excluded, queries = [k for k in c.keywords if k.strip()], [k for k in c.exclude_keywords if k.strip()], c.all_queries()
    plain = [] if c.passing_mentions else plain_terms(c)
    if keywords or excluded or queries:
        used = {"all"} | ({"headline"} if plain else set()) | {f for q in queries for f in bql.fields_of(q)}

        def told(known: Column) -> Column:
            read = {f: known[f] for f in (*used, "low", "odd")}
            said = [terms.any_of(read["all"], keywords, c.portable, read["low"], read["odd"])] if keywords else []
            said += [~terms.any_of(read["all"], excluded, c.portable, read["low"], read["odd"])] if excluded else []
            if queries:
                found = F.lit(False)
                for q in queries:
                    found = found | bql.query_column(q, {f: F.lit("") for f in texts} | read, c.portable)
                said.append(found)
            if plain:
                said.append(prominent(plain, read["headline"], known["body"], read["all"], min(10, max(1, c.min_mentions or 2))))
            out = said[0]
            for x in said[1:]:
                out = out & x
            return out

        # The texts are put together once a row, and only those that the criteria read.
        body = [F.coalesce("content", F.lit("")).alias("body")] if plain else []
        every = texts["all"]
        known = F.struct(*[texts[f].alias(f) for f in sorted(used)], F.lower(every).alias("low"), terms.oddly_folded(every).alias("odd"), *body)
        parts.append(terms.let(known, told))
    if areas := [g for g in (*c.geos, c.geo) if g]:
        near = F.lit(False)
        for area in areas:
            near = near | in_area(area, texts["headline"], columns, centroids or {})
        parts.append(near)
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def plain_terms(c: Criteria) -> list[tuple[str, str]]:
    """(text, pattern) of the keywords and plain query terms, each once."""
    found: dict[str, str] = {}
    for k in c.keywords:
        if k.strip():
            found.setdefault(" ".join(k.lower().split()), terms.keyword(k))
    for q in c.all_queries():
        for t in bql.literal_terms(q, scoped=False):
            found.setdefault(" ".join(t.text.lower().split()), bql.term_pattern(t))
    return list(found.items())


def prominent(plain: list[tuple[str, str]], headline: Column, body: Column, everything: Column, least: int) -> Column:
    """Whether an article is about the terms and doesn't just mention one.

    With least > 2 some term occurs that often. Else a term is in title or summary, or no
    term is in the body, or two are, or the only one is a phrase or occurs often enough.
    """
    count = lambda text, p: F.regexp_count(text, F.lit(terms.FLAGS + p))
    if least > 2:
        out = F.lit(False)
        for _, p in plain:
            out = out | (count(everything, p) >= least)
        return out
    head, n, strong = F.lit(False), F.lit(0), F.lit(False)
    for text, p in plain:
        here = body.rlike(terms.FLAGS + p)
        head = head | headline.rlike(terms.FLAGS + p)
        n = n + here.cast("int")
        strong = strong | (here if " " in text else count(body, p) >= least)
    return head | (n != 1) | strong


def in_area(area: dict, headline: Column, columns: list[str], centroids: dict) -> Column:
    """By name in title or summary unless the countries differ, else by geometry."""
    name, country = (area.get("name") or "").strip(), area.get("country") or ""
    shape = area.get("geometry") or area
    by_place = geo.places_inside(shape, centroids) if "places" in columns else F.lit(False)
    if len(name) < 3:
        return by_place
    own = F.coalesce("country", F.lit(""))
    clash = (F.lit(bool(country)) & (own != "") & (own != country)) if country else F.lit(False)
    return (terms.one_of(headline, name) & ~clash) | by_place


def search(articles: DataFrame, sources: DataFrame, c: Criteria, now: datetime, sort: str = "newest", limit: int = 50) -> DataFrame:
    """The first articles that meet the criteria, in one of two orders with id as the last tie-break."""
    joined = articles.join(sources, "source_id", "left")
    order = [F.desc("importance")] if sort == "importance" else []
    return joined.filter(predicate(c, joined.columns, now)).orderBy(*order, F.desc("published_at"), F.desc("id")).limit(limit)


#: Articles of a plain column and of a grouped one, most of a search, a feed, groups and an export; fixed values.
PLAIN_LIMIT, GROUPED_LIMIT = 40, 200
MOST = {"search": 200, "feed": 200, "groups": 100, "export": 2000}


def bounded(kind: str, limit: int) -> int:
    """A caller's limit within what its kind of view allows."""
    return max(1, min(MOST[kind], limit))


def home(articles: DataFrame, sources: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """The ranked articles of each column of the home view."""
    return {
        name: search(articles, sources, Criteria.from_json(raw), now, order, GROUPED_LIMIT if grouped else PLAIN_LIMIT)
        for name, raw, order, grouped in HOME
    }


def warm(columns: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """The columns as written to tables in a shared folder: what a view reads until the next refresh writes them again."""
    out = {}
    for name, found in columns.items():
        schema = found.schema
        found.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = found.sparkSession.read.schema(schema).parquet(f"{folder}/{name}")
    return out


def fresh(written: datetime, now: datetime, most_s: float = 120.0) -> bool:
    """Whether a warm table may still answer."""
    return 0 <= (now - written).total_seconds() <= most_s


def coverage_queries(c: Criteria, most: int = 5) -> list[str]:
    """Tracker queries that would find what the criteria ask for: no brackets or AND, NOT as a minus."""
    out = []
    for q in [*c.all_queries(), *c.keywords]:
        text = q if not any(q == k for k in c.keywords) else f'"{q}"' if " " in q else q
        text = text.replace("(", " ").replace(")", " ")
        text = " ".join(w for w in text.split() if w.upper() != "AND")
        out.append(" ".join(text.replace("NOT ", "-").split()))
    return list(dict.fromkeys(x for x in out if x))[:most]
