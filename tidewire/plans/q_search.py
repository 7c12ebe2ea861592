"""Search queries: criteria and the boolean language over the test articles."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators.lineage import shared_folder
from ..sources import adapters as A
from . import recent
from .criteria import Criteria, predicate, search

NOW = datetime.fromisoformat(A.NOW)
COLUMNS = ["id", "title", "importance", "published_at"]


def _search(sort: str = "newest", limit: int = 40, **criteria):
    c = Criteria(**criteria)

    def run(spark, sf_dir):
        return search(A.articles(spark, sf_dir), A.sources(spark, sf_dir), c, NOW, sort, limit).select(*COLUMNS)

    return run


def _all(columns=("id",), **criteria):
    """Every match, unordered."""
    c = Criteria(**criteria)

    def run(spark, sf_dir):
        found = A.articles(spark, sf_dir).join(A.sources(spark, sf_dir), "source_id", "left")
        return found.filter(predicate(c, found.columns, NOW)).select(*columns)

    return run


def _re(term: str) -> str:
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){term}(?:$|[^\p{{L}}\p{{N}}_])"


def _near(a: str, b: str, n: int) -> str:
    return _re(rf"{a}(?:[^\p{{L}}\p{{N}}_]+[\p{{L}}\p{{N}}_]+){{0,{n}}}?[^\p{{L}}\p{{N}}_]+{b}")


ALL = "concat_ws(chr(10), title, summary, content)"
HEAD = "concat_ws(chr(10), title, summary)"
LEDE = r"concat_ws(chr(10), title, summary, array_to_string(regexp_extract_all(content, '(\S+)')[1:60], ' '))"


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _sql(where: str, columns: str = ", ".join(COLUMNS), tail: str = "ORDER BY published_at DESC, id DESC LIMIT 40") -> str:
    return f"{A.with_sql('articles', 'sources')}\nSELECT {columns} FROM articles LEFT JOIN sources USING (source_id) WHERE {where} {tail}"


def _every(where: str) -> str:
    return _sql(where, "id", "")


def min_sources(spark, sf_dir):
    c = Criteria(min_sources=3, min_importance=40)
    found = A.articles(spark, sf_dir).join(A.sources(spark, sf_dir), "source_id", "left").join(A.events(spark, sf_dir), "event_id", "left")
    return found.filter(predicate(c, found.columns, NOW)).select("id", "event_id", F.size("source_ids").alias("n_sources"))


def hide_stale(spark, sf_dir):
    c = Criteria(hide_stale=True, stale_hours=200)
    found = A.articles(spark, sf_dir).join(A.events(spark, sf_dir), "event_id", "left")
    return found.filter(predicate(c, found.columns, NOW)).select("id", F.coalesce("event_id", F.lit(-1)).alias("event_id"))


def export_rows(spark, sf_dir):
    """The rows of an export: cleaned cells, newest first, 2000 at most."""
    from ..sources.sinks import export_rows as rows

    c = Criteria(languages=("fr",))
    return rows(search(A.articles(spark, sf_dir), A.sources(spark, sf_dir), c, NOW, "newest", 2000))


def hosts(spark, sf_dir):
    from .criteria import host_of

    pages = A.table(spark, sf_dir, "pages")
    return pages.select("page_id", host_of(F.col("url")).alias("host"))


def kw_recent(spark, sf_dir):
    """The search of kw_newest over a store of days: it stops at the day that fills the limit."""
    path = f"{shared_folder(spark).rstrip('/')}/tidewire-days-{uuid.uuid4().hex}"
    recent.write_days(A.articles(spark, sf_dir), path)
    found, _ = recent.search_newest(spark, path, A.sources(spark, sf_dir), Criteria(**NEWEST), NOW, 40)
    return found.select(*COLUMNS)


NEWEST = {"keywords": ("ndtion",), "passing_mentions": True, "languages": ("en",), "min_importance": 20, "date_from": "2024-01-03", "date_to": "2024-01-28"}
QUERIES = {
    "kw_recent": kw_recent,
    "kw_newest": _search(**NEWEST),
    "kw_importance": _search("importance", keywords=("ndtion",), passing_mentions=True),
    "kw_two": _search(keywords=("ndtion", "esat"), passing_mentions=True),
    "kw_exclude": _search(keywords=("the",), exclude_keywords=("ndtion", "on the"), passing_mentions=True),
    "kw_hours": _search(keywords=("the",), hours=200, passing_mentions=True),
    "bql_and_or_not": _all(query="(ndtion OR esat) AND the NOT enes", passing_mentions=True),
    "bql_phrase": _all(query='"of the" AND "in the"', passing_mentions=True),
    "bql_wildcard": _all(query="ndti* AND est?", passing_mentions=True),
    "bql_near": _all(query="the NEAR/3 ndtion", passing_mentions=True),
    "bql_onear": _all(query="the ONEAR/2 ndtion OR esat PRE/4 of", passing_mentions=True),
    "bql_scope_title": _all(query="title:the -title:of", passing_mentions=True),
    "bql_scope_lede": _all(query="lede:the AND body:and", passing_mentions=True),
    "bql_scope_site": _all(query='site:site3.example.com OR source:"outlet 7"', passing_mentions=True),
    "bql_many": _all(queries=("ndtion esat", "enes AROUND(5) the", "ated ~x"), passing_mentions=True),
    "crit_country_lang_scope": _search(countries=("DE", "FR"), scopes=("national", "local"), platforms=("news",), languages=("de",), min_importance=30),
    "crit_sources_dates": _search("importance", source_ids=(1, 2, 3), date_from="2024-01-10", date_to="2024-01-20"),
    "prominence": _all(keywords=("ndtion", "esat"), languages=("en",)),
    "prominence_three": _all(keywords=("ndtion",), languages=("en",), min_mentions=3),
    "min_sources": min_sources,
    "hide_stale": hide_stale,
    "export_rows": export_rows,
    "page_hosts": hosts,
}

_N, _E = _re("ndtion"), _re("esat")


def _count(text: str, term: str) -> str:
    return rf"len(regexp_extract_all({text}, '(?i)\b{term}\b'))"


SQL = {
    "kw_newest": _sql(f"{_has(ALL, _N)} AND language = 'en' AND importance >= 20 AND published_at >= '2024-01-03' AND published_at < '2024-01-29'"),
    "kw_importance": _sql(_has(ALL, _N), tail="ORDER BY importance DESC, published_at DESC, id DESC LIMIT 40"),
    "kw_two": _sql(f"({_has(ALL, _N)} OR {_has(ALL, _E)})"),
    "kw_exclude": _sql(f"{_has(ALL, _re('the'))} AND NOT {_has(ALL, _N)} AND NOT {_has(ALL, _re('on[ \\t\\n\\r\\f\\v]+the'))}"),
    "kw_hours": _sql(f"{_has(ALL, _re('the'))} AND published_at >= TIMESTAMP '{A.NOW}' - to_hours(200)"),
    "bql_and_or_not": _every(f"({_has(ALL, _N)} OR {_has(ALL, _E)}) AND {_has(ALL, _re('the'))} AND NOT {_has(ALL, _re('enes'))}"),
    "bql_phrase": _every(f"{_has(ALL, _re('of\\s+the'))} AND {_has(ALL, _re('in\\s+the'))}"),
    "bql_wildcard": _every(f"{_has(ALL, '(?i)(?:^|[^\\p{L}\\p{N}_])ndti[\\p{L}\\p{N}_]*')} AND {_has(ALL, '(?i)(?:^|[^\\p{L}\\p{N}_])est[\\p{L}\\p{N}_]')}"),
    "bql_near": _every(f"({_has(ALL, _near('the', 'ndtion', 3))} OR {_has(ALL, _near('ndtion', 'the', 3))})"),
    "bql_onear": _every(f"({_has(ALL, _near('the', 'ndtion', 2))} OR {_has(ALL, _near('esat', 'of', 4))})"),
    "bql_scope_title": _every(f"{_has(HEAD, _re('the'))} AND NOT {_has(HEAD, _re('of'))}"),
    "bql_scope_lede": _every(f"{_has(LEDE, _re('the'))} AND {_has('content', _re('and'))}"),
    "bql_scope_site": _every("host = 'site3.example.com' OR source_id = 7"),
    "bql_many": _every(f"({_has(ALL, _N)} AND {_has(ALL, _E)}) OR {_has(ALL, _near('enes', 'the', 5))} OR {_has(ALL, _near('the', 'enes', 5))}"),
    "crit_country_lang_scope": _sql("country IN ('DE', 'FR') AND scope IN ('national', 'local') AND platform = 'news' AND language = 'de' AND importance >= 30"),
    "crit_sources_dates": _sql("source_id IN (1, 2, 3) AND published_at >= '2024-01-10' AND published_at < '2024-01-21'", tail="ORDER BY importance DESC, published_at DESC, id DESC LIMIT 40"),
    "prominence": f"""{A.with_sql('articles')},
t AS (SELECT id, language, {_has(ALL, _N)} OR {_has(ALL, _E)} AS found, {_count(HEAD, 'ndtion')} + {_count(HEAD, 'esat')} AS head,
  {_count('content', 'ndtion')} AS a, {_count('content', 'esat')} AS b FROM articles)
SELECT id FROM t WHERE language = 'en' AND found AND (head > 0 OR (a > 0)::INT + (b > 0)::INT <> 1 OR a >= 2 OR b >= 2)""",
    "prominence_three": _every(f"language = 'en' AND {_has(ALL, _N)} AND {_count(ALL, 'ndtion')} >= 3"),
    "min_sources": f"""{A.with_sql('articles', 'stored')}
SELECT id, event_id, len(source_ids) AS n_sources FROM articles JOIN stored USING (event_id) WHERE importance >= 40 AND len(source_ids) >= 3""",
    "hide_stale": f"""{A.with_sql('articles', 'stored')}
SELECT id, coalesce(event_id, -1) AS event_id FROM articles LEFT JOIN stored USING (event_id) WHERE event_id IS NULL OR updated_at >= TIMESTAMP '{A.NOW}' - to_hours(200)""",
    "export_rows": f"""{A.with_sql('articles', 'sources')}
SELECT id, regexp_replace(title, '[\\x00-\\x09\\x0b-\\x1f]', '', 'g') AS title, name AS source, url, country, language, importance,
  strftime(published_at, '%Y-%m-%d %H:%M') AS published, regexp_replace(substr(summary, 1, 400), '[\\x00-\\x09\\x0b-\\x1f]', '', 'g') AS summary
FROM articles LEFT JOIN sources USING (source_id) WHERE language = 'fr' ORDER BY published_at DESC, articles.id DESC LIMIT 2000""",
    "page_hosts": r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '^www\.', '') AS host FROM pages",
}
SQL["kw_recent"] = SQL["kw_newest"]
