"""Queries of dashboards, retention, feeds, ratings and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.similarity import cluster_tokens, similarity
from ..operators import ops
from ..sources import adapters as A
from .criteria import Criteria


def dash_stats(spark, sf_dir):
    return ops.dashboard(A.articles(spark, sf_dir), A.sources(spark, sf_dir), A.now())


def _some(spark, sf_dir):
    return A.articles(spark, sf_dir).filter("source_id % 6 <> 2")


def reach(spark, sf_dir):
    return ops.reach(A.sources(spark, sf_dir), _some(spark, sf_dir))


def backlog(spark, sf_dir):
    a = A.articles(spark, sf_dir)
    return ops.backlog(a, a.filter("id % 2 = 0").select("id", F.col("published_at").alias("tried_at")), A.now(), 24 * 30)


def unseen_counts(spark, sf_dir):
    return A.table(spark, sf_dir, "events").filter("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("unseen"))


def group_counts(spark, sf_dir):
    """Rows of three kinds for each group, 0 where there are none."""
    e = A.table(spark, sf_dir, "events")
    groups = A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"))
    return ops.zero_filled(groups, "user_id", {"members": e.filter("event_type = 'signup'"), "feeds": e.filter("event_type = 'click'"), "alerts": e.filter("event_type = 'error'")})


def silent_sources(spark, sf_dir):
    return A.sources(spark, sf_dir).filter("enabled").join(_some(spark, sf_dir).select("source_id").distinct(), "source_id", "left_anti").select("source_id")


def producing_sources(spark, sf_dir):
    return A.sources(spark, sf_dir).join(_some(spark, sf_dir).select("source_id"), "source_id", "left_semi").select("source_id")


def orphan_events(spark, sf_dir):
    kept = A.articles(spark, sf_dir).filter("id % 9 <> 4 AND event_id % 5 <> 3")
    return A.events(spark, sf_dir).join(kept.select("event_id"), "event_id", "left_anti").select("event_id")


def new_urls(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), F.col("page_id").alias("arrival"))
    return ops.unseen(pages, pages.filter("arrival % 4 = 1")).select("url", "arrival")


def domain_rating(spark, sf_dir):
    ratings = spark.createDataFrame([("example.com", 2), ("example.net", 4), ("m.ththth.example.net", 1), ("example.org", 3)], "rated_domain string, rank int")
    return ops.rated(A.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), ratings)


def growth(spark, sf_dir):
    s = A.table(spark, sf_dir, "events").select(F.col("ts").alias("at"), (F.col("event_id") * 1000 + 5_000_000).alias("bytes"), (F.col("event_id") + 10).alias("articles"))
    return ops.growth(s, 1e12)


def feed_kind(spark, sf_dir):
    a = A.articles(spark, sf_dir).select("source_id", "id", (F.col("published_at") + F.make_dt_interval(days=F.when(F.col("source_id") % 4 == 0, 20).otherwise(0).cast("int"))).alias("published_at"), cluster_tokens(F.col("title")).alias("tokens"))
    w = Window.partitionBy("source_id").orderBy("id")
    a = a.withColumn("before", F.lag("tokens").over(w))
    return ops.feed_kind(a, A.now(), F.when(F.col("before").isNotNull(), similarity(F.col("tokens"), F.col("before"))))


def _entries(spark, sf_dir):
    l = A.table(spark, sf_dir, "labels").join(A.articles(spark, sf_dir).select(F.col("id").alias("doc_id"), "published_at", "event_id"), "doc_id")
    return l.select("doc_id", F.col("published_at").alias("at"), F.array(F.concat(F.lit("quality-"), F.col("quality").cast("string")), F.concat(F.lit("toxic-"), F.col("toxic").cast("string"))).alias("themes"))


def coverage_matrix(spark, sf_dir):
    return ops.coverage_matrix(_entries(spark, sf_dir), ["quality-0", "quality-1", "toxic-1"])


def biweeks(spark, sf_dir):
    return ops.biweeks(_entries(spark, sf_dir).select(F.col("doc_id").alias("id"), "at")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def citations_by_host(spark, sf_dir):
    from .criteria import host_of

    return ops.citations(A.table(spark, sf_dir, "pages").select(host_of(F.col("url")).alias("host")))


def retention_keep(spark, sf_dir):
    a = A.articles(spark, sf_dir)
    return ops.without(a, ops.doomed(a, A.now(), days=20, most=None)).select("id")


def due_sources(spark, sf_dir):
    n = F.col("source_id")
    s = A.sources(spark, sf_dir).withColumns({"idle_polls": n % 6, "last_fetch": F.when(n % 5 != 0, A.now() - F.make_dt_interval(mins=(n * 97 % 2000).cast("int")))})
    return ops.due(s, A.now()).select("source_id", ops.interval_seconds(F.col("idle_polls")).alias("seconds"))


def known_domains(spark, sf_dir):
    """Candidate domains without those known, and not under blocked ones."""
    from .criteria import domain_of

    d = A.table(spark, sf_dir, "pages").select(domain_of(F.col("url")).alias("domain")).distinct()
    known = A.table(spark, sf_dir, "pages").filter("page_id % 3 = 0").select(domain_of(F.col("url")).alias("domain"))
    return d.join(known, "domain", "left_anti").filter(~ops.blocked(F.col("domain"), ["example.org"]))


def explain_hits(spark, sf_dir):
    return ops.explain(A.articles(spark, sf_dir), Criteria(keywords=("ndtion",), query="esat OR title:enes"))


def term_times(spark, sf_dir):
    """How often a term occurs in the articles that hold it, up to 9."""
    return ops.explain(A.articles(spark, sf_dir).filter("language = 'en'"), Criteria(keywords=("ndtion", "esat"))).select("id", "term", "times")


def html_text(spark, sf_dir):
    from ..sources.html import page_text

    return page_text(A.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


def summaries(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.length(ops.strip_html(F.col("html"))).cast("long").alias("n"), ops.is_http(F.col("url")).alias("http"))


def languages(spark, sf_dir):
    return A.articles(spark, sf_dir).select("language").distinct()


def host_fan_out(spark, sf_dir):
    return A.articles(spark, sf_dir).join(A.sources(spark, sf_dir), "source_id").groupBy("host").agg(F.count("*").alias("n"))


def alert_hits(spark, sf_dir):
    """Standing queries: for each article the alerts whose predicate holds, in one pass over the texts."""
    from ..streaming.alerts import evaluate
    from .q_search import NOW

    alerts = {1: Criteria(keywords=("ndtion",), passing_mentions=True), 2: Criteria(query="esat NOT the", passing_mentions=True), 3: Criteria(languages=("de",), min_importance=60)}
    return evaluate(A.articles(spark, sf_dir).join(A.sources(spark, sf_dir), "source_id", "left"), alerts, NOW).select("alert_id", "id")


def alert_table(articles):
    """An alert for each article that has three words of five letters, made of them: a keyword, alternatives, an exclusion, or no text at all."""
    found = F.regexp_extract_all(F.lower(F.concat_ws("\n", "title", "content")), F.lit("[a-z]{5,}"), F.lit(0))
    w = articles.withColumn("w", F.array_distinct(found)).filter("size(w) >= 3").withColumn("n", F.size("w"))
    at = lambda part: F.get("w", F.floor(F.col("n") * part).cast("int"))
    a, b, c = at(0.0), at(0.4), at(0.8)
    kind, array = F.col("id") % 4, lambda on, *v: F.when(on, F.array(*v))
    criteria = F.struct(
        array(kind == 0, a).alias("keywords"), array(kind == 0, F.col("language")).alias("languages"),
        F.when(kind == 1, F.concat(a, F.lit(" AND ("), b, F.lit(" OR "), c, F.lit(")"))).when(kind == 2, F.concat(b, F.lit(" NOT "), c)).alias("query"),
        array(kind == 3, F.col("source_id")).alias("source_ids"), array(kind == 3, F.col("country")).alias("countries"),
        F.when(kind == 2, 30).when(kind == 3, 90).alias("min_importance"), F.lit(True).alias("passing_mentions"),
    )
    return w.select(F.col("id").alias("alert_id"), F.to_json(criteria).alias("criteria"))


def alerts_many(spark, sf_dir):
    """As many alerts as articles, looked up by their words."""
    from ..streaming.alerts import evaluate
    from . import percolate
    from .q_search import NOW

    articles = A.articles(spark, sf_dir)
    programs = percolate.compiled(alert_table(articles))
    return evaluate(articles.join(A.sources(spark, sf_dir), "source_id", "left"), programs, NOW).select("alert_id", "id")


def source_fates(spark, sf_dir):
    """Sources after a poll: failures, idle polls and what becomes of them."""
    from ..sources.feeds import next_state

    n = F.col("source_id")
    state = next_state(n % 7, n % 5, n % 3 != 0, n % 4, n % 2 == 0, F.when(n % 6 == 0, "user").otherwise("scan"))
    return A.sources(spark, sf_dir).withColumn("s", state).select("source_id", F.col("s.failures").alias("failures"), F.col("s.idle").alias("idle"), F.col("s.fate").alias("fate"))


def translation_retries(spark, sf_dir):
    """When failed translations are tried again."""
    attempts = (F.col("id") % 5 + 1).cast("int")
    return A.articles(spark, sf_dir).select("id", ops.retry_at(F.col("published_at"), attempts).alias("again"))


QUERIES = {f.__name__: f for f in (
    dash_stats, reach, backlog, unseen_counts, group_counts, silent_sources, producing_sources, orphan_events, new_urls, domain_rating, growth, feed_kind,
    coverage_matrix, biweeks, citations_by_host, retention_keep, due_sources, known_domains, explain_hits, term_times, html_text, summaries, languages, host_fan_out, alert_hits, alerts_many, source_fates, translation_retries,
)}

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '^www\.', '')"
_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')"
_RE = r"(?i)(?:^|[^\p{{L}}\p{{N}}_]){}(?:$|[^\p{{L}}\p{{N}}_])"
_ALL = "concat_ws(chr(10), title, summary, content)"
_NOW = f"TIMESTAMP '{A.NOW}'"
_STOPS = __import__("tidewire.functions.similarity", fromlist=["STOP_WORDS"]).STOP_WORDS

SQL = {
    "dash_stats": f"""{A.with_sql('articles', 'sources')}
SELECT count(*) AS articles, count(*) FILTER (WHERE published_at >= {_NOW} - INTERVAL 1 DAY) AS last_day,
  count(DISTINCT country) FILTER (WHERE published_at >= {_NOW} - INTERVAL 1 DAY AND country <> '') AS countries,
  (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE enabled) AS enabled FROM articles""",
    "reach": f"""{A.with_sql('articles', 'sources')}, made AS (SELECT DISTINCT source_id FROM articles WHERE source_id % 6 <> 2)
SELECT count(*) AS total, count(*) FILTER (WHERE enabled) AS enabled, count(m.source_id) AS producing, count(*) FILTER (WHERE enabled AND m.source_id IS NULL) AS silent
FROM sources s LEFT JOIN made m ON s.source_id = m.source_id""",
    "backlog": f"""{A.with_sql('articles')} SELECT count(*) AS waiting, count(*) FILTER (WHERE id % 2 <> 0) AS never_tried, count(*) FILTER (WHERE id % 2 = 0) AS failed
FROM articles WHERE content = '' AND published_at >= {_NOW} - INTERVAL 720 HOUR""",
    "unseen_counts": "SELECT user_id, count(*) AS unseen FROM events WHERE event_type <> 'view' GROUP BY user_id",
    "group_counts": """SELECT n_nationkey::BIGINT AS user_id, count(*) FILTER (WHERE event_type = 'signup') AS members, count(*) FILTER (WHERE event_type = 'click') AS feeds,
  count(*) FILTER (WHERE event_type = 'error') AS alerts FROM nation LEFT JOIN events ON user_id = n_nationkey GROUP BY n_nationkey""",
    "silent_sources": f"{A.with_sql('articles', 'sources')} SELECT source_id FROM sources WHERE enabled AND source_id NOT IN (SELECT source_id FROM articles WHERE source_id % 6 <> 2)",
    "producing_sources": f"{A.with_sql('articles', 'sources')} SELECT source_id FROM sources WHERE source_id IN (SELECT source_id FROM articles WHERE source_id % 6 <> 2)",
    "orphan_events": f"{A.with_sql('articles', 'stored')} SELECT event_id FROM stored s WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.event_id = s.event_id AND id % 9 <> 4 AND a.event_id % 5 <> 3)",
    "new_urls": """WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS url, page_id AS arrival FROM pages)
SELECT url, min(arrival) AS arrival FROM p WHERE url NOT IN (SELECT url FROM p WHERE arrival % 4 = 1) GROUP BY url""",
    "domain_rating": f"""WITH d AS (SELECT page_id AS id, {_DOMAIN} AS domain FROM pages),
r AS (SELECT unnest(['example.com', 'example.net', 'm.ththth.example.net', 'example.org']) AS rated, unnest([2, 4, 1, 3]) AS rank)
SELECT d.id, any_value(domain) AS domain, arg_max(rank, length(rated)) AS rank FROM d LEFT JOIN r ON domain = rated OR ends_with(domain, '.' || rated) GROUP BY d.id""",
    "growth": """WITH s AS (SELECT ts AS at_, event_id * 1000 + 5000000 AS bytes, event_id + 10 AS articles FROM events),
g AS (SELECT arg_min(bytes, at_) AS b0, arg_max(bytes, at_) AS b1, arg_min(articles, at_) AS a0, arg_max(articles, at_) AS a1, (epoch_us(max(at_)) - epoch_us(min(at_))) / 3600000000.0::DOUBLE AS h FROM s)
SELECT round((b1 - b0) / h * 24, 4) AS bytes_day, round((a1 - a0) / h * 24, 4) AS articles_day, round(b1 / a1, 4) AS bytes_article,
  round(CASE WHEN (b1 - b0) / h * 24 > 0 THEN (1e12::DOUBLE - b1) / ((b1 - b0) / h * 24) END, 4) AS days_left FROM g WHERE h >= 6""",
    "feed_kind": f"""{A.with_sql('articles')},
t AS (SELECT source_id, id, published_at + CASE WHEN source_id % 4 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END AS at_,
  list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in _STOPS)}))))[1:15] AS tokens FROM articles),
b AS (SELECT *, lag(tokens) OVER (PARTITION BY source_id ORDER BY id) AS before FROM t),
s AS (SELECT *, len(list_intersect(tokens, before))::DOUBLE AS i, len(tokens) AS n, len(before) AS m FROM b),
g AS (SELECT source_id, CASE WHEN count(*) >= 3 THEN count(*) FILTER (WHERE at_ > {_NOW} + INTERVAL 36 HOUR) / count(*) ELSE 0 END AS f,
  CASE WHEN count(*) >= 6 THEN coalesce(quantile_cont(CASE WHEN before IS NULL THEN NULL WHEN n = 0 OR m = 0 THEN 0 ELSE greatest(i / (n + m - i), i / least(n, m)) END, 0.5), 0) ELSE 0 END AS q FROM s GROUP BY source_id)
SELECT source_id, round(f, 6) AS future_share, round(q, 6) AS template, (CASE WHEN f >= 0.5 THEN 2 ELSE 0 END + CASE WHEN q >= 0.45 THEN 1 ELSE 0 END) >= 2 AS rejected FROM g""",
    "coverage_matrix": f"""{A.with_sql('articles')},
e AS (SELECT strftime(published_at, '%Y-%m') AS period, unnest(['quality-' || quality, 'toxic-' || toxic]) AS theme FROM labels JOIN articles ON id = doc_id)
SELECT theme, period, count(*) AS n FROM e WHERE theme IN ('quality-0', 'quality-1', 'toxic-1') GROUP BY ALL""",
    "biweeks": f"""{A.with_sql('articles')},
e AS (SELECT doc_id, (row_number() OVER (ORDER BY published_at, doc_id) - 1) // 2 AS bucket FROM labels JOIN articles ON id = doc_id)
SELECT bucket, count(*) AS n, min(doc_id) AS first FROM e GROUP BY bucket""",
    "citations_by_host": f"SELECT {_HOST} AS host, count(*) AS cited FROM pages GROUP BY 1",
    "retention_keep": f"""{A.with_sql('articles')}
SELECT id FROM articles WHERE id NOT IN (SELECT id FROM articles WHERE published_at < {_NOW} - INTERVAL 20 DAY)""",
    "due_sources": f"""{A.with_sql('sources')},
d AS (SELECT *, CASE WHEN source_id % 6 = 0 THEN 180 ELSE 3600 * pow(2, least(source_id % 6, 4))::INT END AS seconds, CASE WHEN source_id % 5 <> 0 THEN (source_id * 97 % 2000) * 60 END AS age FROM sources)
SELECT source_id, seconds::INT AS seconds FROM d WHERE enabled AND (age IS NULL OR age >= seconds)""",
    "known_domains": f"WITH d AS (SELECT page_id, {_DOMAIN} AS domain FROM pages) SELECT DISTINCT domain FROM d WHERE domain NOT IN (SELECT domain FROM d WHERE page_id % 3 = 0) AND domain <> 'example.org' AND NOT ends_with(domain, '.example.org')",
    "term_times": rf"""{A.with_sql('articles')}
SELECT id, term, times FROM (SELECT id, unnest(['ndtion', 'esat']) AS term, unnest([len(regexp_extract_all({_ALL}, '(?i)\bndtion\b')), len(regexp_extract_all({_ALL}, '(?i)\besat\b'))]) AS n, least(9, n)::INT AS times
  FROM articles WHERE language = 'en') WHERE n > 0""",
    "summaries": "SELECT page_id, length(trim(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '))) AS n, regexp_matches(lower(url), '^https?://') AS http FROM pages",
    "languages": f"{A.with_sql('articles')} SELECT DISTINCT language FROM articles",
    "host_fan_out": f"{A.with_sql('articles', 'sources')} SELECT host, count(*) AS n FROM articles JOIN sources USING (source_id) GROUP BY host",
    "source_fates": f"""{A.with_sql('sources')},
s AS (SELECT source_id, source_id % 3 <> 0 AS ok, CASE WHEN source_id % 3 <> 0 THEN 0 ELSE source_id % 7 + 1 END AS failures FROM sources)
SELECT source_id, failures, CASE WHEN ok AND source_id % 4 > 0 THEN 0 WHEN ok THEN source_id % 5 + 1 ELSE source_id % 5 END AS idle,
  CASE WHEN failures < 5 THEN 'keep' WHEN source_id % 2 <> 0 AND source_id % 6 <> 0 THEN 'remove' ELSE 'disable' END AS fate FROM s""",
    "translation_retries": f"""{A.with_sql('articles')}
SELECT id, CASE WHEN id % 5 + 1 < 4 THEN published_at + to_seconds((300 * pow(2, id % 5))::BIGINT) END AS again FROM articles""",
    "alerts_many": rf"""{A.with_sql('articles')},
told AS (
  SELECT *, list_distinct(regexp_extract_all(lower({_ALL}), '[\p{{L}}\p{{N}}_]+')) AS held,
    list_filter(l, lambda x, i: list_position(l, x) = i) AS w
  FROM (SELECT *, regexp_extract_all(lower(concat_ws(chr(10), title, content)), '[a-z]{{5,}}') AS l FROM articles)),
alerts AS (
  SELECT id AS alert_id, id % 4 AS kind, w[1] AS a, w[floor(0.4 * len(w))::INT + 1] AS b, w[floor(0.8 * len(w))::INT + 1] AS c, language, source_id, country
  FROM told WHERE len(w) >= 3)
SELECT alert_id, t.id FROM alerts x JOIN told t ON CASE kind
  WHEN 0 THEN list_contains(held, a) AND t.language = x.language
  WHEN 1 THEN list_contains(held, a) AND (list_contains(held, b) OR list_contains(held, c))
  WHEN 2 THEN list_contains(held, b) AND NOT list_contains(held, c) AND t.importance >= 30
  ELSE t.source_id = x.source_id AND t.country = x.country AND t.importance >= 90 END""",
    "alert_hits": f"""{A.with_sql('articles')}
SELECT 1 AS alert_id, id FROM articles WHERE regexp_matches({_ALL}, '{_RE.format("ndtion").replace("{{", "{").replace("}}", "}")}')
UNION ALL SELECT 2, id FROM articles WHERE regexp_matches({_ALL}, '{_RE.format("esat").replace("{{", "{").replace("}}", "}")}') AND NOT regexp_matches({_ALL}, '{_RE.format("the").replace("{{", "{").replace("}}", "}")}')
UNION ALL SELECT 3, id FROM articles WHERE language = 'de' AND importance >= 60""",
}
