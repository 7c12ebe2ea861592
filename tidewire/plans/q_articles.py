"""Queries of scores, languages, categories, corroboration, syndication and grouped views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import categories, lang, scoring, similarity
from ..operators import coverage
from ..sources import adapters as A
from ..sources import gazetteer

#: A dictionary from the test data's own words; real dictionaries are a parameter of the functions.
BREAKING = {"ndtion": 10, "esat": 7, "enes": 14, "ated": 5}
HINTS = {"politics": ["ndtion", "of the"], "disaster": ["esat"], "sports": ["enes", "ated"]}


#: Places whose names are words of the test texts; real gazetteers are read from a file.
PLACES = [
    {"name": "Ndtion", "country": "US", "lat": 40.0, "lon": -100.0, "aliases": [], "kind": "country"},
    {"name": "Esat", "country": "FR", "lat": 48.8, "lon": 2.3, "aliases": ["enes"], "kind": "city"},
    {"name": "Ated", "country": "DE", "lat": 52.5, "lon": 13.4, "aliases": [], "kind": "city"},
]


def _text():
    return F.concat_ws("\n", "title", "summary")


def breaking(spark, sf_dir):
    return A.articles(spark, sf_dir).select("id", scoring.breaking_signal(_text(), BREAKING).alias("signal"))


def categorised(spark, sf_dir):
    """Categories of the whole text, as once the body is there."""
    empty = F.array().cast("array<string>")
    return A.articles(spark, sf_dir).select("id", F.array_join(categories.classify(F.col("title"), F.concat_ws("\n", "summary", "content"), HINTS, empty), ",").alias("categories"))


def lang_detect(spark, sf_dir):
    words = {k: lang.FUNCTION_WORDS[k] for k in ("en", "es", "fr", "de")}
    return A.articles(spark, sf_dir).select("id", lang.detect(F.concat_ws("\n", "title", "summary", "content"), F.lit("en"), words).alias("detected"))


def tokens(spark, sf_dir):
    """Articles with the words of their titles, and the numbers and cities of title and summary."""
    a = gazetteer.with_places(A.articles(spark, sf_dir).withColumn("text", _text()), PLACES)
    return a.withColumn("tokens", similarity.cluster_tokens(F.col("title"), F.col("text"), F.col("places"))).drop("text", "places")


def cluster_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("id", F.array_join("tokens", " ").alias("tokens"))


def pair_similarity(spark, sf_dir):
    t = tokens(spark, sf_dir).select("id", "tokens")
    return coverage.similar_pairs(t, t, least_shared=2).filter("id < other").select("id", "other", "shared", F.round("similarity", 6).alias("similarity"))


def corroboration(spark, sf_dir):
    return coverage.corroboration(tokens(spark, sf_dir).select("id", "source_id", "published_at", "tokens"))


def importance_score(spark, sf_dir):
    a = A.articles(spark, sf_dir).join(A.sources(spark, sf_dir), "source_id", "left")
    found = scoring.importance(F.col("scope"), F.col("tier"), scoring.breaking_signal(_text(), BREAKING), (F.col("id") % 3).cast("int"), (F.col("id") % 5).cast("int"))
    return a.select("id", found.cast("int").alias("score"), scoring.tier_label(found).alias("label"))


def _decayed(spark, sf_dir):
    a = A.articles(spark, sf_dir).join(A.events(spark, sf_dir), "event_id", "left")
    reference = scoring.decay_reference(F.col("published_at"), F.col("first_seen"), F.col("updated_at"))
    return a.withColumn("aged", scoring.decayed(F.col("importance"), scoring.hours_between(A.now(), reference)))


def decay(spark, sf_dir):
    return _decayed(spark, sf_dir).select("id", F.col("aged").cast("int").alias("aged"))


def event_peaks(spark, sf_dir):
    """Events whose peak importance changes with the decay of their members."""
    peaks = _decayed(spark, sf_dir).filter("event_id IS NOT NULL").groupBy("event_id").agg(F.max("aged").cast("int").alias("peak"))
    return peaks.join(A.events(spark, sf_dir).select("event_id", "event_importance"), "event_id").filter("peak <> event_importance")


def _ranked(spark, sf_dir, limit=200):
    a = A.articles(spark, sf_dir).filter("language = 'en'").orderBy(F.desc("published_at"), F.desc("id")).limit(limit)
    return a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("published_at"), F.desc("id")))).select("place", "id", "event_id", "source_id", "importance")


def grouped_summary(spark, sf_dir):
    heads, _ = coverage.grouped(_ranked(spark, sf_dir), A.events(spark, sf_dir))
    return heads


def grouped_first6(spark, sf_dir):
    _, first = coverage.grouped(_ranked(spark, sf_dir), A.events(spark, sf_dir))
    return first


def _event_tokens(spark, sf_dir):
    t = tokens(spark, sf_dir).filter("event_id IS NOT NULL")
    words = t.select("event_id", F.explode_outer("tokens").alias("w")).groupBy("event_id").agg(F.slice(F.array_sort(F.collect_set("w")), 1, 18).alias("tokens"))
    return A.events(spark, sf_dir).join(words, "event_id")


def story_related(spark, sf_dir):
    return coverage.related(_event_tokens(spark, sf_dir), 5, A.now(), days=30, least=0.05)


def story_timeline(spark, sf_dir):
    """The newest reports of one event, 100 at most."""
    a = A.articles(spark, sf_dir).filter("event_id = 5")
    return a.orderBy(F.desc("published_at"), F.desc("id")).limit(100).select("id", "source_id", "published_at", F.substring("content", 1, 1200).alias("excerpt"), (F.length("content") > 1200).alias("truncated"))


def story_header(spark, sf_dir):
    """Stored count if the timeline is full, else the reports shown; distinct sources."""
    shown = A.articles(spark, sf_dir).filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))
    return shown.join(A.events(spark, sf_dir), "event_id").select("event_id", F.when(F.col("n") >= 100, F.col("article_count")).otherwise(F.col("n")).alias("article_count"), "sources")


def newest_per_event(spark, sf_dir):
    w = Window.partitionBy("event_id").orderBy(F.desc("published_at"), F.desc("id"))
    return A.articles(spark, sf_dir).filter("event_id IS NOT NULL").withColumn("n", F.row_number().over(w)).filter("n = 1").select("event_id", "id")


def syndicate_pairs(spark, sf_dir):
    a = A.articles(spark, sf_dir)
    return coverage.shared_headlines(a, least_chars=10, least_shared=1)


def syndicate_groups(spark, sf_dir):
    pairs = coverage.shared_headlines(A.articles(spark, sf_dir), least_chars=10, least_shared=2)
    return coverage.families(pairs, A.sources(spark, sf_dir).select("source_id"))


def event_merge(spark, sf_dir):
    """Events restated from their members: counts, peaks, sets."""
    a = A.articles(spark, sf_dir).filter("event_id IS NOT NULL")
    return a.groupBy("event_id").agg(
        F.count("*").alias("article_count"), F.max("importance").alias("importance"), F.max("published_at").alias("updated_at"),
        F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"),
        F.array_join(F.slice(F.array_sort(F.collect_set("source_id")), 1, 100).cast("array<string>"), ",").alias("source_ids"),
    )


def cluster_events(spark, sf_dir):
    return coverage.cluster(tokens(spark, sf_dir))


def headline_keys(spark, sf_dir):
    return A.articles(spark, sf_dir).select("id", coverage.normal_headline(F.col("title")).alias("key"))


QUERIES = {f.__name__: f for f in (
    breaking, categorised, lang_detect, cluster_tokens, pair_similarity, corroboration, importance_score, decay, event_peaks,
    grouped_summary, grouped_first6, story_related, story_timeline, story_header, newest_per_event, syndicate_pairs, syndicate_groups,
    event_merge, cluster_events, headline_keys,
)}


def _has(text: str, term: str) -> str:
    return rf"regexp_matches({text}, '(?i)(?:^|[^\p{{L}}\p{{N}}_]){term}(?:$|[^\p{{L}}\p{{N}}_])')"


_TEXT = "concat_ws(chr(10), title, summary)"
_SIGNAL = "least(30, " + " + ".join(f"CASE WHEN {_has(_TEXT, t)} THEN {w} ELSE 0 END" for t, w in BREAKING.items()) + ")"
_POINTS = {
    k: " + ".join(f"CASE WHEN {_has('title', t2)} THEN 2 WHEN {_has('concat_ws(chr(10), summary, content)', t2)} THEN 1 ELSE 0 END" for t in v for t2 in [t.replace(" ", r"\s+")])
    for k, v in HINTS.items()
}
_STOP = ", ".join(f"'{w}'" for w in similarity.STOP_WORDS)
# Runs of five digits or more are no numbers of interest; matched whole, they hide none.
_NUMBERS = f"list_filter(regexp_extract_all({_TEXT}, '[0-9]{{5,}}|[0-9]{{1,4}}[.,][0-9]+|[0-9]{{1,4}}'), lambda x: NOT regexp_full_match(x, '[0-9]{{5,}}'))[1:8]"
_ANCHORS = f"list_filter(list_transform({_NUMBERS}, lambda x: replace(x, ',', '.')), lambda x: contains(x, '.') OR length(x) BETWEEN 2 AND 3)"
_CITIES = " || ".join(f"CASE WHEN {' OR '.join(_has(_TEXT, n.lower()) for n in (p['name'], *p['aliases']))} THEN ['{p['name'].lower()}'] ELSE [] END" for p in PLACES if p["kind"] == "city")
_TOKENS = f"""toks AS (
  SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})) || {_ANCHORS} || {_CITIES}))[1:15] AS tokens FROM articles)"""
_SIM = "greatest(shared / (n + m - shared), shared / least(n, m))"
_DECAY = f"""aged AS (
  SELECT id, event_id, base, (CASE WHEN age - 6 <= 0 OR base <= floor_ THEN base
      ELSE greatest(floor_, least(base, round_even(floor_ + (base - floor_) * pow(0.5, (age - 6) / 48), 0)::INT)) END)::INT AS aged
  FROM (SELECT *, greatest(5, least(base, round_even(base * 0.4::DOUBLE, 0)::INT)) AS floor_ FROM (
    SELECT id, a.event_id, greatest(5, least(100, importance)) AS base,
      epoch_us(TIMESTAMP '{A.NOW}' - least(greatest(published_at, coalesce(first_seen, published_at), coalesce(updated_at, published_at)), published_at + INTERVAL 336 HOUR)) / 3600000000.0::DOUBLE AS age
    FROM articles a LEFT JOIN stored s ON a.event_id = s.event_id)))"""
_RANKED = """ranked AS (
  SELECT row_number() OVER (ORDER BY published_at DESC, id DESC) AS place, id, event_id, source_id, importance,
    coalesce('event-' || event_id, 'solo-' || id) AS grp
  FROM (SELECT * FROM articles WHERE language = 'en' ORDER BY published_at DESC, id DESC LIMIT 200)),
heads AS (
  SELECT r.grp, min(place) AS first, count(*) AS matched_count, count(DISTINCT source_id) AS source_count,
    coalesce(any_value(s.article_count), count(*)) AS total_count, coalesce(any_value(s.event_importance), max(importance)) AS importance
  FROM ranked r LEFT JOIN stored s ON r.event_id = s.event_id GROUP BY r.grp ORDER BY first LIMIT 30)"""
_HEADLINE = r"substr(trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_ ]+', ' ', 'g'), ' +', ' ', 'g'), ' '), 1, 160)"


def _pairs(least: int) -> str:
    return f"""keyed AS (SELECT DISTINCT source_id, {_HEADLINE} AS key FROM articles),
held AS (SELECT * FROM keyed WHERE length(key) >= 10 AND key IN (SELECT key FROM keyed GROUP BY key HAVING count(*) BETWEEN 2 AND 12)),
pairs AS (SELECT x.source_id AS a, y.source_id AS b, count(*) AS shared FROM held x JOIN held y ON x.key = y.key AND x.source_id < y.source_id GROUP BY ALL HAVING count(*) >= {least})"""


_WORDS = {k: ", ".join(f"'{w}'" for w in lang.FUNCTION_WORDS[k].split()) for k in ("en", "es", "fr", "de")}

SQL = {
    "breaking": f"{A.with_sql('articles')} SELECT id, {_SIGNAL} AS signal FROM articles",
    "categorised": f"""{A.with_sql('articles')},
c AS (SELECT id, list_sort(list_filter([CASE WHEN {_POINTS['politics']} >= 2 THEN 'politics' END, CASE WHEN {_POINTS['disaster']} >= 1 THEN 'disaster' END,
  CASE WHEN {_POINTS['sports']} >= 1 THEN 'sports' END], lambda x: x IS NOT NULL)) AS l FROM articles)
SELECT id, CASE WHEN len(l) = 0 THEN 'world' ELSE array_to_string(l, ',') END AS categories FROM c""",
    "lang_detect": f"""{A.with_sql('articles')},
w AS (SELECT id, regexp_extract_all(lower(concat_ws(chr(10), title, summary, content)), '[a-zà-ÿ]+') AS ws FROM articles),
n AS (SELECT id, len(ws) AS total, {", ".join(f"len(list_filter(ws, lambda w: w IN ({v}))) AS {k}_" for k, v in _WORDS.items())} FROM w),
r AS (SELECT *, list_sort([en_, es_, fr_, de_], 'DESC') AS s FROM n)
SELECT id, CASE WHEN total >= 4 AND s[1] >= 3 AND s[1] > s[2] THEN CASE s[1] WHEN en_ THEN 'en' WHEN es_ THEN 'es' WHEN fr_ THEN 'fr' ELSE 'de' END ELSE 'en' END AS detected FROM r""",
    "cluster_tokens": f"{A.with_sql('articles')}, {_TOKENS} SELECT id, array_to_string(tokens, ' ') AS tokens FROM toks",
    "pair_similarity": f"""{A.with_sql('articles')}, {_TOKENS},
x AS (SELECT id, len(tokens) AS n, unnest(tokens) AS token FROM toks),
p AS (SELECT a.id, b.id AS other, a.n, b.n AS m, count(*)::DOUBLE AS shared FROM x a JOIN x b ON a.token = b.token AND a.id < b.id GROUP BY ALL)
SELECT id, other, shared::BIGINT AS shared, round({_SIM}, 6) AS similarity FROM p WHERE shared >= 2 AND {_SIM} >= 0.5""",
    "corroboration": f"""{A.with_sql('articles')}, {_TOKENS},
x AS (SELECT id, source_id, published_at AS at_, len(tokens) AS n, unnest(tokens) AS token FROM toks),
p AS (SELECT a.id, b.id AS other, b.source_id AS room, a.n, b.n AS m, count(*)::DOUBLE AS shared FROM x a JOIN x b ON a.token = b.token AND a.source_id <> b.source_id
  AND b.at_ <= a.at_ AND b.at_ >= a.at_ - INTERVAL 12 HOUR GROUP BY ALL)
SELECT t.id, count(DISTINCT room) AS corroborating FROM articles t LEFT JOIN (SELECT * FROM p WHERE {_SIM} >= 0.5) q ON t.id = q.id GROUP BY t.id""",
    "importance_score": f"""{A.with_sql('articles', 'sources')},
s AS (SELECT id, greatest(5, least(100, CASE scope WHEN 'international' THEN 45 WHEN 'national' THEN 35 WHEN 'local' THEN 25 ELSE 30 END
  + CASE tier WHEN 1 THEN 8 WHEN 3 THEN -4 ELSE 0 END + {_SIGNAL} + CASE WHEN id % 3 >= 2 THEN 6 ELSE 0 END + least(id % 5 * 8, 24)))::INT AS score
  FROM articles LEFT JOIN sources USING (source_id))
SELECT id, score, CASE WHEN score >= 80 THEN 'Critical' WHEN score >= 60 THEN 'High' WHEN score >= 40 THEN 'Notable' ELSE 'Routine' END AS label FROM s""",
    "decay": f"{A.with_sql('articles', 'stored')}, {_DECAY} SELECT id, aged FROM aged",
    "event_peaks": f"""{A.with_sql('articles', 'stored')}, {_DECAY}
SELECT event_id, peak, event_importance FROM (SELECT event_id, max(aged) AS peak FROM aged WHERE event_id IS NOT NULL GROUP BY event_id) JOIN stored USING (event_id) WHERE peak <> event_importance""",
    "grouped_summary": f"{A.with_sql('articles', 'stored')}, {_RANKED} SELECT grp, first, matched_count, source_count, total_count, importance FROM heads",
    "grouped_first6": f"""{A.with_sql('articles', 'stored')}, {_RANKED}
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY place) AS n, id, place FROM ranked WHERE grp IN (SELECT grp FROM heads) QUALIFY n <= 6""",
    "story_related": f"""{A.with_sql('articles', 'stored')}, {_TOKENS},
e AS (SELECT event_id, list_sort(list(DISTINCT w))[1:18] AS tokens FROM (SELECT event_id, unnest(tokens) AS w FROM toks WHERE event_id IS NOT NULL) GROUP BY event_id),
pool AS (SELECT e.event_id, tokens FROM e JOIN stored USING (event_id) WHERE e.event_id <> 5 AND updated_at >= TIMESTAMP '{A.NOW}' - INTERVAL 30 DAY ORDER BY updated_at DESC, event_id LIMIT 500),
s AS (SELECT pool.event_id, len(list_intersect(pool.tokens, o.tokens))::DOUBLE AS shared, len(pool.tokens) AS n, len(o.tokens) AS m FROM pool, (SELECT tokens FROM e WHERE event_id = 5) o)
SELECT event_id, round({_SIM}, 6) AS similarity FROM s WHERE round({_SIM}, 6) >= 0.05 ORDER BY similarity DESC, event_id LIMIT 5""",
    "story_timeline": f"""{A.with_sql('articles')}
SELECT id, source_id, published_at, substr(content, 1, 1200) AS excerpt, length(content) > 1200 AS truncated FROM articles WHERE event_id = 5 ORDER BY published_at DESC, id DESC LIMIT 100""",
    "story_header": f"""{A.with_sql('articles', 'stored')}
SELECT event_id, CASE WHEN count(*) >= 100 THEN any_value(article_count) ELSE count(*) END AS article_count, count(DISTINCT source_id) AS sources
FROM articles JOIN stored USING (event_id) GROUP BY event_id""",
    "newest_per_event": f"""{A.with_sql('articles')}
SELECT event_id, id FROM articles WHERE event_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY published_at DESC, id DESC) = 1""",
    "syndicate_pairs": f"{A.with_sql('articles')}, {_pairs(1)} SELECT a, b, shared FROM pairs",
    "syndicate_groups": f"""{A.with_sql('articles', 'sources', recursive=True)}, {_pairs(2)},
both_ AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(source_id, other) AS (SELECT source_id, source_id FROM sources UNION SELECT r.source_id, both_.b FROM reach r JOIN both_ ON r.other = both_.a)
SELECT source_id, min(other) AS newsroom FROM reach GROUP BY source_id""",
    "event_merge": f"""{A.with_sql('articles')}
SELECT event_id, count(*) AS article_count, max(importance) AS importance, max(published_at) AS updated_at,
  array_to_string(list_sort(list(DISTINCT country)), ',') AS countries, array_to_string(list_sort(list(DISTINCT source_id))[1:100], ',') AS source_ids
FROM articles WHERE event_id IS NOT NULL GROUP BY event_id""",
    "headline_keys": f"{A.with_sql('articles')} SELECT id, {_HEADLINE} AS key FROM articles",
}
