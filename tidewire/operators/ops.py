"""Operations around the corpus: dashboards, retention, feeds, ratings, coverage, explanations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.similarity import similarity
from ..plans import bql
from ..plans.criteria import Criteria, domain_of
from .lineage import cut_lineage
from .ranks import placed, running

# Dashboards


def dashboard(articles: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Counts of all articles, the last day's, its countries, and of sources in one row."""
    day = F.col("published_at") >= now - F.make_dt_interval(days=F.lit(1))
    a = articles.agg(F.count("*").alias("articles"), F.count_if(day).alias("last_day"), F.count_distinct(F.when(day & (F.col("country") != ""), F.col("country"))).alias("countries"))
    s = sources.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"))
    return a.join(s, F.lit(True))  # one row each


def reach(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """How many sources are enabled, have produced, are silent."""
    made = articles.select("source_id").distinct().withColumn("made", F.lit(True))
    s = sources.join(made, "source_id", "left")
    return s.agg(
        F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("made")).alias("producing"),
        F.count_if(F.col("enabled") & F.col("made").isNull()).alias("silent"),
    )


def backlog(articles: DataFrame, tried: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Articles without a body in the window: waiting, never tried, tried in vain."""
    a = articles.filter((F.col("content") == "") & (F.col("published_at") >= now - F.make_dt_interval(hours=F.lit(hours)))).join(tried.select("id", "tried_at"), "id", "left")
    return a.agg(F.count("*").alias("waiting"), F.count_if(F.col("tried_at").isNull()).alias("never_tried"), F.count_if(F.col("tried_at").isNotNull()).alias("failed"))


def zero_filled(groups: DataFrame, key: str, counted: dict[str, DataFrame]) -> DataFrame:
    """groups with the number of rows of each counted table, 0 where there are none."""
    out = groups.select(key)
    for name, rows in counted.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counted])


def growth(samples: DataFrame, ceiling: float) -> DataFrame:
    """Bytes and articles a day between first and last sample; at least 6 hours apart, else no row."""
    s = samples.agg(
        F.min_by(F.struct("bytes", "articles"), "at").alias("a"), F.max_by(F.struct("bytes", "articles"), "at").alias("b"),
        ((F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))) / 3_600_000_000.0).alias("hours"), F.count("*").alias("n"),
    ).filter("n >= 2 AND hours >= 6")
    per_day = lambda c: (F.col(f"b.{c}") - F.col(f"a.{c}")) / F.col("hours") * 24
    return s.select(
        F.round(per_day("bytes"), 4).alias("bytes_day"), F.round(per_day("articles"), 4).alias("articles_day"),
        F.round(F.col("b.bytes") / F.nullif("b.articles", F.lit(0)), 4).alias("bytes_article"),
        F.round(F.when(per_day("bytes") > 0, (ceiling - F.col("b.bytes")) / per_day("bytes")), 4).alias("days_left"),
    )


# Retention and scheduling


def doomed(articles: DataFrame, now: Column, days: int = 30, most: int | None = 5000) -> DataFrame:
    """The oldest articles past retention, a bounded number for each pass; most: None for all of them."""
    past = articles.filter(F.col("published_at") < now - F.make_dt_interval(days=F.lit(days)))
    return (past if most is None else past.orderBy("published_at", "id").limit(most)).select("id")


def prune_pass(articles: DataFrame, now: Column, days: int = 30, most: int = 5000) -> tuple[DataFrame, bool]:
    """The articles that one pass removes and whether more wait for the next."""
    gone = cut_lineage(doomed(articles, now, days, most))
    return gone, gone.count() == most


def over_budget(articles: DataFrame, budget: float, now: Column, least_days: int = 2, most: int | None = None) -> DataFrame:
    """The oldest articles (id, published_at, bytes) to remove until the rest fits a budget of bytes, none of the last days; most: at most so many in a pass."""
    total = articles.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    old = articles.filter(F.col("published_at") < now - F.make_dt_interval(days=F.lit(least_days)))
    summed = running(old, "bytes", F.date_trunc("hour", "published_at"), "published_at", "id")
    # One row on the right. An article goes if those before it don't free enough.
    gone = summed.join(F.broadcast(total), F.lit(True)).filter(F.col("upto") - F.col("bytes") < F.col("total") - F.lit(budget))
    return (gone if most is None else gone.orderBy("published_at", "id").limit(most)).select("id")


def without(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """rows whose key isn't in gone.id: the cascade of a deletion is one call for each table."""
    return rows.join(gone.select(F.col("id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def interval_seconds(idle: Column, base: int = 180, slow: int = 3600) -> Column:
    """Seconds between polls: short while a source produces, doubling up to 16 hours while it is idle."""
    return F.when(idle <= 0, base).otherwise(slow * F.pow(F.lit(2), F.least(idle, F.lit(4)))).cast("int")


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources whose interval has passed: never fetched first, wires before city feeds, oldest first."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_fetch").cast("timestamp"))
    ready = sources.filter(F.col("enabled") & (F.col("last_fetch").isNull() | (age >= interval_seconds(F.col("idle_polls")))))
    return ready.orderBy(F.col("last_fetch").isNotNull(), F.col("scope") == "local", "last_fetch", "source_id")


def retry_at(failed_at: Column, attempts: Column, most: int = 4, first: int = 300) -> Column:
    """When to try a translation again; null after the last attempt."""
    wait = F.make_dt_interval(secs=first * F.pow(F.lit(2), attempts - 1))
    return F.when(attempts < most, failed_at + wait)


def unseen(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """Entries with a URL that is neither stored nor earlier in the batch (by arrival)."""
    w = Window.partitionBy("url").orderBy("arrival")
    first = entries.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return first.join(stored.select("url"), "url", "left_anti")


# Feeds and ratings

#: Thresholds of the feed verdict: hours ahead, least dated, linked, texts, titles; shares; fixed values.
FUTURE_HOURS, LEAST_DATED, LEAST_TITLES = 36, 3, 6
FUTURE_SHARE, TEMPLATE_SIMILARITY, REJECT_AT = 0.5, 0.45, 2


def feed_kind(entries: DataFrame, now: Column, alike: Column) -> DataFrame:
    """source_id, future_share, template and rejected. alike is the similarity to the entry before (null for the first).

    Entries dated far ahead count 2, a template of titles 1; 2 reject.
    """
    ahead = F.col("published_at") > now + F.make_dt_interval(hours=F.lit(FUTURE_HOURS))
    rows = entries.withColumn("alike", alike)
    s = rows.groupBy("source_id").agg(F.count("published_at").alias("dated"), F.count_if(ahead).alias("ahead"), F.count("*").alias("titles"), F.percentile("alike", F.lit(0.5)).alias("median"))
    s = s.select("source_id", F.when(F.col("dated") >= LEAST_DATED, F.col("ahead") / F.col("dated")).otherwise(0.0).alias("future_share"), F.when(F.col("titles") >= LEAST_TITLES, F.coalesce("median", F.lit(0.0))).otherwise(0.0).alias("template"))
    points = F.when(F.col("future_share") >= FUTURE_SHARE, 2).otherwise(0) + F.when(F.col("template") >= TEMPLATE_SIMILARITY, 1).otherwise(0)
    return s.select("source_id", F.round("future_share", 6).alias("future_share"), F.round("template", 6).alias("template"), (points >= REJECT_AT).alias("rejected"))


#: Least linked entries and texts, shares of paths and of phrases; fixed values.
LEAST_LINKED, LEAST_TEXTS, PATH_SHARE, WORD_SHARE = 4, 4, 0.6, 0.5
#: Path segments of pages that are no articles; fixed values.
PATHS = {
    "events": "event events ticket tickets ticketing veranstaltung veranstaltungen evento eventos evenement evenements agenda whats-on box-office boxoffice showtimes lineup sesion sesiones registration register-event rsvp activity activities workshop workshops webinar webinars booking bookings reservation reservations tour-dates",
    "commerce": "product products shop store collections collection cart checkout basket catalog catalogue produkt produkte producto productos boutique tienda loja pricing buy order orders deal deals coupon coupons listing listings classifieds for-sale",
    "jobs": "job jobs career careers vacancy vacancies hiring recruitment stellenangebote empleo empleos vagas opportunity opportunities position positions",
}
#: Phrases of pages that sell something; fixed values.
PHRASES = {
    "events": "buy tickets|get tickets|tickets on sale|on sale now|sold out|doors open|early bird|rsvp|box office|general admission|vip package|book now|reserve your|limited seats|line-up|eintritt|vorverkauf|entradas|boletos|ingressos|billets|售票|早鳥|門票|チケット|예매",
    "commerce": "add to cart|in stock|out of stock|free shipping|shop now|order now|best seller|discount code|use code|% off|new arrival|pre-order|add to basket|en venta|comprar|kaufen|acheter",
    "jobs": "apply now|we are hiring|we're hiring|now hiring|full-time|part-time|salary range|job opening|job description|years of experience|equal opportunity employer|remote position|bewerben|vacante|contratando",
}


def feed_verdict(entries: DataFrame, now: Column) -> DataFrame:
    """What kind of feed each source is, by all four signals: source_id, the shares, score, kind and rejected.

    entries: source_id, arrival, published_at, link, title, summary. Entries dated far ahead count 2; links to pages that are no articles,
    phrases that sell and titles made from a template 1 each; REJECT_AT rejects. A link is one of jobs before
    events before commerce, a text one of events before commerce before jobs; of equal shares the first of events, commerce, jobs wins.
    """
    link = F.lower(F.coalesce("link", F.lit("")))
    segments = F.split(F.coalesce(F.try_parse_url(link, F.lit("PATH")), F.lit("")), "/")
    path = F.lit(None).cast("string")
    for kind in ("commerce", "events", "jobs"):
        path = F.when(F.arrays_overlap(segments, F.array(*map(F.lit, PATHS[kind].split()))), kind).otherwise(path)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    word = F.lit(None).cast("string")
    for kind in ("jobs", "commerce", "events"):
        hit = F.lit(False)
        for phrase in PHRASES[kind].split("|"):
            hit = hit | F.contains(text, F.lit(phrase))
        word = F.when(hit, kind).otherwise(word)
    titles = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}_]+")), lambda w: F.length(w) > 2)
    ahead = F.col("published_at") > now + F.make_dt_interval(hours=F.lit(FUTURE_HOURS))
    rows = entries.select("source_id", "arrival", ahead.alias("ahead"), F.col("published_at").isNotNull().alias("dated"), link.startswith("http").alias("linked"), path.alias("path"), (F.btrim(text) != "").alias("told"), word.alias("word"), titles.alias("words"))
    linked, told = F.col("linked"), F.col("told")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    s = rows.groupBy("source_id").agg(
        count(F.col("dated")).alias("dated"), count(F.col("ahead")).alias("ahead"), count(linked).alias("links"), count(told).alias("texts"),
        *[count(linked & (F.col("path") == k)).alias(f"path_{k}") for k in PATHS], *[count(told & (F.col("word") == k)).alias(f"word_{k}") for k in PATHS],
    )
    w = Window.partitionBy("source_id").orderBy("arrival")
    pairs = rows.filter(F.size("words") > 0).withColumn("before", F.lag("words").over(w))
    alike = F.when(F.col("before").isNotNull(), similarity(F.col("words"), F.col("before")))
    template = pairs.groupBy("source_id").agg(F.count("*").alias("titles"), F.percentile(alike, F.lit(0.5)).alias("median"))

    def share(kind: str, of: str, least: int) -> tuple[Column, Column]:
        n = {k: F.col(f"{kind}_{k}") for k in PATHS}
        most = F.greatest(*n.values())
        name = F.when(n["events"] == most, "events").when(n["commerce"] == most, "commerce").otherwise("jobs")
        enough = (F.col(of) >= least) & (most > 0)
        return F.when(enough, (n["events"] + n["commerce"] + n["jobs"]) / F.col(of)).otherwise(0.0), F.when(enough, name)

    (paths, path_kind), (words, word_kind) = share("path", "links", LEAST_LINKED), share("word", "texts", LEAST_TEXTS)
    s = s.join(template, "source_id", "left").select(
        "source_id", F.when(F.col("dated") >= LEAST_DATED, F.col("ahead") / F.col("dated")).otherwise(0.0).alias("future_share"), paths.alias("path_share"), path_kind.alias("path_kind"),
        words.alias("word_share"), word_kind.alias("word_kind"), F.when(F.col("titles") >= LEAST_TITLES, F.coalesce("median", F.lit(0.0))).otherwise(0.0).alias("template"),
    )
    future, pathed, worded = F.col("future_share") >= FUTURE_SHARE, F.col("path_share") >= PATH_SHARE, F.col("word_share") >= WORD_SHARE
    score = F.when(future, 2).otherwise(0) + pathed.cast("int") + worded.cast("int") + (F.col("template") >= TEMPLATE_SIMILARITY).cast("int")
    kind = F.when(pathed, F.col("path_kind")).when(future, "events").when(worded, F.col("word_kind")).otherwise("news")
    rejected = score >= REJECT_AT
    return s.select("source_id", *[F.round(c, 6).alias(c) for c in ("future_share", "path_share", "word_share", "template")], score.alias("score"), F.when(rejected, kind).otherwise("news").alias("kind"), rejected.alias("rejected"))


def switched_off(sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The sources that a verdict disables: rejected ones that were found automatically."""
    return sources.filter("added_by = 'auto-discovered'").join(verdicts.filter("rejected").select("source_id"), "source_id", "left_semi")


def domain_suffixes(domain: Column) -> Column:
    """(suffix, depth) of a domain: itself, then without its first label, down to two labels."""
    labels = F.split(domain, r"\.")
    n = F.greatest(F.size(labels) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("suffix"), i.alias("depth")))


def rated(urls: DataFrame, ratings: DataFrame) -> DataFrame:
    """id and the rank of the longest suffix of its domain that is rated; null if none is."""
    keyed = urls.select("id", domain_of(F.col("url")).alias("domain"))
    pairs = keyed.select("domain").distinct().select("domain", F.explode(domain_suffixes(F.col("domain"))).alias("s")).select("domain", "s.suffix", "s.depth")
    found = pairs.join(ratings, pairs["suffix"] == ratings["rated_domain"]).groupBy("domain").agg(F.min_by("rank", "depth").alias("rank"))
    return keyed.join(found, "domain", "left").select("id", "domain", "rank")


def blocked(domain: Column, bad: list[str]) -> Column:
    out = F.lit(False)
    for b in bad:
        out = out | (domain == b) | domain.endswith("." + b)
    return out


# Documents and their themes


def coverage_matrix(entries: DataFrame, themes: list[str]) -> DataFrame:
    """Rows of themes, one column for each period (month) and a total. entries: at, themes."""
    flat = entries.select(F.date_format("at", "yyyy-MM").alias("period"), F.explode("themes").alias("theme")).filter(F.col("theme").isin(*themes))
    return flat.groupBy("theme", "period").agg(F.count("*").alias("n"))


def coverage_grid(entries: DataFrame, themes: list[str], period: Column) -> DataFrame:
    """theme, period, n for each theme and each period with entries, 0 where none has it, with the theme's total, the largest cell (1 at least) and the number of entries.

    entries: at, themes. Themes and periods are the lists of a view, so their grid is small whatever the entries.
    """
    rows = entries.select(period.alias("period"), "themes")
    periods = rows.groupBy("period").agg(F.count("*").alias("entries"))
    cells = rows.select("period", F.explode("themes").alias("theme")).filter(F.col("theme").isin(*themes)).groupBy("theme", "period").agg(F.count("*").alias("n"))
    grid = periods.select("period", F.explode(F.array(*map(F.lit, themes))).alias("theme")).join(cells, ["theme", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    totals = cells.groupBy("theme").agg(F.sum("n").alias("total"))
    whole = periods.agg(F.sum("entries").alias("entries")).join(cells.agg(F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(1))).cast("long").alias("largest")), F.lit(True))
    return grid.join(totals, "theme", "left").join(whole, F.lit(True)).select("theme", "period", "n", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "largest", "entries")


def pivoted(grid: DataFrame, periods: list[str]) -> DataFrame:
    """A coverage grid with one column for each period, and the total."""
    return grid.groupBy("theme", "total").pivot("period", periods).agg(F.first("n")).select("theme", *periods, "total")


def biweeks(reports: DataFrame) -> DataFrame:
    """Reports paired two by two in order of their date."""
    return placed(reports, "at", "id").withColumn("bucket", F.floor((F.col("place") - 1) / 2)).drop("place")


def citations(links: DataFrame) -> DataFrame:
    return links.groupBy("host").agg(F.count("*").alias("cited")).orderBy(F.desc("cited"), "host")


# Explanation of a match


def explain(articles: DataFrame, c: Criteria, around: int = 60, most: int = 9) -> DataFrame:
    """For each term of the criteria that an article holds: the first field with it, a snippet, the number of times up to most."""
    wanted = {k.lower(): terms.keyword(k) for k in c.keywords}
    for q in c.all_queries():
        for t in bql.literal_terms(q):
            wanted.setdefault(t.text.lower(), bql.term_pattern(t))
    rows = []
    for place, (term, pattern) in enumerate(wanted.items()):
        p = F.lit(terms.FLAGS + pattern)
        hit = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(terms.FLAGS + pattern)  # noqa: E731, B023
        field = F.when(hit("title"), "title").when(hit("summary"), "summary").when(hit("content"), "content")
        text = F.when(hit("title"), F.col("title")).when(hit("summary"), F.col("summary")).otherwise(F.col("content"))
        at = F.regexp_instr(text, p)
        start = F.greatest(F.lit(1), at - around)
        whole = F.concat_ws("\n", "title", "summary", "content")
        rows.append(F.struct(
            F.lit(place).alias("place"), F.lit(term).alias("term"), field.alias("field"),
            F.concat(F.when(start > 1, "…").otherwise(""), F.substring(text, start, at - start + around + len(term)), F.when(F.length(text) > at + around + len(term), "…").otherwise("")).alias("snippet"),
            F.least(F.lit(most), F.regexp_count(whole, p)).alias("times"),
        ))
    if not rows:
        return articles.select("id").limit(0)
    return articles.select("id", F.explode(F.array(*rows)).alias("t")).filter("t.field IS NOT NULL").select("id", "t.*")


# Text of feeds

_TRAILERS = (
    r"(?is)\bthe post\b.{0,300}?\bappeared first on\b.*$", r"(?is)\bshare this\s*:.*$",
    r"(?i)\b(?:continue reading|read (?:more|the (?:full|rest)))\b[^.]{0,80}$",
    r"(?is)\b(?:this (?:article|story)|it) (?:first |originally )?appeared (?:first )?on\b.*$",
    r"(?is)\boriginally published (?:on|at|by)\b.*$", r"(?is)\bfiled under\s*:.*$", r"(?i)\brelated\s*:\s*$",
)  # trailers of feed generators, fixed values


def clean_summary(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern in _TRAILERS:
        out = F.regexp_replace(out, pattern, " ")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" -–—|·•"))


def strip_html(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    return F.btrim(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))


def entries_to_articles(entries: DataFrame, most: int = 80) -> DataFrame:
    """Feed entries as article rows: the first ones of each source, http links, a title, texts cut to their limits."""
    w = Window.partitionBy("source_id").orderBy("arrival")
    e = entries.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    title = strip_html(F.col("title"))
    return e.filter(is_http(F.col("link")) & (title != "")).select(
        "source_id", F.substring("link", 1, 1000).alias("url"), title.alias("title"), F.substring(clean_summary(strip_html(F.col("summary"))), 1, 2000).alias("summary"),
        F.substring(F.coalesce("guid", "link"), 1, 500).alias("guid"), "published_at", "arrival",
    )


def translated_text(translations: DataFrame) -> DataFrame:
    """article_id and all its translations with a title, in order of language: title, then summary."""
    t = translations.filter("title <> ''").select("article_id", F.struct("lang", F.concat_ws("\n", "title", "summary").alias("text")).alias("t"))
    return t.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["text"]), "\n").alias("translated"))


def with_translations(articles: DataFrame, translations: DataFrame) -> DataFrame:
    """articles with the text of all their translations, for searches that read them; one row for each article."""
    return articles.join(translated_text(translations).withColumnRenamed("article_id", "id"), "id", "left")


def slug(text: str, most: int = 60) -> str:
    import unicodedata

    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:most].strip("-")
