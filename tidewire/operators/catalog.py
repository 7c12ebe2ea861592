"""The catalogue of sources and who sees what: discovery, repair, seeds, shared items, marks of what was read."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.criteria import domain_of
from ..runtime import ship

#: Days after which a failed probe may be tried again, hours between attempts at a body, attempts at a translation; fixed values.
RECHECK_DAYS, RETRY_HOURS, MOST_ATTEMPTS = 30, 6, 4


def states(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: total, enabled, never_polled, producing, silent (polled, enabled, without an article) and retired sources.

    sources: source_id, enabled, last_fetched_at, last_status.
    """
    made = articles.select("source_id").distinct().withColumn("made", F.lit(True))
    s = sources.join(made, "source_id", "left")
    polled = F.col("last_fetched_at").isNotNull()
    return s.agg(
        F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~polled).alias("never_polled"), F.count_if(F.coalesce("made", F.lit(False))).alias("producing"),
        F.count_if(F.col("enabled") & polled & F.col("made").isNull()).alias("silent"),
        F.count_if(~F.col("enabled") & F.coalesce(F.col("last_status").startswith("retired:"), F.lit(False))).alias("retired"),
    )


def discovery(domains: DataFrame, most: int = 12) -> DataFrame:
    """One row: probed, with_a_feed and without_a_feed domains, and the newest of the feedless ones. domains: domain, status, checked_at."""
    counts = domains.agg(F.count("*").alias("probed"), F.count_if(F.col("status") == "added").alias("with_a_feed"), F.count_if(F.col("status") == "no-feed").alias("without_a_feed"))
    newest = domains.filter("status = 'no-feed'").orderBy(F.desc("checked_at"), "domain").limit(most)
    listed = newest.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("checked_at").cast("timestamp"))).alias("t"), "domain"))), lambda x: x["domain"]).alias("feedless"))
    return counts.join(listed, F.lit(True))  # one row each


def probe_candidates(domains: DataFrame, sources: DataFrame, records: DataFrame, now: Column, days: int = RECHECK_DAYS) -> DataFrame:
    """The domains neither of a source's feed or home page nor of a settled probe; failed probes age out, those only seen aren't settled."""
    held = sources.select(F.explode(F.array(domain_of(F.col("rss_url")), domain_of(F.col("homepage")))).alias("domain"))
    fresh = F.col("checked_at") >= now - F.make_dt_interval(days=F.lit(days))
    settled = records.filter((F.col("status") == "added") | ((F.col("status") != "seen") & fresh)).select("domain")
    return domains.select("domain").distinct().join(held.unionByName(settled), "domain", "left_anti")


def sightings(stored: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """The stored domains (domain, status, sightings, checked_at) after a batch of publications (domain): counted up; settled ones keep their status."""
    more = seen.groupBy("domain").agg(F.count("*").alias("more"))
    both = stored.join(more, "domain", "full_outer")
    was = F.coalesce("status", F.lit("seen"))
    return both.select(
        "domain", F.when(F.col("more").isNull() | was.isin("added", "no-feed"), was).otherwise("seen").alias("status"),
        (F.coalesce("sightings", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("sightings"), F.when(F.col("more").isNull(), F.col("checked_at")).otherwise(now).alias("checked_at"),
    )


def needs_repair(status: Column) -> Column:
    """Whether a fetch status is lasting enough to look for another address of the feed."""
    s = F.coalesce(status, F.lit(""))
    return s.rlike(r"^error: (?:401|403|404|410|451)\b") | s.startswith("error: not a feed") | s.startswith("parse error")


def seeded(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of a catalogue whose rss_url isn't stored, each address once: inserting them twice adds nothing."""
    return catalog.dropDuplicates(["rss_url"]).join(stored.select("rss_url"), "rss_url", "left_anti")


def to_backfill(articles: DataFrame, sources: DataFrame, tried: DataFrame, now: Column, limit: int, hours: int = 48, retry_hours: int = RETRY_HOURS) -> DataFrame:
    """The newest articles without a body that may be fetched: in the window, not paywalled, not tried lately."""
    ago = lambda n: now - F.make_dt_interval(hours=F.lit(n))
    a = articles.filter((F.col("content") == "") & (F.col("published_at") >= ago(hours))).join(sources.select("source_id", "paywall"), "source_id").join(tried.select("id", "tried_at"), "id", "left")
    a = a.filter(~F.col("paywall") & (F.col("tried_at").isNull() | (F.col("tried_at") < ago(retry_hours))))
    return a.orderBy(F.desc("published_at"), F.desc("id")).limit(limit).select("id", "source_id", "url")


def translation_totals(translations: DataFrame, lang: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """One row: translations of a language that are there, failing, given up."""
    none = F.col("title") == ""
    return translations.filter(F.col("lang") == lang).agg(F.count_if(~none).alias("cached"), F.count_if(none).alias("failing"), F.count_if(none & (F.col("attempts") >= most)).alias("given_up"))


def looks_translated(original: Column, translated: Column) -> Column:
    """Not empty, and not what was sent unless that has two words at most."""
    new, old = F.btrim(F.coalesce(translated, F.lit(""))), F.btrim(F.coalesce(original, F.lit("")))
    return (new != "") & ((new != old) | (F.size(F.regexp_extract_all(old, F.lit(r"\S+"), F.lit(0))) <= 2))


# Who sees what


def visible(items: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(user_id, key, mine): each user's own items and those shared into a group of theirs, once each.

    items: key, user_id, group_id (null if not shared); members: group_id, user_id.
    """
    own = items.select("user_id", key, F.lit(True).alias("mine"))
    shared = items.select(key, "group_id", F.col("user_id").alias("owner")).join(members.select("group_id", "user_id"), "group_id").filter("user_id <> owner")
    return own.unionByName(shared.select("user_id", key, F.lit(False).alias("mine"))).groupBy("user_id", key).agg(F.max("mine").alias("mine"))


def viewed(articles: DataFrame, events: DataFrame, singles: DataFrame) -> DataFrame:
    """articles with viewed: its event was opened, or the article itself if it has no event. events: event_id, singles: id, of one user."""
    e = events.select("event_id").distinct().withColumn("__event", F.lit(True))
    s = singles.select("id").distinct().withColumn("__single", F.lit(True))
    flag = F.when(F.col("event_id").isNotNull(), F.coalesce("__event", F.lit(False))).otherwise(F.coalesce("__single", F.lit(False)))
    return articles.join(e, "event_id", "left").join(s, "id", "left").withColumn("viewed", flag).drop("__event", "__single")


def access(users: DataFrame, now: Column, charged: bool = True) -> DataFrame:
    """user_id, state (open, comped, paid, trial, expired), until and days_left, rounded up. users: user_id, comped, paid_until, trial_ends_at."""
    paid, trial = F.col("paid_until") > now, F.col("trial_ends_at") > now
    state = F.when(F.lit(not charged), "open").when(F.col("comped"), "comped").when(paid, "paid").when(trial, "trial").otherwise("expired")
    until = F.when(state == "paid", F.col("paid_until")).when(state == "trial", F.col("trial_ends_at")).when(state == "expired", F.coalesce("trial_ends_at", "paid_until"))
    left = F.ceil((F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) / 86400.0)
    days = F.when(state.isin("paid", "trial"), F.greatest(F.lit(0), left)).when(state == "expired", 0)
    return users.select("user_id", state.alias("state"), until.alias("until"), days.cast("int").alias("days_left"))


def found_users(users: DataFrame, q: str) -> DataFrame:
    """Users whose name or address holds q, case ignored."""
    q = q.strip().lower()
    return users.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("email"), F.lit(q))) if q else users


def active_devices(devices: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """user_id and how many of its devices were seen lately."""
    return devices.filter(F.col("seen_at") >= now - F.make_dt_interval(secs=F.lit(seconds))).groupBy("user_id").agg(F.count("*").alias("active"))


# Names and lists


def slugs(names: Column) -> Column:
    """The id of a name: accents folded, other signs to hyphens, 60 characters at most."""

    @F.pandas_udf("string")
    def fold(column: pd.Series) -> pd.Series:
        return column.map(slugify)

    return fold(names)


def slugify(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:60] or "untitled"


def unique_slugs(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """rows with slug, unique in each group: the second of a name gets -2, and so on, past suffixes that other names have."""
    ship(rows.sparkSession)
    rows = rows.withColumn("__base", slugs(F.col(name)))
    nth = F.row_number().over(Window.partitionBy(group, "__base").orderBy(order))
    rows = rows.withColumn("__n", nth)
    # Suffixes that plain names take already; of one base there are few.
    plain = rows.filter("__n = 1").select(F.col(group).alias("__g"), F.regexp_extract("__base", "^(.*)-([0-9]+)$", 1).alias("__b"), F.regexp_extract("__base", "-([0-9]+)$", 1).cast("int").alias("__k"))
    used = plain.filter("__b <> '' AND __k >= 2").groupBy("__g", "__b").agg(F.sort_array(F.collect_set("__k")).alias("__used"))
    rows = rows.join(used, (F.col(group) == F.col("__g")) & (F.substring("__base", 1, 56) == F.col("__b")), "left")
    # The n-th free number: each used one at or below moves it one further.
    k = F.aggregate(F.coalesce("__used", F.array().cast("array<int>")), F.col("__n"), lambda acc, x: F.when(x <= acc, acc + 1).otherwise(acc))
    slug = F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat(F.substring("__base", 1, 56), F.lit("-"), k.cast("string")))
    return rows.withColumn("slug", slug).drop("__base", "__n", "__g", "__b", "__used")


def themed(entries: DataFrame, known: list[str], most: int = 12, most_entries: int = 200) -> DataFrame:
    """entries (document_id, position, title, body, themes) that say something, the first ones of each document, with known themes only, the first few of each."""
    first = entries.filter(F.col("position") < most_entries)
    first = first.filter((F.btrim(F.coalesce("title", F.lit(""))) != "") | (F.btrim(F.coalesce("body", F.lit(""))) != ""))
    slugs_ = F.transform(F.coalesce("themes", F.array().cast("array<string>")), lambda t: F.substring(F.btrim(t), 1, 60))
    held = F.array_intersect(slugs_, F.array(*map(F.lit, known))) if known else F.array().cast("array<string>")
    return first.withColumn("themes", F.slice(held, 1, most))


def ordered_union(*lists: Column) -> Column:
    """The values of all lists, each at its first place."""
    return F.array_distinct(F.concat(*lists))


def only_remote(remote: DataFrame, local: DataFrame, decimals: int = 3) -> DataFrame:
    """Places (name, lat, lon) of a remote search that no local hit lies at, to that many decimals."""
    at = lambda df: df.withColumns({"__y": F.round("lat", decimals), "__x": F.round("lon", decimals)})
    return at(remote).join(at(local).select("__y", "__x"), ["__y", "__x"], "left_anti").drop("__y", "__x")
