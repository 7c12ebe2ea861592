"""Importance of an article: score, decay, tier labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import any_of, held, let, listed, read
from .vocabulary import BREAKING_INTL

#: Points by scope and tier, fixed values.
SCOPE_POINTS = {"international": 45, "national": 35, "local": 25}
OTHER_SCOPE = 30
TIER_POINTS = {1: 8, 3: -4}
MOST_BREAKING = 30
#: Weights of breaking terms, fixed values.
BREAKING = {
    "breaking": 14, "urgent": 12, "live updates": 10,
    "war": 10, "invasion": 12, "airstrike": 12, "air strike": 12, "missile": 10,
    "explosion": 12, "blast": 10, "attack": 9, "terror": 10, "shooting": 10,
    "hostage": 10, "coup": 14, "uprising": 10, "martial law": 14,
    "earthquake": 12, "tsunami": 14, "hurricane": 10, "typhoon": 10,
    "cyclone": 9, "wildfire": 8, "flood": 8, "eruption": 10, "landslide": 8,
    "outbreak": 10, "pandemic": 12, "epidemic": 10, "recall": 5,
    "killed": 8, "dead": 7, "death toll": 12, "casualties": 9, "injured": 5,
    "evacuation": 8, "evacuate": 8, "state of emergency": 14, "emergency": 6,
    "sanctions": 7, "ceasefire": 9, "nuclear": 9, "cyberattack": 10,
    "data breach": 8, "assassination": 14, "impeach": 9, "indicted": 8,
    "resigns": 7, "resignation": 7, "election": 5, "referendum": 6,
    "default": 5, "bailout": 7, "crash": 8, "collapse": 8, "bankruptcy": 6,
    "rate cut": 5, "rate hike": 5, "inflation": 4, "recession": 7,
    "summit": 4, "treaty": 5, "crisis": 7, "protest": 5, "strike": 4,
}
#: English terms and those of other languages, whose weight counts where both have one.
ALL_BREAKING = BREAKING | BREAKING_INTL
#: Hours without decay, half-life, share that always stays, most hours that a live event lifts.
GRACE_H, HALF_LIFE_H, FLOOR_SHARE, LIFT_H = 6.0, 48.0, 0.4, 336


def breaking_signal(text: Column, terms: dict[str, int] | None = None, portable: bool = False) -> Column:
    """Sum of the weights of the terms in the text, 30 at most; terms: those of all languages.

    A term's regular expression only meets texts that hold its words.
    """
    wanted = listed(ALL_BREAKING if terms is None else terms, portable)

    def signal(known: Column) -> Column:
        hits = F.filter(wanted, lambda t: held(known, t))
        return F.least(F.lit(MOST_BREAKING), F.aggregate(hits, F.lit(0), lambda a, t: a + t["value"].cast("int")))

    return F.when(text.isNull(), 0).otherwise(let(read(text), signal))


def importance(scope: Column, tier: Column, breaking: Column, n_countries: Column, corroborating: Column) -> Column:
    """Scope and tier points, breaking signal, 6 for several countries, 8 a corroborating newsroom up to 24; 5 to 100."""
    base = F.lit(OTHER_SCOPE)
    for name, points in SCOPE_POINTS.items():
        base = F.when(scope == name, points).otherwise(base)
    step = F.lit(0)
    for name, points in TIER_POINTS.items():
        step = F.when(tier == name, points).otherwise(step)
    total = base + step + breaking + F.when(n_countries >= 2, 6).otherwise(0) + F.least(corroborating * 8, F.lit(24))
    return F.greatest(F.lit(5), F.least(F.lit(100), total))


def decay_reference(published: Column, first_seen: Column, updated: Column) -> Column:
    """When the story last moved, at most LIFT_H after publication."""
    latest = F.greatest(published, first_seen, updated)
    return F.when(published.isNull(), F.coalesce(updated, first_seen)).otherwise(F.least(latest, published + F.make_dt_interval(hours=F.lit(LIFT_H))))


def decayed(base: Column, age_hours: Column) -> Column:
    """What is left of a score: whole in the hours of grace, then halving towards FLOOR_SHARE of it; halves round to even, 5 at least."""
    start = F.greatest(F.lit(5), F.least(F.lit(100), base.cast("int")))
    rest = F.greatest(F.lit(5), F.bround(start * FLOOR_SHARE).cast("int"))
    late = F.greatest(F.lit(0.0), F.coalesce(age_hours, F.lit(0.0)) - GRACE_H)
    half_lives = late / HALF_LIFE_H
    score = F.bround(rest + (start - rest) * F.pow(F.lit(0.5), half_lives)).cast("int")
    return F.when(rest < start, F.greatest(rest, F.least(start, score))).otherwise(start)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3_600_000_000.0


def tier_label(score: Column) -> Column:
    return F.when(score >= 80, "Critical").when(score >= 60, "High").when(score >= 40, "Notable").otherwise("Routine")


__all__ = ["any_of", "breaking_signal", "decay_reference", "decayed", "hours_between", "importance", "tier_label"]
