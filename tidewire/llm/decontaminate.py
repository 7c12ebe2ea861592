"""Benchmark decontamination by template canonicalisation, all in Spark expressions.

Texts become tokens (runs of letters, numbers) in lower case. Numbers, names (a capitalised word after
a letter, number, comma or semicolon and one space) and units (a known unit after a number)
become typed placeholders. Windows of ``WINDOW`` tokens of the benchmark and of all documents are hashed and
joined; windows in which more than half of the tokens are placeholders are hashed literally. A window with
placeholders is also hashed by its tokens in lower case, so that a copy in other case (Title Case) matches. Windows that match
on one diagonal (document place less item place) are one occurrence. It is consistent if each
slot value of the item has one value in the document; then the passage is the item, perhaps with other parameters. Windows that match by
placeholder count only in consistent occurrences, those that match letter for letter (case apart) count in any. A
document is contaminated by an item if the windows that count cover at least
``COVERED`` percent of the item's distinct windows.

An item of fewer tokens than a window would be found in nearly any text, so it has another rule: it contaminates the documents of which a
whole line, or the whole text, has just its tokens in lower case.

The benchmark's windows are broadcast if there are at most ``BROADCAST_ROWS``, else the join shuffles.

Nulls: a null text, or one without tokens, matches nothing; rows with a null doc_id or item_id are not
compared. Repeated rows count once, and
repeated windows of an item count once. Empty tables give empty results. Extra columns are not read by ``contaminated``;
``clean`` passes them through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from . import base

WINDOW, COVERED, BROADCAST_ROWS = 8, 50, 200_000
#: Units, fixed values.
UNITS = ("mg", "g", "kg", "t", "mm", "cm", "m", "km", "ml", "cl", "l", "ms", "s", "min", "h", "km/h", "w", "kw", "kwh", "mb", "gb", "tb", "usd", "eur", "euro", "euros", "dollar", "dollars", "meter", "meters", "miles", "hours", "minutes", "seconds", "days", "years")
NAME_MARK = "\x02"
#: The rare condition comes first, so most places fail fast.
_NAME = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;] )"
_TOKEN = r"\x02?[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*"
_NAME_KEY, _NUMBER_KEY, _UNIT_KEY = 1, 2, 3


def _marked(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, NAME_MARK))


def _tokens(marked: Column) -> Column:
    return F.regexp_extract_all(marked, F.lit(_TOKEN), F.lit(0))


def _windows(size: int) -> Column:
    """Windows of size tokens over the columns c (canonical), v (literal) and u (v without name marks): key, literal, place and values; literal and values of windows with slots."""
    c = lambda i: [F.get("c", i + k) for k in range(size)]
    v = lambda i: [F.get("v", i + k) for k in range(size)]
    u = lambda i: [F.get("u", i + k) for k in range(size)]

    def window(i: Column) -> Column:
        slots = sum((x.between(_NAME_KEY, _UNIT_KEY).cast("int") for x in c(i)), F.lit(0))
        key = F.when(2 * slots > size, F.xxhash64(F.lit(-size), *v(i))).otherwise(F.xxhash64(F.lit(size), *c(i)))
        literal = F.when(slots > 0, F.xxhash64(F.lit(size), *u(i)))
        return F.struct(key.alias("key"), literal.alias("literal"), i.alias("at"), F.when(slots > 0, F.slice("v", i + 1, F.lit(size))).alias("values"))

    def plain(i: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(size), *v(i)).alias("key"), F.lit(None).cast("bigint").alias("literal"), i.alias("at"), F.lit(None).cast("array<bigint>").alias("values"))

    places = F.sequence(F.lit(0), F.size("v") - size)
    return F.when(F.col("slotted"), F.transform(places, window)).otherwise(F.transform(places, plain))


def windows(texts: DataFrame, key: str, asked: bool = False) -> DataFrame:
    """key and one row for each window of WINDOW tokens; asked: (hash, at, values) instead, one row for each hash that the window is looked up by."""
    digit = lambda w: F.ascii(w).between(48, 57)
    marked = texts.select(key, _marked(F.col("text")).alias("marked"))
    # Without a number or a name there is no slot, so the canonical tokens are the literal ones.
    tokens = marked.select(key, F.col("marked").rlike(f"[0-9{NAME_MARK}]").alias("slotted"), _tokens(F.col("marked")).alias("tokens")).withColumn("v", F.transform("tokens", lambda w: F.xxhash64(w)))

    def canonical(w: Column, i: Column) -> Column:
        unit = digit(F.get("tokens", i - 1)) & w.isin(*UNITS)
        return F.when(F.ascii(w) == 2, _NAME_KEY).when(digit(w), _NUMBER_KEY).when(unit, _UNIT_KEY).otherwise(F.xxhash64(w))

    bare = F.transform("tokens", lambda w: F.xxhash64(F.ltrim(w, F.lit(NAME_MARK))))
    hashed = tokens.withColumns({"c": F.when(F.col("slotted"), F.transform("tokens", canonical)), "u": F.when(F.col("slotted"), bare)}).drop("tokens")
    if asked:
        # Without slots there is one hash for each window, and with few of them a second one for few.
        places = F.sequence(F.lit(0), F.size("v") - WINDOW)
        unslotted = F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(WINDOW), *[F.get("v", i + k) for k in range(WINDOW)]).alias("hash"), i.alias("at"), F.lit(None).cast("array<bigint>").alias("values")))
        first = lambda w: F.struct(w["key"].alias("hash"), w["at"].alias("at"), w["values"].alias("values"))
        second = lambda w: F.struct(w["literal"].alias("hash"), w["at"].alias("at"), F.lit(None).cast("array<bigint>").alias("values"))
        slotted = terms.let(_windows(WINDOW), lambda all_: F.concat(F.transform(all_, first), F.transform(F.filter(all_, lambda w: w["literal"].isNotNull()), second)))
        made = F.when(F.size("v") < WINDOW, F.array().cast("array<struct<hash:bigint,at:int,values:array<bigint>>>")).when(F.col("slotted"), slotted).otherwise(unslotted)
        return hashed.select(key, made.alias("made")).select(key, F.explode_outer("made").alias("w")).filter(F.col("w").isNotNull()).select(key, "w.hash", "w.at", "w.values")
    none = F.array().cast("array<struct<key:bigint,literal:bigint,at:int,values:array<bigint>>>")
    made = F.when(F.size("v") >= WINDOW, _windows(WINDOW)).otherwise(none)
    # The outer form keeps the optimiser from making the windows once more in a filter below.
    return hashed.select(key, made.alias("made")).select(key, F.explode_outer("made").alias("w")).filter(F.col("w").isNotNull()).select(key, "w.key", "w.literal", "w.at", "w.values")


def _few(text: Column) -> Column:
    """The tokens of a text of fewer than a window, joined by spaces; null for others."""
    tokens = _tokens(F.lower(text))
    return F.when(F.size(tokens).between(1, WINDOW - 1), F.array_join(tokens, " "))


def _whole_lines(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """doc_id and item_id where an item shorter than a window is a line or text of its own; None if there is no such item."""
    short = benchmark.filter("item_id IS NOT NULL").select("item_id", _few(F.coalesce("text", F.lit(""))).alias("line")).filter("line IS NOT NULL").distinct()
    n = short.count()
    if not n:
        return None
    lines = F.array_union(F.array(F.col("text")), F.split("text", "\n", -1))
    held = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.transform(lines, _few))).alias("line")).filter("line IS NOT NULL")
    return held.join(F.broadcast(short) if n <= BROADCAST_ROWS else short, "line").select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: int = COVERED) -> DataFrame:
    """doc_id, item_id, n_matched and n_windows (distinct windows of the item), and same_values (no slot was changed); a short item counts as one window."""
    items = windows(benchmark.select("item_id", "text").filter("item_id IS NOT NULL").distinct(), "item_id").persist()
    typed = items.groupBy("item_id", "key").agg(F.min("at").alias("item_at"), F.min_by("values", "at").alias("item_values")).withColumn("hash", F.col("key"))
    literal = items.filter("literal IS NOT NULL").groupBy("item_id", "key", F.col("literal").alias("hash")).agg(F.min("at").alias("item_at"))
    totals = typed.groupBy("item_id").agg(F.count_distinct("key").alias("n_windows"))
    held = typed.unionByName(literal, allowMissingColumns=True).join(totals, "item_id").persist()
    rows = held.count()
    # A window with slots also meets the items by its letters and numbers alone, where no slot speaks.
    made = windows(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), "doc_id", asked=True)
    matched = made.join(F.broadcast(held) if rows <= BROADCAST_ROWS else held, "hash")
    matched = matched.select("doc_id", "item_id", "n_windows", "key", (F.col("at") - F.col("item_at")).alias("diagonal"), F.arrays_zip(F.col("item_values").alias("a"), F.col("values").alias("b")).alias("slots"))
    matched = base.Scratch(docs.sparkSession, "decontaminate").keep(matched, "matched")  # read twice below
    for used in (items, held):
        used.unpersist()
    occurrence = ["doc_id", "item_id", "diagonal"]
    # Literal tokens of a window are equal on both sides, so they never speak against a slot.
    slots = (
        matched.filter("slots IS NOT NULL").select(*occurrence, F.explode("slots").alias("slot"))
        .groupBy(*occurrence, F.col("slot.a").alias("a")).agg(F.min("slot.b").alias("least"), F.max("slot.b").alias("most"))
        .groupBy(*occurrence).agg(F.max(F.col("least") != F.col("most")).alias("torn"), F.max((F.col("least") != F.col("a")) | (F.col("most") != F.col("a"))).alias("changed"))
    )
    found = (
        matched.groupBy(*occurrence, "n_windows", "key").agg(F.max(F.col("slots").isNull()).alias("literal")).join(slots, occurrence, "left")
        .filter(F.col("literal") | ~F.coalesce("torn", F.lit(False)))
        .groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("key").alias("n_matched"), (~F.max(F.coalesce("changed", F.lit(False)))).alias("same_values"))
        .filter(100 * F.col("n_matched") >= covered * F.col("n_windows"))
        .select("doc_id", "item_id", "n_matched", "n_windows", "same_values")
    )
    lines = _whole_lines(docs, benchmark)
    one = F.lit(1).cast("long")
    return found if lines is None else found.unionByName(lines.select("doc_id", "item_id", one.alias("n_matched"), one.alias("n_windows"), F.lit(True).alias("same_values")))


def clean(docs: DataFrame, benchmark: DataFrame, covered: int = COVERED) -> DataFrame:
    """docs without the contaminated ones."""
    bad = contaminated(docs, benchmark, covered).select(F.col("doc_id").alias("__tw_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__tw_id"), "left_anti")
