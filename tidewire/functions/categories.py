"""Categories of an article from its source, its tags and hints in its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import held, let, listed, read
from .vocabulary import HINTS, TAGS

#: The standard categories and those for which one hint is enough, fixed values.
STANDARD = ("world", "politics", "business", "economy", "technology", "science", "health", "environment", "conflict", "disaster", "crime", "sports", "entertainment", "culture")
EASY = ("disaster", "conflict", "sports")


def classify(title: Column, text: Column, hints: dict[str, list[str]] | None, source_categories: Column, tags: Column | None = None, synonyms: dict[str, str] | None = None, portable: bool = False) -> Column:
    """Sorted categories. A hint in the title counts 2, else in the text 1; 2 are needed, 1 for EASY ones.

    hints gives the terms of each category and synonyms the category of each tag; None stands for the built-in ones.
    """
    hints, synonyms = HINTS if hints is None else hints, TAGS if synonyms is None else synonyms
    found = [F.array_intersect(F.coalesce(source_categories, F.array().cast("array<string>")), F.array(*map(F.lit, STANDARD)))]
    if tags is not None and synonyms:
        names = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        found.append(F.filter(F.transform(tags, lambda t: F.element_at(names, F.lower(F.trim(t)))), lambda c: c.isNotNull()))
    # A term may stand for several categories, so each category has its own list.
    tables = {name: listed({w: name for w in words}, portable) for name, words in hints.items()}

    def hinted(known: Column) -> Column:
        each = []
        for name, table in tables.items():
            points = lambda a, t: a + F.when(held(known["title"], t), 2).when(held(known["text"], t), 1).otherwise(0)
            each.append(F.when(F.aggregate(table, F.lit(0), points) >= (1 if name in EASY else 2), F.lit(name)))
        return F.filter(F.array(*each), lambda c: c.isNotNull())

    if hints:
        found.append(let(F.struct(read(title).alias("title"), read(text).alias("text")), hinted))
    out = F.array_sort(F.array_distinct(F.concat(*found)))
    return F.when(F.size(out) == 0, F.array(F.lit("world"))).otherwise(out)

