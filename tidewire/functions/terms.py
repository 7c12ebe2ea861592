"""Regular expressions of search terms: whole words, phrases, scripts without blanks.

``portable`` makes boundaries that Java and RE2 read alike; it consumes the boundary characters, so it
answers yes or no but must not be used to count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scripts that are written without blanks: kana, Han, Hangul, Thai.
UNSPACED = re.compile("[぀-ヿ㐀-䶿一-鿿가-힣฀-๿]")
_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")
FLAGS, PORTABLE_FLAGS = "(?iuU)", "(?iu)"
_LEFT, _RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\1", text)


def bounded(body: str, first: str, last: str, portable: bool, open_left: bool = False, open_right: bool = False) -> str:
    """body between word boundaries, but where an end is open or of a script without blanks."""
    left = "" if open_left or UNSPACED.match(first) else _LEFT if portable else r"\b"
    right = "" if open_right or UNSPACED.match(last) else _RIGHT if portable else r"\b"
    return left + body + right


def keyword(term: str, portable: bool = False) -> str:
    """A keyword taken literally, its words parted by any white space."""
    words = term.split()
    if not words:
        return ""
    return bounded(r"\s+".join(map(escape, words)), words[0][0], words[-1][-1], portable)


def flags(portable: bool) -> str:
    return PORTABLE_FLAGS if portable else FLAGS


#: Letters that equal an ASCII letter, or a Cyrillic one, when case is ignored, though lower case keeps them apart.
_FOLDED, _FOLDED_CYRILLIC = "İıſ\u212a", "\u1c80-\u1c88"
_SIMPLE = re.compile("[a-z0-9à-öø-ÿа-яё]+")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def read(text: Column) -> Column:
    """What ``held`` needs to know of a text: itself, in lower case, and whether a letter of it folds oddly."""
    return F.struct(text.alias("text"), F.lower(text).alias("low"), text.rlike(f"[{_FOLDED}{_FOLDED_CYRILLIC}]").alias("odd"))


def listed(terms: dict[str, int | str], portable: bool = False) -> Column:
    """A constant array of terms for ``held``: the words to look for, the pattern, and the value of each term."""
    rows = []
    for term, value in terms.items():
        words = [w for w in term.lower().split() if _SIMPLE.fullmatch(w) or w.upper() == w]
        rows.append({"words": words, "pattern": flags(portable) + keyword(term, portable), "value": str(value)})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<words:array<string>,pattern:string,value:string>>")


def held(known: Column, term: Column) -> Column:
    """Whether one of the ``listed`` terms occurs in a text as ``read``; only texts with its words meet the regular expression."""
    can = F.forall(term["words"], lambda w: F.contains(known["low"], w))
    return (can | known["odd"]) & F.regexp_like(known["text"], term["pattern"])


def oddly_folded(text: Column) -> Column:
    """Whether a letter outside ASCII equals an ASCII letter when case is ignored."""
    odd = F.lit(False)
    for c in _FOLDED:
        odd = odd | F.contains(text, F.lit(c))
    return odd


def holds(text: Column, words: list[str], low: Column | None = None, odd: Column | None = None) -> Column:
    """Whether a text can match all these words: a search for bytes that spares most texts the regular expression.

    Only words of ASCII are looked for, and a text with a letter that folds to one of ASCII passes, so no match is lost.
    low and odd are the text in lower case and whether it is ``oddly_folded``, if they are at hand.
    """
    plain = sorted({w.lower() for w in words if w.isascii() and w.isalnum()})
    if not plain:
        return F.lit(True)
    low, found = F.lower(text) if low is None else low, F.lit(True)
    for w in plain:
        found = found & F.contains(low, F.lit(w))
    return found | (oddly_folded(text) if odd is None else odd)


def one_of(text: Column, term: str, portable: bool = False) -> Column:
    return holds(text, term.split()) & text.rlike(flags(portable) + keyword(term, portable))


def any_of(text: Column, terms: list[str], portable: bool = False, low: Column | None = None, odd: Column | None = None) -> Column:
    """Whether any of the terms occurs: one alternation, one pass over the texts that can hold one."""
    can = F.lit(False)
    for t in terms:
        can = can | holds(text, t.split(), low, odd)
    return can & text.rlike(flags(portable) + "(?:" + "|".join(keyword(t, portable) for t in terms) + ")")
