"""The boolean text language: text to syntax tree to one Spark predicate.

Precedence, loosest first: OR, AND (also by adjacency), NOT, NEAR, atom. Atoms are words,
"phrases", bracketed expressions and field scopes such as title:word. See ``parse``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import terms

#: Field prefixes and the text they search, fixed values.
FIELDS = {
    "title": "headline", "headline": "headline", "intitle": "headline",
    "intext": "text", "text": "text", "body": "text",
    "inlede": "lede", "lede": "lede", "intro": "lede",
    "source": "source", "publication": "source", "outlet": "source",
    "site": "site", "host": "site", "domain": "site",
}
#: Words that are often searched in one sense and written in another, with better choices; fixed values.
AMBIGUOUS = {
    "wind": '"wind power", "wind farm", "offshore wind"',
    "solar": '"solar power", "solar farm", "solar panel"',
    "coal": '"coal-fired", "coal plant", "coal mine"',
    "nuclear": '"nuclear power", "nuclear plant", "nuclear reactor"',
    "gas": '"natural gas", "gas pipeline", "gas field"',
    "oil": '"crude oil", "oil field", "oil refinery"',
    "power": '"power plant", "power grid", "power outage"',
    "plant": '"power plant", "chemical plant", "plant closure"',
    "mine": '"coal mine", "gold mine", "mine collapse"',
    "grid": '"power grid", "grid operator"',
    "strike": '"labour strike", "air strike", "strike action"',
    "crash": '"plane crash", "market crash", "car crash"',
    "fire": '"wildfire", "house fire", "fire crews"',
    "storm": '"tropical storm", "winter storm", "storm damage"',
    "shell": '"Shell plc", "shell company", "artillery shell"',
    "apple": '"Apple Inc", "Apple iPhone"',
    "amazon": '"Amazon.com", "Amazon rainforest"',
    "meta": '"Meta Platforms", "Meta AI"',
    "target": '"Target Corp", "target of"',
    "delta": '"Delta Air Lines", "Nile delta", "Delta variant"',
    "orange": '"Orange SA", "Orange County"',
}
DEFAULT_GAP, WIDEST_GAP = 10, 100


class QueryError(ValueError):
    """A query that can't be read; the message says why."""


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass(frozen=True)
class Near:
    left: Term
    right: Term
    gap: int
    ordered: bool


@dataclass(frozen=True)
class Scoped:
    field: str
    term: Term


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Token:
    kind: str  # term, field, and, or, not, near, open, close
    value: object = None


_PIECE = re.compile(r'\s+|"(?P<phrase>[^"]*)"|(?P<quote>")|(?P<bracket>[()])|(?P<sign>\|\|?|&&)|(?P<word>[^\s()"|]+)')
_DISTANCE = re.compile(r"(?i)^(NEAR|ONEAR|PRE|W)(?:/(\d+))?$")
_AROUND = re.compile(r"(?i)\bAROUND\s*(?:\(\s*(\d+)\s*\)|/(\d+))?(?![\w/(])")


def tokenize(query: str) -> list[Token]:
    text = re.sub("[“”„«»]", '"', query or "").replace("’", "'")
    text = _AROUND.sub(lambda m: f"NEAR/{n}" if (n := m[1] or m[2]) else "NEAR", text)
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _PIECE.match(text, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m["quote"]:
            raise QueryError("A quotation mark is not closed.")
        if m["phrase"] is not None:
            if not m["phrase"].split():
                raise QueryError("A phrase is empty.")
            out.append(Token("term", Term(" ".join(m["phrase"].split()), True)))
        elif m["bracket"]:
            out.append(Token("open" if m["bracket"] == "(" else "close"))
        elif m["sign"]:
            out.append(Token("and" if m["sign"] == "&&" else "or"))
        elif m["word"]:
            out += _word(m["word"])
    return out


def _word(word: str) -> list[Token]:
    if word.startswith("-") and len(word) > 1:
        return [Token("not"), *_word(word[1:])]
    if word == "-":
        return [Token("not")]
    if word.startswith("~"):
        raise QueryError(f"Synonym search ({word}) isn't supported.")
    upper = word.upper()
    if upper in ("AND", "OR", "NOT", "&&"):
        return [Token("and" if upper == "&&" else upper.lower())]
    if (m := _DISTANCE.match(word)) and (m[2] or m[1].upper() in ("NEAR", "ONEAR")):
        gap = int(m[2]) if m[2] else DEFAULT_GAP
        if not 1 <= gap <= WIDEST_GAP:
            raise QueryError(f"The distance of {m[1].upper()} must be from 1 to {WIDEST_GAP}.")
        return [Token("near", (gap, m[1].upper() != "NEAR"))]
    head, colon, rest = word.partition(":")
    if colon and head.lower() in FIELDS:
        return [Token("field", FIELDS[head.lower()]), *([Token("term", Term(rest))] if rest else [])]
    return [Token("term", Term(word))]


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    def kind(self) -> str | None:
        return self.tokens[self.at].kind if self.at < len(self.tokens) else None

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        if not self.tokens:
            raise QueryError("The query is empty.")
        tree = self.either()
        if self.kind() is not None:
            raise QueryError("Unexpected closing bracket." if self.kind() == "close" else f"Unexpected {self.kind()}.")
        return tree

    def either(self):
        tree = self.both()
        while self.kind() == "or":
            self.take()
            tree = Or(tree, self.both())
        return tree

    def both(self):
        tree = self.negated()
        while self.kind() in ("and", "not", "open", "term", "field"):
            if self.kind() == "and":
                self.take()
            tree = And(tree, self.negated())
        return tree

    def negated(self):
        if self.kind() == "not":
            self.take()
            return Not(self.negated())
        return self.near()

    def near(self):
        left, tree = self.atom(), None
        while self.kind() == "near":
            gap, ordered = self.take().value
            right = self.atom()
            if not (isinstance(left, Term) and isinstance(right, Term)):
                raise QueryError("NEAR needs a word or phrase on both sides.")
            pair = Near(left, right, gap, ordered)
            tree, left = pair if tree is None else And(tree, pair), right
        return left if tree is None else tree

    def atom(self):
        kind = self.kind()
        if kind == "term":
            return checked(self.take().value)
        if kind == "open":
            self.take()
            tree = self.either()
            if self.kind() != "close":
                raise QueryError("A bracket is not closed.")
            self.take()
            return tree
        if kind == "field":
            field = self.take().value
            if self.kind() != "term":
                raise QueryError(f"A word must follow the field {field}.")
            return Scoped(field, checked(self.take().value))
        raise QueryError("The query ends too early." if kind is None else f"Unexpected {kind}.")


def checked(term: Term) -> Term:
    for word in term.text.split():
        if re.search(r"[*?]", word) and len(re.sub(r"[*?]", "", word)) < 2:
            raise QueryError(f"{word}: a wildcard needs two letters beside it.")
    return term


def parse(query: str):
    """The syntax tree of a query; QueryError if there is none."""
    return _Parser(tokenize(query)).whole()


def validate(query: str) -> str | None:
    """What is wrong with a query, or None."""
    try:
        parse(query)
    except QueryError as e:
        return str(e)
    return None


# Regular expressions


def _word_pattern(word: str, portable: bool) -> str:
    any_letter = r"[\p{L}\p{N}_]" if portable else r"\w"
    return "".join(any_letter + "*" if c == "*" else any_letter if c == "?" else terms.escape(c) for c in word)


def _body(term: Term, portable: bool) -> str:
    return r"\s+".join(_word_pattern(w, portable) for w in term.text.split())


def term_pattern(term: Term, portable: bool = False) -> str:
    t = term.text
    return terms.bounded(_body(term, portable), t[0], t[-1], portable, t[0] in "*?", t[-1] in "*?")


def near_pattern(near: Near, portable: bool = False) -> str:
    def one(a: Term, b: Term) -> str:
        if any(terms.UNSPACED.search(x.text) for x in (a, b)):
            return f"(?s:{_body(a, portable)}.{{0,{2 * near.gap}}}?{_body(b, portable)})"
        gap = rf"(?:[^\p{{L}}\p{{N}}_]+[\p{{L}}\p{{N}}_]+){{0,{near.gap}}}?[^\p{{L}}\p{{N}}_]+" if portable else rf"(?:\W+\w+){{0,{near.gap}}}?\W+"
        whole = _body(a, portable) + gap + _body(b, portable)
        return terms.bounded(whole, a.text[0], b.text[-1], portable, a.text[0] in "*?", b.text[-1] in "*?")

    forth = one(near.left, near.right)
    return forth if near.ordered else f"(?:{forth}|{one(near.right, near.left)})"


def to_column(tree, fields: dict[str, Column], portable: bool = False) -> Column:
    """The predicate of a tree over the texts all, headline, text, lede, source and site; a missing text is empty."""
    flags = terms.flags(portable)
    if isinstance(tree, Term):
        return fields["all"].rlike(flags + term_pattern(tree, portable))
    if isinstance(tree, Near):
        return fields["all"].rlike(flags + near_pattern(tree, portable))
    if isinstance(tree, Scoped):
        return fields.get(tree.field, F.lit("")).rlike(flags + term_pattern(tree.term, portable))
    if isinstance(tree, Not):
        return ~to_column(tree.child, fields, portable)
    left, right = to_column(tree.left, fields, portable), to_column(tree.right, fields, portable)
    return left & right if isinstance(tree, And) else left | right


def query_column(query: str, fields: dict[str, Column], portable: bool = False) -> Column:
    """As to_column; a query that can't be read matches nothing. Texts without the words that every match holds are told apart first."""
    try:
        found = to_column(parse(query), fields, portable)
    except QueryError:
        return F.lit(False)
    needed = prefilter_terms(query)
    if not needed:
        return found
    can = F.lit(False)
    for words in needed:
        can = can | terms.holds(fields["all"], words, fields.get("low"), fields.get("odd"))
    return can & found


def fields_of(query: str) -> set[str]:
    """The fields that a query reads; none if it can't be read."""

    def walk(node) -> set[str]:
        if isinstance(node, Scoped):
            return {node.field}
        if isinstance(node, Not):
            return walk(node.child)
        if isinstance(node, (And, Or)):
            return walk(node.left) | walk(node.right)
        return {"all"}

    try:
        return walk(parse(query))
    except QueryError:
        return set()


def plain(text: Column) -> dict[str, Column]:
    """The fields of a plain text: it is all and text, the other fields are empty."""
    return {k: text if k in ("all", "text") else F.lit("") for k in ("all", "headline", "text", "lede", "source", "site")}


def matches(tree, fields: dict[str, str]) -> bool:
    """The same for one row in plain Python; the slow check of to_column."""
    find = lambda p, s: re.search(p, s, re.IGNORECASE) is not None
    if isinstance(tree, Term):
        return find(term_pattern(tree), fields["all"])
    if isinstance(tree, Near):
        return find(near_pattern(tree), fields["all"])
    if isinstance(tree, Scoped):
        return find(term_pattern(tree.term), fields.get(tree.field, ""))
    if isinstance(tree, Not):
        return not matches(tree.child, fields)
    if isinstance(tree, And):
        return matches(tree.left, fields) and matches(tree.right, fields)
    return matches(tree.left, fields) or matches(tree.right, fields)


# What a query says


def literal_terms(query: str, scoped: bool = True) -> list[Term]:
    """Distinct terms, those of NEAR left out; scoped=False leaves out those of fields too."""
    found: dict[str, Term] = {}

    def walk(node) -> None:
        if isinstance(node, Term):
            found.setdefault(node.text.lower(), node)
        elif isinstance(node, Scoped) and scoped:
            found.setdefault(node.term.text.lower(), node.term)
        elif isinstance(node, Not):
            walk(node.child)
        elif isinstance(node, (And, Or)):
            walk(node.left)
            walk(node.right)

    try:
        walk(parse(query))
    except QueryError:
        return []
    return list(found.values())


def only_excludes(tree) -> bool:
    """Whether some alternative of the tree holds for a text without any of its terms."""
    if isinstance(tree, Not):
        return True
    if isinstance(tree, And):
        return only_excludes(tree.left) and only_excludes(tree.right)
    if isinstance(tree, Or):
        return only_excludes(tree.left) or only_excludes(tree.right)
    return False


def matches_everything(query: str) -> bool:
    try:
        return only_excludes(parse(query))
    except QueryError:
        return False


def ambiguous_terms(query: str) -> list[str]:
    """Bare words of the query that are in AMBIGUOUS, in order."""
    try:
        tokens = tokenize(query)
    except QueryError:
        return []
    bare = [t.value.text.lower() for before, t in zip([None, *tokens], tokens) if t.kind == "term" and not (before and before.kind == "field")]
    return list(dict.fromkeys(w for w in bare if w in AMBIGUOUS))


def advisories(query: str) -> list[str]:
    """Hints on a valid query that may not mean what it says."""
    if validate(query) is not None:
        return []
    notes = []
    if matches_everything(query):
        notes.append("One alternative only excludes, so the query matches nearly everything; bracket the alternatives: (a OR b) NOT c.")
    depth, alternatives = 0, set()
    for token in tokenize(query):
        depth += {"open": 1, "close": -1}.get(token.kind, 0)
        if token.kind == "close":
            alternatives.discard(depth + 1)
        if token.kind == "or":
            alternatives.add(depth)
        if token.kind == "not" and depth in alternatives:
            notes.append("NOT excludes from the last alternative only; bracket the alternatives: (a OR b) NOT c.")
            break
    words = ambiguous_terms(query)
    notes += [f"{w} has other meanings; consider {AMBIGUOUS[w]}." for w in words[:3]]
    if words[3:]:
        notes.append(f"{len(words) - 3} more such words: {', '.join(words[3:])}.")
    return notes


def prefilter_terms(query: str) -> list[list[str]] | None:
    """Alternatives of plain words of which every match holds one in full, or None if there is no such list."""

    def walk(node):
        if isinstance(node, Term):
            plain = not re.search(r"[*?]", node.text) and not terms.UNSPACED.search(node.text)
            return [node.text.lower().split()] if plain else None
        if isinstance(node, Scoped):
            return walk(node.term) if node.field in ("headline", "text") else None
        if isinstance(node, Near):
            left, right = walk(node.left), walk(node.right)
            return None if left is None or right is None else [left[0] + right[0]]
        if isinstance(node, And):
            left, right = walk(node.left), walk(node.right)
            if left is None or right is None:
                return left or right
            return [a + b for a in left for b in right]
        if isinstance(node, Or):
            left, right = walk(node.left), walk(node.right)
            return None if left is None or right is None else left + right
        return None

    try:
        return walk(parse(query))
    except QueryError:
        return None
