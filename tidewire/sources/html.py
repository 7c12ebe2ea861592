"""Readable text of web pages: a streaming parser per page, run in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# Tags without text, tags of body text, other blocks, tags without an end, tags that end a
# paragraph, phrases of a site speaking of itself, limits.
SKIPPED = frozenset("script style noscript svg nav form iframe head footer aside figure button select template dialog".split())
BODY = frozenset("p h1 h2 h3 li blockquote".split())
OTHER = frozenset("div section article main header td th dd dt h4 h5 h6 figcaption details summary label caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split()
)
SITE_VOICE = (
    "we use cookies", "uses cookies", "accept all cookies", "cookie settings", "all rights reserved", "sign up for our", "subscribe to our", "enable javascript",
    "javascript is disabled", "javascript to continue", "your browser does not support", "please enable", "already a subscriber", "create a free account", "start your free trial",
)
LEAST_TEXT, LEAST_WORDS = 200, 10
BLOCKS = BODY | OTHER


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipping: list[str] = []
        self.open: list[dict] = []
        self.done: list[tuple[int, str]] = []
        self.other: list[tuple[int, str]] = []
        self.links = self.place = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" and self.open:
                self.open[-1]["text"].append(" ")
            return
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.append(tag)
            return
        if tag in SKIPPED:
            self.skipping.append(tag)
            return
        if tag == "a":
            self.links += 1
        if tag in BLOCKS:
            last = self.open[-1]["tag"] if self.open else ""
            if (last == "p" and tag in ENDS_P) or (last == tag and tag in ("li", "dd", "dt")):
                self._close()
            self.place += 1
            self.open.append({"tag": tag, "place": self.place, "text": [], "plain": False})

    def handle_endtag(self, tag):
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS and any(b["tag"] == tag for b in self.open):
            while self.open[-1]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if self.skipping:
            return
        if self.open:
            self.open[-1]["text"].append(data)
            self.open[-1]["plain"] |= not self.links and bool(data.strip())

    def _close(self):
        block = self.open.pop()
        text = " ".join("".join(block["text"]).split())
        if text and block["plain"] and not any(v in text.lower() for v in SITE_VOICE):
            (self.done if block["tag"] in BODY else self.other).append((block["place"], text))

    def result(self) -> str:
        while self.open:
            self._close()
        text = " ".join(t for _, t in sorted(self.done)).strip()
        if len(text) < LEAST_TEXT:
            other = " ".join(t for _, t in sorted(self.other) if len(t.split()) >= LEAST_WORDS)
            text = other if len(other) > len(text) else text
        return text


def extract(html: str | None, most_input: int | None = None, most_text: int | None = None) -> str:
    """Text of the page's blocks in document order; blocks of links only, or of site talk, are left out. Whole pages are read unless a most is given."""
    parser = _Blocks()
    parser.feed((html or "")[:most_input])
    parser.close()
    return parser.result()[:most_text]


def page_text(pages: DataFrame, key: str, html: str = "html", most_input: int | None = None, most_text: int | None = None) -> DataFrame:
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda page: extract(page, most_input, most_text))

    return pages.select(key, text(html).alias("text"))
