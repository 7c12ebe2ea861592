"""Token counts by heap-and-linked-list byte-pair merging; no token ids are made.

The vocabulary file gives the merges. A word starts as a linked list of byte symbols, the last
with the end mark. A heap holds the adjacent pairs that have a rank; the least (rank, place) is
popped, skipped if its symbols have changed since, else its two nodes become one and the pairs
left and right of it enter the heap. The count is the number of initial symbols minus merges.

The text is treated as the library treats it by default: strings of the special tokens are cut out
of the raw text and count one each; the rest is normalised (NFC, white space, lower case without
regard to context) and cut into contractions, runs of letters, single numbers and runs of other
characters. Counts of blank-separated chunks and of words are kept in bounded tables of the worker.

Nulls: a null text counts as empty, with 0 bytes and 0 tokens. Repeated rows are counted each.
Empty tables give empty results. Extra columns pass through ``count_tokens`` unread; an input
column named n_tokens is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

KEPT_CHUNKS = 600_000
#: White space of the file's pattern; str.split() would also cut at U+001C to U+001F.
_SPACE_CLASS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_SPACE_CLASS}]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f]")


def merged_count(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left after all merges; ranks gives (rank, new symbol) of a pair."""
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        if (found := ranks.get((symbols[i], symbols[i + 1]))) is not None:
            heap.append((found[0], i, symbols[i], symbols[i + 1]))
    if not heap:
        return n
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if symbols[i] != a:
            continue
        j = after[i]
        if j >= n or symbols[j] != b:
            continue
        symbols[i] = c = ranks[a, b][1]
        symbols[j] = -1
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (found := ranks.get((c, symbols[k]))) is not None:
                heapq.heappush(heap, (found[0], i, c, symbols[k]))
        h = before[i]
        if h >= 0 and (found := ranks.get((symbols[h], c))) is not None:
            heapq.heappush(heap, (found[0], h, symbols[h], c))
    return left


class _Table(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, key: str) -> int:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        self[key] = n = self.count(key)
        return n


class Counter:
    """Counts tokens by one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        shown = _byte_characters()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + end] for c in shown]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", _SPACE_CLASS))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.by_word, self.by_chunk = _Table(self._word), _Table(self._chunk)

    def _word(self, word: str) -> int:
        data = word.encode("utf-8", "replace")
        return merged_count([self.inner[x] for x in data[:-1]] + [self.last[data[-1]]], self.ranks)

    def _chunk(self, chunk: str) -> int:
        if chunk.isascii() and chunk.isalpha():
            return self.by_word[chunk]
        return sum(map(self.by_word.__getitem__, self.words.findall(chunk)))

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        chunks = text.split() if not _OTHER_SPACE.search(text) else [c for c in _SPACE.split(text) if c]
        return sum(map(self.by_chunk.__getitem__, chunks))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<" not in text:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def _byte_characters() -> list[str]:
    """The character that shows each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            shown.append(chr(b))
        else:
            shown.append(chr(free))
            free += 1
    return shown


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a file, made once."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens of each whole text by the vocabulary file at path."""
    base.python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        from tidewire.llm import bpe_count

        count = bpe_count.counter(path).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", counted("text"))
