"""Language ID by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary plus every single byte, so each word can be
segmented. A language gives each piece a probability; the probability of a word is the sum, by a
forward algorithm, over all its segmentations of the product of their pieces. A text's score
for a language adds the log-probabilities of its words (runs of letters in lower case, a blank before
each) and the log-prior of the language; the prediction is the best language, its score the posterior.

Piece probabilities come from a few rounds of expectation maximisation over the most frequent
words of each language in a bounded sample of labelled documents, drawn by language; priors are the shares
of all labelled documents.

Forward runs for thousands of words at once: piece ids of substrings are found by rolling hashes in a
table that also knows which substrings begin a piece, then one vector step per (start, length). A word of
any length is summed over all its segmentations: it is read ``LONG`` bytes at a time, and the forward cells
that pieces have reached beyond that are carried on, scaled to stay in range.

Nulls: a null text, or one without a letter (Unicode L), is ``und`` with score 0. Rows with a null lang or
doc_id teach nothing. Repeated rows teach once and are predicted each. Equally good languages
give the first by code point. With no labelled rows all texts are ``und``. Extra columns pass
through ``predict`` unread; input columns named like results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Bytes of a word that are read at once, words of a block, cells of a forward table.
LONG, BLOCK, CELLS = 48, 8192, 4_000_000
#: Places of words whose pieces are looked up at once in teaching.
SEGMENT = 256
#: Runs of letters and of other numerals; those with other numerals are split once more.
_RUNS = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Probabilities are scaled by this per byte, so products of many stay in range.
_SCALE = 32.0
#: Words a worker keeps with their log-probabilities for up to four languages; fewer for more.
KEPT_WORDS = 400_000


def letters(text: str | None) -> Counter:
    """The words of a text (runs of letters, Unicode L, in lower case) and how often each occurs."""
    words = Counter(_RUNS.findall((text or "").lower()))
    for run in [w for w in words if not w.isalpha()]:
        n = words.pop(run)
        for word in "".join(c if c.isalpha() else " " for c in run).split():
            words[word] += n
    return words


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes + 1 of each word, filled with 0 to the longest, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max()) if len(words) else 0
    flat = np.frombuffer(b"".join(words), np.uint8)
    out = np.zeros((len(words), width), np.uint64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat.astype(np.uint64) + np.uint64(1)
    return out, lengths


class Vocabulary:
    """Pieces as byte strings, found by rolling hash; a leading word mark is a blank.

    Ids below ``size`` are pieces, those from there to ``nodes`` only begin pieces; ``inner`` marks what begins a longer piece.
    """

    def __init__(self, pieces: list[bytes]):
        self.pieces = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, self.pieces))
        self.size = len(self.pieces)
        begun = {p[:n] for p in self.pieces for n in range(1, len(p))}
        names = self.pieces + sorted(begun - set(self.pieces))
        self.nodes = len(names)
        self.inner = np.array([*(n in begun for n in names), False])
        keys = np.zeros(self.nodes + 1, np.uint64)
        for i, name in enumerate(names):
            h = 0
            for c in name:
                h = (h * int(_BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = h
        self.keys = keys
        bits = max(20, (8 * self.nodes).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, self.nodes, np.int32)
        for i, at in enumerate(self._slot(keys[:-1]).tolist()):
            while self.slots[at] != self.nodes:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def _slot(self, h):
        h = h ^ (h >> np.uint64(29))
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of what has these hashes; ``nodes`` where there is nothing."""
        at = self._slot(h)
        found = self.slots[at]
        wrong = np.flatnonzero((self.keys[found] != h) & (found != self.nodes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(self.keys[found[wrong]] != h[wrong]) & (found[wrong] != self.nodes)]
        return found

    def lattice(self, codes: np.ndarray, lengths: np.ndarray, starts: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, piece ids) of all pieces that begin in the words (or at their first places), starts in order."""
        out, width, columns = [], codes.shape[1], np.ascontiguousarray(codes.T)
        for start in range(width if starts is None else min(width, starts)):
            rows = np.flatnonzero(lengths > start)
            h = columns[start][rows]
            for n in range(1, self.longest + 1):
                ids = self.find(h)
                hit = ids < self.size
                if hit.any():
                    out.append((start, n, rows[hit], ids[hit]))
                more = self.inner[ids] & (lengths[rows] > start + n)
                rows = rows[more]
                if not len(rows):
                    break
                h = h[more] * _BASE + columns[start + n][rows]
        return out


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of letters of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and piece.strip("▁").isalpha():
            pieces.append(piece.lower().replace("▁", " ").encode())
    return Vocabulary(pieces)


def forward(lattice, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scaled forward sums (words, positions, languages) for scaled piece probabilities p (pieces, languages)."""
    a = np.zeros((int(lengths.max(initial=0)) + 1, len(lengths), p.shape[1]))
    a[0] = 1
    return np.moveaxis(_onward(a, lattice, p), 0, 1)


def _onward(a: np.ndarray, lattice, p: np.ndarray) -> np.ndarray:
    """Add what each piece brings from its start to its end; a has (positions, words, languages)."""
    for start, n, rows, ids in lattice:
        a[start + n][rows] += a[start][rows] * p[ids]
    return a


def _scaled(vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    return p * (_SCALE ** np.fromiter(map(len, vocabulary.pieces), float, vocabulary.size))[:, None]


def _encoded(word: str) -> bytes:
    return b" " + word.encode("utf-8", "replace")


def _blocks(words: list[bytes], most: int, cells: int, width: int | None = None):
    """Indexes of the words by length, in blocks of at most that many words and cells; width: the largest to count."""
    order, block, n = sorted(range(len(words)), key=lambda i: len(words[i])), [], 0
    for i in order:
        n = len(words[i]) if width is None else min(width, len(words[i]))
        if block and (len(block) == most or (len(block) + 1) * (n + 1) > cells):
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def _segments(vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray, backwards: bool = False):
    """The lattice of words of any length, some places at a time."""
    starts = range(0, codes.shape[1], SEGMENT)
    for at in reversed(starts) if backwards else starts:
        part = vocabulary.lattice(codes[:, at : at + SEGMENT + vocabulary.longest], np.clip(lengths - at, 0, SEGMENT + vocabulary.longest), SEGMENT)
        for start, size, rows, ids in reversed(part) if backwards else part:
            yield at + start, size, rows, ids


def expected(vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray, n: np.ndarray, p: np.ndarray | None) -> np.ndarray:
    """How often each piece is used in words that occur n times, over all their segmentations by p; without p, how often it fits."""
    seen = np.zeros(vocabulary.size)
    if p is None:
        for _, _, rows, ids in _segments(vocabulary, codes, lengths):
            seen += np.bincount(ids, n[rows], vocabulary.size)
        return seen
    logs, here = np.log(p), np.arange(len(lengths))
    a = np.full((int(lengths.max(initial=0)) + 1, len(lengths)), -np.inf)
    b = a.copy()
    a[0], b[lengths, here] = 0, 0
    short = list(_segments(vocabulary, codes, lengths)) if codes.shape[1] <= SEGMENT else None
    for start, size, rows, ids in short or _segments(vocabulary, codes, lengths):
        a[start + size][rows] = np.logaddexp(a[start + size][rows], a[start][rows] + logs[ids])
    whole = a[lengths, here]
    for start, size, rows, ids in reversed(short) if short else _segments(vocabulary, codes, lengths, True):
        ending = b[start + size][rows] + logs[ids]
        b[start][rows] = np.logaddexp(b[start][rows], ending)
        seen += np.bincount(ids, n[rows] * np.exp(a[start][rows] + ending - whole[rows]), vocabulary.size)
    return seen


def learn(vocabulary: Vocabulary, counts: dict[str, dict[str, int]], rounds: int = 3, floor: float = 1e-7) -> np.ndarray:
    """Piece probabilities (pieces, languages) from word counts of each language, words of any length; sums are kept as logarithms."""
    out = np.zeros((vocabulary.size, len(counts)))
    for k, words in enumerate(counts.values()):
        taught, n = [_encoded(w) for w in words], np.array(list(words.values()), float)
        blocks = list(_blocks(taught, BLOCK, CELLS))
        p = None
        for _ in range(rounds + 1):
            seen = np.zeros(vocabulary.size)
            for at in blocks:
                seen += expected(vocabulary, *_codes([taught[i] for i in at]), n[at], p)
            p = seen / max(1.0, seen.sum()) + floor
        out[:, k] = p / p.sum()
    return out


class Model:
    """Scores texts; keeps the log-probabilities of the words it has met in a bounded table."""

    def __init__(self, vocabulary: Vocabulary, languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.vocabulary, self.languages = vocabulary, languages
        self.q, self.prior = _scaled(vocabulary, p), np.log(prior)
        self.known: dict[str, int] = {}
        self.kept = KEPT_WORDS * 4 // max(4, len(languages))
        self.table = np.zeros((self.kept, len(languages)))

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, over all segmentations whatever its length."""
        data = [_encoded(w) for w in words]
        out = np.zeros((len(words), len(self.languages)))
        width = LONG + self.vocabulary.longest
        for block in _blocks(data, BLOCK, CELLS // max(1, len(self.languages)), width):
            self._block_logs(data, np.array(block), width, out)
        return out

    def _block_logs(self, data: list[bytes], open_: np.ndarray, width: int, out: np.ndarray) -> None:
        begun, tiny = 0, 1e-300
        a, carried = None, np.zeros((len(open_), len(self.languages)))
        while len(open_):
            codes, lengths = _codes([data[i][begun : begun + width - 1] for i in open_])
            if a is None:
                a = np.zeros((codes.shape[1] + 1, len(open_), len(self.languages)))
                a[0] = 1
            _onward(a, self.vocabulary.lattice(codes, lengths, LONG), self.q)
            left = np.fromiter((len(data[i]) - begun for i in open_), np.int64, len(open_))
            done = np.flatnonzero(left <= LONG)
            whole = left[done] + begun
            out[open_[done]] = np.log(np.maximum(a[left[done], done], tiny)) + carried[done] - whole[:, None] * np.log(_SCALE)
            longer = np.flatnonzero(left > LONG)
            if not len(longer):
                return
            # What pieces have reached beyond the bytes read goes on, as shares of its largest cell.
            begun, open_, tail = begun + LONG, open_[longer], a[LONG:, longer]
            top = np.maximum(tail.max(axis=0), tiny)
            carried = carried[longer] + np.log(top)
            a = np.zeros((width, len(open_), len(self.languages)))
            a[: len(tail)] = tail / top

    def _look_up(self, words: list[str]) -> None:
        if len(self.known) + len(words) > self.kept:
            self.known.clear()
        n = len(self.known)
        words = words[: self.kept - n]
        if words:
            self.table[n : n + len(words)] = self.word_logs(words)
            self.known.update(zip(words, range(n, n + len(words))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores, start = [], [], 0
        while start < len(texts):
            counts, size = [], 0
            while start < len(texts) and (size < 4_000_000 or not counts):
                counts.append(letters(texts[start]))
                size += len(texts[start] or "")
                start += 1
            fresh = list(dict.fromkeys(w for words in counts for w in words if w not in self.known))
            if len(fresh) > self.kept // 2:
                totals = [self._direct(words) for words in counts]
            else:
                self._look_up(fresh)
                totals = [self._total(words) for words in counts]
            for words, total in zip(counts, totals):
                if not words or not self.languages:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                total = total + self.prior
                best = int(total.argmax())
                langs.append(self.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores

    def _total(self, words: Counter) -> np.ndarray:
        try:
            at = [self.known[w] for w in words]
        except KeyError:  # the table was cleared meanwhile
            return self._direct(words)
        return np.fromiter(words.values(), float, len(words)) @ self.table[at] if at else np.zeros(len(self.languages))

    def _direct(self, words: Counter) -> np.ndarray:
        names, total = list(words), np.zeros(len(self.languages))
        for i in range(0, len(names), BLOCK):
            part = names[i : i + BLOCK]
            total += np.array([words[w] for w in part], float) @ self.word_logs(part)
        return total


def train(docs: DataFrame, path: str, max_docs: int = 4000, held_out_mod: int = 3, held_out_rest: int = 1, rounds: int = 3):
    """(languages, piece probabilities, priors) from labelled documents outside the held-out fold.

    The sample is about max_docs documents, shared evenly by the languages (20 documents each at least), those of smallest
    hashed id. All words of the sample teach.
    """
    spark = docs.sparkSession
    base.python_ready(spark)
    work = base.Scratch(spark, "lang")
    labelled = (
        docs.select("doc_id", "text", "lang")
        .filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (base.crc_mod(F.col("doc_id"), held_out_mod) != held_out_rest))
    )
    totals = work.keep(labelled.groupBy("lang").agg(F.count("*").alias("rows")), "totals")
    n_docs = {r["lang"]: r["rows"] for r in totals.collect()}
    languages = sorted(n_docs)
    each_docs = max(20, max_docs // max(1, len(languages)))

    @F.pandas_udf("array<string>")
    def words_of(texts: pd.Series) -> pd.Series:
        from tidewire.llm import language_id

        return texts.map(lambda t: list(language_id.letters(t)))

    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = labelled.join(totals, "lang").filter(place * F.col("rows") < each_docs)
    words = sample.select("doc_id", "lang", F.explode(words_of("text")).alias("word")).groupBy("lang", "word").agg(F.count_distinct("doc_id").alias("n"))
    words = work.keep(words, "words")
    counts: dict[str, dict[str, int]] = {k: {} for k in languages}
    for row in words.select("lang", "word", "n").orderBy("lang", F.desc("n"), "word").toArrow().to_pylist():
        counts[row["lang"]][row["word"]] = row["n"]
    work.drop("totals", "words")
    p = learn(load_vocabulary(path), counts, rounds)
    n = np.array([n_docs[k] for k in languages], float)
    return languages, p.astype(np.float32), (n + 1) / (n + 1).sum()


_MODELS: dict[str, Model] = {}


def model_of(key: str, path: str, languages: list[str], p: np.ndarray, prior: np.ndarray) -> Model:
    """The worker's model, made once for a key."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(load_vocabulary(path), languages, p.astype(float), prior)
    return _MODELS[key]


def predict(docs: DataFrame, path: str, languages: list[str], p: np.ndarray, prior: np.ndarray) -> DataFrame:
    """docs with lang_pred and score of each whole text."""
    import uuid

    base.python_ready(docs.sparkSession)
    key, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((languages, p, prior))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        from tidewire.llm import language_id

        langs, scores = language_id.model_of(key, path, *shared.value).predict(list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn("__tw_guess", guess("text")).withColumns({"lang_pred": F.col("__tw_guess.lang_pred"), "score": F.col("__tw_guess.score")}).drop("__tw_guess")
