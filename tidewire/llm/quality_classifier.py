"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text, numpy over its bytes. Trees are grown on the
driver from per-feature histograms of a bounded labelled sample and flattened into
(tree, node) arrays, which workers walk level by level for a whole batch at once.

Nulls: a null text counts as empty, a row without a doc_id is scored like any other,
labels that are null or not 0/1 teach nothing. Empty texts have all-zero statistics and
get the score those lead to. Repeated rows are scored each; repeated labels of a
document teach once for each distinct label. With no labels, or one class only, every
score is the smoothed share of label 1 (0.5 without labels). Extra columns pass through
``score`` unread; an input column named like the result is replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

SYMBOLS = b"#*$%&|<>"
#: Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 symbol, 6 '!' or '?', 7 other punctuation, 8 non-ASCII.
_CLASS = np.zeros(256, np.uint8)
for _b in range(256):
    _c = bytes([_b])
    _CLASS[_b] = (
        1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c.isspace()
        else 5 if _c in SYMBOLS else 6 if _c in b"!?" else 8 if _b > 127 else 7 if 32 < _b < 127 else 0
    )
_BLANK = _CLASS == 4
_MARK = np.isin(_CLASS, (5, 6))
N_FEATURES = 20


def statistics(text: str | None) -> np.ndarray:
    """The document statistics of one whole text."""
    out = np.zeros(N_FEATURES)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    share = np.bincount(_CLASS[raw], minlength=9) / n
    words = data.split()
    n_words = len(words)
    out[:9] = share
    out[9] = np.log1p(n)
    if n_words:
        blank, mark = _BLANK[raw], _MARK[raw]
        ends = int((mark[:-1] & blank[1:]).sum()) + int(mark[-1])
        out[10] = np.log1p(n_words)
        out[11] = (n - int(blank.sum())) / n_words
        out[12] = len(set(words)) / n_words
        out[13] = len(set(zip(words, words[1:]))) / max(1, n_words - 1)
        out[14] = ends / n_words
        out[15] = max(map(len, words))
    lines = data.split(b"\n")
    out[16] = len(set(lines)) / len(lines)
    out[17] = n / len(lines)
    out[18] = data.count(b".") / max(1, n_words)
    out[19] = len(zlib.compress(data, 1)) / n
    return out


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes) int32
    cut: np.ndarray  # (trees, inner nodes) float64; go right if the value is above
    leaf: np.ndarray  # (trees, leaves) float64
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        n_trees, inner = self.feature.shape
        if not n_trees:
            return np.full(len(x), self.start)
        rows, trees = np.arange(len(x))[:, None], np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), np.int32)
        while node[0, 0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.start + self.leaf[trees, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.zeros(0)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, least: int = 20, l2: float = 1.0) -> Trees:
    """Boost trees under the logistic loss from histograms of binned statistics."""
    p = (y.sum() + 1) / (len(y) + 2)
    start, inner = float(np.log(p / (1 - p))), 2**depth - 1
    if len(y) < 2 * least or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    n_features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    cell = binned + np.arange(n_features) * bins
    features, splits, leaves = [], [], []
    margin = np.full(len(y), start)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        feature, split = np.zeros(inner, np.int32), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (n_features * bins) + cell).ravel()
            size = width * n_features * bins
            shape = (width, n_features, bins)
            g = np.bincount(at, np.repeat(grad, n_features), size).reshape(shape).cumsum(2)
            h = np.bincount(at, np.repeat(hess, n_features), size).reshape(shape).cumsum(2)
            c = np.bincount(at, minlength=size).reshape(shape).cumsum(2)
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + i], split[first + i] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > split[node])
        g = np.bincount(node - inner, grad, inner + 1)
        h = np.bincount(node - inner, hess, inner + 1)
        leaf = rate * g / (h + l2)
        margin = margin + leaf[node - inner]
        features.append(feature)
        splits.append(split)
        leaves.append(leaf)
    return Trees(np.stack(features), np.stack(splits), np.stack(leaves), start)


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return stats(text)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, held_out_mod: int = 5, **growing) -> Trees:
    """Trees from at most max_rows labelled documents outside the held-out fold.

    The sample is the labelled documents of smallest hashed id, so it doesn't depend on
    partitioning; its bound makes it small enough to broadcast and to hold on the driver.
    """
    spark = docs.sparkSession
    base.python_ready(spark)
    sample = (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (base.crc_mod(F.col("id"), held_out_mod) != 0))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "y")
        .limit(max_rows)
    )
    rows = (
        docs.select(F.col("doc_id").alias("id"), "text")
        .join(F.broadcast(sample), "id")
        .select("id", "y", statistics_column(F.col("text")).alias("x"))
        .groupBy("id", "y")
        .agg(F.max("x").alias("x"))
        .orderBy("id", "y")
        .toArrow()
    )
    y = np.array(rows["y"].to_pylist(), float)
    x = np.array(rows["x"].to_pylist(), float).reshape(len(y), N_FEATURES)
    return grow(x, y, **growing) if len(y) else grow(np.zeros((0, N_FEATURES)), np.zeros(0))


def score(docs: DataFrame, trees: Trees, column: str = "score") -> DataFrame:
    """docs with the score of each whole text; only the text crosses to Python."""
    base.python_ready(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        x = np.stack([statistics(t) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES))
        return pd.Series(trees.score(x))

    return docs.withColumn(column, scored(F.col("text")))
