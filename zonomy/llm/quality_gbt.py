"""Document quality from statistics of the text by gradient-boosted trees.

Trees are grown on histograms of binned features and kept as flat arrays of complete binary trees,
which numpy walks for all rows of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.labelled import labelled_sample

STATISTICS = ("log_chars", "word_length", "long_words", "capitals", "digits", "symbols_word", "shouts_word", "stops_word", "commas_word",
              "other_marks_word", "lines_word", "distinct_words", "distinct_pairs", "top_word", "echo_words", "repeated_lines", "non_ascii", "odd_ends")
#: Labelled documents that a fit reads at most, and the bins of a feature.
SAMPLE_ROWS, BINS = 20_000, 64

_KEEP = {name: bytes(b for b in range(256) if b not in chars) for name, chars in {
    "capitals": range(65, 91), "digits": range(48, 58), "symbols_word": b"#*$%&|<>", "shouts_word": b"!", "stops_word": b".?", "commas_word": b",;:",
    "other_marks_word": b"\"'()[]{}/\\@^_`~+=-", "non_ascii": range(128, 256), "lines_word": b"\n"}.items()}
_MARKS = b"#*$%&|<>!"


def statistics(text: bytes) -> tuple[float, ...]:
    """The values of ``STATISTICS``; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    low = text.lower().split()
    count = {name: len(text.translate(None, drop)) for name, drop in _KEEP.items()}
    chars = len(text) - text.count(b" ")
    tally = Counter(low)
    lines = [x for x in text.split(b"\n") if x]
    return (
        np.log1p(len(text)), chars / n, sum(len(w) > 14 for w in tally) / len(tally), count["capitals"] / chars, count["digits"] / chars,
        count["symbols_word"] / n, count["shouts_word"] / n, count["stops_word"] / n, count["commas_word"] / n, count["other_marks_word"] / n,
        count["lines_word"] / n, len(tally) / n ** 0.8, len(set(zip(low, low[1:]))) / n, max(tally.values()) / n,
        sum(map(bytes.__eq__, low, low[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), count["non_ascii"] / chars,
        sum(w[-1] in _MARKS for w in tally) / len(tally),
    )


@dataclass
class Forest:
    """Complete trees of one depth: ``feature`` and ``cut`` (bin, goes right above it) by tree and node, ``leaf`` by tree."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        binned, rows = self.binned(x), np.arange(len(x))
        margin = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            margin += leaf[node - inner]
        return 1 / (1 + np.exp(-margin))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, ridge: float = 2.0, least: int = 8) -> Forest:
    """Boosting of the logistic loss. Without rows, or with one label, the forest has no trees and scores the
    smoothed share of label 1."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    inner, leaves, m = 2**depth - 1, 2**depth, x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if len(x) else np.empty(0) for j in range(m)]
    forest = Forest(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return forest
    binned = forest.binned(x)
    slot = binned + BINS * np.arange(m)
    margin = np.full(len(y), forest.start)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            at = ((node - base)[:, None] * (m * BINS) + slot).ravel()
            g, h, c = (np.bincount(at, w, width * m * BINS).reshape(width, m, BINS).cumsum(axis=2)
                       for w in (np.repeat(gradient, m), np.repeat(weight, m), None))
            total_g, total_h, total_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
            gain[(c < least) | (total_c - c < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            useful = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[base:base + width] = np.where(useful, best // BINS, 0)
            cut[base:base + width] = np.where(useful, best % BINS, BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, gradient, leaves) / (np.bincount(at, weight, leaves) + ridge)
        margin += leaf[at]
        grown.append((feature, cut, leaf))
    forest.feature, forest.cut, forest.leaf = (np.stack(parts) for parts in zip(*grown))
    return forest


def _statistics_rows(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in tx.raw(column)], float).reshape(-1, len(STATISTICS))


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_rows: int = SAMPLE_ROWS,
                id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest fitted on at most ``max_rows`` labelled documents among those whose id is ``usable``."""

    def measured(batches):
        for batch in tx.slices(batches):
            rows = _statistics_rows(batch.column("text"))
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "label", "x"])

    sample = labelled_sample(docs, labels, label, usable, max_rows, id_col, text_col)
    schema = T.StructType([sample.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sample.mapInArrow(measured, schema).orderBy("id").select("label", "x").collect()
    x = np.array([r["x"] for r in rows], float).reshape(-1, len(STATISTICS))
    return fit_forest(x, np.array([r["label"] for r in rows], float))


def quality_score(docs: DataFrame, forest: Forest, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with double ``score_col`` in (0, 1), higher for better texts; null and empty texts get the score of
    a text without words. A column of that name is replaced; only the text is used."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        parts = [shared.value.score(_statistics_rows(text.slice(k, 512))) for k in range(0, len(text), 512)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return docs.withColumn(score_col, score(F.col(text_col)))
