"""Toxicity of documents by a linear classifier that is told not to mind which group is named.

Features are the words of a text and their beginnings. Where a labelled text names groups, the same text with the next group
of each kind in its place is held beside it. Where it names none, one of its sentences is taken with a group's name put in,
beside the same sentence with another one, so every labelled text gives a pair. The fit is charged for the squared change of
the score between the two, so naming a group by itself moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.labelled import labelled_sample

#: Names of groups that stand for each other, by kind and language; other lists are a parameter of the fit.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"), ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives"), ("young", "old", "elderly"), ("deaf", "blind", "disabled"),
    ("americans", "mexicans", "chinese", "germans", "french", "spanish", "africans", "indians"),
    ("frau", "mann"), ("christen", "muslime", "juden", "buddhisten", "atheisten"), ("schwule", "lesben", "heterosexuelle"), ("ausländer", "einheimische", "flüchtlinge"),
    ("femme", "homme"), ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"), ("immigrés", "réfugiés", "étrangers"), ("arabes", "africains", "asiatiques"),
    ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"), ("inmigrantes", "refugiados", "extranjeros"), ("gitanos", "latinos", "asiáticos"),
)
#: Labelled documents that a fit reads at most, features that it chooses, and documents a feature must occur in.
SAMPLE_ROWS, FEATURES, LEAST_DOCS = 20_000, 4_096, 6
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SENTENCE = re.compile(rb"[^.!?\n]+[.!?\n]*")
def swaps(groups: Sequence[Sequence[str]]) -> dict[bytes, bytes]:
    """The name that stands in for each name: the next of its kind."""
    return {a.lower().encode(): b.lower().encode() for terms in groups for a, b in zip(terms, [*terms[1:], terms[0]])}


def word_features(word: bytes) -> tuple[str, ...]:
    """The word and its first three to six characters."""
    w = word.decode("utf-8", "replace")
    return (w, *(w[:k] + "*" for k in range(3, 7) if len(w) > k))


def counterfactual(text: bytes, swap: dict[bytes, bytes]) -> tuple[bytes, bytes] | None:
    """A lower-case text that names groups, and the same with other groups named; None without words or names to put in.

    A text that names none gives one of its sentences with a name put in after one of its words. Sentence, word and name are
    chosen by a hash of the text.
    """
    if any(w in swap for w in set(_WORD.findall(text))):
        return text, b"".join(_WORD.sub(lambda m: swap.get(m[0], m[0]), s) for s in _SENTENCE.findall(text))
    sentences = [s for s in _SENTENCE.findall(text) if _WORD.search(s)]
    if not sentences or not swap:
        return None
    h = xxhash.xxh64_intdigest(text)
    sentence, name = sentences[h % len(sentences)], sorted(swap)[(h >> 20) % len(swap)]
    ends = [m.end() for m in _WORD.finditer(sentence)]
    at = ends[(h >> 40) % len(ends)]
    return tuple(sentence[:at] + b" " + n + b" " + sentence[at:] for n in (name, swap[name]))


@dataclass
class Linear:
    """Weights of chosen features and the intercept."""

    weights: dict[str, float]
    intercept: float
    pairs: int = 0  # counterfactual pairs of the fit

    def __post_init__(self) -> None:
        self.memo: dict[bytes, tuple[str, ...]] = {}

    def present(self, text: bytes) -> set[str]:
        """Chosen features of a lower-case text."""
        found: set[str] = set()
        for w in set(_WORD.findall(text)):
            own = self.memo.get(w)
            if own is None:
                if len(self.memo) >= tx.MEMO_WORDS:
                    self.memo.clear()
                own = self.memo[w] = tuple(f for f in word_features(w) if f in self.weights)
            if own:
                found.update(own)
        return found

    def score(self, text: bytes) -> float:
        margin = self.intercept + sum(map(self.weights.__getitem__, sorted(self.present(text.lower()))))
        return float(1 / (1 + np.exp(-margin)))


class Rows:
    """Sparse rows of column numbers with values."""

    def __init__(self, rows: list[list[int]], values: list[list[float]] | None = None) -> None:
        self.n = len(rows)
        self.columns = np.array([c for r in rows for c in r], np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.values = np.ones(len(self.columns)) if values is None else np.array([v for r in values for v in r], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.columns], self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, self.values * r[self.row], width)


def fit_weights(own: list[list[int]], pairs: list[tuple[list[int], list[int]]], y: np.ndarray, width: int, ridge: float = 2e-5, fairness: float = 1.0,
                steps: int = 400, tolerance: float = 1e-5) -> tuple[np.ndarray, float]:
    """Adam on logistic loss + ``ridge`` |w|^2 + ``fairness`` times the mean squared score change under swaps, until a
    step moves no weight by more than ``tolerance`` times its rate or ``steps`` are done."""
    x = Rows(own)
    pairs = [(set(a), set(b)) for a, b in pairs]
    change = Rows([sorted(a ^ b) for a, b in pairs], [[1.0 if c in a else -1.0 for c in sorted(a ^ b)] for a, b in pairs])
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    w, b = np.zeros(width), float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return w, b
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        rate = 0.1 * (1 - step / (steps + 1))
        residual = 1 / (1 + np.exp(-(x.times(w) + b))) - y
        slope = x.back(residual, width) / len(y) + 2 * ridge * w
        if change.n:
            slope += 2 * fairness * change.back(change.times(w), width) / change.n
        slope = np.append(slope, residual.mean())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if np.abs(move).max() < tolerance * rate:
            break
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_rows: int = SAMPLE_ROWS, features: int = FEATURES,
                 id_col: str = "doc_id", text_col: str = "text", groups: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = 1.0) -> Linear:
    """A classifier fitted on at most ``max_rows`` labelled documents among those whose id is ``usable``. Features are
    chosen by how far their share among toxic documents is from that among the others; names of groups always take part.
    ``groups`` lists the names that stand for each other, by kind; ``fairness`` weighs the charge for score changes between them."""
    swap = swaps(groups)
    sample = labelled_sample(docs, labels, label, usable, max_rows, id_col, text_col)

    def listed(batches):
        for batch in tx.slices(batches):
            found = [sorted({f for w in set(_WORD.findall(t.lower())) for f in word_features(w)}) for t in tx.raw(batch.column("text"))]
            size = np.array([len(f) for f in found])
            y = batch.column("label").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array([f for own in found for f in own], pa.string()), pa.array(np.repeat(y, size), pa.int32())], names=["f", "label"])

    counts = sample.mapInArrow(listed, "f string, label int").groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad")).head()
    share = (size["bad"] + 0.5) / (size["n"] + 1.0)
    distance = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    chosen = counts.where(F.col("n") >= LEAST_DOCS).orderBy(F.abs(distance).desc(), "f").limit(features)
    names = sorted({r["f"] for r in chosen.collect()} | {f for w in swap for f in word_features(w)})
    place = {f: i for i, f in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast(Linear(dict.fromkeys(names, 0.0), 0.0))
    schema = T.StructType([sample.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("own", T.ArrayType(T.StringType())),
                           T.StructField("named", T.ArrayType(T.StringType())), T.StructField("swapped", T.ArrayType(T.StringType()))])

    def observed(batches):
        model = shared.value
        for batch in tx.slices(batches):
            texts = [t.lower() for t in tx.raw(batch.column("text"))]
            pairs = [counterfactual(t, swap) for t in texts]
            sides = [pa.array([None if p is None else sorted(model.present(p[k])) for p in pairs], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.record_batch([batch.column("id"), batch.column("label"), pa.array([sorted(model.present(t)) for t in texts], pa.list_(pa.string())), *sides], names=schema.names)

    rows = sample.mapInArrow(observed, schema).orderBy("id").collect()
    number = lambda found: [place[f] for f in found]
    pairs = [(number(r["named"]), number(r["swapped"])) for r in rows if r["named"] is not None]
    w, b = fit_weights([number(r["own"]) for r in rows], pairs, np.array([r["label"] for r in rows], float), len(names), fairness=fairness)
    return Linear({f: float(v) for f, v in zip(names, w) if v}, b, len(pairs))


def toxicity_score(docs: DataFrame, model: Linear, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with double ``score_col`` in (0, 1), higher for likelier toxic texts; null and empty texts get the score of
    the intercept. A column of that name is replaced; only the whole text is used."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for k in range(0, len(text), 512) for t in tx.raw(text.slice(k, 512))], pa.float64())

    return docs.withColumn(score_col, score(F.col(text_col)))
