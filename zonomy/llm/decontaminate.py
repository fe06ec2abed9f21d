"""Passages of benchmark items inside training documents.

Every batch of documents is a shard with an FM-index of its own. The windows of all items are searched
backwards in it at once, occurrences are located, and overlapping ones are merged into spans. A shard
holds the passages in which any window can lie: runs of words whose neighbours also stand side by
side in some window. Equal passages are held once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.fm_index import FMIndex

WINDOW = 13
#: Items whose windows are searched in one go and sent to the tasks together; more items take more goes.
BLOCK_ITEMS = 5_000
#: Characters of an item's text up to which it counts as one item towards a block.
ITEM_CHARS = 4_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def words(text: bytes) -> list[bytes]:
    """Runs of characters other than ASCII punctuation, space and control, A-Z lower-cased."""
    return _WORD.findall(text.lower())


@dataclass
class Phrases:
    """Distinct windows as rows of word numbers (from 1), padded at the left, and the items of each."""

    number: dict[bytes, int]
    rows: np.ndarray
    sizes: np.ndarray
    items: list[tuple[str, ...]]

    @staticmethod
    def of(items: list[tuple[str, bytes]], window: int) -> "Phrases":
        number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [number.setdefault(w, len(number) + 1) for w in words(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[k:k + window]), set()).add(item)
        rows = np.zeros((len(owners), window), np.int64)
        for k, phrase in enumerate(owners):
            rows[k, window - len(phrase):] = phrase
        return Phrases(number, rows, np.array([len(p) for p in owners], np.int64), [tuple(sorted(o)) for o in owners.values()])

    def __post_init__(self) -> None:
        inside = self.rows[:, :-1] > 0
        self.pairs = np.unique((self.rows[:, :-1] << 32 | self.rows[:, 1:])[inside]) if len(self.rows) else np.empty(0, np.int64)
        self.shortest = int(self.sizes.min()) if len(self.sizes) else 0
        self.bits = (len(self.number) + 2).bit_length()

    def passages(self, found: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """(first word, word numbers) of the runs that can hold a window."""
        if not self.shortest or len(found) < self.shortest:
            return []
        get = self.number.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        key = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), max(0, len(self.pairs) - 1))
        joined = self.pairs[at] == key if len(self.pairs) else np.zeros(len(key), bool)
        breaks = np.flatnonzero(~joined) + 1
        starts, stops = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(ids)]])
        return [(a, ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= self.shortest and ids[a]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def search_shard(phrases: Phrases, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """For each text the number of its words, the merged word spans [start, stop) of occurrences, and the items found."""
    n_words, places, known = [], [], {}
    stretches: list[np.ndarray] = []
    for row, text in enumerate(texts):
        found = words(text)
        n_words.append(len(found))
        for first, ids in phrases.passages(found):
            k = known.setdefault(ids.tobytes(), len(stretches))
            if k == len(stretches):
                stretches.append(ids)
            places.append((row, first, k))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    if not stretches:
        return n_words, spans, items
    sizes = np.array([len(s) + 1 for s in stretches])
    offset = np.cumsum(sizes) - sizes
    index = FMIndex(np.concatenate([np.append(s, 0) for s in stretches]), phrases.bits)
    low, high = index.search(phrases.rows, phrases.sizes)
    hit = np.flatnonzero(high > low)
    count = (high - low)[hit]
    window = np.repeat(hit, count)
    rows = np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = index.locate(rows)
    owner = np.searchsorted(offset, at, side="right") - 1
    own_spans: dict[int, list[tuple[int, int]]] = {}
    own_items: dict[int, set[str]] = {}
    for k, start, w in zip(owner.tolist(), (at - offset[owner]).tolist(), window.tolist()):
        own_spans.setdefault(k, []).append((start, start + int(phrases.sizes[w])))
        own_items.setdefault(k, set()).update(phrases.items[w])
    own_spans = {k: _merged(s) for k, s in own_spans.items()}
    for row, first, k in places:
        for a, b in own_spans.get(k, ()):
            spans[row].append((first + a, first + b))
        items[row] |= own_items.get(k, set())
    return n_words, spans, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with long ``n_words``, ``spans`` array<struct<start, stop>> of hit words (from 0, stop excluded, merged, in order),
    ``items`` array<string> sorted, long ``n_hit``, boolean ``contaminated`` (``n_hit`` > 0 and at least 5 % of the words).

    An item of fewer than ``window`` words, but not none, is one window. Null and empty texts have no words; items without
    words or id find nothing; an item given twice counts as one. Columns of ``docs`` with the names of the new
    ones are replaced. Items beyond ``block_items`` are searched in further goes over the rows, not left out.
    """
    spark = docs.sparkSession
    names = ("n_words", "spans", "items", "n_hit", "contaminated")
    docs = docs.drop(*names)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).dropna()
    weight = tests.agg(F.sum(1 + F.floor(F.length("text") / ITEM_CHARS))).head()[0] or 0
    blocks = -(-weight // block_items)
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(_SPANS), "items": F.array().cast("array<string>")})
    schema = found.schema
    at_text = docs.columns.index(text_col)
    for k in range(max(1, blocks)):
        block = tests.where(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))) == k)
        phrases = spark.sparkContext.broadcast(Phrases.of(sorted((r["item"], r["text"].encode()) for r in block.collect()), window))
        found = found.mapInArrow(_searcher(phrases, schema, at_text), schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _searcher(phrases, schema: T.StructType, at_text: int):
    at_spans, at_items, at_words = (schema.names.index(n) for n in ("spans", "items", "n_words"))
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches):
        for batch in batches:
            n_words, spans, items = search_shard(phrases.value, tx.raw(batch.column(at_text)))
            before = batch.column(at_spans).to_pylist(), batch.column(at_items).to_pylist()
            columns = list(batch.columns)
            columns[at_words] = pa.array(n_words, pa.int64())
            columns[at_spans] = pa.array([[{"start": a, "stop": b} for a, b in _merged(new + [(x["start"], x["stop"]) for x in old])]
                                          for new, old in zip(spans, before[0])], span_type)
            columns[at_items] = pa.array([sorted(new | set(old)) for new, old in zip(items, before[1])], pa.list_(pa.string()))
            yield pa.record_batch(columns, names=schema.names)

    return run


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")
