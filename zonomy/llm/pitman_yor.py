"""Language-model scores from a hierarchical Pitman-Yor model.

Every context is a restaurant: one for each word as the word before, one for the start of a text. All of them share one
parent, the restaurant of single words, whose base is uniform over the known words and one unknown. Customers of
a context are the tokens that follow it; each of its tables sends one customer to the parent. Seatings are sampled by
Gibbs sweeps, and probabilities are averaged over several of them.

A restaurant is never in one place: cells (context, word) are dealt out by word, those of frequent words one by one, and
restaurants meet only in their totals of customers and tables, which are renewed after every sweep. The totals of the most
frequent words, as words and as contexts, are broadcast, a fixed number; those of all others are joined.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.seating import table_counts
from zonomy.session import cut_lineage

#: The token that ends a text; no word can equal it.
END = b"\n"
#: The context of a text's first word; no word can equal it.
START = b"\n\n"
#: Places of the broadcast totals: 0 for what is joined, then the most frequent words, last START as a context and END as a word.
CONTEXTS = 65_536
#: Most frequent pairs of words whose scores are sent to every task.
HEAD_PAIRS = 1_000_000
#: Discount and strength of the contexts and of their parent.
DISCOUNT, STRENGTH, ROOT_DISCOUNT, ROOT_STRENGTH = 0.75, 20.0, 0.6, 200.0
#: Sweeps before the first sample, and samples.
BURN_IN, SAMPLES = 2, 3
#: Tokens that a task counts before it passes the counts on, and frequent words that it then proposes for the broadcast.
COUNT_TOKENS, PROPOSED = 2_000_000, 20_000
BLOCK = "b int, blob binary, totals array<struct<k:int,v:double>>"


def _pack(state: dict) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(state, protocol=5))


def _unpack(blob: bytes) -> dict:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def context_words(texts: DataFrame) -> list[int]:
    """Hashes of frequent words of all texts, from each task's list of its most frequent ones. Which words these are
    decides what is broadcast and what is joined, and moves no result."""

    def propose(batches):
        held, n = [], 0

        def top():
            w, c = np.unique(np.concatenate(held), return_counts=True)
            best = np.lexsort((w, -c))[:PROPOSED]
            return pa.record_batch([tx.to_long(w[best]), pa.array(c[best], pa.int64())], names=["w", "c"])

        for batch in tx.slices(batches):
            held.append(tx.word_hashes(tx.raw(batch.column(0)))[0])
            n += len(held[-1])
            if n >= COUNT_TOKENS:
                yield top()
                held, n = [], 0
        if held:
            yield top()

    rows = texts.mapInArrow(propose, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "w").limit(CONTEXTS - 2).collect()
    return [r["w"] for r in rows]


class Places:
    """The places of words and contexts among the broadcast totals."""

    def __init__(self, contexts: list[int]) -> None:
        known = np.array(contexts, np.int64).view(np.uint64)
        order = np.argsort(known)
        self.known, self.code = known[order], (order + 1).astype(np.int32)

    def of(self, h: np.ndarray, last: bytes) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            out = np.where(self.known[at] == h, self.code[at], 0).astype(np.int32)
        out[h == tx.word_hash(last)] = CONTEXTS - 1
        return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words, of the words before, tokens of each text), every text with its end."""
    found, size = tx.word_hashes(texts)
    w = np.full(len(found) + len(texts), tx.word_hash(END), np.uint64)
    w[np.arange(len(found)) + np.repeat(np.arange(len(texts)), size)] = found
    size = size + 1
    v = np.concatenate([w[:1], w[:-1]])
    v[np.cumsum(size) - size] = tx.word_hash(START)
    return w, v, size


def pair_key(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tx.mix(w ^ tx.mix(v ^ np.uint64(0x5851F42D4C957F2D)))


def _summed(w: np.ndarray, v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of distinct (word, context)."""
    key = pair_key(w, v)
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return w[order][first], v[order][first], np.add.reduceat(c[order], first)


def _sparse(**parts: tuple[int, np.ndarray]) -> pa.Array:
    """One row of totals from arrays that begin at given places."""
    k = np.concatenate([at + np.flatnonzero(x) for at, x in parts.values()]).astype(np.int32)
    v = np.concatenate([x[x != 0] for _, x in parts.values()]).astype(float)
    flat = pa.StructArray.from_arrays([pa.array(k), pa.array(v)], names=["k", "v"])
    return pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), flat)


def count_cells(texts: DataFrame, contexts: list[int]) -> DataFrame:
    """Blocks of cells: (b, blob, totals). Totals are the customers per place, the words, and from CONTEXTS + 1 on per
    place the cells and the customers as a word and the cells as a context."""
    spark = texts.sparkSession
    places = spark.sparkContext.broadcast(Places(contexts))

    def count(batches):
        held, n = [], 0

        def rows():
            w, v = (np.concatenate(x) for x in zip(*held))
            w, v, c = _summed(w, v, np.ones(len(w), np.int64))
            held.clear()
            near = np.where(places.value.of(w, END) > 0, pair_key(w, v), w)
            for k in range(0, len(w), 100_000):
                part = slice(k, k + 100_000)
                yield pa.record_batch([tx.to_long(near[part]), tx.to_long(w[part]), tx.to_long(v[part]), pa.array(c[part].astype(np.int32))], names=["p", "w", "v", "c"])

        for batch in tx.slices(batches):
            w, v, _ = tokens(tx.raw(batch.column(0)))
            held.append((w, v))
            n += len(w)
            if n >= COUNT_TOKENS:
                yield from rows()
                n = 0
        if held:
            yield from rows()

    def gather(batches):
        got = [[batch.column(i).to_numpy() for i in range(1, 4)] for batch in batches if batch.num_rows]
        if not got:
            return
        w, v, c = (np.concatenate(x) for x in zip(*got))
        w, v, c = _summed(w.view(np.uint64), v.view(np.uint64), c.astype(np.int64))
        a, u = places.value.of(w, END), places.value.of(v, START)
        order = np.lexsort((v, w, a))  # words without a place first
        w, v, c, a, u = w[order], v[order], c[order], a[order], u[order]
        own = w[a == 0]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        state = {"b": TaskContext.get().partitionId(), "w": w, "v": v, "c": c, "a": a, "u": u, "head": head, "samples": []}
        count = lambda at, weight=None: np.bincount(at, weight, CONTEXTS)
        totals = _sparse(customers=(0, count(u, c)), words=(CONTEXTS, np.array([len(head)])), cells=(CONTEXTS + 1, count(a)),
                         counts=(2 * CONTEXTS + 1, count(a, c)), tables=(3 * CONTEXTS + 1, count(u)))
        yield pa.record_batch([pa.array([state["b"]], pa.int32()), pa.array([_pack(state)], pa.binary()), totals], names=["b", "blob", "totals"])

    frequent = len(contexts) + bool(texts.head(1))
    none = _pack({"b": -1, "c": np.empty(0, np.int64)})
    some = spark.createDataFrame([(-1, bytearray(none), [(CONTEXTS, float(frequent))])] if frequent else [], BLOCK)
    return texts.mapInArrow(count, "p long, w long, v long, c int").repartition("p").mapInArrow(gather, BLOCK).unionByName(some)


def _total(blocks: DataFrame, width: int) -> np.ndarray:
    out = np.zeros(width)
    for r in blocks.select(F.inline("totals")).where(F.col("k") < width).groupBy("k").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["k"]] = r["v"]
    return out


def _arrays(batches, *names: str) -> list[np.ndarray]:
    """Whole columns of a task's rows."""
    got = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*got)] if got else []


def _by_context(v: np.ndarray, *sums: np.ndarray) -> list[np.ndarray]:
    own, place = np.unique(v, return_inverse=True)
    return [own, *(np.bincount(place, x, len(own)) for x in sums)]


def _states(batches):
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            state = _unpack(blob)
            if len(state["c"]):
                yield state


def _asked(blocks: DataFrame) -> DataFrame:
    """(v, b, customers, closed, open): of contexts without a place, the customers, the tables of single customers and the
    other tables that a block has; b is negative where the block has only single customers."""

    def run(batches):
        for s in _states(batches):
            x = s["u"] == 0
            one, t = s["c"][x] == 1, s.get("t", np.ones(len(s["c"])))[x]
            v, c, t, many = _by_context(s["v"][x], s["c"][x], t, ~one)
            for k in range(0, len(v), 100_000):
                q = slice(k, k + 100_000)
                yield pa.record_batch([tx.to_long(v[q]), pa.array(np.where(many[q] > 0, s["b"], -1).astype(np.int32)), pa.array(c[q]), pa.array(t[q])], names=["v", "b", "c", "t"])

    return blocks.mapInArrow(run, "v long, b int, c double, t double")


def _told(blocks: DataFrame) -> DataFrame:
    """Blocks with the tables of the contexts without a place that they have a choice in, as rows (b, blob, told)."""

    def answer(batches):
        got = _arrays(batches, "v", "b", "t")
        if got:
            v, b, t = got
            own, place = np.unique(v, return_inverse=True)
            t = np.bincount(place, t)[place]
            for k in np.unique(b[b >= 0]):
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([None], pa.binary()), pa.array([_pack((v[b == k], t[b == k]))], pa.binary())], names=["b", "blob", "told"])

    told = _asked(blocks).select("v", "b", "t").repartition("v").mapInArrow(answer, "b int, blob binary, told binary")
    return blocks.select("b", "blob", F.lit(None).cast("binary").alias("told")).unionByName(told).repartition("b")


def seat_block(state: dict, tables: np.ndarray, every: float, roots: np.ndarray, root_tables: float, words: float, keep: bool, seed: int) -> pa.Array:
    """One sweep over the cells of a block and over its words in the parent restaurant; ``state`` is changed.

    All are totals after the sweep before: ``tables`` of the context of each cell, ``every`` of all contexts, ``roots`` the
    customers in the parent, less discounts, of words with a place, ``root_tables`` of the parent. Gives the new totals. The
    first sweep starts from one table per cell."""
    rng = np.random.default_rng([seed, int(state["w"][0])])
    c, a, head = state["c"], state["a"], state["head"]
    own = int((a == 0).sum())
    if "t" not in state:
        state |= {"t": np.ones(len(c), np.int64), "root_t": np.ones(len(head), np.int64)}
    fresh_root = (ROOT_STRENGTH + ROOT_DISCOUNT * root_tables) / (words + 1)
    goal = lambda t: np.add.reduceat(t[:own], head) if len(head) else np.empty(0, np.int64)
    root = roots[a] + fresh_root
    root[:own] += np.repeat(goal(state["t"]) - ROOT_DISCOUNT * state["root_t"], np.diff(np.append(head, own)))
    t = table_counts(c, (STRENGTH + DISCOUNT * tables) * root / (ROOT_STRENGTH + every), DISCOUNT, rng)
    below = goal(t)
    root_t = table_counts(below, np.full(len(below), fresh_root), ROOT_DISCOUNT, rng)
    state |= {"t": t, "root_t": root_t}
    if keep:
        state["samples"].append((t.astype(np.int32), below, root_t))
    return _sparse(tables=(0, np.bincount(state["u"], t, CONTEXTS)), roots=(CONTEXTS, np.array([root_t.sum()])), words=(CONTEXTS + 1, np.bincount(a, t, CONTEXTS)))


class Sample(NamedTuple):
    """Totals of one sweep: tables by place (0 for all without one), tables of the parent, and by place the customers and
    tables that words have in the parent."""

    tables: np.ndarray
    root_tables: float
    goal: np.ndarray
    root_t: np.ndarray


def sample_seatings(blocks: DataFrame, words: float) -> tuple[DataFrame, list[Sample]]:
    """Blocks with their samples, and the totals that belong to each sample."""
    sums = _total(blocks, 4 * CONTEXTS + 1)
    goal, tables = sums[CONTEXTS + 1:2 * CONTEXTS + 1].copy(), sums[3 * CONTEXTS + 1:]
    goal[0], rare = 0, sums[0] > 0
    last, kept = Sample(tables, words, goal, np.minimum(goal, 1)), []
    for sweep in range(BURN_IN + SAMPLES):
        keep = sweep >= BURN_IN
        shared = blocks.sparkSession.sparkContext.broadcast(last)

        def run(batches, keep=keep, sweep=sweep, shared=shared):
            blobs, told = {}, {}
            for batch in batches:
                for b, blob, own in zip(*(batch.column(n).to_pylist() for n in ("b", "blob", "told"))):
                    if blob is not None:
                        blobs[b] = blob
                    else:
                        told.setdefault(b, []).append(_unpack(own))
            for b in list(blobs):
                state, now = _unpack(blobs.pop(b)), shared.value
                if not len(state["c"]):
                    continue
                t = now.tables[state["u"]]
                if b in told:
                    v, x = (np.concatenate(y) for y in zip(*told.pop(b)))
                    v, order = np.sort(v.view(np.uint64)), np.argsort(v.view(np.uint64))
                    ask = np.flatnonzero((state["u"] == 0) & (state["c"] > 1))
                    t[ask] = x[order][np.searchsorted(v, state["v"][ask])]
                totals = seat_block(state, t, now.tables.sum(), now.goal - ROOT_DISCOUNT * now.root_t, now.root_tables, words, keep, sweep)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([_pack(state)], pa.binary()), totals], names=["b", "blob", "totals"])

        asked = _told(blocks) if rare else blocks.select("b", "blob", F.lit(None).cast("binary").alias("told"))
        blocks = cut_lineage(asked.mapInArrow(run, BLOCK))
        sums = _total(blocks, 2 * CONTEXTS + 1)
        goal = sums[CONTEXTS + 1:].astype(np.int64)
        goal[0] = 0
        fresh_root = (ROOT_STRENGTH + ROOT_DISCOUNT * last.root_tables) / (words + 1)
        root_t = table_counts(goal, np.full(CONTEXTS, fresh_root), ROOT_DISCOUNT, np.random.default_rng([sweep, 1]))
        last = Sample(sums[:CONTEXTS], sums[CONTEXTS] + root_t.sum(), goal, root_t)
        if keep:
            kept.append(last)
    return blocks, kept


class Model:
    """What is broadcast of a model: by sample and place what contexts leave to the parent and the parent's probabilities of
    words, and the parent's probability of an unknown word by sample."""

    def __init__(self, customers: np.ndarray, samples: list[Sample], words: float) -> None:
        self.customers = customers.copy()
        self.customers[0] = 0
        tables = np.stack([s.tables for s in samples])
        norm = ROOT_STRENGTH + tables.sum(axis=1)
        tables[:, 0] = 0
        self.left = (STRENGTH + DISCOUNT * tables) / (STRENGTH + self.customers)
        self.fresh = np.array([(ROOT_STRENGTH + ROOT_DISCOUNT * s.root_tables) / (words + 1) for s in samples])
        self.norm, self.unknown = norm, self.fresh / norm
        self.roots = np.stack([(s.goal - ROOT_DISCOUNT * s.root_t + f) / n for s, f, n in zip(samples, self.fresh, norm)])


def _roots(state: dict, model: Model) -> np.ndarray:
    """The parent's probabilities of the words of a block that have no place, by sample."""
    return np.stack([(goal - ROOT_DISCOUNT * t + f) / n for (_, goal, t), f, n in zip(state["samples"], model.fresh, model.norm)])


def _floats(rows: np.ndarray) -> pa.Array:
    """Arrays of the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(rows, float).ravel()))


def word_rows(blocks: DataFrame, shared) -> DataFrame:
    """(w, c, roots) of the words without a place: count, and the parent's probability by sample."""

    def run(batches):
        for s in _states(batches):
            if len(s["head"]):
                own = int((s["a"] == 0).sum())
                yield pa.record_batch([tx.to_long(s["w"][s["head"]]), pa.array(np.add.reduceat(s["c"][:own], s["head"])), _floats(_roots(s, shared.value).T)], names=["w", "c", "roots"])

    return blocks.mapInArrow(run, "w long, c long, roots array<double>")


def context_rows(blocks: DataFrame) -> DataFrame:
    """(v, n, lefts) of the contexts without a place: customers, and what they leave to the parent by sample."""

    def run(batches):
        for s in _states(batches):
            x = s["u"] == 0
            v, c, *t = _by_context(s["v"][x], s["c"][x], *(k[0][x] for k in s["samples"]))
            yield pa.record_batch([tx.to_long(v), pa.array(c), *(pa.array(k) for k in t)], names=["v", "n", *(f"t{k}" for k in range(SAMPLES))])

    rows = blocks.mapInArrow(run, "v long, n double, " + ", ".join(f"t{k} double" for k in range(SAMPLES)))
    rows = rows.groupBy("v").agg(F.sum("n").alias("n"), *(F.sum(f"t{k}").alias(f"t{k}") for k in range(SAMPLES)))
    return rows.select("v", "n", F.array(*((STRENGTH + DISCOUNT * F.col(f"t{k}")) / (STRENGTH + F.col("n")) for k in range(SAMPLES))).alias("lefts"))


def pair_rows(blocks: DataFrame, shared) -> DataFrame:
    """(key, w, v, u, c, n, p) of all observed pairs: count of the pair and of the word (0 if it has a place), and the averaged
    probability."""
    names = ["key", "w", "v", "u", "c", "n", "p", "seated", "roots"]

    def run(batches):
        for s in _states(batches):
            m, a, u, head = shared.value, s["a"], s["u"], s["head"]
            own = int((a == 0).sum())
            n = np.zeros(len(a), np.int64)
            roots = m.roots[:, a]
            if own:
                size = np.diff(np.append(head, own))
                n[:own] = np.repeat(np.add.reduceat(s["c"][:own], head), size)
                roots[:, :own] = np.repeat(_roots(s, m), size, axis=1)
            seated = s["c"] - DISCOUNT * sum(k[0] for k in s["samples"]) / SAMPLES
            p = seated / (STRENGTH + m.customers[u]) + (m.left[:, u] * roots).mean(axis=0)
            key = pair_key(s["w"], s["v"])
            for rare in (False, True):
                at = np.flatnonzero((u == 0) == rare)
                for k in range(0, len(at), 50_000):
                    q = at[k:k + 50_000]
                    far = [pa.array(seated[q]), _floats(roots[:, q].T)] if rare else [pa.nulls(len(q), pa.float64()), pa.nulls(len(q), pa.list_(pa.float64()))]
                    yield pa.record_batch([tx.to_long(key[q]), tx.to_long(s["w"][q]), tx.to_long(s["v"][q]), pa.array(u[q]), pa.array(s["c"][q]), pa.array(n[q]),
                                           pa.array(p[q]), *far], names=names)

    rows = blocks.mapInArrow(run, "key long, w long, v long, u int, c long, n long, p double, seated double, roots array<double>")
    near = rows.where("u > 0").select(*names[:7])
    backed = sum(F.get("lefts", F.lit(k)) * F.get("roots", F.lit(k)) for k in range(SAMPLES)) / SAMPLES
    far = rows.where("u = 0").drop("p").join(context_rows(blocks).withColumnRenamed("n", "of"), "v").withColumn("p", F.col("seated") / (STRENGTH + F.col("of")) + backed)
    return near.unionByName(far.select(*names[:7]))


def predictive(blocks: DataFrame, customers: np.ndarray, samples: list[Sample], words: float) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(w, us, ps, roots): each word with its averaged probability in each context with a place where it was seen, and its
    probability in the parent by sample; with these what contexts leave to the parent, and the parent's
    probability of an unknown word, by sample. A view of a small model as a whole."""
    model = Model(customers, samples, words)
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def frequent(batches):
        for s in _states(batches):
            w, first = np.unique(s["w"][s["a"] > 0], return_index=True)
            yield pa.record_batch([tx.to_long(w), _floats(model.roots[:, s["a"][s["a"] > 0][first]].T)], names=["w", "roots"])

    roots = blocks.mapInArrow(frequent, "w long, roots array<double>").dropDuplicates(["w"]).unionByName(word_rows(blocks, shared).drop("c"))
    seen = pair_rows(blocks, shared).where("u > 0").groupBy("w").agg(F.collect_list(F.struct("u", "p")).alias("s"))
    rows = roots.join(seen, "w", "left").select("w", F.coalesce("s.u", F.array().cast("array<int>")).alias("us"), F.coalesce("s.p", F.array().cast("array<double>")).alias("ps"), "roots")
    return rows, model.left, model.unknown


def least_count(blocks: DataFrame, head_pairs: int) -> int:
    """The smallest count, at least 2, from which on there are at most ``head_pairs`` pairs. Of any corpus of N tokens there
    are at most sqrt(2 N) different counts, which are gone through from the largest."""

    def run(batches):
        for s in _states(batches):
            c, n = np.unique(s["c"][s["c"] > 1], return_counts=True)
            yield pa.record_batch([pa.array(c), pa.array(n)], names=["c", "n"])

    left, least = head_pairs, 2**62
    for r in blocks.mapInArrow(run, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        if r["n"] > left:
            break
        left, least = left - r["n"], r["c"]
    return least


class Head:
    """Scores of the most frequent pairs, in order of their keys."""

    def __init__(self, rows: pa.Table) -> None:
        key = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.key, self.n, self.log = key[order], rows["n"].to_numpy()[order], np.log10(rows["p"].to_numpy())[order]

    def of(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_PAIRS, places: int = CONTEXTS - 2) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, boolean ``held_out``, longs ``n_tokens``, ``n_known``, ``train_tokens``, doubles ``base_score``,
    ``score`` (log10 of the text's probability under the model) and ``perplexity`` (per token).

    ``trains`` tells the rows to learn from. Tokens are white-space separated words, A-Z lower-cased, then one end. The
    base is a unigram with one added to each count. Null texts are empty: one end. Rows that repeat are scored and learnt
    from like any others. Without a row to learn from every word is unknown and both models are uniform over
    one unknown word. Words and pairs are told apart by 64-bit hashes. Of word pairs at most ``head_words`` and of words
    ``places`` are broadcast, all others joined.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    training = slim.where("trains").select("text")
    contexts = context_words(training)[:places]
    blocks = cut_lineage(count_cells(training, contexts))
    totals = _total(blocks, 4 * CONTEXTS + 1)
    customers, words, counts = totals[:CONTEXTS], totals[CONTEXTS], totals[2 * CONTEXTS + 1:3 * CONTEXTS + 1]
    n_train = int(customers.sum())
    if words:
        blocks, samples = sample_seatings(blocks, words)
    else:
        samples = [Sample(np.zeros(CONTEXTS), 0.0, np.zeros(CONTEXTS), np.zeros(CONTEXTS))] * SAMPLES
    model = spark.sparkContext.broadcast(Model(customers, samples, words))
    pairs = pair_rows(blocks, model)
    head = spark.sparkContext.broadcast(Head(pairs.where(F.col("c") >= least_count(blocks, head_words)).select("key", "n", "p").toArrow()))
    placed = spark.sparkContext.broadcast((Places(contexts), counts))
    norm = float(np.log10(n_train + words + 1))
    sums = [T.StructField(c, T.DoubleType()) for c in ("known", "base", "score")]
    first = [T.StructField("rid", T.LongType()), slim.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), *sums]
    schema = T.StructType([*first, *(T.StructField(c, T.LongType()) for c in ("key", "w", "v")), T.StructField("near_w", T.BooleanType()), T.StructField("near_v", T.BooleanType())])

    def run(batches):
        (known, count), pair, m, rid = placed.value, head.value, model.value, TaskContext.get().partitionId() << 36
        for batch in tx.slices(batches):
            w, v, size = tokens(tx.raw(batch.column("text")))
            n = batch.num_rows
            row, out = np.repeat(np.arange(n), size), ~batch.column("trains").to_numpy(zero_copy_only=False)
            a, u, key = known.of(w, END), known.of(v, START), pair_key(w, v)
            at = pair.of(key)
            hit, far = at >= 0, a == 0
            c = np.where(far, np.where(hit & far, pair.n[at] if len(pair.n) else 0, 0), count[a])
            here = hit | ~far  # the word's count is known here
            seen = np.bincount(row, here & (c > 0), n)
            base = np.bincount(row, np.where(here, np.log10(c + 1.0) - norm, 0), n)
            score = np.bincount(row[hit], pair.log[at[hit]], n)
            ids = rid + np.arange(n)
            rid += n
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.record_batch([pa.array(ids), batch.column("id"), pa.array(out), pa.array(size), pa.array(seen), pa.array(base), pa.array(score.astype(float)),
                                   tx.to_long(tx.mix(ids.astype(np.uint64))), *[pa.array(np.zeros(n, np.int64))] * 2, *[pa.array(np.ones(n, bool))] * 2], names=schema.names)
            miss = np.flatnonzero(~hit)
            k, new = len(miss), out[row[miss]]
            near = new & (a[miss] > 0) & (u[miss] > 0)  # the score if the pair was never observed
            p = np.full(k, np.nan)
            p[near] = np.log10((m.left[:, u[miss][near]] * m.roots[:, a[miss][near]]).mean(axis=0))
            yield pa.record_batch([pa.array(ids[row[miss]]), none(k, batch.schema.field("id").type), none(k, pa.bool_()), none(k, pa.int64()), *[pa.array(np.zeros(k))] * 2,
                                   pa.array(p, from_pandas=True), tx.to_long(key[miss]), *(tx.to_long(np.where(new, x[miss], np.uint64(0))) for x in (w, v)),
                                   pa.array(a[miss] > 0), pa.array(u[miss] > 0)], names=schema.names)

    def back_off(batches):
        (known, _), m = placed.value, model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            w, v = (batch.column(c).to_numpy().view(np.uint64) for c in ("w", "v"))
            a, u = known.of(w, END), known.of(v, START)
            root, left = m.roots[:, a], m.left[:, u]
            for kept, own, missing, place in ((root, batch.column("roots"), m.unknown, a), (left, batch.column("lefts"), np.ones(SAMPLES), u)):
                has = own.is_valid().to_numpy(zero_copy_only=False)
                kept[:, place == 0] = missing[:, None]
                kept[:, has] = own.flatten().to_numpy().reshape(-1, SAMPLES).T
            c = batch.column("c").to_numpy(zero_copy_only=False)
            far = a == 0
            yield pa.record_batch([batch.column("rid"), pa.array((far & (c > 0)).astype(float)), pa.array(np.where(far, np.log10(c + 1.0) - norm, 0)),
                                   pa.array(np.log10((root * left).mean(axis=0)))], names=["rid", "known", "base", "score"])

    asked = slim.mapInArrow(run, schema).join(pairs.select("key", "p", "n"), "key", "left")
    lone = F.col("n_tokens").isNull() & F.col("p").isNull() & F.col("score").isNull()
    far = F.col("p").isNotNull() & ~F.col("near_w")
    done = asked.where(~lone).select("rid", "id", "held_out", "n_tokens", F.when(far, 1.0).otherwise(F.col("known")).alias("known"),
                                     F.when(far, F.log10(F.col("n") + 1.0) - norm).otherwise(F.col("base")).alias("base"),
                                     F.when(F.col("p").isNotNull(), F.log10("p")).otherwise(F.col("score")).alias("score"))
    rest = asked.where(lone).select("rid", "w", "v", F.when(F.col("near_w"), F.col("key")).otherwise(F.col("w")).alias("own_w"), F.when(F.col("near_v"), F.col("key")).otherwise(F.col("v")).alias("own_v"))
    rest = rest.join(word_rows(blocks, model).withColumnRenamed("w", "own_w"), "own_w", "left")
    rest = rest.join(context_rows(blocks).select(F.col("v").alias("own_v"), "lefts"), "own_v", "left")
    rest = rest.select("rid", "w", "v", F.coalesce("c", F.lit(0)).alias("c"), "roots", "lefts").mapInArrow(back_off, "rid long, known double, base double, score double")
    whole = done.unionByName(rest, allowMissingColumns=True).groupBy("rid").agg(
        F.first("id", True).alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("known", "base", "score")])
    return whole.select(F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
                        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
