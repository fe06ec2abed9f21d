"""Hard negatives by angular triangle filtering.

Every vector stores its angles to a few reference directions. The angle between two vectors lies between the largest
difference and the smallest sum of their angles to a reference, so its cosine, times both norms, bounds their
score. Rows are kept in chunks of one label and neighbouring directions. Anchors go over the chunks in goes of a
bounded number: a chunk whose score interval misses what an anchor still needs is passed over, then single
rows are, and only the rest is scored, in integers.

Rows need an id, a label and a vector without null or non-finite components; others take no part. Of rows with one id
the one of smallest label and vector counts. Vectors of unequal length are filled up with zeros. Components
saturate at 2^24. Other columns of the input are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from zonomy.llm.text import mix, slices
from zonomy.llm.vectors import finite, int_matrix
from zonomy.session import cut_lineage, ensure_checkpoint_dir

#: Reference directions, chosen farthest first among the rows of a bounded sample; they move no result.
REFERENCES, SAMPLE = 8, 2048
#: Rows of a chunk, rows that a task cuts into chunks, and anchors that go over all rows at once (on average).
CHUNK, CHUNKED, ANCHORS = 1024, 1 << 14, 1 << 13
#: Anchors that are compared with a chunk at once, and candidates that a task keeps before it ranks them.
ROUND, BUFFER = 512, 1 << 18
#: What single-precision angles and cosines may be wrong by, several times over.
_ANGLE, _COSINE = 4e-6, 4e-6
_EXACT = float(1 << 53)


# -- bounds ------------------------------------------------------------------------------------------------------------

def angles(v: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to the unit vectors ``refs``) of integer rows; a zero row has norm and angles 0."""
    x = v.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    cosine = np.clip(x @ refs.T / np.where(norm, norm, 1)[:, None], -1, 1)
    return norm, np.where(norm[:, None] > 0, np.arccos(cosine), 0).astype(np.float32)


def _scores(least: np.ndarray, most: np.ndarray, small: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores from bounds of the angle and of the product of norms, widened by the rounding."""
    high, low = np.cos(np.maximum(least - _ANGLE, 0)) + _COSINE, np.cos(np.minimum(most + _ANGLE, np.pi)) - _COSINE
    return np.where(low > 0, small, large) * low - 1, np.where(high > 0, large, small) * high + 1


def chunk_bounds(norm: np.ndarray, ang: np.ndarray, chunk_norm: np.ndarray, chunk_ang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score that each row of (norm, ang) can have with any row of a chunk."""
    lo, hi = chunk_ang.min(axis=0), chunk_ang.max(axis=0)
    least = np.maximum(np.maximum(ang - hi, lo - ang), 0).max(axis=1)
    near, far = ang + lo, ang + hi
    fold = lambda s: np.minimum(s, 2 * np.pi - s)
    most = np.where((near <= np.pi) & (far >= np.pi), np.pi, np.maximum(fold(near), fold(far))).min(axis=1)
    slack = 1e-9
    return _scores(least.astype(np.float64), most.astype(np.float64), norm * chunk_norm.min() * (1 - slack), norm * chunk_norm.max() * (1 + slack))


def pair_bounds(norm: np.ndarray, ang: np.ndarray, row_norm: np.ndarray, row_ang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score of every pair of rows."""
    least = np.zeros((len(ang), len(row_ang)), np.float32)
    most = np.full(least.shape, np.pi, np.float32)
    for j in range(ang.shape[1]):
        a, b = ang[:, j, None], row_ang[None, :, j]
        np.maximum(least, np.abs(a - b), out=least)
        s = a + b
        np.minimum(most, np.minimum(s, np.float32(2 * np.pi) - s), out=most)
    product = norm[:, None] * row_norm[None, :]
    return _scores(least, most, product, product)


def exact_scores(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Integer inner products; by way of doubles where no partial sum can leave their integers."""
    if len(a) and len(b) and norm_a.max() * norm_b.max() * 1.01 < _EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


# -- chunks ------------------------------------------------------------------------------------------------------------

def pick_references(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of up to ``count`` sampled rows, each as far as can be from those before it."""
    x = sample.astype(np.float64)
    x = x[np.any(x != 0, axis=1)]
    if not len(x):
        return np.eye(1, max(sample.shape[1], 1))[:, :sample.shape[1]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _measured(rows: DataFrame, scale: int, dims: int, refs: np.ndarray) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            v = int_matrix(batch.column("v"), scale, dims)
            norm, ang = angles(v, refs)
            cell = ang.argmin(axis=1)
            vec = pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary())
            columns = [batch.column("id"), batch.column("label"), batch.column("anchor"), pa.array(cell.astype(np.int32)),
                       pa.array(ang[np.arange(len(cell)), cell]), vec, pa.array([r.tobytes() for r in ang], pa.binary()), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "anchor", "cell", "own", "vec", "ang", "norm"])

    return rows.mapInArrow(measure, "id long, label long, anchor boolean, cell int, own float, vec binary, ang binary, norm double")


def _chunks(measured: DataFrame, tasks: int) -> DataFrame:
    """One row per chunk of one label and neighbouring directions: its columns as bytes."""
    dealt = measured.repartitionByRange(tasks, "label", "cell", "own", "id").sortWithinPartitions("label", "cell", "own", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [len(label)]]) if len(label) else np.zeros(1, np.int64)
            starts = [s for a, b in zip(edges[:-1], edges[1:]) for s in range(a, b, CHUNK)] + [len(label)]
            parts = [batch.slice(a, b - a) for a, b in zip(starts[:-1], starts[1:])]
            packed = lambda p, c, kind: p.column(c).to_numpy(zero_copy_only=False).astype(kind).tobytes()
            joined = lambda p, c: b"".join(p.column(c).to_pylist())
            yield pa.RecordBatch.from_pylist([
                {"label": p.column("label")[0].as_py(), "ids": packed(p, "id", "<i8"), "anchors": packed(p, "anchor", "u1"), "norms": packed(p, "norm", "<f8"),
                 "vecs": joined(p, "vec"), "angs": joined(p, "ang")} for p in parts], schema=pa.schema([("label", pa.int64())] + [
                     (c, pa.binary()) for c in ("ids", "anchors", "norms", "vecs", "angs")]))

    return dealt.mapInArrow(cut, "label long, ids binary, anchors binary, norms binary, vecs binary, angs binary")


class Rows:
    """The rows of a chunk, or the anchors of a go, as arrays."""

    def __init__(self, ids, label, norm, vec, ang):
        self.ids, self.label, self.norm, self.vec, self.ang = ids, label, norm, vec, ang

    @staticmethod
    def of(r: dict, refs: int) -> "Rows":
        ids = np.frombuffer(r["ids"], "<i8")
        square = lambda b, kind, width: np.frombuffer(b, kind).reshape(len(ids), width)
        return Rows(ids, r["label"], np.frombuffer(r["norms"], "<f8"), square(r["vecs"], "<i4", len(r["vecs"]) // 4 // len(ids)), square(r["angs"], "<f4", refs))

    def take(self, keep) -> "Rows":
        return Rows(self.ids[keep], self.label if np.isscalar(self.label) else self.label[keep], self.norm[keep], self.vec[keep], self.ang[keep])


def _anchor_rows(chunks: DataFrame, goes: int) -> DataFrame:
    """The anchors, as chunks of one go each."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                go = (mix(ids.view(np.uint64)) % np.uint64(goes)).astype(np.int64)
                flag = np.frombuffer(r["anchors"], "u1").astype(bool)
                for g in np.unique(go[flag]):
                    at = np.flatnonzero(flag & (go == g))
                    part = lambda b: b"".join(b[k * (len(b) // len(ids)):(k + 1) * (len(b) // len(ids))] for k in at)
                    out.append({"go": int(g), "label": r["label"]} | {c: part(r[c]) for c in ("ids", "norms", "vecs", "angs")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("go", pa.int64()), ("label", pa.int64())] + [(c, pa.binary()) for c in ("ids", "norms", "vecs", "angs")]))

    return chunks.where(F.locate("01", F.hex("anchors")) > 0).mapInArrow(pick, "go long, label long, ids binary, norms binary, vecs binary, angs binary")


# -- one go ------------------------------------------------------------------------------------------------------------

class Best:
    """The best ``k`` candidates of every slot seen so far: highest score first, then smallest id."""

    def __init__(self, slots: int, k: int, floor: np.ndarray):
        self.k, self.need = k, floor.astype(np.float64)
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._new: list[tuple] = []
        self._held = 0

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        """Offer the wanted pairs of a score matrix, whose rows are slots and whose columns are ids."""
        many = np.flatnonzero(wanted.sum(axis=1) > self.k)
        if len(many):  # the k-th best of this chunk is a bound already
            kth = np.partition(np.where(wanted[many], scores[many], np.iinfo(np.int64).min), -self.k, axis=1)[:, -self.k]
            wanted[many] &= scores[many] >= kth[:, None]
            self.need[slots[many]] = np.maximum(self.need[slots[many]], kth)
        row, col = np.nonzero(wanted)
        self._new.append((slots[row], scores[row, col], ids[col]))
        self._held += len(row)
        if self._held > BUFFER:
            self.rank()

    def rank(self) -> None:
        slot, score, row = (np.concatenate([old, *new]) for old, new in zip((self.slot, self.score, self.id), zip(*self._new))) if self._new else (self.slot, self.score, self.id)
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, bool)
        place = np.arange(len(slot)) - np.maximum.accumulate(np.where(first, np.arange(len(slot)), 0)) if len(slot) else np.empty(0, np.int64)
        full = place == self.k - 1
        self.need[slot[full]] = np.maximum(self.need[slot[full]], score[full])
        keep = place < self.k
        self.slot, self.score, self.id, self._new, self._held = slot[keep], score[keep], row[keep], [], 0


def _rounds(anchors: Rows, among: np.ndarray, need: np.ndarray, most: np.ndarray, chunk: Rows):
    """(anchor numbers, scores, open pairs) of those ``among`` the anchors whose interval [need, most] a chunk can meet."""
    for k in range(0, len(among), ROUND):
        at = among[k:k + ROUND]
        low, high = chunk_bounds(anchors.norm[at], anchors.ang[at], chunk.norm, chunk.ang)
        at = at[(high >= need[at]) & (low <= most[at])]
        if not len(at):
            continue
        low, high = pair_bounds(anchors.norm[at], anchors.ang[at], chunk.norm, chunk.ang)
        open_ = (high >= need[at, None]) & (low <= most[at, None])
        rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if len(rows):
            at = at[rows]
            scores = exact_scores(anchors.vec[at], chunk.vec[cols], anchors.norm[at], chunk.norm[cols])
            yield at, cols, scores, open_[np.ix_(rows, cols)]


def best_positives(anchors: Rows, chunks: Iterator[Rows], k: int) -> Best:
    """The ``k`` highest-scored rows of the anchor's label with another id."""
    best = Best(len(anchors.ids), k, np.full(len(anchors.ids), -np.inf))
    endless = np.full(len(anchors.ids), np.inf)
    for chunk in chunks:
        among = np.flatnonzero(anchors.label == chunk.label)
        for at, cols, scores, open_ in _rounds(anchors, among, best.need, endless, chunk):
            best.add(at, scores, chunk.ids[cols], open_ & (scores >= best.need[at, None]) & (anchors.ids[at, None] != chunk.ids[cols]))
    best.rank()
    return best


def best_negatives(anchors: Rows, chunks: Iterator[Rows], k: int, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> Best:
    """Per window [low, high] the ``k`` highest-scored rows of another label inside it; window j of anchor a has the number
    ``slots[a, j]``, -1 where there is none."""
    best = Best(len(low), k, low)
    for chunk in chunks if len(low) else ():
        need = np.where(slots >= 0, best.need[slots], np.inf)
        most = np.where(slots >= 0, high[slots], -np.inf)
        among = np.flatnonzero((anchors.label != chunk.label) & (slots >= 0).any(axis=1))
        for at, cols, scores, open_ in _rounds(anchors, among, need.min(axis=1), most.max(axis=1), chunk):
            for j in range(slots.shape[1]):
                has = np.flatnonzero(slots[at, j] >= 0)
                own = slots[at[has], j]
                wanted = open_[has] & (scores[has] >= best.need[own][:, None]) & (scores[has] <= high[own][:, None])
                best.add(own, scores[has], chunk.ids[cols], wanted)
    best.rank()
    return best


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of what the tasks found; at most ``k`` rows a task and group come in."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _emit(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _go(spark: SparkSession, chunks: DataFrame, anchors: Rows, positives: int, negatives: int, least: int, most: int, folder: str) -> None:
    """Write the negatives of one go's anchors; what it broadcast is dropped again."""
    refs = anchors.ang.shape[1]
    sent = spark.sparkContext.broadcast(anchors)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
        return (Rows.of(r, refs) for batch in slices(batches, 16) for r in batch.to_pylist())

    def positive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = best_positives(sent.value, opened(batches), positives)
        yield _emit([b.slot, b.score, b.id], ["slot", "score", "row"])

    own = _top(chunks.mapInArrow(positive, "slot long, score long, row long"), ["slot"], positives)
    got = own.select("slot", "rank", "score", "row").toArrow()  # at most `positives` rows an anchor of this go
    slot, rank, score, row = (got.column(c).to_numpy() for c in ("slot", "rank", "score", "row"))
    slots = np.full((len(anchors.ids), positives), -1, np.int64)
    slots[slot, rank - 1] = np.arange(len(slot))
    low, high = -((-least * score) // 100), most * score // 100
    windows = spark.sparkContext.broadcast((slots, low, high))

    def negative(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = best_negatives(sent.value, opened(batches), negatives, *windows.value)
        yield _emit([anchors_of[b.slot], row[b.slot], score[b.slot], b.score, b.id], ["anchor_id", "positive_id", "positive_score", "score", "row"])

    anchors_of = anchors.ids[slot]
    found = chunks.mapInArrow(negative, "anchor_id long, positive_id long, positive_score long, score long, row long")
    best = _top(found, ["anchor_id", "positive_id"], negatives)
    best = best.select("anchor_id", "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    best.write.mode("append").parquet(folder)
    sent.unpersist()
    windows.unpersist()


def hard_negatives(df: DataFrame, is_anchor: Column, scale: int, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
                   id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(scale * x)``, scores are integer inner products, higher first, ties by smaller id. The
    ``positives`` best other rows of an anchor's label are its positives; for each, the ``negatives`` best rows of another
    label between ``least`` and ``most`` hundredths of the positive's score are returned. An anchor or
    positive without such rows, and an empty table, give none.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("v"))
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("anchors")).first()
    dims = size["dims"] or 1
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    refs = pick_references(int_matrix(sample, scale, dims), REFERENCES)
    once = rows.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    chunks = cut_lineage(_chunks(_measured(once, scale, dims, refs), max(1, -(-size["n"] // CHUNKED))))
    goes = max(1, -(-size["anchors"] // ANCHORS))
    dealt = cut_lineage(_anchor_rows(chunks, goes))
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/negatives-{uuid.uuid4().hex}"
    for go in range(goes):
        parts = [(r["label"], Rows.of(r, len(refs))) for r in (x.asDict() for x in dealt.where(F.col("go") == go).collect())]
        if not parts and go < goes - 1:
            continue
        if parts:
            joined = [np.concatenate([getattr(p, c) for _, p in parts]) for c in ("ids", "norm", "vec", "ang")]
            labels = np.concatenate([np.full(len(p.ids), label) for label, p in parts])
        else:
            joined, labels = [np.empty(0, np.int64), np.empty(0), np.empty((0, dims), np.int32), np.empty((0, len(refs)), np.float32)], np.empty(0, np.int64)
        _go(spark, chunks, Rows(joined[0], labels, *joined[1:]), positives, negatives, least, most, folder)
    return spark.read.parquet(folder)
