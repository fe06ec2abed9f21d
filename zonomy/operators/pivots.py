"""Exact nearest neighbours by pivots: blocks of references with covering radii, visited in rounds.

Every reference belongs to its nearest pivot, and to one of the pivot's shells of like angle; a shell, or a hashed part of a
large one, is a block. The angle between a query and a pivot and the angles of a shell bound every distance
between them (triangle inequality on the sphere). In the first round a query visits the nearest blocks that hold k
references; its k-th distance then rules blocks out for good. The second round takes few more blocks, which
tightens that distance, the third all that are left.

Inside a block that k-th distance, and the one found there so far, also rule out most references by a product in single
precision, from which only those within its rounding error are measured in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions import vectors as V
from zonomy.session import cut_lineage

#: Most pivots, and most shells of a pivot: together they bound what a task knows of the blocks.
PIVOTS, SHELLS = 1024, 64
#: References per pivot aimed at, and blocks of the second round.
PER_PIVOT, SECOND = 512, 4
#: Queries at most that a task streams past a bundle, and those that are worth a task.
STREAM, SOME = 1 << 16, 1 << 14
#: References at most of the blocks that share a bundle, and numbers at most in their vectors.
BUNDLE, NUMBERS = 1 << 16, 1 << 23
#: What rounding may change of a distance and of an angle.
_DIST, _ANGLE = 2e-9, 1e-7
#: Cells of a matrix that are held at once.
TABLE = 1 << 21
#: Queries and references of a product, and those of a row that may pass its bound before all are measured.
ROWS, TILE, PASSED = 512, 1024, 64


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of what the blocks found, ties by reference."""
    w = Window.partitionBy("q").orderBy("dist", "r")  # at most k rows per visited block
    return pairs.withColumn("nn", F.row_number().over(w)).where(F.col("nn") <= k)


def _single(vec: str) -> Column:
    """Whether single precision holds the vector as it is."""
    return F.coalesce(F.forall(V.doubles(vec), lambda x: x.eqNullSafe(x.cast("float").cast("double"))), F.lit(False))


def _packed(df: DataFrame, key: str, vec: str, name: str, kind: str) -> DataFrame:
    """(name, v): vectors as bytes of numbers of ``kind``."""
    key_type = dict(df.dtypes)[key]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in flat.astype(kind)], pa.binary())], names=[name, "v"])

    return df.select(F.col(key).alias(name), V.doubles(vec).alias("v")).mapInArrow(pack, f"{name} {key_type}, v binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Packed vectors over their norm (plus 1e-8)."""
    if not len(column):
        return np.empty((0, 0))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind).reshape(len(column), -1).astype(float)
    return flat / (np.linalg.norm(flat, axis=1, keepdims=True) + 1e-8)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _cosines(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.clip(_units(v) @ pivots.T, -1, 1)


def _assigned(refs: DataFrame, pivots: np.ndarray, id_type: str, kind: str) -> DataFrame:
    """(r, v, p, angle): nearest pivot and the angle to it; a zero vector has pivot -1."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), kind)
            p, angle = np.zeros(len(v), np.int32), np.zeros(len(v))
            for a in range(0, len(v), 1024):
                c = _cosines(v[a:a + 1024], pivots)
                p[a:a + 1024], angle[a:a + 1024] = c.argmax(axis=1), np.arccos(c.max(axis=1))
            p[~v.any(axis=1)] = -1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(angle)], names=["r", "v", "p", "angle"])

    return refs.mapInArrow(assign, f"r {id_type}, v binary, p int, angle double")


class Blocks:
    """Pivot, least and largest angle and row count of every block that is not empty, and the bundle that it is part of.

    A bundle is a run of blocks with at most ``size`` references, or a hashed part of one block of more.
    """

    def __init__(self, pivots: np.ndarray, rows: list, size: int):
        self.pivots = pivots
        self.name = np.array([r["b"] for r in rows], np.int64)
        self.pivot = np.array([r["p"] for r in rows], np.int64)
        self.low, self.high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.subs = -(-self.n // size)
        self.runs: list[list[int]] = []  # first and last block (exclusive), first bundle, number of bundles
        held = 0
        for i, (n, subs) in enumerate(zip(self.n.tolist(), self.subs.tolist())):
            if not self.runs or subs > 1 or self.runs[-1][3] > 1 or held + n > size:
                first = sum(self.runs[-1][2:]) if self.runs else 0
                self.runs.append([i, i + 1, first, subs])
                held = n
            else:
                self.runs[-1][1], held = i + 1, held + n
        self.bundles = sum(self.runs[-1][2:]) if self.runs else 0

    def placed(self) -> list[tuple[int, int, int, int]]:
        """(block, first bundle, number of its bundles, place in the bundle) of every block."""
        return [(int(self.name[i]), first, subs, i - a) for a, z, first, subs in self.runs for i in range(a, z)]

    def gaps(self, v: np.ndarray) -> np.ndarray:
        """Least angle that each row can have to a reference of each block; below 0 where its own angle is among theirs."""
        angle = np.arccos(_cosines(v, self.pivots))[:, np.maximum(self.pivot, 0)]
        gap = np.maximum(angle - self.high, self.low - angle)
        gap[:, self.pivot < 0] = 0  # zero vectors are as far from all
        return gap

    def nearest(self, gaps: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """(order, take): the blocks of least angle in order, as many as ``enough`` needs, and which of them it takes."""
        width = min(gaps.shape[1], 64)
        while True:
            few = np.argpartition(gaps, width - 1, axis=1)[:, :width] if width < gaps.shape[1] else np.broadcast_to(np.arange(width), gaps.shape)
            order = np.take_along_axis(few, np.argsort(np.take_along_axis(gaps, few, axis=1), axis=1, kind="stable"), axis=1)
            take, settled = enough(order)
            if settled or width == gaps.shape[1]:
                return order, take
            width = min(gaps.shape[1], 8 * width)

    def asked(self, want: np.ndarray) -> pa.Array:
        """Per row the bundles that hold wanted blocks, with one bit for each of their blocks."""
        row, bundle, bits = [], [], []
        for a, z, first, subs in self.runs:
            own = np.flatnonzero(want[:, a:z].any(axis=1))
            packed = [b.tobytes() for b in np.packbits(want[own, a:z], axis=1)]
            for k in range(subs):
                row.append(own)
                bundle.append(np.full(len(own), first + k))
                bits += packed
        row = np.concatenate(row)
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(want)))])
        values = pa.StructArray.from_arrays([pa.array(np.concatenate(bundle)[order]), pa.array(bits, pa.binary()).take(pa.array(order))], names=["bundle", "bits"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _lists(rows: int, row: np.ndarray, value: np.ndarray) -> pa.Array:
    """Per row its values."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(value[np.argsort(row, kind="stable")], pa.int32()))


def _wanted(blocks: Blocks, k: int, step: int | None, id_type: str, kind: str):
    """Which blocks each query visits in a round: the nearest that hold k references, ``step`` more, or all that are left. ``kth`` is null
    while fewer than k are known; ``had`` are the blocks of the rounds before the last, ``seen`` is the number of all."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, TABLE // 8 // max(len(blocks.n), len(blocks.pivots)))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                gaps = blocks.gaps(_matrix(batch.column("v"), kind))
                kth = pc.fill_null(batch.column("kth"), np.inf).to_numpy()
                had = batch.column("had")
                at = np.repeat(np.arange(len(gaps)), pc.list_value_length(had).to_numpy()), had.flatten().to_numpy()
                want, done = np.zeros(gaps.shape, bool), at
                if step == 0:
                    def enough(order: np.ndarray) -> tuple[np.ndarray, bool]:
                        held = np.cumsum(blocks.n[order], axis=1)
                        return np.concatenate([np.ones((len(held), 1), bool), held[:, :-1] < k], axis=1), bool((held[:, -1] >= k).all())

                    order, take = blocks.nearest(gaps, enough)
                else:
                    # a distance is at least 1 less the cosine of that angle, and never under 1 beyond a right angle
                    reach = np.where(kth + _DIST >= 1, np.inf, np.arccos(np.clip(1 - _DIST - kth, 0, 1)))
                    gaps[at] = np.nan  # passes no test
                    if step is None:
                        want = gaps <= reach[:, None] + _ANGLE
                    else:
                        gaps[at] = np.inf
                        order, take = blocks.nearest(gaps, lambda order: (np.broadcast_to(np.arange(order.shape[1]) < step, order.shape), order.shape[1] >= step))
                        ahead = np.take_along_axis(gaps, order, axis=1)
                        take = take & np.isfinite(ahead) & (ahead <= reach[:, None] + _ANGLE)
                if step is not None:
                    np.put_along_axis(want, order, take, axis=1)
                    done = np.concatenate([at[0], np.nonzero(take)[0]]), np.concatenate([at[1], order[take]])
                seen = pa.array(batch.column("seen").to_numpy() + want.sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), batch.column("kth"), blocks.asked(want), _lists(len(want), *done), seen],
                                                 names=["q", "v", "kth", "asked", "had", "seen"])

    return choose, f"q {id_type}, v binary, kth double, asked array<struct<bundle:long,bits:binary>>, had array<int>, seen long"


def _first_k(row: np.ndarray, rank: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of least (dist, rank) of every row, by row."""
    order = np.lexsort((rank, dist, row))
    r = row[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def _set(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few cells that are set."""
    flat = mask.reshape(-1)
    if flat.size % 8:
        at = np.flatnonzero(flat)
    else:
        words = np.flatnonzero(flat.view(np.uint64))
        word, byte = np.nonzero(flat.reshape(-1, 8)[words])
        at = words[word] * 8 + byte
    return np.divmod(at, mask.shape[1])


class _Refs:
    """The references of a bundle, block by block, cut to pieces of at most ``TILE`` rows, and runs of pieces."""

    def __init__(self, held: list[pa.RecordBatch], kind: str, exclude_self: bool):
        whole = pa.Table.from_batches(held)
        order = pc.sort_indices(whole.select(["place", "id"]), [("place", "ascending"), ("id", "ascending")])
        self.place, self.ids = whole.column("place").to_numpy()[order], pa.concat_arrays(whole.column("id").chunks).take(order)
        self.v = np.concatenate([_matrix(b.column("v"), kind) for b in held])[order]
        self.short = self.v.astype(np.float32)
        self.room = np.empty(ROWS * TILE, np.float32), np.empty(ROWS * TILE, bool)
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.own = {x: i for i, x in enumerate(self.ids.to_pylist())} if exclude_self else {}
        ends = np.concatenate([[0], np.flatnonzero(np.diff(self.place)) + 1, [len(self.place)]]).tolist()
        self.runs: list[list[tuple[int, int]]] = []
        for a, z in ((s, min(s + TILE, z)) for a, z in zip(ends[:-1], ends[1:]) for s in range(a, z, TILE)):
            if self.runs and z - self.runs[-1][0][0] <= TILE:
                self.runs[-1].append((a, z))
            else:
                self.runs.append([(a, z)])


class _Queries:
    """Queries that meet the references of a bundle, and the k nearest that they have found."""

    def __init__(self, refs: _Refs, part: pa.RecordBatch, k: int, kind: str):
        self.refs, self.k, self.ids = refs, k, part.column("id")
        self.v = _matrix(part.column("v"), kind)
        self.short = self.v.astype(np.float32)
        self.bits = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in part.column("bits").to_pylist()]), axis=1).astype(bool)
        self.own = np.array([refs.own.get(x, -1) for x in self.ids.to_pylist()]) if refs.own else np.full(len(self.ids), -1)
        self.kth = pc.fill_null(part.column("kth"), np.inf).to_numpy().copy()
        #: Twice what single precision may change of a product of two vectors of length 1.
        self.slack = 1e-9 + 1.2e-7 * (self.v.shape[1] + 4)
        self.row, self.at, self.dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, row: np.ndarray, at: np.ndarray, dist: np.ndarray) -> None:
        keep = dist <= self.kth[row]
        if keep.any():
            self.new.append((row[keep], at[keep], dist[keep]))
            if sum(len(n[0]) for n in self.new) >= self.k * len(self.v):
                self.merge()

    def merge(self) -> None:
        if self.new:
            row, at, dist = (np.concatenate(x) for x in zip((self.row, self.at, self.dist), *self.new))
            first = _first_k(row, self.refs.rank[at], dist, self.k)
            self.row, self.at, self.dist, self.new = row[first], at[first], dist[first], []
            last = self.k - 1
            full = np.flatnonzero(self.row[last:] == self.row[:max(0, len(self.row) - last)]) + last  # the k-th of a row
            self.kth[self.row[full]] = np.minimum(self.kth[self.row[full]], self.dist[full])

    def meet(self, rows: np.ndarray, a: int, z: int, mixed: bool) -> None:
        """Rows beside the references from ``a`` to ``z``, which are those of wanted blocks unless ``mixed``."""
        free = np.isinf(self.kth[rows])
        if free.any():
            self.measure(rows[free], a, z, mixed)
            rows = rows[~free]
        for start in range(0, len(rows), ROWS):
            some = rows[start:start + ROWS]
            cells = len(some) * (z - a)
            near, passed = (x[:cells].reshape(len(some), z - a) for x in self.refs.room)
            np.matmul(self.short[some], self.refs.short[a:z].T, out=near)
            np.greater_equal(near, (1 - self.slack - self.kth[some]).astype(np.float32)[:, None], out=passed)
            row, at = _set(passed)
            many = np.bincount(row, minlength=len(some)) > PASSED + self.k
            if many.any():
                self.measure(some[many], a, z, mixed)
                row, at = row[~many[row]], at[~many[row]]
            row, at = some[row], at + a
            if mixed:
                ok = self.bits[row, self.refs.place[at]]
                row, at = row[ok], at[ok]
            ok = self.own[row] != at
            row, at = row[ok], at[ok]
            self.add(row, at, np.round(1.0 - np.einsum("ij,ij->i", self.v[row], self.refs.v[at]), 9))

    def measure(self, rows: np.ndarray, a: int, z: int, mixed: bool) -> None:
        """All distances of the rows, of which the k least stay, ties by reference."""
        by_id = a + np.argsort(self.refs.rank[a:z])
        refs, step = self.refs.v[by_id], max(1, TABLE // (z - a))
        for some in (rows[s:s + step] for s in range(0, len(rows), step)):
            d = np.round(1.0 - self.v[some] @ refs.T, 9)
            if mixed:
                d[~self.bits[some[:, None], self.refs.place[by_id]]] = np.inf
            own = self.own[some]
            hit = np.flatnonzero((own >= a) & (own < z))
            d[hit, self.refs.rank[a:z].argsort().argsort()[own[hit] - a]] = np.inf
            d[np.isnan(d)] = np.inf
            keep = d < np.inf
            if z - a > self.k:
                last = np.partition(d, self.k - 1, axis=1)[:, self.k - 1:self.k]
                less, tie = d < last, d == last
                keep &= less | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= self.k - less.sum(axis=1, keepdims=True)))
            row, at = np.nonzero(keep)
            self.add(some[row], by_id[at], d[keep])

    def found(self) -> pa.RecordBatch | None:
        for run in self.refs.runs:
            a, z = run[0][0], run[-1][1]
            asked = self.bits[:, self.refs.place[[p[0] for p in run]]]
            rows = np.flatnonzero(asked.any(axis=1))
            met = asked.sum(axis=0) @ np.array([p[1] - p[0] for p in run])
            if 4 * met >= len(rows) * (z - a):  # most cells are asked for
                if len(rows):
                    self.meet(rows, a, z, met < len(rows) * (z - a))
                continue
            for (a, z), own in zip(run, asked.T):
                if own.any():
                    self.meet(np.flatnonzero(own), a, z, False)
        self.merge()
        if not len(self.row):
            return None
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), self.refs.ids.take(pa.array(self.at)), pa.array(self.dist)], names=["q", "r", "dist"])


def _compare(k: int, exclude_self: bool, id_type: str, kind: str):
    """Stream the queries of a bundle past its references, which come first; a query meets the blocks of its bits."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, ready = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("slot", "role")], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, [len(marks)]]) if len(marks) else [0]
            for a, z in zip(edges[:-1], edges[1:]):
                run, own = batch.slice(a, z - a), marks[a, 0]
                if own != group:
                    group, held, ready = own, [], None
                if marks[a, 1] == 0:
                    held.append(run.select(["place", "id", "v"]))
                    continue
                if not held:
                    continue
                ready = ready or _Refs(held, kind, exclude_self)
                step = max(1, 8 * TABLE // (int(ready.place[-1]) + 1))
                for s in range(0, run.num_rows, step):
                    found = _Queries(ready, run.slice(s, step), k, kind).found()
                    if found is not None:
                        yield found

    return compare, f"q {id_type}, r {id_type}, dist double"


def _slots(spark, n: int) -> list[int]:
    """Numbers that ``repartition(n, number)`` puts into partitions of their own, as far as they are found among the first."""
    at = F.pmod(F.hash("id"), F.lit(n))
    found = [r[0] for r in spark.range(16 * n, numPartitions=1).groupBy(at.alias("p")).agg(F.min("id")).select("min(id)").orderBy("min(id)").collect()]
    return found + [16 * n + i for i in range(n - len(found))]


def _visit(wanted: DataFrame, placed: DataFrame, bundles: int, k: int, exclude_self: bool, id_type: str, kind: str) -> DataFrame:
    """(q, r, dist) of the k best per query and bundle. A query goes once to a bundle, for all of its blocks."""
    spark = wanted.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    load = wanted.select(F.inline("asked")).groupBy("bundle").agg(F.count(F.lit(1)).alias("_q"))
    some = F.least(F.lit(-(-tasks // bundles)), F.ceil(F.col("_q") / SOME))  # few bundles are dealt out for the tasks' sake
    parts = load.select("bundle", F.greatest(F.ceil(F.col("_q") / STREAM), some).cast("int").alias("parts")).orderBy("bundle").collect()  # a row per bundle
    n = max(1, sum(r["parts"] for r in parts))
    slots, ends = _slots(spark, n), np.cumsum([0] + [r["parts"] for r in parts]).tolist()
    dealt = F.broadcast(spark.createDataFrame([(r["bundle"], slots[a:z]) for r, a, z in zip(parts, ends[:-1], ends[1:])], "bundle long, slots array<long>"))
    none = F.lit(None)
    refs = placed.join(dealt, "bundle").select(F.explode("slots").alias("slot"), F.lit(0).alias("role"), F.col("r").alias("id"), "v", "place", none.cast("binary").alias("bits"), none.cast("double").alias("kth"))
    own = F.get("slots", F.pmod(F.xxhash64("q"), F.size("slots")).cast("int"))
    q = wanted.select("q", "v", "kth", F.inline("asked")).join(dealt, "bundle").select(own.alias("slot"), F.lit(1).alias("role"), F.col("q").alias("id"), "v", none.cast("int").alias("place"), "bits", "kth")
    compare, schema = _compare(k, exclude_self, id_type, kind)
    return refs.unionByName(q).repartition(n, "slot").sortWithinPartitions("slot", "role").mapInArrow(compare, schema)


def search(queries: DataFrame, refs: DataFrame, k: int, key: str, vec: str, exclude_self: bool, block: int, n_refs: int) -> tuple[DataFrame, dict]:
    """(q, r, dist) rows that hold the k nearest references of every query, and how many of the (query, block) pairs were visited.

    Pivots are the references of smallest hash. What tasks know of all blocks are at most ``PIVOTS`` vectors and
    ``PIVOTS * SHELLS`` rows of figures; a block of more rows than a bundle holds is dealt into hashed parts. Vectors travel
    in single precision where that holds all of them as they are.
    """
    id_type = dict(queries.dtypes)[key]
    both = queries.select(_single(vec).alias("s")).unionByName(refs.select(_single(vec).alias("s")))
    kind = "<f4" if both.agg(F.min("s")).first()[0] else "<f8"
    packed = _packed(refs, key, vec, "r", kind)
    count = int(min(PIVOTS, max(1, n_refs // min(PER_PIVOT, block))))
    chosen = packed.orderBy(F.xxhash64("r"), "r").limit(count).select("v").toArrow().column("v").combine_chunks()
    pivots = _units(_matrix(chosen, kind))
    pivots = pivots[pivots.any(axis=1)] if pivots.any() else np.eye(1, pivots.shape[1])
    near = cut_lineage(_assigned(packed, pivots, id_type, kind))
    ends = near.groupBy("p").agg(F.min("angle").alias("_lo"), F.max("angle").alias("_hi"), F.least(F.ceil(F.count(F.lit(1)) / block), F.lit(SHELLS)).alias("_s"))
    shell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("angle") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_s")), F.col("_s") - 1)).otherwise(0)
    shelled = near.join(F.broadcast(ends), "p").select("r", "v", "p", "angle", (F.col("p") * SHELLS + shell).cast("long").alias("b"))
    figures = shelled.groupBy("b").agg(F.first("p").alias("p"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    size = max(block, min(BUNDLE, n_refs // 4, NUMBERS // pivots.shape[1]))
    blocks = Blocks(pivots, figures.orderBy("b").collect(), size)  # at most PIVOTS * SHELLS rows
    places = refs.sparkSession.createDataFrame(blocks.placed(), "b long, first long, subs int, place int")
    own = F.col("first") + F.pmod(F.xxhash64("r"), F.col("subs"))
    placed = cut_lineage(shelled.join(F.broadcast(places), "b").select(own.cast("long").alias("bundle"), "place", "r", "v"))
    state = _packed(queries, key, vec, "q", kind).withColumns({"kth": F.lit(None).cast("double"), "had": F.array().cast("array<int>"), "seen": F.lit(0).cast("long")})
    best = None
    for step in (0, SECOND, None):
        choose, schema = _wanted(blocks, k + exclude_self, step, id_type, kind)
        wanted = cut_lineage(state.mapInArrow(choose, schema))
        found = _visit(wanted, placed, blocks.bundles, k, exclude_self, id_type, kind)
        best = cut_lineage(top_pairs(found if best is None else best.unionByName(found), k).drop("nn"))
        kth = best.groupBy("q").agg(F.max("dist").alias("_d"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k).select(F.col("q").alias("_q"), F.col("_d").alias("kth"))
        state = wanted.select("q", "v", "had", "seen").join(kth, F.col("q") == F.col("_q"), "left").drop("_q")
    seen = wanted.agg(F.sum("seen"), F.count(F.lit(1))).first()
    return best, {"visited": seen[0] or 0, "pairs": seen[1] * len(blocks.n)}
