"""Overlay of general polygons: union area inside zones and shared area of pairs, exact for any rings.

A polygon is a column of rings (``array<array<struct<x, y>>>``); what an odd number of its rings hold is inside, so holes and
multiparts need no order or direction. Polygons are cut to grid cells first, and everything after that happens in a cell:
edges become rows of one cell, the union of a cell's shapes is a list of disjoint trapezoids, and zones meet these
trapezoids by an equi-join on the cell. Cells with many shapes are united in salted parts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions import geometry as G, hull as H, inscribed, sweep
from zonomy.session import broadcast_if_small, cut_lineage

#: Shapes of a cell that one task unites at a time, edges that it unites at once, and dense cells whose list is broadcast.
HOT_SHAPES, EDGES, HOT_CELLS = 2_000, 1_200, 10_000
#: Shapes of a cell up to which zones meet them as they are, and bytes of their edges on average; those of fuller cells are united first.
FEW_SHAPES, FEW_BYTES = 64, 256
#: Polygons of a task when they are cut, and trapezoids that are looked at together.
TASK_POLYGONS, TRAPEZOIDS = 50_000, 1 << 18
BOX = ("_x0", "_y0", "_x1", "_y1")


def rings_box(rings: Column) -> Column:
    """Bounding box of a polygon."""
    return G.ring_box(F.flatten(rings))


def _rings_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, points of every ring, row of every ring), rows one behind the other; rings of fewer than three points or with missing or
    non-finite coordinates are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rings = column.flatten()
    points = rings.flatten()
    xy = np.stack([np.asarray(points.field(k).to_numpy(zero_copy_only=False), np.float64) for k in ("x", "y")], axis=1) if len(points) else np.empty((0, 2))
    size = pc.fill_null(rings.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(int)
    row = np.repeat(np.arange(len(column)), pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))
    ring = np.repeat(np.arange(len(size)), size)
    good = (size > 2) & (np.bincount(ring, ~np.isfinite(xy).all(axis=1), minlength=len(size)) == 0)
    return xy[good[ring]], size[good], row[good]


def _polygons(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The rings of every row as arrays of points, those of ``_rings_of``."""
    xy, size, row = _rings_of(column)
    of_ring = np.concatenate([[0], np.cumsum(size)]).astype(int)
    of_row = np.searchsorted(row, np.arange(len(column) + 1))
    for a, b in zip(of_row[:-1], of_row[1:]):
        yield [xy[of_ring[k]:of_ring[k + 1]] for k in range(a, b)]


def dealt(df: DataFrame) -> DataFrame:
    """Polygons dealt out before they are cut or measured, as a small file of many polygons is read by one task."""
    n = -(-df.count() // TASK_POLYGONS)
    return df.repartition(n) if n > 1 else df


def cell_edges(df: DataFrame, rings: str, cell: float, keep: tuple[str, ...]) -> DataFrame:
    """(keep, _cx, _cy, edges, _x0, _y0, _x1, _y1) of every cell that a polygon reaches: the edges of its part there, as bytes, and their box."""
    slim = df.select(*keep, F.col(rings).alias("_rings"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("_rings").schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy, size, row = _rings_of(batch.column("_rings"))
            ring, at, points, n = sweep.cut_all_to_cells(xy, size, cell)
            e, part = sweep.all_edges(points, n)
            key = np.column_stack([row[ring], at])[part]
            order = np.lexsort((ring[part], key[:, 2], key[:, 1], key[:, 0]))
            e, key = e[order], key[order]
            first = np.nonzero(np.concatenate([[True], (np.diff(key, axis=0) != 0).any(axis=1)]))[0] if len(e) else np.empty(0, int)
            offsets = np.append(first, len(e)).astype(np.int32) * 32
            edges = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(e).tobytes())])
            boxes = _boxes(e, first, np.diff(np.append(first, len(e)))).T
            k = key[first]
            columns = [batch.column(c).take(pa.array(k[:, 0])) for c in keep] + [pa.array(k[:, 1]), pa.array(k[:, 2]), edges, *map(pa.array, boxes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_cx", "_cy", "edges", *BOX])

    return dealt(slim).mapInArrow(cut, (schema + ", " if keep else "") + "_cx long, _cy long, edges binary, " + ", ".join(f"{c} double" for c in BOX))


def _edges(b: bytes) -> np.ndarray:
    return np.frombuffer(b).reshape(-1, 4)


class _Union:
    """The union of the shapes of a group, which takes up shapes until there are many edges and then unites them."""

    def __init__(self):
        self.done, self.parts, self.edges = np.empty((0, 4)), [], 0

    def add(self, e: np.ndarray) -> None:
        self.parts.append(e)
        self.edges += len(e)
        if self.edges > EDGES:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.parts:
            sizes = [len(self.done), *map(len, self.parts)]
            shape = np.repeat(np.arange(len(sizes)), sizes)  # the trapezoids so far are one shape
            self.done, self.parts, self.edges = sweep.union_edges(np.concatenate([self.done, *self.parts]), shape), [], 0
        return self.done


def _united(pieces: DataFrame, group: list[str]) -> DataFrame:
    """One row of trapezoids per group; a task holds the union of a group and a bounded number of further edges."""
    keys = pieces.select(*group)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys.schema)
    dealt = pieces.select(*group, "edges").repartition(_tasks(pieces), *group).sortWithinPartitions(*group)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union = None, _Union()

        def row():
            return pa.RecordBatch.from_arrays([*(c.slice(0, 1) for c in now[1]), pa.array([union.settle().tobytes()], pa.binary())], names=[*group, "edges"])

        for batch in batches:
            edges, columns = batch.column("edges").to_pylist(), [batch.column(c) for c in group]
            named = list(zip(*(c.to_pylist() for c in columns)))
            for k, (name, e) in enumerate(zip(named, edges)):
                if now is None or now[0] != name:
                    if now is not None:
                        yield row()
                    now, union = (name, [c.slice(k, 1) for c in columns]), _Union()
                union.add(_edges(e))
        if now is not None:
            yield row()

    return dealt.mapInArrow(unite, schema + ", edges binary")


def union_cells(shapes: DataFrame, cell: float, rings: str = "rings", keys: tuple[str, ...] = (), hot_shapes: int = HOT_SHAPES) -> DataFrame:
    """(keys, _cx, _cy, edges): the union of the shapes of every key and cell, as disjoint trapezoids.

    Equal parts collapse first. Cells of more than ``hot_shapes`` parts are dealt out by salt, united, and
    united once more.
    """
    return _union_of(cut_lineage(cell_edges(shapes, rings, cell, keys).drop(*BOX).distinct()), keys, hot_shapes)


def _union_of(pieces: DataFrame, keys: tuple[str, ...], hot_shapes: int) -> DataFrame:
    group = [*keys, "_cx", "_cy"]
    counts = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_shapes)
    hot = cut_lineage(counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)], F.ceil(F.col("_n") / hot_shapes).cast("int").alias("_salts")))
    if hot.isEmpty():
        return _united(pieces, group)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)]
    salted = pieces.join(broadcast_if_small(hot, HOT_CELLS), same, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64("edges"), F.col("_salts")).cast("int"), F.lit(0)))
    return _united(_united(salted.select(*group, "_salt", "edges"), [*group, "_salt"]).drop("_salt"), group)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _by_cell(df: DataFrame, cx: str, cy: str) -> DataFrame:
    """Dealt out by cell over a fixed number of tasks: bytes, by which small partitions are put together, do not tell the work here."""
    return df.repartition(_tasks(df), cx, cy)


def _edge_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges of all rows, first edge and number of edges of every row) of a column of edges as bytes."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(int)
    edges = _edges(data[ends[0]:ends[-1]].to_pybytes()) if ends[-1] > ends[0] else np.empty((0, 4))
    ends = (ends - ends[0]) // 32
    return edges, ends[:-1], np.diff(ends)


def _boxes(edges: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(x0, y0, x1, y1) of runs of edges; a run without edges has a box that meets nothing."""
    out, some = np.tile([np.inf, np.inf, -np.inf, -np.inf], (len(size), 1)), size > 0
    if some.any():
        own = edges[sweep.runs(start[some], size[some])]
        first = np.cumsum(size[some]) - size[some]
        for k, (f, v) in enumerate(((np.minimum, own[:, ::2].min(axis=1)), (np.minimum, own[:, 1]), (np.maximum, own[:, ::2].max(axis=1)), (np.maximum, own[:, 3]))):
            out[some, k] = f.reduceat(v, first)
    return out


def _areas(pairs: DataFrame, keep: list[str], left: str, right: str, trapezoids: bool = False) -> DataFrame:
    """``keep`` and the area that two edge sets of a row share. Where the right one is a list of disjoint ``trapezoids``, it is the sum over those
    whose box meets that of the left one."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, a_start, a_size), (b, b_start, b_size) = (_edge_runs(batch.column(c)) for c in (left, right))
            area = np.zeros(batch.num_rows)
            step = batch.num_rows if not trapezoids else max(1, int(TRAPEZOIDS // max(1.0, b_size.mean() / 2))) if batch.num_rows else 1
            for k in range(0, batch.num_rows, step):
                s = slice(k, k + step)
                if not trapezoids:
                    area[s] = sweep.shared_areas(a, a_start[s], a_size[s], b, b_start[s], b_size[s])
                    continue
                row = np.repeat(np.arange(len(a_size[s])), b_size[s] // 2)
                first = sweep.runs(b_start[s] // 2, b_size[s] // 2) * 2
                box = _boxes(a, a_start[s], a_size[s])[row]
                x0, x1 = b[first][:, ::2].min(axis=1, initial=np.inf), b[first + 1][:, ::2].max(axis=1, initial=-np.inf)
                meet = (x0 < box[:, 2]) & (x1 > box[:, 0]) & (b[first, 1] < box[:, 3]) & (b[first, 3] > box[:, 1])
                row, first = row[meet], first[meet]
                part = sweep.shared_areas(a, a_start[s][row], a_size[s][row], b, first, np.full(len(first), 2))
                area[s] = np.bincount(row, part, minlength=len(a_size[s]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(area, pa.float64())], names=[*keep, "_a"])

    return pairs.select(*keep, left, right).mapInArrow(measure, schema + ", _a double")


def _zone_cells(zones: DataFrame, zone_id: str, zrings: str, cell: float) -> DataFrame:
    return cell_edges(zones, zrings, cell, (zone_id,)).select(F.col(zone_id).alias("_zone"), F.col("_cx").alias("_zx"), F.col("_cy").alias("_zy"), F.col("edges").alias("_zone_edges"), *[F.col(c).alias(f"_z{c}") for c in BOX])


def _areas_under(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the area of ``_zone_edges`` under the shapes of the list ``shapes`` (edge sets as bytes), many rows at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep).schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, a_start, a_size = _edge_runs(batch.column("_zone_edges"))
            shapes = batch.column("shapes")
            b, b_start, b_size = _edge_runs(shapes.flatten())
            row = np.repeat(np.arange(batch.num_rows), shapes.value_lengths().to_numpy(zero_copy_only=False))
            zone, box = _boxes(a, a_start, a_size)[row], _boxes(b, b_start, b_size)
            meet = (box[:, 0] < zone[:, 2]) & (box[:, 2] > zone[:, 0]) & (box[:, 1] < zone[:, 3]) & (box[:, 3] > zone[:, 1])
            row, b_start, b_size = row[meet], b_start[meet], b_size[meet]
            shape = 1 + np.arange(len(row)) - np.searchsorted(row, row)
            area = sweep.covered_areas(a, a_size, b[sweep.runs(b_start, b_size)], np.repeat(row, b_size), np.repeat(shape, b_size))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(area, pa.float64())], names=[*keep, "_a"])

    return pairs.select(*keep, "_zone_edges", "shapes").mapInArrow(measure, schema + ", _a double")


def covered_polygon_area(zones: DataFrame, shapes: DataFrame, cell: float, zone_id: str, zrings: str = "zrings", rings: str = "rings",
                         keys: tuple[str, ...] = (), hot_shapes: int = HOT_SHAPES, few_shapes: int = FEW_SHAPES) -> DataFrame:
    """(zone_id, keys, covered): area of each zone under the union of the shapes of each key; zones without any have no row.

    Zones meet the shapes of a cell as they are, where these are at most ``few_shapes`` of a key, and the trapezoids of their union
    elsewhere. ``cell``, ``hot_shapes`` and ``few_shapes`` move no result. A polygon without a ring of three finite points is empty.
    """
    group = [*keys, "_cx", "_cy"]
    tasks = max(_tasks(shapes), -(-shapes.count() // TASK_POLYGONS))
    z = _zone_cells(zones, zone_id, zrings, cell).repartition(tasks, "_zx", "_zy")
    here = (F.col("_zx") == F.col("_cx")) & (F.col("_zy") == F.col("_cy"))
    pieces = cut_lineage(cell_edges(shapes, rings, cell, keys).drop(*BOX).repartition(tasks, "_cx", "_cy").distinct())
    counted = pieces.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("edges")).alias("_b"))
    full = cut_lineage(counted.where((F.col("_n") > few_shapes) | (F.col("_b") > few_shapes * FEW_BYTES)).select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(group)]))
    dense = [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(group)]
    crowded = not full.isEmpty()
    few = pieces.join(broadcast_if_small(full, HOT_CELLS), dense, "left_anti") if crowded else pieces
    lists = few.repartition(tasks, "_cx", "_cy").groupBy(*group).agg(F.collect_list("edges").alias("shapes"))  # few_shapes at most
    areas = _areas_under(z.join(lists.hint("merge"), here), ["_zone", *keys])
    if crowded:
        union = _union_of(cut_lineage(pieces.join(broadcast_if_small(full, HOT_CELLS), dense, "left_semi")), keys, hot_shapes)
        areas = areas.unionByName(_areas(z.join(union.repartition(tasks, "_cx", "_cy").hint("merge"), here), ["_zone", *keys], "_zone_edges", "edges", trapezoids=True))
    return areas.where(F.col("_a") > 0).groupBy(F.col("_zone").alias(zone_id), *keys).agg(F.sum("_a").alias("covered"))


def polygon_overlaps(left: DataFrame, right: DataFrame, cell: float, left_id: str, right_id: str, lrings: str = "zrings", rrings: str = "rings") -> DataFrame:
    """(left_id, right_id, shared_area) of all pairs of polygons with positive shared area."""
    a = _zone_cells(left, left_id, lrings, cell)
    b = cell_edges(right, rrings, cell, (right_id,))
    meet = (F.col("_z_x0") < F.col("_x1")) & (F.col("_x0") < F.col("_z_x1")) & (F.col("_z_y0") < F.col("_y1")) & (F.col("_y0") < F.col("_z_y1"))
    pairs = _by_cell(a, "_zx", "_zy").join(_by_cell(b, "_cx", "_cy"), (F.col("_zx") == F.col("_cx")) & (F.col("_zy") == F.col("_cy")) & meet)
    areas = _areas(pairs, ["_zone", right_id], "_zone_edges", "edges")
    return areas.where(F.col("_a") > 0).groupBy(F.col("_zone").alias(left_id), right_id).agg(F.sum("_a").alias("shared_area"))


class _Known:
    """What was found for the polygons of a task so far, so that equal ones are measured once; emptied when it holds many."""

    def __init__(self, measure, most: int = 1 << 16):
        self.measure, self.most, self.found = measure, most, {}

    def __call__(self, own: list[np.ndarray]):
        key = tuple(r.tobytes() for r in own)
        if key not in self.found:
            if len(self.found) >= self.most:
                self.found.clear()
            self.found[key] = self.measure(own)
        return self.found[key]


def polygon_area(rings: Column) -> Column:
    """Area of a polygon whose rings may overlap, cross themselves or be holes (even-odd)."""
    @F.arrow_udf("double")
    def measure(column: pa.Array) -> pa.Array:
        xy, size, row = _rings_of(column)
        e, ring = sweep.all_edges(xy, size)
        return pa.array(sweep.areas(e, np.bincount(row[ring], minlength=len(column))), pa.float64())

    return measure(rings)


def _sides(own: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.hstack([r, np.roll(r, -1, axis=0)]) for r in own]) if own else np.empty((0, 4))


def inner_width(rings: Column, tolerance: float = 0.01) -> Column:
    """Width of the largest circle inside a polygon, at most ``tolerance`` below the true one; 0 for an empty one."""
    @F.arrow_udf("double")
    def measure(column: pa.Array) -> pa.Array:
        return pa.array([2 * inscribed.inner_radius(_sides(own), tolerance / 2) if own else 0.0 for own in _polygons(column)], pa.float64())

    return measure(rings)


def small_or_thin(rings: Column, min_area: float, corridor: float, tolerance: float = 0.01) -> Column:
    """Area below the floor, or no circle wider than the corridor fits (to within ``tolerance``); true for an empty polygon."""
    known = _Known(lambda own: not own or not inscribed.wider_than(_sides(own), corridor, tolerance / 2))

    @F.arrow_udf("boolean")
    def thin(column: pa.Array) -> pa.Array:
        return pa.array([known(own) for own in _polygons(column)], pa.bool_())

    return (polygon_area(rings) < min_area) | thin(rings)


def part_hulls(parts: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """(keys, hull) of multiparts: the hull of each part first, then one of their corners."""
    own = parts.select(*keys, H.convex_hull(F.flatten(F.col(rings))).alias("_h"))
    return own.groupBy(*keys).agg(F.flatten(F.collect_list("_h")).alias("_p")).select(*keys, H.convex_hull("_p").alias("hull"))


def polygon_cover(zones: DataFrame, shapes: DataFrame, cell: float, zone_id: str, zrings: str = "zrings", rings: str = "rings") -> DataFrame:
    """Area and covered share of every zone; a zone without area has the share 0."""
    zones = dealt(zones).withColumn("area", polygon_area(F.col(zrings)))
    c = covered_polygon_area(zones, shapes, cell, zone_id, zrings, rings)
    share = F.when(F.col("area") > 0, F.least(F.coalesce("covered", F.lit(0.0)) / F.col("area"), F.lit(1.0))).otherwise(0.0)
    return zones.join(c, zone_id, "left").select(zone_id, "area", F.coalesce("covered", F.lit(0.0)).alias("covered"), share.alias("fraction"))


def polygon_building_stats(overlaps: DataFrame, buildings: DataFrame, shape_id: str, zone_id: str, value: str) -> DataFrame:
    """Per zone the shapes it meets, their clipped area and the area-weighted mean and the largest of ``value``."""
    d = overlaps.join(buildings.select(shape_id, value), shape_id)
    known, a = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.col("shared_area")
    return d.groupBy(zone_id).agg(F.count(F.lit(1)).alias("n_shapes"), F.sum(a).alias("shape_area"),
                                  (F.sum(F.when(known, a * F.col(value))) / F.sum(F.when(known, a))).alias("mean_value"),
                                  F.max(F.when(known, F.col(value))).alias("max_value"))
