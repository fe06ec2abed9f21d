"""Polygon overlay, pivot neighbours, summed-area tables: against brute force on odd inputs."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonomy.functions import geometry as G, hull as H, inscribed, sweep
from zonomy.operators import neighbours, pivots, polygons, prefix, spatial

RINGS = "array<array<struct<x:double,y:double>>>"


def star(r, corners, centre, radius):
    turn = np.sort(r.uniform(0, 2 * np.pi, corners))
    far = radius * r.uniform(0.3, 1, corners)
    return np.stack([centre[0] + far * np.cos(turn), centre[1] + far * np.sin(turn)], axis=1)


def crossings(rings, y):
    """Sorted x at which a horizontal line enters or leaves a polygon."""
    out = []
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0)):
            if (y0 <= y) != (y1 <= y):
                out.append(x0 + (x1 - x0) * (y - y0) / (y1 - y0))
    return sorted(out)


def intervals(polygon, y):
    x = crossings(polygon, y)
    return list(zip(x[::2], x[1::2]))


def merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def lined_area(zone, shapes, lines=700, low=0.0, high=12.0):
    """Area of the union of the shapes in the zone from many horizontal lines."""
    total, step = 0.0, (high - low) / lines
    for k in range(lines):
        y = low + (k + 0.5) * step
        union = merged([i for s in shapes for i in intervals(s, y)])
        total += step * sum(max(0.0, min(b, d) - max(a, c)) for a, b in intervals(zone, y) for c, d in union)
    return total


def as_rings(polygon):
    return [[(float(x), float(y)) for x, y in ring] for ring in polygon]


@pytest.fixture(scope="module")
def scene():
    r = np.random.default_rng(4)
    zones = [[star(r, 9, (4, 4), 3.5)], [star(r, 7, (7, 6), 4)], [star(r, 30, (6, 6), 5), star(r, 8, (6, 6), 2)], [star(r, 5, (30, 30), 1)]]
    shapes = [[star(r, int(r.integers(3, 14)), r.uniform(2, 9, 2), 2.5)] for _ in range(14)]
    shapes.append([star(r, 12, (5, 5), 4), star(r, 6, (5, 5), 1.2)])  # with a hole
    shapes += shapes[:3]  # repeated shapes
    return zones, shapes


@pytest.mark.parametrize("cell, hot, edges", [(1.0, 2000, 1200), (50.0, 2000, 20), (2.5, 3, 30)])
def test_union_in_zones(spark, monkeypatch, scene, cell, hot, edges):
    monkeypatch.setattr(polygons, "EDGES", edges)
    zones, shapes = scene
    z = spark.createDataFrame([(k, as_rings(p)) for k, p in enumerate(zones)] + [(9, None), (10, [])], f"zone_id int, zrings {RINGS}")
    odd = [(k % 2, as_rings(p)) for k, p in enumerate(shapes)] + [(0, None), (1, [[(1.0, 1.0), (2.0, 2.0)]]), (0, [[(1.0, 1.0), (2.0, math.nan), (0.0, 5.0)]])]
    s = spark.createDataFrame(odd, f"kind int, rings {RINGS}")
    got = {(r["zone_id"], r["kind"]): r["covered"] for r in polygons.covered_polygon_area(z, s, cell, "zone_id", keys=("kind",), hot_shapes=hot).collect()}
    for k, zone in enumerate(zones):
        for kind in (0, 1):
            assert got.get((k, kind), 0.0) == pytest.approx(lined_area(zone, shapes[kind::2]), rel=1e-2, abs=1e-2)
    assert (3, 0) not in got and not any(k in (9, 10) for k, _ in got)


def test_cells_move_no_area(spark, scene):
    zones, shapes = scene
    z = spark.createDataFrame([(k, as_rings(p)) for k, p in enumerate(zones)], f"zone_id int, zrings {RINGS}")
    s = spark.createDataFrame([(as_rings(p),) for p in shapes], f"rings {RINGS}")
    runs = [{r["zone_id"]: r["fraction"] for r in polygons.polygon_cover(z, s, cell, "zone_id").collect()} for cell in (0.7, 3.0, 100.0)]
    for other in runs[1:]:
        assert other == pytest.approx(runs[0], rel=1e-9, abs=1e-12)
    assert runs[0][3] == 0.0


@pytest.mark.parametrize("few", [0, 3, 64])
def test_few_shapes_of_a_cell_need_no_union(spark, scene, few):
    zones, shapes = scene
    z = spark.createDataFrame([(k, as_rings(p)) for k, p in enumerate(zones)], f"zone_id int, zrings {RINGS}")
    s = spark.createDataFrame([(None if k % 3 else k % 2, as_rings(p)) for k, p in enumerate(shapes)], f"kind int, rings {RINGS}")
    got = {(r["zone_id"], r["kind"]): r["covered"] for r in polygons.covered_polygon_area(z, s, 2.5, "zone_id", keys=("kind",), few_shapes=few).collect()}
    for k, zone in enumerate(zones):
        for kind in (None, 0, 1):
            own = [p for i, p in enumerate(shapes) if (None if i % 3 else i % 2) == kind]
            assert got.get((k, kind), 0.0) == pytest.approx(lined_area(zone, own), rel=1e-2, abs=1e-2)


def test_cover_of_many_zones_at_once():
    r = np.random.default_rng(12)
    zones = [sweep.ring_edges(star(r, int(r.integers(3, 9)), r.uniform(2, 4, 2), 2)) for _ in range(40)] + [np.empty((0, 4))]
    owned = [[sweep.ring_edges(star(r, int(r.integers(3, 9)), r.uniform(1, 5, 2), 1.5)) for _ in range(k % 13)] for k in range(41)]  # past SHORT edges, too
    edges = [(e, k, i + 1) for k, own in enumerate(owned) for i, e in enumerate(own)]
    b, row, shape = np.concatenate([e for e, _, _ in edges]), *(np.repeat([x[i] for x in edges], [len(x[0]) for x in edges]) for i in (1, 2))
    got = sweep.covered_areas(np.concatenate(zones), np.array(list(map(len, zones))), b, row, shape)
    for k, (zone, own) in enumerate(zip(zones, owned)):
        union = sweep.union_edges(np.concatenate(own), np.repeat(np.arange(len(own)), list(map(len, own)))) if own else np.empty((0, 4))
        assert got[k] == pytest.approx(sweep.shared_area(zone, union), rel=1e-9, abs=1e-12)


def test_shared_areas_of_pairs(spark, scene):
    zones, shapes = scene
    z = spark.createDataFrame([(k, as_rings(p)) for k, p in enumerate(zones)], f"zone_id int, zrings {RINGS}")
    s = spark.createDataFrame([(k, as_rings(p), float(k)) for k, p in enumerate(shapes)], f"sid int, rings {RINGS}, height double")
    pairs = polygons.polygon_overlaps(z, s, 1.5, "zone_id", "sid")
    got = {(r["zone_id"], r["sid"]): r["shared_area"] for r in pairs.collect()}
    for k, zone in enumerate(zones):
        for j, shape in enumerate(shapes):
            assert got.get((k, j), 0.0) == pytest.approx(lined_area(zone, [shape], 500), rel=2e-2, abs=2e-2)
    stats = {r["zone_id"]: r for r in polygons.polygon_building_stats(pairs, s, "sid", "zone_id", "height").collect()}
    own = {j: a for (k, j), a in got.items() if k == 0}
    assert stats[0]["n_shapes"] == len(own) and stats[0]["mean_value"] == pytest.approx(sum(j * a for j, a in own.items()) / sum(own.values()))


def test_sweep_of_grids_and_touching_shapes():
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    shapes = [box(0, 0, 2, 2), box(2, 0, 1, 2), box(1, 1, 3, 3), box(1, 1, 3, 3), box(10, 10, 1, 1)]
    edges = [sweep.ring_edges(s) for s in shapes]
    union = sweep.union_edges(np.concatenate(edges), np.repeat(np.arange(5), [len(e) for e in edges]))
    assert sweep.area(union) == pytest.approx(6 + 9 - 2 + 1) and len(union) <= 10
    assert sweep.shared_area(union, sweep.ring_edges(box(-5, -5, 8, 8))) == pytest.approx(6 + 4 - 2)
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)  # crosses itself
    assert sweep.area(sweep.ring_edges(bow)) == pytest.approx(2.0)
    assert len(sweep.union_edges(np.empty((0, 4)), np.empty(0, int))) == 0 and sweep.area(np.empty((0, 4))) == 0


# -- neighbours --------------------------------------------------------------------------------------------------------

def clustered(r, n, dims, centres):
    c = r.normal(size=(centres, dims))
    return c[np.arange(n) % centres] + r.normal(size=(n, dims)) * 0.05


@pytest.mark.parametrize("block, exclude", [(40, True), (40, False), (7, True)])
def test_pivot_rounds_give_the_neighbours_of_all_blocks(spark, block, exclude):
    r = np.random.default_rng(9)
    v = clustered(r, 400, 5, 9)
    v[5] = 0
    v[6:12] = v[6]  # ties
    df = spark.createDataFrame([(int(k), [float(c) for c in x]) for k, x in enumerate(v)], "id long, v array<double>")
    q = df.where("id % 3 = 0")
    key = lambda rows: sorted((x["id"], x["nn"], x["ref"], x["dist"]) for x in rows)
    assert key(neighbours.knn(q, df, 6, exclude_self=exclude, block=block).collect()) == key(neighbours.knn(q, df, 6, exclude_self=exclude).collect())


def test_few_blocks_are_visited_on_clustered_rows(spark):
    r = np.random.default_rng(2)
    v = clustered(r, 4000, 8, 80)
    df = spark.createDataFrame([(int(k), [float(c) for c in x]) for k, x in enumerate(v)], "id long, v array<double>")
    pairs, seen = pivots.search(df, df, 5, "id", "v", True, 32, 4000)
    assert seen["visited"] < 0.1 * seen["pairs"]
    assert pivots.top_pairs(pairs, 5).count() == 20_000


def bundle(v, places, ids):
    packed = pa.array([x.astype("<f4").tobytes() for x in v], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(ids), packed], names=["place", "id", "v"])


def asking(v, bits, ids, kth):
    packed = pa.array([x.astype("<f4").tobytes() for x in v], pa.binary())
    flags = pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids), packed, flags, pa.array(kth, pa.float64())], names=["id", "v", "bits", "kth"])


def distances(v, w):
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    return np.round(1 - unit(v.astype(np.float32).astype(float)) @ unit(w.astype(np.float32).astype(float)).T, 9)


def test_a_known_distance_spares_most_measurements():
    r = np.random.default_rng(4)
    v, w, k = r.normal(size=(300, 24)), r.normal(size=(5000, 24)), 5
    d = distances(v, w)
    kth = np.sort(d[:, :500], axis=1)[:, k - 1]  # what a round before has found
    refs = pivots._Refs([bundle(w, np.arange(5000) // 700, np.arange(5000))], "<f4", False)
    queries = pivots._Queries(refs, asking(v, np.ones((300, 8), bool), np.arange(300), kth), k, "<f4")
    measured, add = [], queries.add
    queries.add = lambda row, at, dist: (measured.append(len(row)), add(row, at, dist))
    got = queries.found().to_pydict()
    best = np.argsort(d, axis=1, kind="stable")[:, :k]
    want = {(i, int(j)) for i in range(300) for j in best[i] if d[i, j] <= kth[i]}
    assert set(zip(got["q"], got["r"])) == want
    assert sum(measured) < 0.05 * d.size


@pytest.mark.parametrize("known", [True, False])
def test_equal_references_and_unwanted_blocks(known):
    r = np.random.default_rng(5)
    w = np.repeat(r.normal(size=(30, 6)), 100, axis=0)[r.permutation(3000)]
    w[::7] = 0
    ids, places, k = r.permutation(3000), np.sort(np.arange(3000) % 60), 4
    bits = r.random((400, 60)) < 0.5
    own = r.integers(0, 3000, 400)  # queries are some of the references
    v = w[own]
    d = np.where(bits[:, places], distances(v, w), np.inf)
    d[np.arange(400), own] = np.inf
    refs = pivots._Refs([bundle(w, places, ids)], "<f4", True)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
    kth = np.take_along_axis(d, order, axis=1)[:, -1]
    got = pivots._Queries(refs, asking(v, bits, ids[own], kth if known else [None] * 400), k, "<f4").found().to_pydict()
    want = {(int(ids[own[i]]), int(ids[j])) for i in range(400) for j in order[i] if d[i, j] < np.inf}
    assert set(zip(got["q"], got["r"])) == want


@pytest.mark.parametrize("step", [0, 3, None])
def test_blocks_of_a_round_are_chosen_by_their_bounds(step):
    r = np.random.default_rng(7)
    pivots_, v = pivots._units(r.normal(size=(20, 5))), r.normal(size=(200, 5))
    low = r.uniform(0, 0.6, 180)
    rows = [{"b": i, "p": i // 9, "low": low[i], "high": low[i] + 0.1, "n": int(r.integers(1, 4))} for i in range(180)]
    blocks = pivots.Blocks(pivots_, rows, 40)
    had = [sorted(r.choice(180, 4, replace=False).tolist()) if step != 0 else [] for _ in range(200)]
    kth = np.where(r.random(200) < 0.2, np.nan, r.uniform(0, 0.3, 200))
    packed = pa.array([x.astype("<f8").tobytes() for x in v], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), packed, pa.array(kth, from_pandas=True), pa.array(had, pa.list_(pa.int32())), pa.array([len(h) for h in had])], names=["q", "v", "kth", "had", "seen"])
    out = pa.Table.from_batches(pivots._wanted(blocks, 30, step, "long", "<f8")[0](iter([batch]))).to_pylist()
    angle = np.arccos(np.clip(pivots._units(v) @ pivots_.T, -1, 1))
    for i, row in enumerate(out):
        gap = np.array([max(angle[i, b["p"]] - b["high"], b["low"] - angle[i, b["p"]]) for b in rows])
        least = 1 - np.cos(np.clip(gap, 0, np.pi / 2))
        ahead = [int(b) for b in np.argsort(gap, kind="stable") if b not in had[i]]
        want = [b for b in ahead if np.isnan(kth[i]) or least[b] <= kth[i]]
        if step == 0:
            want = ahead[:1 + int(np.searchsorted(np.cumsum(blocks.n[ahead]), 30))]
        elif step:
            want = [b for b in ahead[:step] if b in want]
        got = set()
        for ask in row["asked"]:
            first, last = next((a, z) for a, z, bundle, subs in blocks.runs if bundle <= ask["bundle"] < bundle + subs)
            got |= {first + int(j) for j in np.flatnonzero(np.unpackbits(np.frombuffer(ask["bits"], np.uint8))[:last - first])}
        assert got == set(want) and row["seen"] == len(had[i]) + len(want)
        assert step is None or sorted(row["had"]) == sorted(had[i] + want)


@pytest.mark.parametrize("scale", [1.0, 1 / 3])
def test_vectors_travel_as_short_as_they_can(spark, scale):
    """Thirds need double precision; halves and tenths of an image do not lose a bit in single precision."""
    r = np.random.default_rng(6)
    v = r.integers(-9, 9, (300, 6)) * scale
    df = spark.createDataFrame([(int(k), [float(c) for c in x]) for k, x in enumerate(v)], "id long, v array<double>")
    assert df.agg(F.min(pivots._single("v"))).first()[0] == (scale == 1)
    key = lambda rows: sorted((x["id"], x["nn"], x["ref"], x["dist"]) for x in rows)
    assert key(neighbours.knn(df, df, 6, exclude_self=True, block=50).collect()) == key(neighbours.knn(df, df, 6, exclude_self=True).collect())


def test_queries_that_need_double_precision_keep_it(spark):
    """References alone would travel in single precision, in which a third is another number."""
    r = np.random.default_rng(10)
    v = r.integers(-9, 9, (120, 6)).astype(float)
    df = spark.createDataFrame([(int(k), [float(c) for c in x]) for k, x in enumerate(v)], "id long, v array<double>")
    q = spark.createDataFrame([(int(k), [float(c) / 3 + 1e-8 for c in x]) for k, x in enumerate(v[:40])], "id long, v array<double>")
    pairs, _ = pivots.search(q, df, 4, "id", "v", False, 30, 120)
    unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = np.round(1 - unit(v[:40] / 3 + 1e-8) @ unit(v).T, 9)
    got = {(x["q"], x["r"]): x["dist"] for x in pairs.collect()}
    assert len(got) == 160 and all(x == pytest.approx(d[i, j], abs=2e-9) for (i, j), x in got.items())
    kept = [sorted(d[i, j] for a, j in got if a == i) for i in range(40)]
    assert np.allclose(kept, np.sort(d, axis=1)[:, :4], atol=2e-9)


def test_tasks_of_a_round_grow_with_its_queries(spark):
    """A partition for every group of queries that meets a bundle, and none beside these."""
    slots = pivots._slots(spark, 7)
    at = spark.createDataFrame([(s,) for s in slots], "slot long").repartition(7, "slot").select(F.spark_partition_id()).collect()
    assert sorted(r[0] for r in at) == list(range(7))
    wanted = spark.createDataFrame([(k, b"", None, [(0, b"\x80"), (1, b"\x80")]) for k in range(50)], "q long, v binary, kth double, asked array<struct<bundle:long,bits:binary>>")
    placed = spark.createDataFrame([(0, 0, 1, b""), (1, 0, 2, b"")], "bundle long, place int, r long, v binary")
    assert pivots._visit(wanted, placed, 2, 3, True, "long", "<f4").rdd.getNumPartitions() == 2


def test_fewer_references_than_neighbours(spark):
    df = spark.createDataFrame([(k, [float(k + 1), 1.0]) for k in range(6)], "id long, v array<double>")
    assert neighbours.knn(df, df, 9, exclude_self=True, block=2).count() == 30


# -- summed-area tables ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("tile", [4, 16, 64])
def test_rectangles(spark, tile):
    r = np.random.default_rng(3)
    planes = {g: np.where(r.random((40, 55)) < 0.6, r.integers(-5, 9, (40, 55)), 0) for g in (0, 1)}
    rows = [(g, int(i), int(j), int(p[i, j])) for g, p in planes.items() for i, j in zip(*np.nonzero(p))]
    px = spark.createDataFrame(rows, "g int, row long, col long, v int")
    windows = []
    for k in range(60):
        a, b = sorted(int(x) for x in r.integers(-3, 44, 2))
        c, d = sorted(int(x) for x in r.integers(-3, 60, 2))
        windows.append((k, k % 2, a, b, c, d))
    windows += [(60, 0, 5, 4, 0, 9), (61, 7, 0, 9, 0, 9), (62, 0, -200, 300, -200, 300), (63, 1, 30, 30, 30, 30), (63, 1, 30, 30, 30, 30)]
    w = spark.createDataFrame(windows, "k int, g int, r0 int, r1 int, c0 int, c1 int")
    got = {x["k"]: (x["n"], x["s"]) for x in prefix.window_sums(px, w, ["g"], "k", {"n": F.lit(1), "s": F.col("v")}, tile).collect()}
    want = {}
    for k, g, a, b, c, d in windows:
        part = planes.get(g, np.zeros((1, 1), int))[max(a, 0):b + 1, max(c, 0):d + 1] if b >= a and b >= 0 and d >= 0 else np.zeros((0, 0), int)
        n, s = want.get(k, (0, 0))
        want[k] = (n + int((part != 0).sum()), s + int(part.sum()))
    assert got == want


def test_moments_have_no_cancellation(spark):
    px = spark.createDataFrame([(k, 0, 1_000_000_007) for k in range(100)], "row long, col long, v long")
    w = spark.createDataFrame([(1, 10, 19, 0, 0), (2, 500, 510, 0, 0)], "k int, r0 int, r1 int, c0 int, c1 int")
    got = {r["k"]: r for r in prefix.window_moments(px, w, [], "k", "v", 5.0, tile=8).collect()}
    assert (got[1]["n_pixels"], got[1]["mean"], got[1]["std"], got[1]["share_above"]) == (10, 1_000_000_007.0, 0.0, 1.0)
    assert got[2]["n_pixels"] == 0 and got[2]["mean"] is None


# -- hulls and widths --------------------------------------------------------------------------------------------------

def plain_hull(points):
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def test_hulls_and_rectangles(spark):
    r = np.random.default_rng(1)
    sets = [[tuple(map(float, p)) for p in r.integers(0, 8, (int(n), 2))] for n in r.integers(0, 40, 40)] + [[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], [(1.0, 1.0)] * 3]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)] + [(99, [(0.0, 0.0), (None, 1.0), (math.inf, 2.0), (3.0, 4.0)])], "id int, p array<struct<x:double,y:double>>")
    got = {x["id"]: x for x in df.select("id", H.convex_hull("p").alias("hull"), H.smallest_rectangle("p").alias("r"), H.elongation_of(H.smallest_rectangle("p")).alias("e")).collect()}
    for k, s in enumerate(sets):
        want = plain_hull(s)
        assert [tuple(p) for p in got[k]["hull"]] == want
        if len(want) > 2:
            areas = []
            for (x0, y0), (x1, y1) in zip(want, want[1:] + want[:1]):
                u = np.array([x1 - x0, y1 - y0]) / math.hypot(x1 - x0, y1 - y0)
                q = np.array(want) @ np.stack([u, [-u[1], u[0]]], axis=1)
                areas.append(np.prod(np.ptp(q, axis=0)))
            assert got[k]["r"]["long"] * got[k]["r"]["short"] == pytest.approx(min(areas))
    assert (got[99]["r"]["long"], got[99]["r"]["short"], got[99]["e"]) == (5.0, 0.0, 1.0) and got[41]["e"] == 0.0


def test_inner_widths_against_a_fine_grid(spark):
    r = np.random.default_rng(5)
    c_shape = [[(0.0, 0.0), (30.0, 0.0), (30.0, 6.0), (8.0, 6.0), (8.0, 20.0), (30.0, 20.0), (30.0, 25.0), (0.0, 25.0)]]
    shapes = [c_shape, *[as_rings([star(r, 9, (15, 12), 12)]) for _ in range(4)], as_rings([star(r, 30, (15, 12), 12), star(r, 8, (15, 12), 3)])]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)] + [(90, []), (91, None)], f"id int, rings {RINGS}")
    got = {x["id"]: x for x in df.select("id", polygons.inner_width(F.col("rings"), 0.01).alias("w"), polygons.small_or_thin(F.col("rings"), 1.0, 8.5).alias("thin")).collect()}
    at = np.stack(np.meshgrid(np.linspace(0, 30, 301), np.linspace(0, 25, 251)), axis=-1).reshape(-1, 2)
    for k, s in enumerate(shapes):
        sides = np.concatenate([np.hstack([np.array(q), np.roll(np.array(q), -1, axis=0)]) for q in s])
        want = 2 * inscribed.signed_distance(sides, at).max()
        assert want - 1e-9 <= got[k]["w"] + 0.01 and got[k]["w"] <= want + 0.15
        assert got[k]["thin"] == (got[k]["w"] <= 8.5)
    assert got[90]["w"] == got[91]["w"] == 0.0 and got[90]["thin"] and got[91]["thin"]
    assert got[0]["w"] == pytest.approx(2 * (8 + 6 - math.sqrt(2 * 8 * 6)), abs=0.011)


def test_unions_of_shapes_that_share_corners_and_sides():
    r = np.random.default_rng(0)
    for t in range(60):
        shapes = [np.round(r.uniform(0, 6, (3, 2)) * 4) / 4 + (5e6 if t % 2 else 0) for _ in range(int(r.integers(2, 12)))]
        cells = {}
        for s in shapes:
            for x, y, part in sweep.cut_to_cells(s, 1.7):
                cells.setdefault((x, y), []).append(sweep.ring_edges(part))
        union = lambda parts: sweep.area(sweep.union_edges(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])))
        assert sum(map(union, cells.values())) == pytest.approx(union([sweep.ring_edges(s) for s in shapes]), abs=1e-5)


def test_box_join_has_more_tasks_for_more_cells_and_no_broadcast(spark, monkeypatch):
    """A few boxes over many cells: neither exploded side goes to every task, and tasks do not grow with the cells."""
    monkeypatch.setattr(spatial, "TASK_ROWS", 20)
    ids = spark.range(12)
    box = lambda n, far: G.box(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + far, F.lit(9.0)).alias(n)
    j = spatial.box_join(ids.select(F.col("id").alias("l"), box("lbox", 45.0)), ids.select(F.col("id").alias("r"), box("rbox", 5.0)), 5.0)
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and j.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, j.select("l", "r").collect())) == [(a, b) for a in range(12) for b in range(a, min(a + 5, 12))]


def test_queries_go_to_bundles_of_blocks(spark):
    """Blocks of random rows cannot be told apart, so every query meets all of them; it is sent to a few bundles, not to every block."""
    v = np.random.default_rng(4).normal(size=(1500, 32))
    blocks = pivots.Blocks(pivots._units(v[:50]), [{"b": 64 * k, "p": k, "low": 0.0, "high": 3.0, "n": 30} for k in range(49)] + [{"b": 64 * 49, "p": 49, "low": 0.0, "high": 3.0, "n": 900}], 400)
    asked = blocks.asked(np.ones((3, 50), bool)).to_pylist()
    assert blocks.bundles == 7 and [len(a) for a in asked] == [7, 7, 7]
    assert [a["bundle"] for a in asked[0]] == list(range(7)) and sum(bin(int.from_bytes(a["bits"])).count("1") for a in asked[0]) == 49 + 3


def test_ring_adjacency_meets_only_near_edges_of_a_line(spark):
    """A long row of squares shares two lines: pairs that are tried grow with the squares, not with their square."""
    n = 400
    rows = spark.range(n).select(F.col("id").alias("block_id"), G.ring_of(G.box(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + 10, F.lit(10.0))).alias("ring"))
    long = spark.createDataFrame([(n,)], "block_id long").select("block_id", G.ring_of(G.box(F.lit(-5.0), F.lit(-7.0), F.lit(10.0 * n + 5), F.lit(0.0))).alias("ring"))
    d = spatial.ring_adjacency(rows.union(long))
    got = {(r["block_a"], r["block_b"]): r["shared_len_m"] for r in d.collect()}
    assert len(got) == 2 * n - 1 and set(got.values()) == {10.0} and all(b in (a + 1, n) for a, b in got)
    assert "_s#" in d._jdf.queryExecution().optimizedPlan().toString()


def test_equal_polygons_are_measured_once():
    seen = []
    known = polygons._Known(lambda own: seen.append(1) or len(own), most=2)
    a, b, c = ([np.full((3, 2), float(k))] for k in range(3))
    assert [known(p) for p in (a, a, b, a, [*a, *b])] == [1, 1, 1, 1, 2] and len(seen) == 3
    assert known(c) == 1 and len(known.found) <= 2


def test_rectangle_sums_broadcast_no_windows(spark, tmp_path):
    """A small file of windows holds four corners each: Spark's size of it does not tell, so no join may broadcast."""
    spark.range(300).write.parquet(str(tmp_path / "w"))
    w = spark.read.parquet(str(tmp_path / "w")).select(F.col("id").alias("k"), F.col("id").alias("r0"), (F.col("id") + 4).alias("r1"), F.lit(0).alias("c0"), F.lit(9).alias("c1"))
    px = spark.range(400).select((F.col("id") % 40).alias("row"), F.floor(F.col("id") / 40).alias("col"))
    d = prefix.window_sums(px, w, [], "k", {"n": F.lit(1)}, tile=8)
    got = {x["k"]: int(x["n"]) for x in d.collect()}
    assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
    assert got == {k: 10 * max(0, min(40, k + 5) - k) if k < 40 else 0 for k in range(300)}


def test_covered_squares_broadcast_nothing_and_are_dealt_out_once(spark, tmp_path, monkeypatch):
    """Squares and covers of a small file of shapes may be many: no side goes to every task, and tasks grow with the cells touched."""
    from zonomy.operators import patches
    monkeypatch.setattr(spatial, "TASK_ROWS", 20)
    spark.range(40).write.parquet(str(tmp_path / "s"))
    x = (F.col("id") * 10).cast("double")
    s = spark.read.parquet(str(tmp_path / "s")).select(F.col("id").alias("shape_id"), F.lit(1).alias("class"), F.lit(1.0).alias("weight"), F.lit(True).alias("qc_pass"),
                                                       G.box(x, F.lit(0.0), x + 8, F.lit(9.0)).alias("box"))
    d = patches.relaxed_squares(s, 10.0, 16.0)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    got = {(r["ix"], r["iy"], r["shape_id"]): round(r["dominant_frac"], 6) for r in d.collect()}
    assert got == {(k, 0, k): 0.72 for k in range(40)}
    z = s.select(F.col("shape_id").alias("z"), F.col("box").alias("lbox"))
    c = spatial.covered_area(z, s.select(F.col("box").alias("rbox")), 16.0, "z")
    assert "REPARTITION_BY_NUM" in c._jdf.queryExecution().executedPlan().toString() and {r["covered"] for r in c.collect()} == {72.0}


def test_long_chains_take_few_steps(spark, monkeypatch):
    """Tasks tie their own edges before the rounds: a chain of a thousand nodes is settled in few steps, by numbers and by names."""
    from zonomy.operators import graph
    steps, plain = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda d: steps.append(1) or plain(d))
    chain = [(k, k + 1) for k in range(1000) if k != 600] + [(2000, 2001), (1500, 1500)]
    for rows, most in ((10_000, 4), (400, 14)):
        monkeypatch.setattr(graph, "TASK_ROWS", rows)
        for name in (int, lambda k: f"n{k:05d}"):
            steps.clear()
            d = spark.createDataFrame([(name(a), name(b)) for a, b in reversed(chain)], f"block_a {'int' if name is int else 'string'}, block_b {'int' if name is int else 'string'}")
            got = {r["node"]: r["component"] for r in graph.connected_components(d).collect()}
            want = {name(k): name(0 if k <= 600 else 601) for k in range(1001)} | {name(2000): name(2000), name(2001): name(2000)}
            assert got == want and len(steps) <= most
    r = np.random.default_rng(3)
    lo, hi = r.integers(0, 400, (2, 300))
    ids, roots = graph.local_roots(lo, hi)
    assert all(dict(zip(ids, roots))[a] == dict(zip(ids, roots))[b] for a, b in zip(lo, hi)) and all(a >= b for a, b in zip(ids, roots))


def test_nearest_deals_points_out(spark, monkeypatch):
    monkeypatch.setattr(spatial, "NEAREST_POINTS", 500)
    points = spark.range(4000).select(F.col("id").alias("pid"), (F.col("id") * 37 % 900).cast("double").alias("x"), (F.col("id") * 53 % 700).cast("double").alias("y"))
    sites = spark.range(25).select(F.col("id").alias("sid"), (F.col("id") % 5 * 200).cast("double").alias("sx"), (F.floor(F.col("id") / 5) * 170).cast("double").alias("sy"))
    near = spatial.nearest(points, sites, "pid", "sid", 100.0, 900.0)
    near.collect()
    assert near._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(pid") and "REPARTITION_BY_NUM" in near._jdf.queryExecution().executedPlan().toString()
    got = {r["pid"]: (r["sid"], r["dist"]) for r in near.collect()}
    own = [(r["sid"], r["sx"], r["sy"]) for r in sites.collect()]
    for r in points.collect():
        dist, sid = min((math.hypot(r["x"] - sx, r["y"] - sy), sid) for sid, sx, sy in own)
        assert got[r["pid"]] == (sid, pytest.approx(dist))
