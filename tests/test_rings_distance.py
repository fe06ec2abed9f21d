"""Scan-line filling and distance transforms against pixel by pixel loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonomy.functions import sweep
from zonomy.operators import distance, polygons as P, rings

RINGS = "array<array<struct<x:double,y:double>>>"


def star(r, corners, centre, radius):
    turn = np.sort(r.uniform(0, 2 * np.pi, corners))
    far = radius * r.uniform(0.3, 1, corners)
    return [(float(centre[0] + f * np.cos(t)), float(centre[1] + f * np.sin(t))) for t, f in zip(turn, far)]


def inside(polygon, x, y):
    odd = False
    for ring in polygon:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
            if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
    return odd


@pytest.fixture(scope="module")
def shapes():
    r = np.random.default_rng(8)
    made = [[star(r, int(r.integers(3, 12)), r.uniform(5, 25, 2), 9)] for _ in range(12)]
    made.append([star(r, 20, (15, 15), 12), star(r, 9, (15, 15), 4)])
    made.append([[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(20.0, 0.0), (25.0, 0.0), (25.0, 5.0), (20.0, 5.0)]])
    return made


def masks(shapes, res):
    n = int(40 / res)
    return {k: {(i, j) for i in range(-n, n) for j in range(-n, n) if inside(s, (j + 0.5) * res, (i + 0.5) * res)} for k, s in enumerate(shapes)}


def shrunk(mask, by):
    return {(i, j) for i, j in mask if all((i + a, j + b) in mask for a in range(-by, by + 1) for b in range(-by, by + 1))}


@pytest.mark.parametrize("res", [1.0, 1.7])
def test_runs_are_the_pixels_inside(spark, shapes, res):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)] + [(90, None), (91, []), (92, [[(0.0, 0.0), (5.0, 5.0)]])], f"id int, rings {RINGS}")
    want = masks(shapes, res)
    runs = rings.ring_runs(df, ["id"], res)
    got = {}
    for r in runs.collect():
        cells = {(r["row"], c) for c in range(r["c0"], r["c1"] + 1)}
        assert not cells & got.setdefault(r["id"], set())
        got[r["id"]] |= cells
    assert got == {k: m for k, m in want.items() if m}
    for by in (1, 2):
        got = {}
        for r in rings.eroded_runs(runs, ["id"], by).collect():
            got.setdefault(r["id"], set()).update((r["row"], c) for c in range(r["c0"], r["c1"] + 1))
        assert got == {k: e for k, m in want.items() if (e := shrunk(m, by))}


def test_burning_and_contested_pixels(spark, shapes):
    rows = [(k % 2, k, s, k * 7 % 5, f"v{k % 3}") for k, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"g int, id int, rings {RINGS}, acc int, label string")
    mask = masks(shapes, 1.0)
    best, claims = {}, {}
    for g, k, _, acc, label in rows:
        for at in mask[k]:
            best[(g, *at)] = max(best.get((g, *at), (-1, -1, "")), (acc, k, label))
        for at in shrunk(mask[k], 1):
            claims.setdefault((g, *at), set()).add(label)
    got = {(r["g"], r["row"], r["col"]): r["label"] for r in rings.burn_rings(df, ["g"], 1.0, "id", "label", "acc").collect()}
    assert got == {k: v[2] for k, v in best.items()}
    got = {(r["g"], r["row"], r["col"]): r["label"] for r in rings.burn_rings_uncontested(df, ["g"], 1.0, "id", "label", erode_px=1).collect()}
    assert got == {k: next(iter(v)) for k, v in claims.items() if len(v) == 1}


def test_many_edges_over_many_pixels(spark):
    turn = np.arange(10_000) / 10_000 * 2 * math.pi
    ring = [(float(1800 * math.cos(t)), float(1800 * math.sin(t))) for t in turn]
    df = spark.createDataFrame([(1, [ring])], f"id int, rings {RINGS}")
    r = rings.ring_runs(df, ["id"], 1.0).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"), F.count(F.lit(1)).alias("runs")).first()
    assert r["n"] == pytest.approx(math.pi * 1800 ** 2, rel=1e-4) and r["runs"] <= 3602  # 10^7 pixels as 3,600 runs


def plain_nearest(mask, donors, radius):
    at = np.argwhere(donors)
    out = {}
    for i, j in np.argwhere(~mask):
        d2 = (at[:, 0] - i) ** 2 + (at[:, 1] - j) ** 2
        k = np.lexsort((at[:, 1], at[:, 0], d2))[0] if len(at) else None
        if k is not None and d2[k] <= radius * radius:
            out[int(i), int(j)] = (int(d2[k]), int(at[k, 0]), int(at[k, 1]))
    return out


@pytest.mark.parametrize("tile, radius, apart", [(16, 9.0, False), (32, 50.0, True), (None, 6.5, True), (8, 20.0, False)])
def test_nearest_donors(spark, tile, radius, apart):
    r = np.random.default_rng(6)
    planes = {}
    for g in (0, 1):
        m = r.random((70, 45)) < (0.5 if g else 0.02)
        m[10:60, 5:40] &= r.random((50, 35)) < 0.01
        planes[g] = m
    donors = {g: m & (r.random(m.shape) < 0.4) for g, m in planes.items()}
    rows = lambda d: [(g, int(i), int(j), int(i * 100 + j)) for g, m in d.items() for i, j in np.argwhere(m)]
    px = spark.createDataFrame(rows(planes), "g int, row int, col int, class int")
    given = spark.createDataFrame(rows(donors), "g int, row int, col int, class int") if apart else None
    got = {(x["g"], x["row"], x["col"]): (x["d2"], x["drow"], x["dcol"]) for x in distance.nearest_donors(px, ["g"], "g int", radius, 70, 45, given, tile).collect()}
    want = {(g, *k): v for g, m in planes.items() for k, v in plain_nearest(m, donors[g] if apart else m, radius).items()}
    assert got == want
    filled = {(x["g"], x["row"], x["col"]): x["class"] for x in distance.fill_far(px, ["g"], "g int", radius, 70, 45, donors=given, tile=tile).collect()}
    assert filled == {(g, i, j): c for g, i, j, c in rows(planes)} | {k: v[1] * 100 + v[2] for k, v in want.items()}


def test_a_hole_as_wide_as_a_large_radius(spark):
    n = 420
    edge = [(i, j) for i in range(n) for j in range(n) if i in (0, n - 1) or j in (0, n - 1)]
    px = spark.createDataFrame(edge, "row int, col int")
    got = distance.nearest_donors(px, [], "", 210.0, n, n).agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("d2"), F.sum("d2").alias("s")).first()
    i, j = np.mgrid[1:n - 1, 1:n - 1]
    d = np.minimum(np.minimum(i, n - 1 - i), np.minimum(j, n - 1 - j)).astype(np.int64)
    assert (got["n"], got["d2"], got["s"]) == ((n - 2) ** 2, int(d.max()) ** 2, int((d * d).sum()))


def test_small_polygons_are_measured_together():
    rng = np.random.default_rng(3)
    rings = [np.round(rng.uniform(-90, 90, (1, 2)) + rng.uniform(-60, 60, (rng.integers(3, 9), 2)), int(rng.integers(0, 4))) for _ in range(150)]
    size, xy = np.array([len(r) for r in rings]), np.concatenate(rings)
    ring, at, points, n = sweep.cut_all_to_cells(xy, size, 64.0)
    parts = {(int(r), int(x), int(y)): p for r, (x, y), p in zip(ring, at, np.split(points, np.cumsum(n)[:-1]))}
    one_by_one = {(i, x, y): p for i, r in enumerate(rings) for x, y, p in sweep.cut_to_cells(r, 64.0)}
    assert parts.keys() == one_by_one.keys() and all(np.array_equal(parts[k], p) for k, p in one_by_one.items())
    e, own = sweep.all_edges(xy, size)
    n = np.bincount(own, minlength=len(rings))
    start = np.cumsum(n) - n
    assert np.allclose(sweep.areas(e, n), [sweep.area(sweep.ring_edges(r)) for r in rings], atol=1e-8)
    i, j = rng.integers(0, 150, (2, 1500))
    want = [sweep.shared_area(sweep.ring_edges(rings[a]), sweep.ring_edges(rings[b])) for a, b in zip(i, j)]
    assert np.count_nonzero(want) > 200 and np.allclose(sweep.shared_areas(e, start[i], n[i], e, start[j], n[j]), want, atol=1e-8)


def test_polygons_of_a_small_file_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_POLYGONS", 10)
    d = spark.range(50, numPartitions=1).select("id", F.expr(f"cast(array(array(struct(double(id), 0D), struct(id + 3D, 0D), struct(id + 1D, 2D))) AS {RINGS})").alias("rings"))
    assert P.cell_edges(d, "rings", 4.0, ("id",)).rdd.getNumPartitions() == 5


def test_burning_takes_as_many_tasks_as_pixels_ask_for(spark, monkeypatch):
    from zonomy.functions import geometry as G
    from zonomy.operators import pixels as X
    monkeypatch.setattr(X, "TASK_PIXELS", 1_000)
    s = spark.range(20, numPartitions=1).select((F.col("id") % 3).alias("band"), "id", G.box(F.col("id") * 10.0, F.lit(0.0), F.col("id") * 10.0 + 200, F.lit(200.0)).alias("box"))
    for d in (X.burn(s, [], 10.0, "band", F.col("id")), X.burn_uncontested(s, [], 10.0, "band", F.col("id")), X.evidence_bands(s, [], 10.0)):
        assert d.rdd.getNumPartitions() == 8
    e = X.evidence_bands(s, [], 10.0, building_bands=(1,))
    one = e.where("row = 0 and col = 1").head()
    assert (one.bands, one.band, one.building) == ([0, 1], 1, True) and e.count() == 20 * 39


def test_turned_shapes_of_a_small_file_are_dealt_out(spark, monkeypatch):
    from zonomy.functions import hull as H
    monkeypatch.setattr(P, "TASK_POLYGONS", 10)
    assert P.dealt(spark.range(50, numPartitions=1)).rdd.getNumPartitions() == 5
    points = np.random.default_rng(5).integers(-9, 9, (60, 2)).astype(float)
    few = H.hull_of(points)
    monkeypatch.setattr(H, "FEW", 0)
    assert np.array_equal(few, H.hull_of(points)) and len(few) > 3
    assert H.rectangle_of(H.hull_of(points[:1])) == (0.0, 0.0)
