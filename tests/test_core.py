"""Operators against brute force on small fixtures, including skewed ones."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonomy.functions import geometry as G
from zonomy.functions import vectors as V
from zonomy.functions.similarity import trait_similarity, validate
from zonomy.operators import confusion as C
from zonomy.operators import ensemble as E
from zonomy.operators import graph as N
from zonomy.operators import manifest as M
from zonomy.operators import models as ML
from zonomy.operators import neighbours as K
from zonomy.operators import ordered as O
from zonomy.operators import pixels as X
from zonomy.operators import spatial as S
from zonomy.operators import splits as P
from zonomy.operators import vectors as W
from zonomy.operators import votes as VO
from zonomy.plans import QUERIES
from zonomy.session import stored


# ── ordered ──────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(1)
    rows = [("hot", r.choice([0.0, 1.0, r.random()]), i) for i in range(4000)]
    rows += [(f"g{i % 50}", r.random(), 4000 + i) for i in range(500)] + [("nulls", None, 9000), ("one", 2.5, 9001)]
    return rows, spark.createDataFrame(rows, "g string, x double, id int")


def test_rank_matches_sorting(skewed):
    rows, df = skewed
    got = {r["id"]: r["rank"] for r in O.with_rank(df, ["g"], F.col("x"), [F.col("id")]).collect()}
    for g in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in part] == list(range(1, len(part) + 1))


def test_quantiles_match_numpy(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in O.exact_quantiles(df, ["g"], F.col("x"), {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for g in {r[0] for r in rows} - {"nulls"}:
        v = [r[1] for r in rows if r[0] == g]
        assert [got[g][c] for c in "abc"] == pytest.approx(np.quantile(v, [0.1, 0.5, 0.99]).tolist())
    assert "nulls" not in got


def test_running_sum_and_first_n(skewed):
    rows, df = skewed
    run = O.with_running_sum(df.where("x is not null"), [], F.col("x"), F.lit(1.0), [F.col("id")]).agg(F.max("running"), F.max("total")).first()
    assert run[0] == run[1] == len(rows) - 1
    top = O.first_n(df, ["g"], F.col("x"), 3, [F.col("id")]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in top}["hot"] == 3
    assert max(r["count"] for r in top) == 3


def test_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "x double")
    got = sorted(r[0] for r in O.with_average_rank(df, [], F.col("x")).where("x is not null").select("avg_rank").collect())
    assert got == [1.0, 2.5, 2.5, 4.0]


# ── metrics ──────────────────────────────────────────────────────────────────


def test_identity_weights_give_plain_figures(spark):
    r = random.Random(2)
    rows = [(r.randint(1, 17), r.randint(1, 17)) for _ in range(500)] + [(3, 3)] * 200
    c = C.confusion_counts(spark.createDataFrame(rows, "truth int, pred int"))
    eye = [[float(i == j) for j in range(17)] for i in range(17)]
    w, s = C.weighted_scores(c, eye).first(), C.summary_scores(c).first()
    assert w["oa_weighted"] == pytest.approx(s["oa"]) and w["kappa_weighted"] == pytest.approx(s["kappa"])
    assert C.dense_confusion(c).count() == 289


def test_perfect_and_degenerate(spark):
    perfect = C.confusion_counts(spark.createDataFrame([(1, 1), (2, 2)], "truth int, pred int"))
    s = C.summary_scores(perfect).first()
    assert (s["oa"], s["kappa"], s["f1_macro"]) == (1.0, 1.0, 1.0)
    one = C.confusion_counts(spark.createDataFrame([(5, 5)], "truth int, pred int"))
    assert C.summary_scores(one).first()["kappa"] is None
    assert C.summary_scores(one, macro="all").first()["f1_macro"] == pytest.approx(1 / 17)


def test_similarity_is_valid():
    w = validate(trait_similarity())
    assert (w[0][3], w[7][9], w[12][0]) == (0.67, 0.92, 0.08)
    w[0][1] = 0.5
    with pytest.raises(ValueError):
        validate(w)


def test_union_area_of_any_coordinates(spark):
    r = random.Random(4)
    zones = [(k, (x := r.uniform(0, 300)), (y := r.uniform(0, 300)), x + r.uniform(1, 90), y + r.uniform(1, 200)) for k in range(12)]
    shapes = [((x := r.uniform(-20, 380)), (y := r.uniform(-20, 480)), x + r.uniform(0.1, 70), y + r.uniform(0.1, 150)) for _ in range(150)] + [(0, 0, 10, 0.5)]
    frame = lambda rows, cols, name: spark.createDataFrame(rows, cols).select(
        *([] if name == "rbox" else ["zone"]), G.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(name))
    got = S.covered_area(frame(zones, "zone int, x0 double, y0 double, x1 double, y1 double", "lbox"),
                         frame([tuple(map(float, q)) for q in shapes], "x0 double, y0 double, x1 double, y1 double", "rbox"), 50.0, "zone")
    got = {q["zone"]: q["covered"] for q in got.collect()}
    for k, x0, y0, x1, y1 in zones:
        clipped = [(max(a, x0), max(b, y0), min(c, x1), min(d, y1)) for a, b, c, d in shapes]
        clipped = [q for q in clipped if q[0] < q[2] and q[1] < q[3]]
        xs, ys = (sorted({q[i] for q in clipped} | {q[i + 2] for q in clipped}) for i in (0, 1))
        area = sum((xb - xa) * (yb - ya) for xa, xb in zip(xs, xs[1:]) for ya, yb in zip(ys, ys[1:])
                   if any(q[0] <= xa and xb <= q[2] and q[1] <= ya and yb <= q[3] for q in clipped))
        assert got.get(k, 0.0) == pytest.approx(area, rel=1e-9, abs=1e-9)


def test_nearest_reaches_points_far_outside(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 9e5, -4e5)], "p int, x double, y double")
    sites = spark.createDataFrame([("a", 3.0, 4.0), ("b", 5e4, 0.0)], "s string, sx double, sy double")
    got = {q["p"]: (q["s"], round(q["dist"])) for q in S.nearest(points, sites, "p", "s", 10.0, 100.0).collect()}
    assert got == {1: ("a", 5), 2: ("b", round(math.hypot(8.5e5, 4e5)))}
    with pytest.raises(ValueError):
        S.nearest(points, sites.where("false"), "p", "s", 10.0, 100.0)


def test_ranks_of_names(spark):
    names = [f"city {k * 7919 % 20_011}" for k in range(20_000)] + ["city 1"] * 5
    got = {q["c"]: q["rank"] for q in O.name_rank(spark.createDataFrame([(n,) for n in names], "c string"), "c").collect()}
    assert got == {n: k + 1 for k, n in enumerate(sorted(set(names)))}


# ── votes ────────────────────────────────────────────────────────────────────


def _votes(spark, rows):
    return spark.createDataFrame(rows, "aoi string, pixel int, annotator string, submission int, date int, class int, weight double")


def test_unanimous_split_and_diffuse(spark):
    rows = [("a", 1, f"u{i}", i, 1, 5, 1.0) for i in range(5)]
    rows += [("a", 2, f"u{i}", i, 1, 2 if i % 2 else 3, 1.0) for i in range(4)]
    rows += [("a", 3, f"u{i}", i, 1, i + 1, 1.0) for i in range(10)]
    got = {r["pixel"]: r for r in VO.consensus(_votes(spark, rows), keep_rejected=True).collect()}
    assert (got[1]["set_size"], got[1]["top_class"], got[1]["bitmask"]) == (1, 5, 16)
    assert got[2]["bitmask"] == 6 and got[2]["set_size"] == 2
    assert got[3]["bitmask"] == 0 and got[3]["confidence"] == 0.0


def test_resubmission_counts_once_and_newest_wins(spark):
    rows = [("a", 1, "u", s, s, 2, 1.0) for s in range(5)] + [("a", 1, "u", 9, 9, 4, 1.0), ("a", 1, "v", 1, 1, 4, 1.0), ("a", 1, "z", 1, 1, 7, 0.0)]
    v = VO.newest_votes(_votes(spark, rows)).collect()
    assert sorted((r["annotator"], r["class"]) for r in v) == [("u", 4), ("v", 4)]


# ── spatial ──────────────────────────────────────────────────────────────────


def _boxes(n, seed, spot=0):
    r = random.Random(seed)
    out = [(i, x := r.randint(0, 900), y := r.randint(0, 900), x + r.randint(1, 120), y + r.randint(1, 120)) for i in range(n)]
    return out + [(n + i, 450, 450, 460, 462) for i in range(spot)]


def _frame(spark, rows, key, name):
    d = spark.createDataFrame(rows, f"{key} int, a int, b int, c int, d int")
    return d.select(key, G.box("a", "b", "c", "d").alias(name))


def left_out(votes, peers):
    """Per area: decided pixels, agreement with the others' consensus, peers there and agreement with them, one author at a time."""
    out = {}
    for (aoi, held), peer in peers.items():
        others = {}
        for (a, pixel, who), (c, w) in votes.items():
            if a == aoi and who != held:
                others.setdefault(pixel, []).append((c, w))
        total = sum(w for x in others.values() for _, w in x)
        prior = [sum(w for x in others.values() for c, w in x if c == k) / total for k in range(1, 18)]
        alpha = sum(sum(w * w for _, w in x) / sum(w for _, w in x) for x in others.values()) / len(others)
        for (a, pixel, who), (truth, _) in votes.items():
            if (a, who) != (aoi, held) or pixel not in others:
                continue
            whole = sum(w for _, w in others[pixel])
            p = sorted((-(sum(w for c, w in others[pixel] if c == k) + alpha * prior[k - 1]) / (whole + alpha), k) for k in range(1, 18))
            mass, chosen = 0.0, []
            for x, k in p[:4]:
                if mass < 0.65:
                    mass, chosen = mass - x, chosen + [k]
            if len(chosen) <= 3 and -p[0][0] >= 0.35:
                other = votes.get((aoi, pixel, peer))
                out.setdefault(aoi, []).append((truth in chosen, other and other[0] == truth))
    mean = lambda x: sum(x) / len(x) if x else None
    return {a: (len(x), mean([ok for ok, _ in x]), sum(s is not None for _, s in x), mean([s for _, s in x if s is not None])) for a, x in out.items()}


@pytest.mark.parametrize("chunk", [10_000, 90])
def test_authors_left_out_in_parts(spark, chunk):
    r = random.Random(8)
    rows = [(f"a{r.randrange(2)}", r.randrange(30), r.randrange(7), k, 1 + k % 3, r.choice([3, 3, 3, 5, 9, 17]), r.choice([0.2, 0.6, 1.0])) for k in range(500)]
    v = spark.createDataFrame(rows, "aoi string, pixel long, annotator long, submission long, date int, class int, weight double")
    newest = {(aoi, pixel, who): (c, w) for aoi, pixel, who, s, d, c, w in sorted(rows, key=lambda x: x[4:5] + x[3:4])}
    authors = VO.pick_authors(v)
    peers = {(x["aoi"], x["held"]): x["peer"] for x in authors.collect()}
    got = {x["aoi"]: (x["n_consensus"], x["loao_consensus"], x["n_peer"], x["loao_peer"]) for x in VO.leave_one_out(v, authors, chunk=chunk).collect()}
    want = left_out(newest, peers)
    assert set(got) == set(want) == {"a0", "a1"}
    for a in want:
        assert got[a] == pytest.approx(want[a])


def test_stored_tables_leave_no_shuffle_files(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = held()
    d = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    assert held() == before and {x["k"]: x["s"] for x in d.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}


@pytest.mark.parametrize("hot", [20, 10**9])
@pytest.mark.parametrize("touching", [False, True])
def test_box_join_is_complete_without_repeats(spark, hot, touching):
    left, right = _boxes(80, 3), _boxes(120, 4, spot=60)
    got = S.box_join(_frame(spark, left, "l", "lbox"), _frame(spark, right, "r", "rbox"), 64.0, touching=touching, hot_rows=hot).select("l", "r").collect()
    def meets(p, q):
        if touching:
            return p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]
        return p[1] < q[3] and q[1] < p[3] and p[2] < q[4] and q[2] < p[4]
    want = sorted((p[0], q[0]) for p in left for q in right if meets(p, q))
    assert sorted((r["l"], r["r"]) for r in got) == want


def test_union_coverage(spark):
    zone = _frame(spark, [(0, 0, 0, 10, 10)], "z", "lbox")
    shapes = _frame(spark, [(0, 0, 0, 5, 10), (1, 3, 0, 6, 10), (2, 3, 0, 6, 10), (3, 9, 9, 30, 30)], "r", "rbox")
    assert S.coverage_fraction(zone, shapes, 4.0, "z").first()["fraction"] == pytest.approx(0.61)


def test_nearest_matches_brute_force(spark):
    r = random.Random(5)
    pts = [(i, r.uniform(0, 1000), r.uniform(0, 1000)) for i in range(60)]
    sites = [(i, r.uniform(0, 60), r.uniform(900, 1000)) for i in range(40)] + [(100, 990.0, 10.0)]
    p = spark.createDataFrame(pts, "id int, x double, y double")
    s = spark.createDataFrame(sites, "site int, sx double, sy double")
    dist = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    got = {q["id"]: q["site"] for q in S.nearest(p, s, "id", "site", 10.0, 1000.0).collect()}
    assert got == {a[0]: min(sites, key=lambda b: (dist(a, b), b[0]))[0] for a in pts}
    five = S.nearest(p, s, "id", "site", 10.0, 1000.0, k=5).groupBy("id").agg(F.array_sort(F.collect_list("site")).alias("s")).collect()
    for q in five:
        a = pts[q["id"]]
        assert q["s"] == sorted(b[0] for b in sorted(sites, key=lambda b: (dist(a, b), b[0]))[:5])


def test_near_lonlat_matches_haversine(spark):
    r = random.Random(6)
    a = [(i, r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for i in range(400)] + [(1000, 179.9, 60.0), (1001, 10.0, 89.5)]
    b = [(r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(60)] + [(-179.9, 60.0), (-170.0, 89.6)]
    def km(p, q):
        f = [math.radians(v) for v in (p[1], p[2], *q)]
        h = math.sin((f[3] - f[1]) / 2) ** 2 + math.cos(f[1]) * math.cos(f[3]) * math.sin((f[2] - f[0]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))
    want = {p[0] for p in a if any(km(p, q) < 500 for q in b)}
    got = S.near_lonlat(spark.createDataFrame(a, "id int, lon double, lat double"), spark.createDataFrame(b, "lon double, lat double"), "id", 500.0)
    assert {r["id"] for r in got.collect()} == want


def test_projection_known_point(spark):
    d = spark.range(1).select(*G.utm_xy(F.lit(13.4), F.lit(52.5), F.lit(15.0)), *G.equal_area_xy(F.lit(180.0), F.lit(0.0)), G.utm_zone(F.lit(13.4)))
    e, n, x, y, z = d.first()
    assert z == 33 and (e, n) == (pytest.approx(391389, abs=2000), pytest.approx(5817900, abs=2000))
    assert x == pytest.approx(17367530.45, abs=0.5) and y == pytest.approx(0.0, abs=1e-6)


def test_shape_index(spark):
    r = spark.range(1).select(G.shape_index(F.lit(math.pi), F.lit(2 * math.pi)), G.shape_index(F.lit(1.0), F.lit(4.0)), G.shape_index(F.lit(0.0), F.lit(4.0))).first()
    assert r[0] == pytest.approx(1.0) and r[1] == pytest.approx(1.2732, abs=1e-4) and math.isinf(r[2])


# ── graphs ───────────────────────────────────────────────────────────────────


def test_components_of_random_graph(spark):
    r = random.Random(7)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(260)] + [(0, i) for i in range(500, 800)] + [(i, i + 1) for i in range(900, 1000)]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {q["node"]: q["component"] for q in N.connected_components(spark.createDataFrame(edges, "block_a int, block_b int")).collect()}
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert got == want


def test_zones_against_plain_search(spark):
    """A random planar lattice: zones are the connected cells of one label, grade follows their area."""
    r = random.Random(12)
    n = 9
    label = {(i, j): r.choice(["low", "mid", None]) for i in range(n) for j in range(n)}
    area = {k: r.uniform(2_000, 40_000) for k in label}
    name = lambda k: f"q{k[0]}{k[1]}"
    edges = [((i, j), k) for i in range(n) for j in range(n) for k in ((i + 1, j), (i, j + 1)) if k in label]
    z = N.form_zones(spark.createDataFrame([(name(k), label[k], area[k]) for k in label], "block_id string, label_key string, area_m2 double"),
                     spark.createDataFrame([(name(a), name(b)) for a, b in edges], "block_a string, block_b string"))
    near = {k: [b if a == k else a for a, b in edges if k in (a, b)] for k in label}
    for row in z.collect():
        start = next(k for k in label if name(k) == row["block_id"])
        seen, todo = {start}, [start]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen and label[k] is not None and label[k] == label[start]:
                    seen.add(k)
                    todo.append(k)
        if label[start] is None:
            assert row["zone_id"] is None and not row["zone_grade"]
        else:
            ha = sum(area[k] for k in seen) / 1e4
            assert row["zone_id"] == min(map(name, seen)) and row["zone_area_ha"] == pytest.approx(ha)


# ── pixels ───────────────────────────────────────────────────────────────────


def _pixels(spark, array):
    rows = [(0, r, c, int(v)) for r, line in enumerate(array) for c, v in enumerate(line) if v]
    return spark.createDataFrame(rows, "g int, row long, col long, class int")


def _array(df, shape):
    out = np.zeros(shape, dtype=int)
    for r in df.collect():
        out[r["row"], r["col"]] = r["class"]
    return out


def test_majority_pool_of_quadrants(spark):
    a = np.zeros((8, 8), dtype=int)
    a[:4, :4], a[4:, 4:], a[0, 0], a[6, 1] = 3, 7, 9, 5
    got = {(r["brow"], r["bcol"]): r["class"] for r in X.majority_pool(_pixels(spark, a), ["g"], 4, height=8, width=8).collect()}
    assert got == {(0, 0): 3, (1, 1): 7, (1, 0): 5}


def test_narrow_gaps_between_one_class_close(spark):
    """Gaps of one and two pixels across a class are filled; a wide one stays."""
    a = np.full((31, 26), 6)
    a[15, :] = a[4:6, :] = 0
    a[18:26, 12:21] = 0
    out = _array(X.repair_seams(_pixels(spark, a), ["g"], 31, 26), a.shape)
    assert (out[15] == 6).all() and (out[4:6] == 6).all() and (out[18:26, 12:21] == 0).all()


def test_gaussian_filter_matches_dense_convolution(spark):
    r = np.random.default_rng(8)
    a = r.integers(0, 4, (23, 31))
    sigma = {c: 1.0 + 0.3 * c for c in range(1, 4)}
    got = _array(X.gaussian_filter(_pixels(spark, a), ["g"], "g int", sigma, 23, 31, tile=16), a.shape)
    best, arg = np.full(a.shape, -1.0), np.zeros(a.shape, dtype=int)
    for c, s in sigma.items():
        rad = int(4 * s + 0.5)
        k = np.exp(-0.5 * (np.arange(-rad, rad + 1) / s) ** 2)
        k /= k.sum()
        m = np.pad((a == c).astype(float), rad)
        m = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, m)
        m = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, m)
        up = m > best + 1e-12
        arg[up], best[up] = c, m[up]
    arg[a == 0] = 0
    assert (got == arg).all()


# ── vectors ──────────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(9)
    centre = r.normal(size=(4, 12)) * 2
    label = r.integers(0, 4, 300)
    x = centre[label] + r.normal(size=(300, 12))
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i]), i // 10) for i in range(300)], "id long, v array<double>, label int, patch int")
    return x, label, df


@pytest.mark.parametrize("block", [8192, 37])
def test_knn_over_blocks(cloud, block):
    x, _, df = cloud
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(d, np.inf)
    want = {i: np.argsort(d[i], kind="stable")[:7].tolist() for i in range(300)}
    got: dict = {}
    for r in K.knn(df, df, 7, exclude_self=True, block=block).orderBy("id", "nn").collect():
        got.setdefault(r["id"], []).append(r["ref"])
    assert got == want


def test_silhouette_matches_pairs(cloud):
    x, label, df = cloud
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == g].mean() for g in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    assert K.silhouette(df, "id", "label").first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-6)


def test_principal_axes_and_map(cloud):
    x, _, df = cloud
    mean, comp, share = W.principal_axes(df)
    value, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(np.sum(comp * axes[:, ::-1][:, :3].T, axis=1)), 1, atol=1e-8)
    assert share.sum() == pytest.approx(value[::-1][:3].sum() / value.sum())
    m = np.random.default_rng(3).normal(size=(12, 12))
    pairs = df.sparkSession.createDataFrame([(i, i // 10, x[i].tolist(), (x[i] @ m).tolist()) for i in range(300)], "id long, patch int, a array<double>, b array<double>")
    r2 = {r["pairing"]: r["r2"] for r in W.linear_map_r2(pairs, "patch", "id").collect()}
    assert r2["paired"] == pytest.approx(1.0, abs=1e-6) and r2["shuffled"] < 0.5


def test_mixture_separates_classes(cloud):
    x, label, df = cloud
    for k in (1, 3):
        p = ML.predict_mixtures(df, ML.fit_mixtures(df, "label", components=k), "id", 4).join(df.select("id", "label"), "id")
        assert p.where("pred = label").count() / 300 > 0.9


def test_pooling_fallbacks(spark):
    px = [(0, r, c, [float(r * 3 + c)], r == 0 and c == 0) for r in range(3) for c in range(3)] + [(1, r, c, [float(r * 3 + c)], False) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(px, "patch int, row int, col int, v array<double>, valid boolean")
    got = {r["patch"]: r for r in W.pool_patches(df, ["patch"], F.lit(3), F.lit(3)).collect()}
    assert (got[0]["mean"], got[0]["center"], got[0]["ring_in"], got[0]["ring_out"]) == (0.0, 0.0, 0.0, 0.0)
    assert (got[1]["mean"], got[1]["center"], got[1]["q50"]) == (4.0, 4.0, 4.0)


def test_pooling_without_fallback(spark):
    px = [(0, r, c, [float(r * 3 + c)], r == 0) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(px, "patch int, row int, col int, v array<double>, valid boolean")
    got = W.pool_patches(df, ["patch"], F.lit(3), F.lit(3), fallback=False).first()
    assert (got["mean"], got["center"], got["ring_in"], got["ring_out"]) == (1.0, 1.0, None, 1.0)


def test_pooled_queries_on_a_patch_without_inner_pixels(spark):
    """Five vectors fill one line of a patch, so its inner ring is empty: null as in the SQL of both queries."""
    vectors = spark.createDataFrame([(i, [float(i)] * 64, 0) for i in range(5)], "vec_id long, embedding array<float>, label int")
    tables = {"embeddings": vectors}
    pooled = QUERIES["pooled_patches"].build(tables)
    assert {(r["ring_in"], r["ring_out"], r["mean"]) for r in pooled.collect()} == {(None, 2.5, 2.5)}
    got = QUERIES["pooled_recipe"].build(tables).first()
    assert (got["patch"], got["dim"], got["checksum"]) == (0, 192, None)


def test_quantise_round_trip(spark):
    codes, scale = V.quantise(F.col("v"))
    r = spark.createDataFrame([([0.5, -1.0, 0.25],), ([0.0, 0.0, 0.0],)], "v array<double>").select(codes, scale).collect()
    assert r[0][0] == [64, -127, 32] and r[1] == ([0, 0, 0], 1.0)


# ── manifest, splits, ensembles ──────────────────────────────────────────────


def test_neutral_filters_return_the_input(spark):
    items = spark.createDataFrame([("training", 1)], "dataset string, patch_id int")
    assert M.filter_invalid(items, items, 1.0) is items
    assert M.filter_native(items, items, 0.0, []) is items
    assert M.filter_members(items, None) is items


def test_unknown_items_are_kept(spark):
    items = spark.createDataFrame([("training", 1), ("training", 2), ("validation", 1)], "dataset string, patch_id int")
    scan = spark.createDataFrame([("f", "training", 1, 0.9), ("f", "training", 2, 0.1)], "family string, dataset string, patch_id int, invalid_frac double")
    got = M.filter_invalid(items, scan, 0.25).collect()
    assert sorted(map(tuple, got)) == [("training", 2), ("validation", 1)]


def test_splits_survive_growth(spark):
    mk = lambda n: spark.createDataFrame([(f"a{i}", f"r{i % 3}") for i in range(n)], "aoi string, region string")
    a = {r["aoi"]: r["split"] for r in P.region_splits(mk(60)).collect()}
    assert statistics.multimode(a.values()) == ["train"] and {"val", "test"} <= set(a.values())
    tiny = P.region_splits(spark.createDataFrame([("x", "r"), ("y", "r")], "aoi string, region string")).collect()
    assert {r["split"] for r in tiny} == {"train"}


def test_leakage_guard(spark):
    d = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "val")], "city string, split string")
    with pytest.raises(ValueError):
        P.assert_splits(d, "city", ["train", "val", "test"])
    with pytest.raises(ValueError):
        P.require_unique(d, ["city"])


def test_weighted_draws_follow_weights(spark):
    d = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 3.0)], "id int, w double")
    got = {r["id"]: r["count"] for r in P.draw_weighted(d, 4000, F.col("w"), "id").groupBy("id").count().collect()}
    assert 0 not in got and sum(got.values()) == 4000 and got[2] / got[1] == pytest.approx(3, rel=0.15)


def test_simplex_grid():
    g = E.simplex(3, 0.25)
    assert len(g) == 15 and all(sum(w) == pytest.approx(1) for w in g) and len(set(g)) == 15


def test_temperature_recovers_sharpness(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(400):
        z = r.normal(size=17)
        p = np.exp(z) / np.exp(z).sum()
        y = int(r.choice(17, p=p)) + 1
        q = p**2 / (p**2).sum()
        rows.append(("m", y, q.tolist()))
    t = E.fit_temperatures(spark.createDataFrame(rows, "model string, label int, probs array<double>"))
    assert t["m"] == pytest.approx(2.0, rel=0.25)


def test_offsets_are_fitted_to_the_end(spark):
    """The gradient is all but zero where the fit ends, and too few rounds are an error."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(120, 2)) * [1.0, 0.2], rng.integers(1, 4, 120)
    df = spark.createDataFrame([([0.0, 0.0, 0.0], [float(v) for v in r], int(k)) for r, k in zip(x + 0.3 * y[:, None], y)], "p array<double>, a array<double>, label int").coalesce(1)
    a, b = E.fit_offset(df, "p", "a", "label", 1e-4)
    z = (x + 0.3 * y[:, None]) @ a.T + b
    e = np.exp(z - z.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    e[np.arange(120), y - 1] -= 1
    assert np.abs(e.T @ (x + 0.3 * y[:, None]) / 120 + 2e-4 * a).max() < 1e-3
    with pytest.raises(RuntimeError):
        E.fit_offset(df, "p", "a", "label", 1e-4, rounds=1)
