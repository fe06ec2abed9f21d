"""Hilbert layout and file bounds, stored sketches, training items, names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonomy.functions import clean
from zonomy.functions import geometry as G
from zonomy.operators import items, sketches
from zonomy.sources import layout


def test_the_curve_visits_neighbours(spark):
    n = 16
    df = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    at = {r["d"]: (r["x"], r["y"]) for r in df.select("x", "y", layout.hilbert_key(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    assert sorted(at) == list(range(n * n))
    assert all(abs(at[k][0] - at[k + 1][0]) + abs(at[k][1] - at[k + 1][1]) == 1 for k in range(n * n - 1))


def test_a_small_box_opens_few_files(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(k, float(a), float(b), float(a + c), float(b + d)) for k, (a, b, c, d) in enumerate(zip(r.uniform(0, 1000, 4000), r.uniform(0, 1000, 4000), r.uniform(0, 5, 4000), r.uniform(0, 5, 4000)))]
    df = spark.createDataFrame(rows + [(-1, None, None, None, None)], "id int, x0 double, y0 double, x1 double, y1 double")
    df = df.select("id", F.when(F.col("x0").isNotNull(), G.box("x0", "y0", "x1", "y1")).alias("box"))
    laid = layout.write_layout(df, str(tmp_path / "t"), "box", file_bytes=4000, row_bytes=F.lit(100))
    assert spark.read.parquet(laid.data).count() == 4001 and 60 <= spark.read.parquet(laid.bounds).count() <= 101
    got = {x["id"] for x in layout.read_box(spark, laid, "box", 200.0, 300.0, 260.0, 350.0).collect()}
    assert got == {k for k, a, b, c, d in rows if a <= 260 and c >= 200 and b <= 350 and d >= 300}
    assert len(layout.files_for(spark, laid, 200.0, 300.0, 260.0, 350.0)) <= 8
    assert layout.read_box(spark, laid, "box", 5000.0, 0.0, 5001.0, 1.0).count() == 0
    empty = layout.write_layout(df.where("false"), str(tmp_path / "e"), "box")
    assert layout.read_box(spark, empty, "box", 0.0, 0.0, 1.0, 1.0).count() == 0


def test_sketches_merge_within_their_error(spark, tmp_path):
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=20_000), r.normal(5, 0.1, 5000)])
    df = spark.createDataFrame([(int(k % 10), [float(v), None if k % 7 == 0 else float(k)]) for k, v in enumerate(x)], "tile int, v array<double>")
    path = str(tmp_path / "states")
    first = sketches.append_states(df.where("tile < 9"), ["tile"], path)
    known = {(s["tile"], s["ch"]): bytes(s["sketch"]) for s in first.collect()}
    changed = df.withColumn("v", F.when(F.col("tile") < 9, F.array(F.lit(1e9))).otherwise(F.col("v")))
    states = sketches.append_states(changed, ["tile"], path)  # only the new tile is taken up
    now = {(s["tile"], s["ch"]): bytes(s["sketch"]) for s in states.collect()}
    assert len(now) == 20 and all(now[k] == v for k, v in known.items())
    figures = {f["ch"]: f for f in sketches.state_figures(sketches.merged_states(states), {f"q{p}": p / 100 for p in (1, 25, 50, 75, 99)}).collect()}
    assert figures[0]["n"] == len(x) and figures[1]["n"] == sum(k % 7 > 0 for k in range(len(x)))
    assert figures[0]["mean"] == pytest.approx(x.mean()) and figures[0]["std"] == pytest.approx(x.std()) and figures[0]["low"] == x.min()
    ranks = np.sort(x)
    for p in (1, 25, 50, 75, 99):
        assert abs(np.searchsorted(ranks, figures[0][f"q{p}"]) / len(x) - p / 100) < 0.01


def test_items_need_a_file_and_known_splits(spark):
    patches = spark.createDataFrame([("training", "1", 3, "train"), ("training", "2", 4, "test"), ("testing", "1", 5, "val"), ("validation", "1", 6, "odd"), ("training", "9", 1, "val")], "dataset string, patch_id string, lcz int, plan string")
    files = spark.createDataFrame([("training", "1"), ("training", "2"), ("testing", "1"), ("validation", "1")], "dataset string, patch_id string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    got, unknown = items.split_items(patches, files, "column", "plan")
    assert rows(got) == [("testing", "1", 4, "val"), ("training", "1", 2, "train"), ("training", "2", 3, "test")] and rows(unknown) == [("odd", 1)]
    assert rows(items.split_items(patches, files, "hybrid", "plan")[0]) == [("testing", "1", 4, "test"), ("training", "1", 2, "train"), ("training", "2", 3, "train")]
    assert rows(items.split_items(patches, files)[0])[-1] == ("validation", "1", 5, "val")
    with pytest.raises(ValueError, match="empty splits"):
        items.split_items(patches.where("plan <> 'test'"), files, "column", "plan")
    with pytest.raises(ValueError, match="no column"):
        items.split_items(patches, files, "column", "nowhere")
    weak = patches.withColumns({"weight": F.lit(0.5), "lon": F.col("lcz").cast("double"), "lat": F.lit(0.0)})
    held = spark.createDataFrame([(3.5, 0.0)], "lon double, lat double")
    assert rows(items.weak_items(weak, files, held, 100.0, 0.2)) == [("testing", "1", 4, "train", 0.1), ("validation", "1", 5, "train", 0.1)]


def test_names_fold(spark):
    df = spark.createDataFrame([(t,) for t in ("Ｆｕｌｌ ｗｉｄｔｈ", "ﬁne/é", "東營區", "  ", "São  Paulo–Nord", "STRAẞE", None)], "t string")
    got = [tuple(r) for r in df.select(clean.slug("t"), clean.slug("t", compatible=False), clean.place_key("t")).collect()]
    assert got[0] == ("Full_width", "Ｆｕｌｌ_ｗｉｄｔｈ", "full width") and got[1][0] == "fine_é" and got[1][2] == "fine e"
    assert got[2] == ("東營區", "東營區", "") and got[3][0] == "unnamed" and got[4][2] == "sao paulo nord" and got[5][2] == "strasse" and got[6] == (None, None, None)


def plain_fit(x, y, lam, classes):
    """Newton's method on one fold."""
    n, d = x.shape
    w = np.zeros((classes, d))
    own = np.append(np.full(d - 1, lam), 0.0)
    for _ in range(60):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - np.eye(classes)[y]).T @ x / n + own * w
        h = np.einsum("ij,ik,il,im->jlkm", p, p, x, x) / -n
        for k in range(classes):
            h[k, :, k] += (x * p[:, k:k + 1]).T @ x / n
        h = h.reshape(classes * d, -1) + np.diag(np.tile(own, classes))
        w = w - np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(w.shape)
        if np.abs(g).max() < 1e-12:
            break
    return w


def test_all_folds_are_the_separate_fits(spark):
    from zonomy.operators import folds

    r = np.random.default_rng(2)
    x, city = r.random((240, 4)), np.array(["a", "b", "c"])[r.integers(0, 3, 240)]
    y = np.arange(240) % 17  # every class in every fold, so that each has a minimum
    x[:, 0] += y / 20
    df = spark.createDataFrame([([float(v) for v in a], int(b), str(c), k, int(b) + 1) for k, (a, b, c) in enumerate(zip(x, y, city))], "x array<double>, y int, city string, id int, label int")
    got = folds.fit_folds(df, 1e-2, tolerance=1e-9)
    full = np.column_stack([x, np.ones(len(x))])
    for c in "abc":
        want = plain_fit(full[city != c], y[city != c], 1e-2, 17)
        apart = lambda w: w - w.mean(axis=0)  # noqa: E731  (a shift of all classes moves nothing)
        assert np.abs(apart(got[c]) - apart(want)).max() < 1e-6
    pred = {p["id"]: p["pred"] for p in folds.predict_folds(df, got).collect()}
    assert all(pred[k] == int(np.round(full[k] @ got[city[k]].T, 9).argmax()) + 1 for k in range(240))
    assert folds.fit_folds(df.where("false"), 1e-2) == {} and folds.predict_folds(df.where("false"), got).count() == 0
