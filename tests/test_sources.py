"""File payloads, caches and scans."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonomy.sources import cache as C
from zonomy.sources import payloads as L
from zonomy.sources import scans as S


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("patches")
    for ds, n in (("training", 3), ("testing", 2)):
        (root / ds / "emb" / "2017").mkdir(parents=True)
        for i in range(n):
            np.save(root / ds / "emb" / "2017" / f"patch_{i}.npy", np.arange(2 * 3 * (4 + i), dtype="int16").reshape(2, 3, 4 + i))
    return str(root)


def test_inventory_and_payloads(spark, tree):
    inv = sorted((r["dataset"], r["patch_id"]) for r in S.patch_inventory(spark, tree).collect())
    assert inv == [("testing", "0"), ("testing", "1"), ("training", "0"), ("training", "1"), ("training", "2")]
    shapes = {(r["dataset"], r["patch_id"]): (r["h"], r["w"]) for r in L.read_shapes(spark, tree).collect()}
    assert shapes[("training", "2")] == (3, 6)
    px = L.read_pixels(spark, tree).where("dataset = 'training' and patch_id = '0' and row = 1 and col = 2").first()
    assert px["v"] == [6.0, 18.0]


def test_cached_stage_builds_once(spark, tmp_path):
    calls = []
    def build():
        calls.append(1)
        return spark.range(5).toDF("x")
    for t in (0.1, 0.2):
        assert C.cached_stage(spark, str(tmp_path), "scan", {"year": 1, "t": t}, build, only=["year"]).count() == 5
    assert len(calls) == 1
    C.cached_stage(spark, str(tmp_path), "scan", {"year": 2, "t": 0.1}, build, only=["year"])
    assert len(calls) == 2


def test_bounds_need_unique_keys(spark, tmp_path):
    head = "SMOD_ID,JRC_NAME_MAIN,minx,miny,maxx,maxy\n"
    good, bad = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text(head + "1,Ab,0,0,1,1\n2,Ab,0,0,2,2\n")
    bad.write_text(head + "1,Ab,0,0,1,1\n1,Cd,0,0,2,2\n")
    assert S.read_bounds(spark, str(good)).count() == 2
    with pytest.raises(ValueError):
        S.read_bounds(spark, str(bad))


def test_theme_scan_pushes_filters(spark, tmp_path):
    d = spark.range(100).select(F.struct(F.col("id").cast("double").alias("xmin"), (F.col("id") + 1.0).alias("xmax"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("ymax")).alias("bbox"),
                                F.lit("base").alias("theme"), F.when(F.col("id") % 2 == 0, "land").otherwise("water").alias("type"), F.col("id"))
    d.write.partitionBy("theme", "type").parquet(str(tmp_path / "t"))
    out = S.read_theme(spark, str(tmp_path / "t"), "base", "land", (10.0, 0.0, 20.0, 1.0), ["id"])
    plan = out._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):].split("ReadSchema")[0]
    assert "bbox.xmin" in pushed and "theme" in plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert sorted(r["id"] for r in out.collect()) == [10, 12, 14, 16, 18, 20]


def test_optional_layer(spark):
    assert S.informal_flag(spark.range(3)) is None
    d = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "access double")
    assert [r["informal"] for r in S.informal_flag(d).orderBy("access").collect()] == [True, True, False]


def test_tile_names_keep_their_decimals(spark):
    d = spark.createDataFrame([("grid_121.35_31.25",), ("grid_-46.15_-0.95",), ("dir/grid_1.05_2.15.tif",), ("readme",)], "name string")
    got = {r["name"]: (r["lon"], r["lat"]) for r in S.tile_cells(d).collect()}
    assert got == {"grid_121.35_31.25": (121.35, 31.25), "grid_-46.15_-0.95": (-46.15, -0.95), "dir/grid_1.05_2.15.tif": (1.05, 2.15)}


def test_append_migrates_columns(spark, tmp_path):
    p = str(tmp_path / "s")
    C.append_rows(spark.createDataFrame([(1,)], "a int"), p)
    d = C.append_rows(spark.createDataFrame([(2, "x")], "a int, b string"), p)
    assert sorted(map(tuple, d.select("a", "b").collect())) == [(1, None), (2, "x")]


def test_functions_reach_the_executors_from_any_folder(tmp_path):
    """Arrow functions of the package run when the driver was started elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from zonomy.session import build_session; "
            "s = build_session('local[2]', spark__ui__enabled='false'); "
            "print([e.queries()[q](s, '/root/testdata/sf0.001').count() for q in ('density_classes', 'gaussian_coarsen')])")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
