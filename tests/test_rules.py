"""Decision table: every branch and threshold edge."""

import pytest

from zonomy.functions import labelsets as L
from zonomy.functions import rules as R
from pyspark.sql import functions as F

BASE = {c: 0.0 for c in R.ZERO_DEFAULT} | {"h_mean": None, "mn_informal_frac": None, "ghs_built_s": 0.5, "height_evidence_frac": 1.0}
SCHEMA = ", ".join(f"{c} double" for c in BASE)

CASES = [
    # natural branch
    (dict(bsf=0.0, ghs_built_s=0.0, f_water=0.75), "h17", 0.75, None),
    (dict(bsf=0.0, ghs_built_s=0.0, f_trees=0.75), "h11", 0.75, None),
    (dict(bsf=0.0, ghs_built_s=0.0, f_trees=0.35, f_lowplants=0.40), "h12", 0.75, None),
    (dict(bsf=0.0, ghs_built_s=0.0, f_trees=0.34, f_lowplants=0.60), None, 0.0, "no_positive_evidence"),
    (dict(bsf=0.0, ghs_built_s=0.0, f_shrub=0.6), "h13", 0.6, None),
    (dict(bsf=0.0, ghs_built_s=0.0, f_lowplants=0.8), "h14", 0.8, None),
    (dict(bsf=0.0, ghs_built_s=0.0, f_bare_rock=0.6, f_paved_infra=0.7), "h15", 0.7, None),
    (dict(bsf=0.0, ghs_built_s=0.0, f_sand=0.6), "h16", 0.6, None),
    (dict(bsf=0.0, ghs_built_s=0.16, f_water=0.9), None, 0.0, "completeness_trap"),
    (dict(bsf=0.0, ghs_built_s=0.10, f_water=0.9), None, 0.0, "built_signal_present"),
    (dict(bsf=0.0, ghs_built_s=None, f_water=0.9), "h17", 0.9, None),
    (dict(bsf=float("nan"), ghs_built_s=0.0, f_water=0.9), "h17", 0.9, None),
    # special built classes
    (dict(bsf=0.1, f_industrial_lu=0.5, n_heavy_industry_poi=1.0), "h10", 1.0, None),
    (dict(bsf=0.3, mean_footprint_area=800.0, large_lowrise_frac=0.5), "h8", 1.0, None),
    (dict(bsf=0.3, mean_footprint_area=800.0, large_lowrise_frac=0.5, f_industrial_lu=0.5), "c8,10", 1.0, None),
    (dict(bsf=0.3, mean_footprint_area=800.0, large_lowrise_frac=0.5, h_mean=10.0), "h5", 1.0, None),
    # height by density
    (dict(bsf=0.5, h_mean=25.0), "h1", 1.0, None),
    (dict(bsf=0.3, h_mean=25.0), "h4", 1.0, None),
    (dict(bsf=0.1, h_mean=25.0), None, 0.0, "matrix_unlabelled"),
    (dict(bsf=0.5, h_mean=10.0), "h2", 1.0, None),
    (dict(bsf=0.3, h_mean=24.9), "h5", 1.0, None),
    (dict(bsf=0.3, h_mean=9.9), "h6", 1.0, None),
    (dict(bsf=0.1, h_mean=5.0, f_lowplants=0.4), "h9", 1.0, None),
    (dict(bsf=0.1, h_mean=5.0, f_lowplants=0.39), None, 0.0, "matrix_unlabelled"),
    (dict(bsf=0.3), None, 0.0, "no_height_class"),
    (dict(bsf=0.3, h_max=25.0, n_tower=3.0), "h4", 1.0, None),
    (dict(bsf=0.3, h_mean=12.0, h_max=25.0, n_tower=2.0), "h5", 1.0, None),
    # confidence
    (dict(bsf=0.3, h_mean=12.0, height_none_frac=0.51), None, 0.0, "insufficient_height_evidence"),
    (dict(bsf=0.3, h_mean=12.0, height_evidence_frac=0.49), "h5", 0.6, None),
    (dict(bsf=0.42, h_mean=12.0), "h2", 0.7, None),
    (dict(bsf=0.3, h_mean=12.0, ghs_built_s=0.01, built_area_ml_frac=1.0), "h5", 0.5, None),
    # compact low-rise router
    (dict(bsf=0.5, h_mean=5.0, building_count_density=1999.0), "c3,7", 1.0, None),
    (dict(bsf=0.5, h_mean=5.0, building_count_density=6000.0, median_footprint_area=60.0, footprint_area_cv=0.7, f_google_source=1.0), "h7", 0.6, None),
    (dict(bsf=0.5, h_mean=5.0, building_count_density=3000.0, mn_informal_frac=0.5), "h7", 0.75, None),
    (dict(bsf=0.5, h_mean=5.0, building_count_density=3000.0, median_footprint_area=100.0), "h3", 1.0, None),
    (dict(bsf=0.5, h_mean=5.0, building_count_density=3000.0, median_footprint_area=80.0), "c3,7", 1.0, None),
    (dict(bsf=0.5, h_mean=5.0, building_count_density=3000.0, median_footprint_area=100.0, height_evidence_frac=0.2, height_none_frac=0.9), "c3,7", 1.0, None),
]


def test_decision_table(spark):
    rows = [tuple({**BASE, **over}.values()) for over, *_ in CASES]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SCHEMA)
    out = R.classify(df).select("i", L.dissolve_key("label_type", "lcz", "lcz_set").alias("k"), "confidence", "reject_reason").orderBy("i").collect()
    for row, (over, key, conf, reason) in zip(out, CASES):
        assert (row["k"], row["reject_reason"]) == (key, reason), over
        assert row["confidence"] == pytest.approx(conf), over


def test_label_sets(spark):
    df = spark.createDataFrame([([3, 7],), ([17],), ([],)], "s array<int>").withColumn("m", L.encode("s"))
    got = [tuple(r) for r in df.select("m", L.decode("m"), L.hard_class("m"), L.size("m")).collect()]
    assert got == [(68, [3, 7], 0, 2), (65536, [17], 17, 1), (0, [], 0, 0)]


def test_stability_needs_coverage(spark):
    df = spark.createDataFrame([(0.1, 5.0, 0.15, 6.0), (None, 5.0, 0.1, 5.0), (0.1, 5.0, 0.25, 5.0), (0.1, None, 0.1, None), (0.1, 5.0, 0.1, 12.0)],
                               "a double, b double, c double, d double")
    got = [r[0] for r in df.select(R.stable(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [True, False, False, True, False]
