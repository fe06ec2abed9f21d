"""Drift of crop sizes: scanned patches at the places of their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.operators import crops as C
from zonomy.plans import inventory, spatial  # noqa: F401  (the views below read their views)
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

view("placed_crops", """
SELECT s.dataset, s.patch_id, s.h, s.w, p.lon, p.lat, s.city FROM {scan} s JOIN {places} p ON p.place_id = s.patch_id WHERE s.family = 'fa'
""")
WHOLE = """md AS (SELECT median(h) AS mh, median(w) AS mw FROM placed_crops), wh AS (SELECT c.*, abs(lat) AS al, abs(lon - ((floor((lon + 180) / 6) + 1) * 6 - 183)) AS dm, h * 10 / 32.0::DOUBLE AS rh, w * 10 / 32.0::DOUBLE AS rw, sqrt(h * w) * 10 / 32.0::DOUBLE AS rg
 FROM placed_crops c, md WHERE h >= 0.85::DOUBLE * mh AND w >= 0.85::DOUBLE * mw)"""
MEANS = "count(*) AS n, round(avg(h), 6) AS h, round(avg(w), 6) AS w, round(avg(rh), 6) AS res_h, round(avg(rw), 6) AS res_w, round(avg(rg), 6) AS res_geo"
TABLES = "-- {placed_crops}"


def _whole(t):
    return C.whole_crops(t["placed_crops"])


@query("crop_cities", "D40", f"""WITH {WHOLE} SELECT city, {MEANS}, round(avg(lat), 6) AS lat, round(stddev_samp(h), 6) AS h_std, round(stddev_samp(w), 6) AS w_std, city IN ('city3', 'city11') AS held_out FROM wh GROUP BY city {TABLES}""")
def crop_cities(t):
    return rounded(C.city_drift(_whole(t), ["city3", "city11"]))


@query("crop_bands", "D40", f"""WITH {WHOLE} SELECT band, {MEANS} FROM (SELECT *, CASE WHEN al > 0 AND al <= 15 THEN '(0, 15]' WHEN al > 15 AND al <= 30 THEN '(15, 30]' WHEN al > 30 AND al <= 40 THEN '(30, 40]' WHEN al > 40 AND al <= 50 THEN '(40, 50]' WHEN al > 50 AND al <= 90 THEN '(50, 90]' END AS band FROM wh) WHERE band IS NOT NULL GROUP BY band {TABLES}""")
def crop_bands(t):
    return rounded(C.band_drift(_whole(t)))


@query("crop_shapes", "D40", """SELECT h, w, count(*) AS n FROM {placed_crops} GROUP BY h, w ORDER BY n DESC, h, w LIMIT 10""")
def crop_shapes(t):
    return C.shape_counts(t["placed_crops"])


@query("crop_correlations", "D40 E11", f"""WITH {WHOLE}, v AS (SELECT 'h_vs_abs_lat' AS pair, h AS a, al AS b FROM wh UNION ALL SELECT 'res_geo_vs_dist_meridian', rg, dm FROM wh),
 r AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY a) + (count(*) OVER (PARTITION BY pair, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY pair ORDER BY b) + (count(*) OVER (PARTITION BY pair, b) - 1) / 2 AS rb FROM v)
SELECT pair, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r GROUP BY pair {TABLES}""")
def crop_correlations(t):
    return rounded(C.drift_correlations(_whole(t), [("h", "abs_lat"), ("res_geo", "dist_meridian")]))
