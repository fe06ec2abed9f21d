"""Boxes, points and zones on a metric plane built from part, line item and customer keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import geometry as G
from zonomy.operators import overlay as O
from zonomy.operators import patches as P
from zonomy.operators import spatial as S
from zonomy.operators import zonal as Z
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

CELL = 128.0

view("zone_boxes", """
SELECT p_partkey AS zone_id, CAST((p_partkey % 50) * 100 AS DOUBLE) AS minx, CAST(floor(p_partkey / 50) * 100 AS DOUBLE) AS miny,
  CAST((p_partkey % 50) * 100 + 100 AS DOUBLE) AS maxx, CAST(floor(p_partkey / 50) * 100 + 100 AS DOUBLE) AS maxy,
  p_size, p_retailprice FROM {part}
""")
view("features", """
SELECT *, x0 + 3 + q % 17 AS x1, y0 + 2 + orderkey % 13 AS y1 FROM (
  SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS fid,
    CAST((l_partkey % 50) * 100 + l_orderkey * 7 % 100 - 10 AS DOUBLE) AS x0,
    CAST(floor(l_partkey / 50) * 100 + (l_linenumber * 13 + l_suppkey * 3) % 100 - 10 AS DOUBLE) AS y0,
    l_quantity AS q, l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS linenumber,
    CASE l_suppkey % 12 WHEN 0 THEN 'lake' WHEN 1 THEN 'forest' WHEN 2 THEN 'grass' WHEN 3 THEN 'scrub' WHEN 4 THEN 'dune' WHEN 5 THEN 'scree'
      WHEN 6 THEN 'parking' WHEN 7 THEN 'works' WHEN 8 THEN NULL ELSE 'building' END AS class
  FROM {lineitem}) f
""")
# annotated shapes on a loose lattice that overlap their neighbours
view("shapes", """
SELECT p_partkey AS shape_id, 1 + p_partkey * 7 % 5 AS class, p_retailprice / 1000 AS acc, p_partkey % 11 AS date, p_size AS p_size,
  CAST((p_partkey % 40) * 150 + p_size * 3 AS DOUBLE) AS x0, CAST(floor(p_partkey / 40) * 150 + p_size AS DOUBLE) AS y0,
  CAST((p_partkey % 40) * 150 + p_size * 3 + 60 + p_partkey * 13 % 300 AS DOUBLE) AS x1,
  CAST(floor(p_partkey / 40) * 150 + p_size + 50 + p_partkey * 17 % 290 AS DOUBLE) AS y1,
  1 - p_size / 100.0 AS weight, 'city' || CAST(p_partkey % 8 AS STRING) AS city FROM {part}
""")
view("points", """
SELECT c_custkey AS point_id, CAST(c_custkey * 37 % 5000 AS DOUBLE) + 0.5 AS x, CAST(floor((c_acctbal + 10000) % 4000) AS DOUBLE) + 0.25 AS y,
  CAST(1 + c_custkey % 6 AS INT) AS label FROM {customer}
""")
view("aoi_boxes", """
SELECT n_nationkey AS aoi, 'Nation ' || n_name AS name, CAST((n_nationkey % 5) * 1000 - n_nationkey * 20 AS DOUBLE) AS minx,
  CAST(floor(n_nationkey / 5) * 900 - n_nationkey * 10 AS DOUBLE) AS miny, CAST((n_nationkey % 5) * 1000 + 700 + n_nationkey * 15 AS DOUBLE) AS maxx,
  CAST(floor(n_nationkey / 5) * 900 + 600 + n_nationkey * 12 AS DOUBLE) AS maxy FROM {nation}
""")


def zones(t):
    return t["zone_boxes"].select("zone_id", "p_size", G.box("minx", "miny", "maxx", "maxy").alias("lbox"))


def feats(t, name="rbox"):
    return t["features"].select("*", G.box("x0", "y0", "x1", "y1").alias(name))


def shapes(t, name="box"):
    return t["shapes"].select("*", G.box("x0", "y0", "x1", "y1").alias(name))


COVER = """CASE WHEN class = 'lake' THEN 'f_water' WHEN class = 'forest' THEN 'f_trees' WHEN class = 'grass' THEN 'f_lowplants'
 WHEN class = 'scrub' THEN 'f_shrub' WHEN class = 'dune' THEN 'f_sand' WHEN class = 'scree' THEN 'f_bare_rock'
 WHEN class = 'parking' THEN 'f_paved_infra' WHEN class = 'works' THEN 'f_industrial_lu' END"""
GROUPS = list(Z.COVER_GROUPS)


@query("zone_cover_fractions", "C1 B16 H19", f"""WITH px AS (SELECT DISTINCT g, x, y FROM (
   SELECT {COVER} AS g, unnest(range(x0::BIGINT, x1::BIGINT)) AS x, y0, y1 FROM features), LATERAL (SELECT unnest(range(y0::BIGINT, y1::BIGINT)) AS y) WHERE g IS NOT NULL),
 z AS (SELECT CAST(floor(y / 100) * 50 + floor(x / 100) AS BIGINT) AS zone_id, g, count(*) AS n FROM px WHERE x >= 0 AND x < 5000 AND y >= 0 GROUP BY ALL)
SELECT zone_boxes.zone_id, {', '.join(f"round(coalesce(sum(n) FILTER (g = '{g}'), 0) / 10000.0::DOUBLE, 6) AS {g}" for g in GROUPS)}
FROM zone_boxes LEFT JOIN z USING (zone_id) GROUP BY 1 -- {{zone_boxes}} {{features}}""", headline=True)
def zone_cover_fractions(t):
    return rounded(Z.cover_fractions(zones(t), feats(t).select("class", "rbox"), CELL, "zone_id"))


@query("zone_union_coverage", "C1 D42", """WITH px AS (SELECT DISTINCT x, y FROM (
   SELECT unnest(range(x0::BIGINT, x1::BIGINT)) AS x, y0, y1 FROM {features} WHERE class = 'building'), LATERAL (SELECT unnest(range(y0::BIGINT, y1::BIGINT)) AS y)),
 z AS (SELECT CAST(floor(y / 100) * 50 + floor(x / 100) AS BIGINT) AS zone_id, count(*) AS n FROM px WHERE x >= 0 AND x < 5000 AND y >= 0 GROUP BY ALL)
SELECT zone_id, round(coalesce(n, 0) / 10000.0::DOUBLE, 6) AS fraction FROM {zone_boxes} LEFT JOIN z USING (zone_id)""")
def zone_union_coverage(t):
    b = feats(t).where(F.col("class") == "building").select("rbox")
    return rounded(S.coverage_fraction(zones(t), b, CELL, "zone_id").select("zone_id", "fraction"))


@query("zone_hit_counts", "C2", """SELECT z.zone_id, count(f.fid) AS n_hits FROM {zone_boxes} z LEFT JOIN
 (SELECT * FROM {features} WHERE class IN ('works', 'parking')) f
 ON f.x0 <= z.maxx AND f.x1 >= z.minx AND f.y0 <= z.maxy AND f.y1 >= z.miny GROUP BY z.zone_id""")
def zone_hit_counts(t):
    f = feats(t).where(F.col("class").isin("works", "parking"))
    return S.hit_counts(zones(t), f, CELL, "zone_id", "fid").select("zone_id", "n_hits")


BLD = """b AS (SELECT z.zone_id, (z.maxx - z.minx) * (z.maxy - z.miny) AS za,
   (least(z.maxx, f.x1) - greatest(z.minx, f.x0)) * (least(z.maxy, f.y1) - greatest(z.miny, f.y0)) AS a, (f.x1 - f.x0) * (f.y1 - f.y0) AS fp,
   CASE WHEN orderkey % 4 > 0 THEN q END AS h, CASE orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'explicit' WHEN 2 THEN 'levels' ELSE 'raster' END AS tier,
   partkey % 2 = 0 OR linenumber % 3 = 0 AS goo, suppkey % 5 > 0 AS tru, orderkey % 6 = 0 AS lar, orderkey % 10 = 0 AS tow
   FROM zone_boxes z JOIN features f ON f.x0 < z.maxx AND f.x1 > z.minx AND f.y0 < z.maxy AND f.y1 > z.miny WHERE f.class = 'building')"""


@query("zone_buildings", "C3 D1", f"""WITH {BLD}, g AS (SELECT zone_id, avg(goo::INT) AS gs FROM b GROUP BY zone_id),
 m AS (SELECT b.zone_id, median(fp) AS med FROM b JOIN g USING (zone_id) WHERE gs < 0.5::DOUBLE OR goo GROUP BY 1),
 s AS (SELECT zone_id, sum(a) / any_value(za) AS bsf, count(*) AS n_buildings, avg(goo::INT) AS gs, avg(fp) AS mf, stddev_pop(fp) / avg(fp) AS cv,
   count(*) / (any_value(za) / 1e6) AS cd, sum(a * h) / sum(a) FILTER (h IS NOT NULL) AS h_mean, max(h) AS h_max,
   coalesce(sum(a) FILTER (tier IN ('explicit', 'levels')), 0) / sum(a) AS ev, coalesce(sum(a) FILTER (tier = 'none'), 0) / sum(a) AS nf,
   coalesce(sum(a) FILTER (lar), 0) / sum(a) AS lf, count(*) FILTER (tow) AS nt, coalesce(sum(a) FILTER (NOT tru), 0) / sum(a) AS ml FROM b GROUP BY zone_id)
SELECT z.zone_id, round(coalesce(bsf, 0), 6) AS bsf, coalesce(n_buildings, 0) AS n_buildings, round(coalesce(gs, 0), 6) AS f_google_source,
  round(coalesce(mf, 0), 6) AS mean_footprint_area, round(cv, 6) AS footprint_area_cv, round(coalesce(cd, 0), 6) AS building_count_density,
  round(h_mean, 6) AS h_mean, h_max, round(coalesce(ev, 0), 6) AS height_evidence_frac, round(coalesce(nf, 0), 6) AS height_none_frac,
  round(coalesce(lf, 0), 6) AS large_lowrise_frac, coalesce(nt, 0) AS n_tower, round(coalesce(ml, 0), 6) AS built_area_ml_frac,
  round(med, 6) AS median_footprint_area FROM zone_boxes z LEFT JOIN s USING (zone_id) LEFT JOIN m USING (zone_id) -- {{zone_boxes}} {{features}}""", headline=True)
def zone_buildings(t):
    o = F.col("orderkey")
    tier = F.when(o % 4 == 0, "none").when(o % 4 == 1, "explicit").when(o % 4 == 2, "levels").otherwise("raster")
    b = feats(t).where(F.col("class") == "building").select(
        "rbox", F.when(o % 4 > 0, F.col("q")).alias("height_m"), tier.alias("height_tier"), G.area(F.col("rbox")).alias("footprint_area_m2"),
        (o % 6 == 0).alias("is_large"), (o % 10 == 0).alias("is_tower"), (F.col("suppkey") % 5 > 0).alias("is_trusted"),
        ((F.col("partkey") % 2 == 0) | (F.col("linenumber") % 3 == 0)).alias("is_google"))
    return rounded(Z.building_stats(zones(t), b, CELL, "zone_id"))


@query("zone_roads", "C4 B16", """WITH s AS (SELECT x0 AS ax, y0 AS ay, x1 + q AS ex, y0 AS ey FROM {features} WHERE class IN ('lake', 'forest') AND orderkey % 2 = 0
   UNION ALL SELECT x0, y0, x0, y1 + q FROM {features} WHERE class IN ('lake', 'forest') AND orderkey % 2 = 1),
 k AS (SELECT z.zone_id, sum(CASE WHEN ay = ey AND ay BETWEEN z.miny AND z.maxy THEN greatest(0, least(ex, z.maxx) - greatest(ax, z.minx))
    WHEN ax = ex AND ax BETWEEN z.minx AND z.maxx THEN greatest(0, least(ey, z.maxy) - greatest(ay, z.miny)) ELSE 0 END) / 1000 AS km
   FROM {zone_boxes} z JOIN s ON s.ax <= z.maxx AND s.ex >= z.minx AND s.ay <= z.maxy AND s.ey >= z.miny GROUP BY z.zone_id)
SELECT z.zone_id, round(coalesce(km, 0) / 0.01::DOUBLE, 6) AS road_length_density,
  round(CASE WHEN km > 0 THEN p_size / greatest(km, 1e-9) WHEN p_size > 0 THEN 10000 ELSE 0 END, 6) AS buildings_per_road_km
FROM {zone_boxes} z LEFT JOIN k USING (zone_id)""")
def zone_roads(t):
    f = t["features"]
    across = F.col("orderkey") % 2 == 0
    seg = f.select("class", "x0", "y0", F.when(across, F.col("x1") + F.col("q")).otherwise(F.col("x0")).alias("x1"),
                   F.when(across, F.col("y0")).otherwise(F.col("y1") + F.col("q")).alias("y1"))
    n = zones(t).select("zone_id", F.col("p_size").alias("n_buildings"))
    return rounded(Z.road_stats(zones(t), seg, n, CELL, "zone_id", ("lake", "forest")))


@query("landuse_overlay", "C17", """WITH j AS (SELECT z.zone_id, f.class AS c, sum((least(z.maxx, f.x1) - greatest(z.minx, f.x0)) * (least(z.maxy, f.y1) - greatest(z.miny, f.y0))) / 10000 AS a
   FROM {zone_boxes} z JOIN {features} f ON f.x0 < z.maxx AND f.x1 > z.minx AND f.y0 < z.maxy AND f.y1 > z.miny WHERE f.class IN ('building', 'grass', 'works') GROUP BY ALL),
 w AS (SELECT zone_id, coalesce(sum(a) FILTER (c = 'building'), 0) AS b, coalesce(sum(a) FILTER (c = 'grass'), 0) AS g, coalesce(sum(a) FILTER (c = 'works'), 0) AS k
   FROM {zone_boxes} LEFT JOIN j USING (zone_id) GROUP BY zone_id)
SELECT zone_id, round(least(b, 1), 6) AS frac_building, round(least(g, 1), 6) AS frac_grass, round(least(k, 1), 6) AS frac_works,
  round(least(b + k, 1), 6) AS built_or_works, round(least(b + g + k, 1), 6) AS frac_any FROM w""")
def landuse_overlay(t):
    f = feats(t).select(F.col("class").alias("category"), "rbox").where(F.col("category").isin("building", "grass", "works"))
    return rounded(Z.landuse_overlay(zones(t), f, CELL, "zone_id", ("building", "grass", "works"), {"built_or_works": ("building", "works")}))


@query("point_area", "C5 E2 A19", """SELECT point_id, coalesce(CAST(aoi AS VARCHAR), '_rural') AS aoi, name FROM (
 SELECT p.point_id, a.aoi, a.name, row_number() OVER (PARTITION BY p.point_id ORDER BY (a.maxx - a.minx) * (a.maxy - a.miny), a.aoi) AS r
 FROM {points} p LEFT JOIN {aoi_boxes} a ON p.x BETWEEN a.minx AND a.maxx AND p.y BETWEEN a.miny AND a.maxy) WHERE r = 1""")
def point_area(t):
    boxes = t["aoi_boxes"].select("aoi", "name", G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    d = S.pick_container(t["points"], boxes, 1000.0, "point_id", F.struct(G.area(F.col("rbox")), F.col("aoi")),
                         {"aoi": F.col("aoi"), "name": F.col("name")})
    return d.select("point_id", F.coalesce(F.col("aoi").cast("string"), F.lit("_rural")).alias("aoi"), "name")


@query("area_index", "D2 A19", """WITH pk AS (SELECT point_id, label, aoi, name FROM (
 SELECT p.point_id, p.label, a.aoi, a.name, row_number() OVER (PARTITION BY p.point_id ORDER BY (a.maxx - a.minx) * (a.maxy - a.miny), a.aoi) AS r
 FROM {points} p JOIN {aoi_boxes} a ON p.x BETWEEN a.minx AND a.maxx AND p.y BETWEEN a.miny AND a.maxy) WHERE r = 1)
SELECT aoi, any_value(name) AS name, count(*) AS n_points, count(DISTINCT label) AS n_classes FROM pk GROUP BY aoi""")
def area_index(t):
    boxes = t["aoi_boxes"].select("aoi", "name", G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    d = S.pick_container(t["points"], boxes, 1000.0, "point_id", F.struct(G.area(F.col("rbox")), F.col("aoi")),
                         {"aoi": F.col("aoi"), "name": F.col("name")})
    return d.where(F.col("aoi").isNotNull()).groupBy("aoi").agg(
        F.min("name").alias("name"), F.count(F.lit(1)).alias("n_points"), F.countDistinct("label").alias("n_classes"))


CTR = "(a.minx + a.maxx) / 2 AS cx, (a.miny + a.maxy) / 2 AS cy"


def _centres(t):
    return t["aoi_boxes"].select("aoi", ((F.col("minx") + F.col("maxx")) / 2).alias("sx"), ((F.col("miny") + F.col("maxy")) / 2).alias("sy"))


@query("nearest_area", "C7", f"""SELECT point_id, aoi, round(d, 6) AS dist FROM (SELECT p.point_id, a.aoi, sqrt((p.x - cx) ** 2 + (p.y - cy) ** 2) AS d,
  row_number() OVER (PARTITION BY point_id ORDER BY sqrt((p.x - cx) ** 2 + (p.y - cy) ** 2), aoi) AS r FROM points p, (SELECT aoi, {CTR} FROM aoi_boxes a) a) WHERE r = 1 -- {{points}} {{aoi_boxes}}""")
def nearest_area(t):
    d = S.nearest(t["points"].select("point_id", "x", "y"), _centres(t), "point_id", "aoi", 400.0, 8000.0)
    return rounded(d.select("point_id", "aoi", "dist"))


@query("area_or_nearest", "C6", f"""SELECT point_id, aoi, inside FROM (SELECT p.point_id, a.aoi, p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy AS inside,
  row_number() OVER (PARTITION BY point_id ORDER BY NOT (p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy), sqrt((p.x - cx) ** 2 + (p.y - cy) ** 2), aoi) AS r
  FROM points p, (SELECT a.*, {CTR} FROM aoi_boxes a) a) WHERE r = 1 -- {{points}} {{aoi_boxes}}""")
def area_or_nearest(t):
    return S.container_or_nearest(
        t["points"].select("point_id", "x", "y"), t["aoi_boxes"].select("aoi", G.box("minx", "miny", "maxx", "maxy").alias("rbox")),
        1000.0, "point_id", "aoi", 400.0, 8000.0)


RANKED = "struct_pack(a := -acc, d := date, k := shape_id)"


@query("conflict_winners", "C8", f"""SELECT a.shape_id, NOT EXISTS (SELECT 1 FROM shapes b WHERE b.class <> a.class AND b.x0 <= a.x1 AND b.x1 >= a.x0 AND b.y0 <= a.y1 AND b.y1 >= a.y0
  AND (b.acc > a.acc OR (b.acc = a.acc AND (b.date < a.date OR (b.date = a.date AND b.shape_id < a.shape_id))))) AS wins FROM shapes a -- {{shapes}}""")
def conflict_winners(t):
    return O.resolve_conflicts(shapes(t), 256.0).select("shape_id", "wins")


NBR = """n AS (SELECT a.shape_id, min(sqrt(greatest(a.x0 - b.x1, b.x0 - a.x1, 0) ** 2 + greatest(a.y0 - b.y1, b.y0 - a.y1, 0) ** 2)) AS d,
   sum(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)) AS o
   FROM shapes a JOIN shapes b ON a.class <> b.class GROUP BY a.shape_id)"""


@query("neighbour_relations", "C9", f"""WITH {NBR} SELECT shape_id, round(CASE WHEN d <= 500 THEN d END, 6) AS nbr_dist_m, coalesce(d < 20, false) AS nbr_conflict,
  round(least(coalesce(o / ((x1 - x0) * (y1 - y0)), 0), 1), 6) AS overlap_frac FROM shapes LEFT JOIN n USING (shape_id) -- {{shapes}}""")
def neighbour_relations(t):
    d = O.neighbour_relations(shapes(t), 256.0, cap=500.0, buffer_m=20.0)
    inf = F.col("nbr_dist_m") == float("inf")
    return rounded(d.select("shape_id", F.when(~inf, F.col("nbr_dist_m")).alias("nbr_dist_m"), "nbr_conflict",
                            F.col("overlap_frac_diff_class").alias("overlap_frac")))


@query("shape_verdicts", "B12 B25 G9 G11", """WITH g AS (SELECT *, (x1 - x0) * (y1 - y0) / 1e6 AS area_km2, 2 * (x1 - x0 + y1 - y0) AS p FROM {shapes}),
 w AS (SELECT g.*, p * p / (4 * pi() * area_km2 * 1e6) AS shape, NOT EXISTS (SELECT 1 FROM {shapes} b WHERE b.class <> g.class AND b.x0 <= g.x1 AND b.x1 >= g.x0 AND b.y0 <= g.y1 AND b.y1 >= g.y0
  AND (b.acc > g.acc OR (b.acc = g.acc AND (b.date < g.date OR (b.date = g.date AND b.shape_id < g.shape_id))))) AS wins FROM g)
SELECT shape_id, round(area_km2, 6) AS area_km2, p AS perimeter_m, round(shape, 6) AS shape, least(x1 - x0, y1 - y0) > 200 AS fits_patch,
  area_km2 >= 0.04::DOUBLE AND shape < 3 AS qc1, wins, area_km2 >= 0.04::DOUBLE AND shape < 3 AND acc >= 0.5 AND wins AS qc_pass FROM w""")
def shape_verdicts(t):
    d = O.qc_flags(shapes(t), 256.0, patch_side=200.0, cap=50.0)
    return rounded(d.select("shape_id", "area_km2", "perimeter_m", "shape", "fits_patch", "qc1", "wins", "qc_pass"))


view("sites", """
SELECT s_suppkey AS site_id, CAST(s_suppkey * 37 % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((s_acctbal + 10000) % 160 AS DOUBLE) - 80 AS lat FROM {supplier}
""")
view("places", """
SELECT c_custkey AS place_id, CAST(c_custkey * 17 % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((c_acctbal + 10000) % 170 AS DOUBLE) - 85 AS lat, c_nationkey AS nation FROM {customer}
""")


@query("far_from_held_out", "C10 B30", """SELECT p.place_id FROM {places} p WHERE NOT EXISTS (SELECT 1 FROM {sites} s WHERE
 2 * 6371.0088::DOUBLE * asin(sqrt(least(1, sin(radians(s.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(s.lat)) * sin(radians(s.lon - p.lon) / 2) ** 2))) < 300)""")
def far_from_held_out(t):
    return S.drop_near(t["places"], t["sites"], "place_id", 300.0).select("place_id")


@query("buffered_exclusion", "C11 C12", """SELECT a.shape_id, EXISTS (SELECT 1 FROM {aoi_boxes} b WHERE b.aoi % 3 = 0 AND b.minx - 50 < a.x1 AND b.maxx + 50 > a.x0 AND b.miny - 50 < a.y1 AND b.maxy + 50 > a.y0) AS excluded,
 EXISTS (SELECT 1 FROM {zone_boxes} z WHERE z.p_size = 7 AND z.minx < a.x1 AND z.maxx > a.x0 AND z.miny < a.y1 AND z.maxy > a.y0) AS overlaps_strict FROM {shapes} a""")
def buffered_exclusion(t):
    held = t["aoi_boxes"].where(F.col("aoi") % 3 == 0).select(G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    strict = t["zone_boxes"].where(F.col("p_size") == 7).select(G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    d = S.flag_overlap(shapes(t, "lbox"), held, 512.0, "shape_id", 50.0, "excluded")
    return S.flag_overlap(d, strict, 512.0, "shape_id", 0.0, "overlaps_strict").select("shape_id", "excluded", "overlaps_strict")


OV = """j AS (SELECT z.zone_id AS p, CASE WHEN s.p_size % 3 = 0 THEN least(s.class, s.class % 5 + 1) || ',' || greatest(s.class, s.class % 5 + 1) ELSE s.class::VARCHAR END AS k,
   s.p_size % 3 = 0 AS coarse, s.class AS c1, s.class % 5 + 1 AS c2, s.acc, (least(z.maxx, s.x1) - greatest(z.minx, s.x0)) * (least(z.maxy, s.y1) - greatest(z.miny, s.y0)) AS a
   FROM zone_boxes z JOIN shapes s ON s.x0 < z.maxx AND s.x1 > z.minx AND s.y0 < z.maxy AND s.y1 > z.miny),
 k AS (SELECT p, k, any_value(coarse) AS coarse, sum(a) AS a, sum(a * acc) AS ca FROM j GROUP BY ALL),
 d AS (SELECT p, sum(a) AS lab, sum(ca) / sum(a) AS conf, coalesce(sum(a) FILTER (coarse), 0) AS cr FROM k GROUP BY p),
 tp AS (SELECT p, k AS dk, a AS da, coarse AS dc FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY a DESC, coarse, k DESC) AS r FROM k) WHERE r = 1),
 f AS (SELECT p, c, sum(w) AS w FROM (SELECT p, c1 AS c, CASE WHEN coarse THEN a / 2 ELSE a END AS w FROM j UNION ALL SELECT p, c2, a / 2 FROM j WHERE coarse) GROUP BY ALL),
 fw AS (SELECT p, sum(w) FILTER (c = 1) / 1e4 AS f1, sum(w) FILTER (c = 5) / 1e4 AS f5 FROM f GROUP BY p),
 ov AS (SELECT z.zone_id AS patch_id, coalesce(f1, 0) AS f_lcz_1, coalesce(f5, 0) AS f_lcz_5, greatest(1 - coalesce(lab, 0) / 1e4, 0) AS unlabelled_frac,
   coalesce(cr, 0) / 1e4 AS coarse_frac, CASE WHEN NOT dc THEN dk::INT END AS dominant_lcz, dk AS dominant_set, coalesce(da, 0) / 1e4 AS dominant_frac, conf AS mean_confidence
   FROM zone_boxes z LEFT JOIN d ON d.p = z.zone_id LEFT JOIN tp ON tp.p = z.zone_id LEFT JOIN fw ON fw.p = z.zone_id)"""
OV_COLS = ["patch_id", "f_lcz_1", "f_lcz_5", "unlabelled_frac", "coarse_frac", "dominant_lcz", "dominant_set", "dominant_frac", "mean_confidence"]


def _overlay(t):
    pair = F.array(F.col("class"), F.col("class") % 5 + 1).cast("array<int>")
    lab = shapes(t, "rbox").select(
        F.when(F.col("p_size") % 3 == 0, pair).otherwise(F.array(F.col("class").cast("int"))).alias("lbl_set"),
        F.col("acc").alias("confidence"), "rbox")
    return O.patch_overlay(lab, zones(t).withColumnRenamed("zone_id", "patch_id"), 256.0)


@query("patch_overlay", "C13", f"""WITH {OV} SELECT patch_id, round(f_lcz_1, 6) AS f_lcz_1, round(f_lcz_5, 6) AS f_lcz_5, round(unlabelled_frac, 6) AS unlabelled_frac,
 round(coarse_frac, 6) AS coarse_frac, dominant_lcz, dominant_set, round(dominant_frac, 6) AS dominant_frac, round(mean_confidence, 6) AS mean_confidence,
 dominant_frac < 0.75::DOUBLE AS boundary_flag FROM ov -- {{zone_boxes}} {{shapes}}""", headline=True)
def patch_overlay(t):
    return rounded(_overlay(t).select(*OV_COLS, "boundary_flag"))


@query("patch_yield", "B33 D48", f"""WITH {OV} SELECT CAST(patch_id % 8 AS INT) AS grp, count(*) AS n, count(*) FILTER (unlabelled_frac < 1) AS touched,
 count(*) FILTER (dominant_lcz IS NOT NULL AND dominant_frac >= 0.75::DOUBLE AND unlabelled_frac <= 0.25::DOUBLE) AS kept FROM ov GROUP BY 1 -- {{zone_boxes}} {{shapes}}""")
def patch_yield(t):
    ov = _overlay(t).withColumn("grp", (F.col("patch_id") % 8).cast("int"))
    kept = O.patch_yield(ov).groupBy("grp").agg(F.count(F.lit(1)).alias("kept"))
    head = ov.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("unlabelled_frac") < 1).alias("touched"))
    return head.join(kept, "grp", "left").fillna(0)


@query("tile_cover_status", "C14 C33", """WITH j AS (SELECT s.shape_id, count(*) AS n, sum((least(z.maxx, s.x1) - greatest(z.minx, s.x0)) * (least(z.maxy, s.y1) - greatest(z.miny, s.y0))) AS a,
   bool_or(z.minx <= s.x0 AND z.maxx >= s.x1 AND z.miny <= s.y0 AND z.maxy >= s.y1) AS one
   FROM {shapes} s JOIN {zone_boxes} z ON s.x0 < z.maxx AND s.x1 > z.minx AND s.y0 < z.maxy AND s.y1 > z.miny WHERE z.p_size > 3 GROUP BY s.shape_id)
SELECT s.shape_id, CASE WHEN a >= (x1 - x0) * (y1 - y0) - 1e-6 THEN 'full' WHEN a > 0 THEN 'partial' ELSE 'none' END AS status,
  coalesce(n, 0) AS n_tiles, coalesce(one, false) AS in_one_tile FROM {shapes} s LEFT JOIN j USING (shape_id)""")
def tile_cover_status(t):
    tiles = t["zone_boxes"].where(F.col("p_size") > 3).select(G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    return S.cover_status(shapes(t, "lbox").select("shape_id", "lbox"), tiles, 256.0, "shape_id").drop("lbox")


@query("zone_adjacency", "C15 M5", """SELECT a.zone_id AS block_a, b.zone_id AS block_b, CASE WHEN least(a.maxx, b.maxx) = greatest(a.minx, b.minx) THEN least(a.maxy, b.maxy) - greatest(a.miny, b.miny)
  ELSE least(a.maxx, b.maxx) - greatest(a.minx, b.minx) END AS shared_len_m
FROM {zone_boxes} a JOIN {zone_boxes} b ON a.zone_id < b.zone_id AND a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy
WHERE (least(a.maxx, b.maxx) = greatest(a.minx, b.minx)) <> (least(a.maxy, b.maxy) = greatest(a.miny, b.miny))""")
def zone_adjacency(t):
    z = t["zone_boxes"].select(F.col("zone_id").alias("block_id"), G.box("minx", "miny", "maxx", "maxy").alias("box"))
    return S.adjacency(z, CELL)


@query("ring_adjacency", "C15", """SELECT a.zone_id AS block_a, b.zone_id AS block_b, 100.0::DOUBLE AS shared_len_m
FROM {zone_boxes} a JOIN {zone_boxes} b ON (b.zone_id = a.zone_id + 1 AND a.zone_id % 50 < 49) OR b.zone_id = a.zone_id + 50""")
def ring_adjacency(t):
    z = t["zone_boxes"].select(F.col("zone_id").alias("block_id"), G.ring_of(G.box("minx", "miny", "maxx", "maxy")).alias("ring"))
    return rounded(S.ring_adjacency(z))


@query("block_homogeneity", "C16 D23", """WITH i AS (SELECT a.aoi, p.* FROM {points} p JOIN {aoi_boxes} a ON p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy),
 c AS (SELECT aoi, count(*) AS m, avg(x) AS cx, avg(y) AS cy FROM i GROUP BY aoi HAVING count(*) >= 2),
 h AS (SELECT aoi, label FROM (SELECT c.aoi, c.m, p.label, row_number() OVER (PARTITION BY c.aoi ORDER BY sqrt((p.x - cx) ** 2 + (p.y - cy) ** 2), p.point_id) AS r FROM c, {points} p) WHERE r <= m),
 q1 AS (SELECT aoi, label, count(*) AS n FROM i GROUP BY aoi, label), q2 AS (SELECT aoi, label, count(*) AS n FROM h GROUP BY aoi, label),
 s1 AS (SELECT *, sum(n) OVER (PARTITION BY aoi) AS t FROM q1), s2 AS (SELECT *, sum(n) OVER (PARTITION BY aoi) AS t FROM q2),
 e1 AS (SELECT aoi, sum(n) AS n, sum(-(n / t) * log2(n / t)) AS e FROM s1 GROUP BY aoi),
 e2 AS (SELECT aoi, sum(-(n / t) * log2(n / t)) AS e FROM s2 GROUP BY aoi)
SELECT aoi AS block_id, e1.n::BIGINT AS n, round(e1.e, 6) AS entropy, round(e2.e, 6) AS hood_entropy FROM e1 JOIN e2 USING (aoi) WHERE e1.n >= 2""")
def block_homogeneity(t):
    blocks = t["aoi_boxes"].select(F.col("aoi").alias("block_id"), G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    return rounded(O.homogeneity(t["points"], blocks, 1000.0, 100.0, 8000.0))


@query("overlap_trust", "C30 F4", """WITH z AS (SELECT *, 1 + zone_id % 5 AS c FROM {zone_boxes} WHERE p_size % 4 = 0),
 j AS (SELECT s.city, s.shape_id, s.class = z.c AS ok FROM {shapes} s JOIN z ON s.x0 < z.maxx AND s.x1 > z.minx AND s.y0 < z.maxy AND s.y1 > z.miny)
SELECT s.city, count(*) AS n_shapes, coalesce(any_value(np), 0) AS n_pairs, round(any_value(ag), 6) AS agreement,
  count(*) FILTER (s.shape_id NOT IN (SELECT shape_id FROM j)) AS n_clean
FROM {shapes} s LEFT JOIN (SELECT city, count(*) AS np, avg(ok::INT) AS ag FROM j GROUP BY city) q USING (city) GROUP BY s.city""")
def overlap_trust(t):
    z = t["zone_boxes"].where(F.col("p_size") % 4 == 0).select((1 + F.col("zone_id") % 5).alias("class"), G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    return rounded(O.overlap_trust(shapes(t, "lbox"), z, 256.0))


@query("tile_multiplicity", "C26", """SELECT s.shape_id, count(z.zone_id) AS bbox_hits,
 count(*) FILTER (s.x0 < z.maxx AND s.x1 > z.minx AND s.y0 < z.maxy AND s.y1 > z.miny) AS true_hits,
 count(DISTINCT CASE WHEN s.x0 < z.maxx AND s.x1 > z.minx AND s.y0 < z.maxy AND s.y1 > z.miny THEN z.zone_id % 3 END) AS n_zones
FROM {shapes} s LEFT JOIN {zone_boxes} z ON s.x0 <= z.maxx AND s.x1 >= z.minx AND s.y0 <= z.maxy AND s.y1 >= z.miny GROUP BY s.shape_id""")
def tile_multiplicity(t):
    tiles = t["zone_boxes"].select((F.col("zone_id") % 3).alias("zone"), G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    return O.tile_multiplicity(shapes(t, "lbox"), tiles, 256.0)


view("value_pixels", """
SELECT r AS row, c AS col, CAST(max(v) AS DOUBLE) AS value FROM (
  SELECT l_orderkey % 400 AS r, l_partkey * 3 % 500 AS c, floor(l_extendedprice / 100) AS v FROM {lineitem}) x GROUP BY r, c
""")


@query("zonal_pixel_stats", "C27 H21", """WITH j AS (SELECT z.zone_id, p.value FROM {zone_boxes} z JOIN {value_pixels} p ON p.col BETWEEN floor(z.minx / 10) AND ceil(z.maxx / 10) - 1 AND p.row BETWEEN floor(z.miny / 10) AND ceil(z.maxy / 10) - 1)
SELECT zone_id, coalesce(count(value), 0) AS n_pixels, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS max,
 round(avg((value > 500)::INT) FILTER (value IS NOT NULL), 6) AS share_above, round(quantile_cont(value, 0.9), 6) AS p90
FROM {zone_boxes} LEFT JOIN j USING (zone_id) GROUP BY zone_id""")
def zonal_pixel_stats(t):
    d = Z.zonal_stats(zones(t), t["value_pixels"], 10.0, "zone_id", threshold=500.0).fillna(0, subset=["n_pixels"])
    return rounded(d)


@query("point_pixel_samples", "C27 B14", """SELECT point_id, value FROM {points} LEFT JOIN {value_pixels} ON col = floor(x / 10) AND row = floor(y / 10)""")
def point_pixel_samples(t):
    return Z.sample_points(t["points"], t["value_pixels"], 10.0).select("point_id", "value")


# ── lattices, placement, descriptors ─────────────────────────────────────────


@query("patch_lattice", "G1", """SELECT aoi, lpad(CAST(j * nx + i AS VARCHAR), 7, '0') AS patch_id, minx + i * 320 AS x0, miny + j * 320 AS y0 FROM (
 SELECT aoi, minx, miny, greatest(ceil((maxx - minx) / 320), 1)::BIGINT AS nx, greatest(ceil((maxy - miny) / 320), 1)::BIGINT AS ny FROM {aoi_boxes}) a,
 LATERAL (SELECT unnest(range(nx)) AS i), LATERAL (SELECT unnest(range(ny)) AS j)""")
def patch_lattice(t):
    d = P.lattice(t["aoi_boxes"].select("aoi", G.box("minx", "miny", "maxx", "maxy").alias("box")), 320.0)
    return d.select("aoi", "patch_id", F.col("patch.minx").alias("x0"), F.col("patch.miny").alias("y0"))


@query("snapped_cells", "G2", """SELECT shape_id, count(*) AS n_pieces, sum((least(x1, (i + 1) * 100) - greatest(x0, i * 100)) * (least(y1, (j + 1) * 100) - greatest(y0, j * 100))) AS area FROM (
 SELECT *, unnest(range(floor(x0 / 100)::BIGINT, ceil(x1 / 100)::BIGINT)) AS i FROM {shapes} WHERE (x1 - x0) * (y1 - y0) > 40000) a,
 LATERAL (SELECT unnest(range(floor(y0 / 100)::BIGINT, ceil(y1 / 100)::BIGINT)) AS j) GROUP BY shape_id""")
def snapped_cells(t):
    d = P.snapped_cells(shapes(t), 100.0, 40000.0)
    return d.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum(G.area(F.col("piece"))).alias("area"))


@query("snapped_grids", "G3", """WITH b AS (SELECT city, min(x0) - 100 AS x0, min(y0) - 100 AS y0, max(x1) + 100 AS x1, max(y1) + 100 AS y1 FROM {shapes} GROUP BY city),
 r AS (SELECT *, 10.0::DOUBLE AS res FROM b)
SELECT city, res, floor(x0 / res) * res AS minx, ceil(y1 / res) * res AS maxy, (ceil(x1 / res) - floor(x0 / res))::BIGINT AS width, (ceil(y1 / res) - floor(y0 / res))::BIGINT AS height FROM r""")
def snapped_grids(t):
    return P.snapped_grid(shapes(t), ["city"], 10.0, 100.0)


@query("macro_split", "G4 C32", """SELECT point_id, floor(x / 250)::BIGINT AS ix, floor(y / 250)::BIGINT AS iy,
 CASE WHEN floor(x / 250)::BIGINT % 3 = 1 AND floor(y / 250)::BIGINT % 3 = 2 THEN 'test' WHEN floor(x / 250)::BIGINT % 3 = 1 AND floor(y / 250)::BIGINT % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM {points}""")
def macro_split(t):
    return P.split_cells(t["points"], (F.lit(0.0), F.lit(0.0)), 250.0).select("point_id", "ix", "iy", "split")


@query("strict_squares", "G6 E5", """WITH c AS (SELECT shape_id, x0, y0, x1, y1, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, i * 100.0::DOUBLE + 50 AS mx, j * 100.0::DOUBLE + 50 AS my
  FROM (SELECT *, unnest(range(ceil(x0 / 100)::BIGINT, floor(x1 / 100)::BIGINT)) AS i FROM {shapes}) a, LATERAL (SELECT unnest(range(ceil(y0 / 100)::BIGINT, floor(y1 / 100)::BIGINT)) AS j)),
 r AS (SELECT shape_id, mx, my, row_number() OVER (PARTITION BY shape_id ORDER BY (mx - cx) ** 2 + (my - cy) ** 2, mx, my) AS r FROM c)
SELECT shape_id, mx AS x, my AS y FROM r WHERE r <= 3
UNION ALL SELECT shape_id, (x0 + x1) / 2, (y0 + y1) / 2 FROM {shapes} WHERE least(x1 - x0, y1 - y0) > 100 AND shape_id NOT IN (SELECT shape_id FROM c)""")
def strict_squares(t):
    d = P.place_squares(shapes(t), 100.0, cap=3)
    cx, cy = G.centre(F.col("square"))
    return d.select("shape_id", cx.alias("x"), cy.alias("y"))


@query("relaxed_squares", "G7 F5", """WITH sm AS (SELECT * FROM {shapes} WHERE p_size % 5 > 0 AND least(x1 - x0, y1 - y0) <= 150),
 cd AS (SELECT shape_id, class, weight, x0, y0, x1, y1, i, j FROM (SELECT *, unnest(range(floor(x0 / 150)::BIGINT, floor(x1 / 150)::BIGINT + 1)) AS i FROM sm) a, LATERAL (SELECT unnest(range(floor(y0 / 150)::BIGINT, floor(y1 / 150)::BIGINT + 1)) AS j)),
 sq AS (SELECT DISTINCT i, j FROM cd),
 hit AS (SELECT sq.i, sq.j, s.class, s.p_size % 5 > 0 AS ok, greatest(s.x0, sq.i * 150) AS ax, least(s.x1, sq.i * 150 + 150) AS bx, greatest(s.y0, sq.j * 150) AS ay, least(s.y1, sq.j * 150 + 150) AS cy
   FROM sq JOIN {shapes} s ON s.x0 < sq.i * 150 + 150 AND s.x1 > sq.i * 150 AND s.y0 < sq.j * 150 + 150 AND s.y1 > sq.j * 150),
 px AS (SELECT i, j, class, bool_or(ok) AS ok FROM (SELECT i, j, class, ok, x, unnest(range(ay::BIGINT, cy::BIGINT)) AS y FROM (SELECT *, unnest(range(ax::BIGINT, bx::BIGINT)) AS x FROM hit)) GROUP BY i, j, class, x, y),
 ar AS (SELECT i, j, class, count(*) AS al, count(*) FILTER (ok) AS own FROM px GROUP BY ALL), tt AS (SELECT i, j, sum(al) AS tot FROM ar GROUP BY ALL),
 k AS (SELECT cd.*, own / 22500 AS dom, (tot - al) / 22500 AS oth, (least(x1, cd.i * 150 + 150) - greatest(x0, cd.i * 150)) * (least(y1, cd.j * 150 + 150) - greatest(y0, cd.j * 150)) AS mine
   FROM cd JOIN ar ON ar.i = cd.i AND ar.j = cd.j AND ar.class = cd.class JOIN tt ON tt.i = cd.i AND tt.j = cd.j WHERE own / 22500 >= 0.4::DOUBLE AND (tot - al) / 22500 <= 0.3::DOUBLE),
 cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY mine DESC, i, j) AS r FROM k) WHERE r <= 2)
SELECT i AS ix, j AS iy, shape_id, class, round(weight * dom, 6) AS weight, round(dom, 6) AS dominant_frac, round(oth, 6) AS other_frac FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY shape_id) AS q FROM cp) WHERE q = 1""")
def relaxed_squares(t):
    s = shapes(t).withColumn("qc_pass", F.col("p_size") % 5 > 0).withColumn("weight", F.col("weight").cast("double"))
    return rounded(P.relaxed_squares(s, 150.0, 256.0, min_own=0.4, max_other=0.3, cap=2))


@query("relaxed_off_strict", "G7 F4", """SELECT shape_id FROM {shapes} a WHERE NOT EXISTS (SELECT 1 FROM {zone_boxes} z WHERE z.p_size % 6 = 0 AND z.minx < a.x1 AND z.maxx > a.x0 AND z.miny < a.y1 AND z.maxy > a.y0)""")
def relaxed_off_strict(t):
    z = t["zone_boxes"].where(F.col("p_size") % 6 == 0).select(G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    return P.without_shared_ground(shapes(t, "lbox"), z, 256.0, "shape_id").select("shape_id")


@query("shape_descriptors", "G9 G10 G11 B12", """WITH g AS (SELECT shape_id, x1 - x0 AS w, y1 - y0 AS h FROM {shapes})
SELECT shape_id, w * h AS area_m2, 2 * (w + h) AS perimeter_m, round(4 * (w + h) ** 2 / (4 * pi() * w * h), 6) AS shape_index, round(4 * pi() * w * h / (4 * (w + h) ** 2), 6) AS compactness,
 round(1 - least(w, h) / greatest(w, h), 6) AS elongation, w * h < 12000 OR least(w, h) <= 90 AS small_or_thin,
 CASE WHEN w * h > 60000 THEN least(w, 160) * least(h, 160) ELSE w * h END AS core_area FROM g""")
def shape_descriptors(t):
    b = F.col("box")
    d = shapes(t).withColumns(Z.geometric_descriptors(b)).withColumns({
        "small_or_thin": G.small_or_thin(b, 12000.0, 90.0), "core_area": G.area(G.oversize_core(b, 60000.0, 80.0))})
    return rounded(d.select("shape_id", "area_m2", "perimeter_m", "shape_index", "compactness", "elongation", "small_or_thin", "core_area"))


@query("shape_ids", "G12 E3", """WITH i AS (SELECT city, shape_id, substr(sha256(city || '|' || printf('%.3f,%.3f,%.3f,%.3f', x0, y0, x1, y1)), 1, 16) AS block_id FROM {shapes})
SELECT shape_id, block_id, row_number() OVER (PARTITION BY city ORDER BY block_id) AS block_idx FROM i""")
def shape_ids(t):
    from zonomy.operators.ordered import with_rank
    d = shapes(t).select("city", "shape_id", G.shape_id("city", F.col("box")).alias("block_id"))
    head = F.conv(F.substring("block_id", 1, 13), 16, 10).cast("double")
    return with_rank(d, ["city"], head, [F.col("block_id")], name="block_idx").select("shape_id", "block_id", "block_idx")


@query("window_starts", "G14", """SELECT aoi, unnest(list_sort(list_distinct(list_append(range(0, greatest((maxx - minx)::BIGINT - 320, 0) + 1, 200), greatest((maxx - minx)::BIGINT - 320, 0))))) AS start FROM {aoi_boxes}""")
def window_starts(t):
    w = (F.col("maxx") - F.col("minx")).cast("long")
    return t["aoi_boxes"].select("aoi", F.explode(P.window_starts(w, 320, 200)).alias("start"))


@query("stride_points", "G13", """WITH b AS (SELECT site_id, lon, lat, 0.2::DOUBLE AS s, 4000 / 111320.0::DOUBLE AS dl FROM {sites}), c AS (SELECT *, dl / cos(radians((lat + (lat + s)) / 2)) AS dx FROM b)
SELECT site_id, (greatest(floor((lon + s - lon) / dx), 0)::BIGINT + 1) * (greatest(floor((lat + s - lat) / dl), 0)::BIGINT + 1) AS n_points FROM c""")
def stride_points(t):
    tiles = t["sites"].select("site_id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), (F.col("lon") + 0.2).alias("lon1"), (F.col("lat") + 0.2).alias("lat1"))
    return P.stride_points(tiles, 4000.0).groupBy("site_id").agg(F.count(F.lit(1)).alias("n_points"))


@query("touched_tiles", "D44", """SELECT DISTINCT i * 7.5 AS lon, j * 7.5 AS lat FROM (SELECT unnest(range(floor((lon - 3) / 7.5)::BIGINT, floor((lon + 3) / 7.5)::BIGINT + 1)) AS i, lat FROM {places}) a,
 LATERAL (SELECT unnest(range(floor((lat - 1) / 7.5)::BIGINT, floor((lat + 1) / 7.5)::BIGINT + 1)) AS j)""".replace("i * 7.5 AS lon, j * 7.5 AS lat", "(i * 7.5)::DOUBLE AS lon, (j * 7.5)::DOUBLE AS lat"))
def touched_tiles(t):
    b = G.box(F.col("lon") - 3, F.col("lat") - 1, F.col("lon") + 3, F.col("lat") + 1)
    return t["places"].select(F.inline(P.touched_tiles(b, 7.5))).distinct()


@query("equal_area_km2", "B8", """WITH k AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257223563::DOUBLE AS f), e AS (SELECT a, f * (2 - f) AS e2 FROM k),
 c AS (SELECT a, e2, sqrt(e2) AS e, cos(radians(30)) / sqrt(1 - e2 * sin(radians(30)) ** 2) AS k0 FROM e),
 q AS (SELECT place_id, a, k0, (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS q0,
   (1 - e2) * (sin(radians(lat + 0.3)) / (1 - e2 * sin(radians(lat + 0.3)) ** 2) - ln((1 - e * sin(radians(lat + 0.3))) / (1 + e * sin(radians(lat + 0.3)))) / (2 * e)) AS q1 FROM {places}, c)
SELECT place_id, round(radians(0.4) * a * k0 * a * (q1 - q0) / (2 * k0) / 1e6, 3) AS area_km2 FROM q""")
def equal_area_km2(t):
    p = t["places"]
    x0, y0 = G.equal_area_xy(F.col("lon"), F.col("lat"))
    x1, y1 = G.equal_area_xy(F.col("lon") + 0.4, F.col("lat") + 0.3)
    ring = G.ring_of(G.box(x0, y0, x1, y1))
    return p.select("place_id", F.round(G.ring_area(ring) / 1e6, 3).alias("area_km2"))


@query("utm_zones", "B9 B10", """SELECT place_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::INT AS epsg, ((floor((lon + 180) / 6) + 1) * 6 - 183)::INT AS meridian,
 round(10 / 111320.0::DOUBLE / cos(radians(lat)), 9) AS factor FROM {places}""")
def utm_zones(t):
    z = G.utm_zone("lon")
    return t["places"].select("place_id", G.utm_epsg("lon", "lat").alias("epsg"), G.utm_meridian(z).alias("meridian"),
                              F.round(G.local_factor(10.0, F.col("lat")), 9).alias("factor"))


@query("utm_round_trip", "B9 G15", """SELECT place_id, round(lon, 6) AS lon, round(lat, 6) AS lat, true AS east_in_zone FROM {places}""")
def utm_round_trip(t):
    p = t["places"].withColumn("m", G.utm_meridian(G.utm_zone("lon")).cast("double"))
    x, y = G.utm_xy(F.col("lon"), F.col("lat"), F.col("m"))
    p = p.withColumns({"e": x, "n": y})
    lon, lat = G.utm_lonlat(F.col("e"), F.col("n"), F.col("m"), F.col("lat") < 0)
    return p.select("place_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"), F.col("e").between(100000, 900000).alias("east_in_zone"))


@query("ring_measures", "B7 B8 B12 C23", """WITH r AS (SELECT shape_id, x0, y0, (x1 - x0) / (CASE WHEN p_size % 9 = 0 THEN 0 ELSE 1 END) AS w0, x1 - x0 AS w, y1 - y0 AS h, p_size FROM {shapes})
SELECT shape_id, w * h / 2 AS area, round(w + h + sqrt(w * w + h * h), 6) AS perimeter, round(x0 + w / 3, 6) AS cx, round(y0 + h / 3, 6) AS cy, true AS holds_quarter, false AS holds_corner FROM r WHERE p_size % 9 > 0""")
def ring_measures(t):
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    bad = F.when(F.col("p_size") % 9 == 0, F.lit(float("nan"))).otherwise(x1)
    d = t["shapes"].select("shape_id", x0, y0, x1, y1, F.array(pt(x0, y0), pt(bad, y0), pt(x0, y1)).alias("ring"))
    d = d.where(G.finite_ring(F.col("ring")))
    r = F.col("ring")
    cx, cy = G.ring_centroid(r)
    return rounded(d.select("shape_id", G.ring_area(r).alias("area"), G.ring_perimeter(r).alias("perimeter"), cx.alias("cx"), cy.alias("cy"),
                            G.in_ring(r, x0 + (x1 - x0) / 4, y0 + (y1 - y0) / 4).alias("holds_quarter"), G.in_ring(r, x1 - 1, y1 - 1).alias("holds_corner")))
