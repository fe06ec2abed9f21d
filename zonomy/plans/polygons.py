"""Zones and features as general polygons: hexagons from parts, triangles from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import hull as H
from zonomy.operators import polygons as P
from zonomy.operators import rings as R
from zonomy.plans import spatial  # noqa: F401  (the views below read its views)
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

CELL = 128.0

# corner lists: three of every feature that is a building, six of every zone
view("triangles", """
SELECT fid, x0 AS px0, y0 AS py0, x1 + 5 AS px1, y0 + orderkey % 9 AS py1, x0 + q % 11 AS px2, y1 + 7 AS py2,
  CASE WHEN orderkey % 4 > 0 THEN q END AS height FROM {features} WHERE class = 'building'
""")
view("hexagons", """
SELECT zone_id, minx + 25 AS px0, miny AS py0, minx + 75 AS px1, miny AS py1, maxx AS px2, miny + 50 AS py2, minx + 75 AS px3, maxy AS py3,
  minx + 25 AS px4, maxy AS py4, minx AS px5, miny + 50 AS py5 FROM {zone_boxes}
""")


def rings(df, corners: int, name: str):
    point = lambda k: F.struct(F.col(f"px{k}").cast("double").alias("x"), F.col(f"py{k}").cast("double").alias("y"))
    return df.withColumn(name, F.array(F.array(*map(point, range(corners)))))


def _side_rows(corners: int, table: str, key: str, shape: str) -> str:
    sides = [(k, (k + 1) % corners) for k in range(corners)]
    return " UNION ALL ".join(
        f"SELECT {key} AS k, {shape} AS s, CASE WHEN py{a} < py{b} THEN px{a} ELSE px{b} END AS ax, least(py{a}, py{b}) AS ay, "
        f"CASE WHEN py{a} < py{b} THEN px{b} ELSE px{a} END AS bx, greatest(py{a}, py{b}) AS by_ FROM {table} WHERE py{a} <> py{b}" for a, b in sides)


# all shapes are convex here, so a shape is one interval of every line; lines lie between neighbouring corners and crossings
SLABS = f"""meets AS MATERIALIZED (SELECT h.zone_id AS z, t.* FROM hexagons h JOIN triangles t ON least(px0_, px1_, px2_) < h.px2 AND greatest(px0_, px1_, px2_) > h.px5
     AND least(py0_, py1_, py2_) < h.py3 AND greatest(py0_, py1_, py2_) > h.py0),
 sides AS MATERIALIZED (SELECT k AS z, s, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, by_::DOUBLE AS by_ FROM ({_side_rows(3, "meets", "z", "fid")} UNION ALL {_side_rows(6, "hexagons", "zone_id", "'zone'")})),
 crossed AS (SELECT z, ay + t * (by_ - ay) AS y FROM (SELECT a.z, a.ay, a.by_, ((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / turn AS t,
   ((b.ax - a.ax) * (a.by_ - a.ay) - (b.ay - a.ay) * (a.bx - a.ax)) / turn AS u FROM (SELECT a, b, (a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax) AS turn
     FROM sides a JOIN sides b ON a.z = b.z AND a.s < b.s AND a.ay < b.by_ AND b.ay < a.by_) WHERE turn <> 0) WHERE t > 0 AND t < 1 AND u > 0 AND u < 1),
 slabs AS (SELECT z, y, lead(y) OVER (PARTITION BY z ORDER BY y) - y AS h FROM (SELECT z, ay AS y FROM sides UNION SELECT z, by_ FROM sides UNION SELECT z, y FROM crossed)),
 lines AS (SELECT l.z, l.y, any_value(l.h) AS h, e.s, min(e.ax + (e.bx - e.ax) * (l.y + l.h / 2 - e.ay) / (e.by_ - e.ay)) AS x0, max(e.ax + (e.bx - e.ax) * (l.y + l.h / 2 - e.ay) / (e.by_ - e.ay)) AS x1
   FROM slabs l JOIN sides e ON e.z = l.z AND e.ay < l.y + l.h / 2 AND e.by_ > l.y + l.h / 2 WHERE l.h > 0 GROUP BY l.z, l.y, e.s),
 inside AS (SELECT t.z, t.y, t.h, t.s, greatest(t.x0, o.x0) AS x0, least(t.x1, o.x1) AS x1 FROM lines t JOIN lines o ON o.z = t.z AND o.y = t.y AND o.s = 'zone' WHERE t.s <> 'zone')""".replace(
    "px0_", "t.px0").replace("px1_", "t.px1").replace("px2_", "t.px2").replace("py0_", "t.py0").replace("py1_", "t.py1").replace("py2_", "t.py2")
TABLES = "-- {hexagons} {triangles}"


@query("polygon_cover", "C1 D42", f"""WITH {SLABS},
 fresh AS (SELECT z, h * greatest(0, x1 - greatest(x0, coalesce(max(x1) OVER (PARTITION BY z, y ORDER BY x0, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x0))) AS a FROM inside WHERE x1 > x0),
 c AS (SELECT z, sum(a) AS covered FROM fresh GROUP BY z)
SELECT zone_id, 7500.0::DOUBLE AS area, round(coalesce(covered, 0), 6) AS covered, round(coalesce(covered, 0) / 7500, 6) AS fraction FROM hexagons LEFT JOIN c ON z = zone_id {TABLES}""")
def polygon_cover(t):
    return rounded(P.polygon_cover(rings(t["hexagons"], 6, "zrings").select("zone_id", "zrings"), rings(t["triangles"], 3, "rings").select("rings"), CELL, "zone_id"))


@query("polygon_buildings", "C3 D1", f"""WITH {SLABS},
 p AS (SELECT z, s, sum(h * (x1 - x0)) AS a FROM inside WHERE x1 > x0 GROUP BY z, s)
SELECT z AS zone_id, count(*) AS n_shapes, round(sum(a), 6) AS shape_area, round(sum(a * height) / sum(a) FILTER (height IS NOT NULL), 6) AS mean_value,
  max(height)::DOUBLE AS max_value FROM p JOIN triangles ON fid = s GROUP BY z {TABLES}""")
def polygon_buildings(t):
    b = rings(t["triangles"], 3, "rings").select("fid", F.col("height").cast("double").alias("height"), "rings")
    pairs = P.polygon_overlaps(rings(t["hexagons"], 6, "zrings").select("zone_id", "zrings"), b.select("fid", "rings"), CELL, "zone_id", "fid")
    return rounded(P.polygon_building_stats(pairs, b, "fid", "zone_id", "height"))


# pixel rows of 5 m; a convex shape has one run a row, between its least and largest crossing
RUNS = f"""e AS (SELECT k, s AS h, ax::DOUBLE AS ax, ay::DOUBLE AS ay, bx::DOUBLE AS bx, by_::DOUBLE AS by_ FROM ({_side_rows(3, "triangles", "fid", "height")})),
 x AS (SELECT k, any_value(h) AS h, row, min(ax + (bx - ax) * ((row + 0.5::DOUBLE) * 5 - ay) / (by_ - ay)) AS x0, max(ax + (bx - ax) * ((row + 0.5::DOUBLE) * 5 - ay) / (by_ - ay)) AS x1
   FROM (SELECT *, unnest(range(ceil(ay / 5 - 0.5::DOUBLE)::BIGINT, ceil(by_ / 5 - 0.5::DOUBLE)::BIGINT)) AS row FROM e) GROUP BY k, row),
 runs AS (SELECT k, h, row, ceil(x0 / 5 - 0.5::DOUBLE)::BIGINT AS c0, ceil(x1 / 5 - 0.5::DOUBLE)::BIGINT - 1 AS c1 FROM x),
 px AS (SELECT k, h, row, unnest(range(c0, c1 + 1)) AS col FROM runs WHERE c1 >= c0)"""


@query("ring_runs", "H1 H2", f"""WITH {RUNS} SELECT k AS fid, row, c0, c1 FROM runs WHERE c1 >= c0 -- {{triangles}}""")
def ring_runs(t):
    return R.ring_runs(rings(t["triangles"], 3, "rings"), ["fid"], 5.0)


@query("ring_burn", "H1 H2", f"""WITH {RUNS} SELECT row, col, k AS shape FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY h DESC NULLS LAST, k DESC) AS r FROM px) WHERE r = 1 -- {{triangles}}""")
def ring_burn(t):
    d = rings(t["triangles"], 3, "rings").withColumn("shape", F.col("fid"))
    return R.burn_rings(d, [], 5.0, "fid", "shape", "height")


@query("ring_labels", "H3 H29", f"""WITH {RUNS}, inner_ AS (SELECT a.k, a.h, a.row, a.col FROM px a JOIN px b ON a.k = b.k AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL HAVING count(*) = 9)
SELECT row, col, min(coalesce(h, 0) % 3)::INT AS label FROM inner_ GROUP BY row, col HAVING min(coalesce(h, 0) % 3) = max(coalesce(h, 0) % 3) -- {{triangles}}""")
def ring_labels(t):
    d = rings(t["triangles"], 3, "rings").withColumn("label", (F.coalesce("height", F.lit(0)) % 3).cast("int"))
    return R.burn_rings_uncontested(d, [], 5.0, "fid", "label", erode_px=1)


# rectangles turned by a whole number of degrees, in two parts that share a point, with points inside
view("turned", """
SELECT p_partkey AS shape_id, 20 + p_size AS a, 5 + p_partkey % 40 AS b, radians(CAST(p_partkey % 90 AS DOUBLE)) AS turn, p_partkey % 7 AS inner_x FROM {part}
""")


@query("turned_rectangles", "G11", """SELECT shape_id, greatest(a, b)::DOUBLE AS long_side, least(a, b)::DOUBLE AS short_side, round(1 - least(a, b) / greatest(a, b)::DOUBLE, 6) AS elongation FROM {turned}""")
def turned_rectangles(t):
    def point(u, v):
        c, s = F.cos("turn"), F.sin("turn")
        return F.struct((u * c - v * s).alias("x"), (u * s + v * c).alias("y"))

    a, b, z = F.col("a"), F.col("b"), F.lit(0.0)
    first = F.array(point(z, z), point(a, z), point(a / 2, b / 2), point(a / 3, F.col("inner_x") * b / 20))
    second = F.array(point(a, b), point(z, b), point(a / 2, b / 2))
    parts = P.dealt(t["turned"]).select("shape_id", F.explode(F.array(F.array(first), F.array(second))).alias("rings"))
    d = P.part_hulls(parts, ["shape_id"]).withColumn("r", H.smallest_rectangle("hull"))
    return rounded(d.select("shape_id", F.col("r.long").alias("long_side"), F.col("r.short").alias("short_side"), H.elongation_of(F.col("r")).alias("elongation")))


# L-shapes: the widest circle sits in the corner unless one arm is twice as wide as the other
view("angles", """SELECT p_partkey AS shape_id, CAST(10 + p_partkey % 23 AS DOUBLE) AS a, CAST(8 + p_size % 31 AS DOUBLE) AS b FROM {part}""")


@query("thin_angles", "G9", """WITH w AS (SELECT shape_id, a, b, 2 * CASE WHEN b >= 2 * a THEN b / 2 WHEN a >= 2 * b THEN a / 2 ELSE a + b - sqrt(2 * a * b) END AS width FROM {angles})
SELECT shape_id, width <= 20.613::DOUBLE AS thin, 120 * (a + b) - a * b < 3333.5::DOUBLE OR width <= 20.613::DOUBLE AS small_or_thin FROM w""")
def thin_angles(t):
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not isinstance(x, str) else F.col(x).alias("x"), F.lit(y).cast("double").alias("y") if not isinstance(y, str) else F.col(y).alias("y"))
    ring = F.array(p(0, 0), p(120, 0), p(120, "a"), p("b", "a"), p("b", 120), p(0, 120))
    d = t["angles"].withColumn("rings", F.array(ring))
    thin, either = (P.small_or_thin(F.col("rings"), area, 20.613, 0.02) for area in (0.0, 3333.5))
    return d.select("shape_id", thin.alias("thin"), either.alias("small_or_thin"))
