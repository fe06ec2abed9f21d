"""Label grids as pixel tables: burning, merging, pooling, smoothing, filling, cropping."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.operators import graph as N
from zonomy.operators import patches as P
from zonomy.operators import pixels as X
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded
from zonomy.plans.spatial import shapes

H = W = 96
GR = ["g"]

view("cells96", """
SELECT g, r AS row, c AS col, count(*) AS n, max(q) AS q, min(q) AS q0 FROM (
  SELECT l_linenumber % 2 AS g, l_orderkey % 96 AS r, l_partkey % 96 AS c, l_quantity AS q FROM {lineitem}) x GROUP BY g, r, c
""")
# coherent classes with noise; every 40th column and some scattered cells are nodata
view("class_pixels", """
SELECT g, row, col, CAST(CASE WHEN q % 5 = 1 THEN 1 + q % 17 ELSE 1 + (floor(row / 16) * 3 + floor(col / 16) * 5) % 17 END AS INT) AS class,
  q / 50 AS confidence, CAST(floor(row / 16) * 6 + floor(col / 16) + 1 AS BIGINT) AS block FROM {cells96} WHERE col % 40 <> 39 AND q % 11 <> 0
""")
view("set_pixels", """
SELECT g, row, col, CAST(CASE WHEN (row + col) % 29 = 0 THEN 3 ELSE power(2, floor(floor(row / 8) * 3 + floor(col / 12)) % 17) END AS BIGINT) AS bitmask,
  q / 50 AS confidence, 1 + q0 / 10 AS n_eff FROM {cells96} WHERE q % 13 <> 0
""")

CNT = "SELECT g, floor(row / 4)::BIGINT AS brow, floor(col / 4)::BIGINT AS bcol"


@query("majority_pool", "H6 H15", """WITH c AS (SELECT g, floor(row / 5)::BIGINT AS brow, floor(col / 5)::BIGINT AS bcol, class, count(*) AS n FROM {class_pixels} WHERE row < 95 AND col < 95 GROUP BY ALL)
SELECT g, brow, bcol, class, nv AS n_valid FROM (SELECT *, sum(n) OVER (PARTITION BY g, brow, bcol)::BIGINT AS nv, row_number() OVER (PARTITION BY g, brow, bcol ORDER BY n DESC, class) AS r FROM c) WHERE r = 1""", headline=True)
def majority_pool(t):
    return X.majority_pool(t["class_pixels"], GR, 5, height=H, width=W)


@query("mean_pool", "H7", """SELECT g, floor(row / 4)::BIGINT AS brow, floor(col / 4)::BIGINT AS bcol, round(avg(confidence), 6) AS confidence FROM {class_pixels} GROUP BY ALL""")
def mean_pool(t):
    return rounded(X.mean_pool(t["class_pixels"], GR, 4, "confidence"))


@query("interior_mask", "H8", """SELECT a.g, a.row, a.col FROM {class_pixels} a JOIN {class_pixels} b ON a.g = b.g AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1
WHERE a.confidence >= 0.5::DOUBLE GROUP BY a.g, a.row, a.col
HAVING min(b.block) = max(b.block) AND count(*) = (least(any_value(a.row) + 1, 95) - greatest(any_value(a.row) - 1, 0) + 1) * (least(any_value(a.col) + 1, 95) - greatest(any_value(a.col) - 1, 0) + 1)""")
def interior_mask(t):
    d = t["class_pixels"].withColumn("bitmask", F.lit(1))
    return X.erosion_valid(d, GR, H, W, 1, 0.5).select("g", "row", "col")


@query("erosion_survival", "H18", """WITH i AS (SELECT a.g, a.class, a.row, a.col, count(*) AS m, min(b.class) = max(b.class) AS same FROM {class_pixels} a JOIN {class_pixels} b ON a.g = b.g AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.g, a.class, a.row, a.col)
SELECT g, class, count(*) AS n, round(avg((m = 9 AND same)::INT), 6) AS interior_share FROM i GROUP BY ALL""")
def erosion_survival(t):
    return rounded(X.survival_share(t["class_pixels"], GR, "class", H, W))


def _gauss_sql(sig_expr: str, factor: int) -> str:
    return f"""WITH s AS (SELECT c, {sig_expr} AS s, floor(4 * ({sig_expr}) + 0.5::DOUBLE)::INT AS r FROM (SELECT unnest(range(1, 18))::INT AS c)),
 k1 AS (SELECT c, d, exp(-0.5::DOUBLE * (d / s) ** 2) AS w FROM (SELECT *, unnest(range(-r, r + 1)) AS d FROM s)), k AS (SELECT c, d, w / sum(w) OVER (PARTITION BY c) AS w FROM k1),
 v AS (SELECT g, row + a.d AS row, col + b.d AS col, class, sum(a.w * b.w) AS w FROM class_pixels JOIN k a ON a.c = class JOIN k b ON b.c = class GROUP BY ALL),
 p AS (SELECT g, floor(row / {factor})::BIGINT AS row, floor(col / {factor})::BIGINT AS col, class, sum(w) AS w FROM v WHERE row >= 0 AND col >= 0 AND row < {96 // factor * factor} AND col < {96 // factor * factor} GROUP BY ALL),
 cv AS (SELECT g, floor(row / {factor})::BIGINT AS row, floor(col / {factor})::BIGINT AS col FROM class_pixels GROUP BY ALL HAVING count(*) >= 0.5::DOUBLE * {factor * factor})
SELECT g, row, col, class FROM (SELECT p.*, row_number() OVER (PARTITION BY g, row, col ORDER BY round(w, 12) DESC, class) AS r FROM p JOIN cv USING (g, row, col)) WHERE r = 1 -- {{class_pixels}}"""


SIGMA = {c: 1.5 if c <= 10 else 0.75 for c in range(1, 18)}


@query("gaussian_filter", "H9", _gauss_sql("CASE WHEN c <= 10 THEN 1.5::DOUBLE ELSE 0.75::DOUBLE END", 1))
def gaussian_filter(t):
    return X.gaussian_filter(t["class_pixels"], GR, "g int", SIGMA, H, W, tile=32)


@query("gaussian_coarsen", "H9 H32 H23", _gauss_sql("CASE WHEN c <= 10 THEN 1.5::DOUBLE ELSE 0.75::DOUBLE END", 4), headline=True)
def gaussian_coarsen(t):
    return X.gaussian_filter(t["class_pixels"], GR, "g int", SIGMA, H, W, factor=4, tile=32)


GAPS = """alls AS (SELECT g, r AS row, c AS col FROM (SELECT DISTINCT g FROM class_pixels), (SELECT unnest(range(96)) AS r), (SELECT unnest(range(96)) AS c)),
 gap AS (SELECT * FROM alls ANTI JOIN class_pixels USING (g, row, col))"""


@query("fill_gaps", "H11", f"""WITH {GAPS}, f AS (SELECT gap.g, gap.row, gap.col, p.class, row_number() OVER (PARTITION BY gap.g, gap.row, gap.col ORDER BY (gap.row - p.row) ** 2 + (gap.col - p.col) ** 2, p.row, p.col) AS r
  FROM gap JOIN class_pixels p ON p.g = gap.g AND (gap.row - p.row) ** 2 + (gap.col - p.col) ** 2 <= 4 AND abs(gap.row - p.row) <= 2)
SELECT g, row, col, class FROM class_pixels UNION ALL SELECT g, row, col, class FROM f WHERE r = 1 -- {{class_pixels}}""")
def fill_gaps(t):
    return X.fill_gaps(t["class_pixels"], GR, 2, H, W)


@query("seam_fill", "H12", f"""WITH {GAPS}, c AS (SELECT gap.g, gap.row, gap.col, p.class, count(*) AS n FROM gap JOIN class_pixels p ON p.g = gap.g AND abs(gap.row - p.row) <= 1 AND abs(gap.col - p.col) <= 1 GROUP BY ALL),
 m AS (SELECT *, sum(n) OVER (PARTITION BY g, row, col) AS tn, row_number() OVER (PARTITION BY g, row, col ORDER BY n DESC, class) AS r FROM c)
SELECT g, row, col, class FROM class_pixels UNION ALL SELECT g, row, col, class FROM m WHERE r = 1 AND tn >= 6 -- {{class_pixels}}""")
def seam_fill(t):
    return X.seam_fill(t["class_pixels"], GR, H, W)


def _cc_sql(src: str, value: str) -> str:
    """Region of each pixel: the smallest pixel id reachable over 4-neighbours of equal value."""
    return f"""px AS (SELECT g, row * 96 + col AS id, row, col, {value} AS k FROM {src}),
 e AS (SELECT a.g, a.id AS a, b.id AS b FROM px a JOIN px b ON a.g = b.g AND a.k = b.k AND ((b.id = a.id + 1 AND b.row = a.row) OR b.id = a.id + 96)),
 e2 AS (SELECT g, a, b FROM e UNION ALL SELECT g, b, a FROM e),
 rc AS (SELECT g, id, id AS root FROM px UNION SELECT rc.g, e2.b, rc.root FROM rc JOIN e2 ON e2.g = rc.g AND e2.a = rc.id WHERE rc.root < e2.b),
 cc AS (SELECT g, id, min(root) AS root FROM rc GROUP BY g, id)"""


@query("repair_seams", "H10 H32", f"""WITH RECURSIVE {GAPS}, {_cc_sql('gap', '1')},
 nd AS (SELECT gap.g, gap.row, gap.col, p.class, row_number() OVER (PARTITION BY gap.g, gap.row, gap.col ORDER BY (gap.row - p.row) ** 2 + (gap.col - p.col) ** 2, p.row, p.col) AS r
  FROM gap JOIN class_pixels p ON p.g = gap.g AND (gap.row - p.row) ** 2 + (gap.col - p.col) ** 2 <= 4),
 f AS (SELECT gap.g, gap.row, gap.col, cc.root, nd.class FROM gap JOIN cc ON cc.g = gap.g AND cc.id = gap.row * 96 + gap.col LEFT JOIN nd ON nd.g = gap.g AND nd.row = gap.row AND nd.col = gap.col AND nd.r = 1),
 thin AS (SELECT g, root FROM f GROUP BY g, root HAVING count(class) = count(*))
SELECT g, row, col, class FROM class_pixels UNION ALL SELECT f.g, f.row, f.col, f.class FROM f SEMI JOIN thin USING (g, root) -- {{class_pixels}}""")
def repair_seams(t):
    return X.repair_seams(t["class_pixels"], GR, H, W)


@query("consensus_regions", "K2", f"""WITH RECURSIVE {_cc_sql('set_pixels', 'bitmask')}
SELECT s.g, count(*) AS n_pixels, any_value(bitmask) AS bitmask, (CASE WHEN any_value(bitmask) = 4 THEN 2 ELSE 1 END)::INT AS source, round(avg(confidence), 6) AS confidence, round(avg(n_eff), 6) AS n_eff,
 CASE WHEN bit_count(any_value(bitmask)) = 1 THEN 'hard' ELSE 'coarse' END AS label_type,
 CASE WHEN any_value(bitmask) = 4 THEN 'authoritative' WHEN avg(n_eff) >= 3 THEN 'consensus_deep' ELSE 'consensus_shallow' END AS block_kind
FROM set_pixels s JOIN cc ON cc.g = s.g AND cc.id = s.row * 96 + s.col GROUP BY s.g, root HAVING count(*) >= 10 -- {{set_pixels}}""")
def consensus_regions(t):
    d = t["set_pixels"].withColumn("source", F.when(F.col("bitmask") == 4, 2).otherwise(1))
    return rounded(N.consensus_regions(d, GR, 10.0, 1000.0).drop("region"))


@query("region_pixel_runs", "K2", """WITH r AS (SELECT g, row, col, bitmask, col - row_number() OVER (PARTITION BY g, row, bitmask ORDER BY col) AS i FROM {set_pixels})
SELECT g, row, min(col) AS c0, max(col) AS c1, bitmask, count(*) AS n FROM r GROUP BY g, row, bitmask, i""")
def region_pixel_runs(t):
    return N.pixel_runs(t["set_pixels"], GR, "bitmask").select("g", "row", "c0", "c1", "bitmask", "n")


@query("burn_shapes", "H1 H2 H30", """WITH p AS (SELECT shape_id, acc, class, i AS row, unnest(range(ceil(x0 / 20 - 0.5)::BIGINT, ceil(x1 / 20 - 0.5)::BIGINT)) AS col FROM (SELECT *, unnest(range(ceil(y0 / 20 - 0.5)::BIGINT, ceil(y1 / 20 - 0.5)::BIGINT)) AS i FROM {shapes}))
SELECT row, col, shape_id, class FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY acc DESC, shape_id DESC) AS r FROM p) WHERE r = 1""", headline=True)
def burn_shapes(t):
    s = shapes(t).withColumn("pair", F.struct("shape_id", "class"))
    return X.burn(s, [], 20.0, "pair", F.struct("acc", "shape_id")).select("row", "col", "pair.*")


@query("burn_uncontested", "H3 H29", """WITH p AS (SELECT shape_id, acc, class, i AS row, unnest(range(ceil((x0 + 20) / 20 - 0.5)::BIGINT, ceil((x1 - 20) / 20 - 0.5)::BIGINT)) AS col FROM (SELECT *, unnest(range(ceil((y0 + 20) / 20 - 0.5)::BIGINT, ceil((y1 - 20) / 20 - 0.5)::BIGINT)) AS i FROM {shapes} WHERE x1 - x0 > 40 AND y1 - y0 > 40))
SELECT row, col, any_value(class) AS class FROM p GROUP BY row, col HAVING min(class) = max(class)""")
def burn_uncontested(t):
    return X.burn_uncontested(shapes(t), [], 20.0, "class", F.struct("acc", "shape_id"), erode_px=1)


@query("evidence_bands", "H19 H17", """WITH p AS (SELECT class, i AS row, unnest(range(ceil(x0 / 20 - 0.5)::BIGINT, ceil(x1 / 20 - 0.5)::BIGINT)) AS col FROM (SELECT *, unnest(range(ceil(y0 / 20 - 0.5)::BIGINT, ceil(y1 / 20 - 0.5)::BIGINT)) AS i FROM {shapes}))
SELECT row, col, array_to_string(list_sort(list_distinct(list(class))), ',') AS bands, max(class) AS band, bool_or(class IN (1, 2)) AS building FROM p GROUP BY ALL""")
def evidence_bands(t):
    e = X.evidence_bands(shapes(t), [], 20.0, "class", building_bands=(1, 2))
    return e.select("row", "col", F.array_join(F.col("bands").cast("array<string>"), ",").alias("bands"), "band", "building")


@query("merge_layers", "H4 H31 B42 B43", """WITH l AS (SELECT g, row, col, CASE WHEN q >= 3 AND q < 10 THEN 3 WHEN q >= 10 AND q < 25 THEN 2 WHEN q >= 25 THEN 1 END AS v, 0 AS layer FROM {cells96}
  UNION ALL SELECT g, row, col, CASE WHEN q0 >= 20 THEN 11 WHEN q0 >= 8 THEN 12 END, 1 FROM {cells96} UNION ALL SELECT g, row, col, CASE WHEN n >= 6 THEN 10 END, 2 FROM {cells96})
SELECT g, row, col, arg_max(v, layer)::INT AS value, max(layer)::INT AS layer FROM l WHERE v IS NOT NULL GROUP BY g, row, col""")
def merge_layers(t):
    c = t["cells96"]
    q, q0, n = (F.col(x).cast("double") for x in ("q", "q0", "n"))
    layers = [c.select("g", "row", "col", e.alias("value")).where("value is not null") for e in (
        X.height_tiers(q, ((3, 3), (10, 2), (25, 1))), X.height_tiers(q0, ((8, 12), (20, 11))), X.presence_class(n, 6, 10))]
    return X.merge_layers(layers, GR)


@query("authority_overlay", "H4 H5", """WITH tr AS (SELECT g, row, col, class FROM {class_pixels} WHERE block % 3 = 0)
SELECT coalesce(s.g, t.g) AS g, coalesce(s.row, t.row) AS row, coalesce(s.col, t.col) AS col, CASE WHEN t.class IS NOT NULL THEN (1::BIGINT << (t.class - 1)) ELSE bitmask END AS bitmask,
 CASE WHEN t.class IS NOT NULL THEN 1 ELSE confidence END AS confidence, (CASE WHEN t.class IS NOT NULL THEN 2 ELSE 1 END)::INT AS source, coalesce(n_eff, 0) AS n_eff
FROM {set_pixels} s FULL JOIN tr t ON s.g = t.g AND s.row = t.row AND s.col = t.col""")
def authority_overlay(t):
    return X.overlay_authority(t["set_pixels"], t["class_pixels"].where(F.col("block") % 3 == 0), GR)


@query("teacher_fusion", "H5 B45", """WITH te AS (SELECT g, row, col, class FROM {class_pixels} WHERE confidence >= 0.6::DOUBLE AND block % 6 <> 1), tr AS (SELECT g, row, col, class FROM {class_pixels} WHERE block % 7 = 2)
SELECT coalesce(a.g, b.g) AS g, coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, coalesce(b.class, a.class) AS class FROM te a FULL JOIN tr b ON a.g = b.g AND a.row = b.row AND a.col = b.col""")
def teacher_fusion(t):
    p = t["class_pixels"]
    return X.fuse_teacher(p, p.where(F.col("block") % 7 == 2), p.where(F.col("block") % 6 == 1), GR, 0.6)


@query("source_merge", "H14 H13", """WITH s AS (SELECT g, row, col, class, block % 4 AS source FROM {class_pixels} UNION ALL SELECT g, row, col + 3, class, 4 + block % 3 FROM {class_pixels}),
 n AS (SELECT g, source, count(*) AS n FROM s GROUP BY ALL)
SELECT g, row, col, class, source FROM (SELECT s.*, row_number() OVER (PARTITION BY g, row, col ORDER BY n DESC, source DESC) AS r FROM s JOIN n USING (g, source)) WHERE r = 1""")
def source_merge(t):
    p = t["class_pixels"]
    a = p.select("g", "row", "col", "class", (F.col("block") % 4).alias("source"))
    b = p.select("g", "row", (F.col("col") + 3).alias("col"), "class", (4 + F.col("block") % 3).alias("source"))
    return X.merge_sources(a.unionByName(b), GR, "source", "class")


@query("common_grid", "H13", """SELECT g, CAST(floor((g * 960 + (col + 0.5) * 10 + 480) / 15) AS BIGINT) AS col, CAST(floor((2000 - (960 - (row + 0.5) * 10)) / 15) AS BIGINT) AS row, class FROM {class_pixels}""")
def common_grid(t):
    d = t["class_pixels"].select("g", "row", "col", "class", (F.col("g") * 960.0).alias("minx"), F.lit(960.0).alias("maxy"))
    return X.to_common_grid(d, 10.0, (-480.0, 2000.0), 15.0)


@query("class_volume_pool", "H23 H22", """WITH w AS (SELECT g, row, col, class, 0.625::DOUBLE AS p FROM {class_pixels} UNION ALL SELECT g, row, col, class % 17 + 1, 0.375::DOUBLE FROM {class_pixels}),
 c AS (SELECT g, floor(row / 4)::BIGINT AS brow, floor(col / 4)::BIGINT AS bcol, class, sum(p) AS p FROM w GROUP BY ALL), n AS (SELECT g, floor(row / 4)::BIGINT AS brow, floor(col / 4)::BIGINT AS bcol, count(*) AS n FROM {class_pixels} GROUP BY ALL)
SELECT g, brow, bcol, class::INT AS class, round(p / n, 6) AS confidence, n / 16 AS coverage FROM (SELECT c.*, n, row_number() OVER (PARTITION BY g, brow, bcol ORDER BY round(p, 9) DESC, class) AS r FROM c JOIN n USING (g, brow, bcol)) WHERE r = 1 AND n >= 8""")
def class_volume_pool(t):
    c = F.col("class")
    probs = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: F.when(k == c, 0.625).when(k == c % 17 + 1, 0.375).otherwise(0.0))
    return rounded(X.pool_class_volume(t["class_pixels"].withColumn("probs", probs), GR, 4, "soft"))


@query("window_soft_vote", "H22", """WITH w AS (SELECT g, row AS row0, col AS col0, class FROM {class_pixels}),
 p AS (SELECT g, row0 + i AS row, col0 + j AS col, class, (greatest(0.5 - 0.5 * cos(2 * pi() * i / 3), 0.001) * greatest(0.5 - 0.5 * cos(2 * pi() * j / 3), 0.001))::DOUBLE AS w FROM w, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)),
 s AS (SELECT g, row, col, class, sum(w) AS s FROM p GROUP BY ALL)
SELECT g, row, col, class::INT AS class, round(p, 5) AS p FROM (SELECT *, s / sum(s) OVER (PARTITION BY g, row, col) AS p, row_number() OVER (PARTITION BY g, row, col ORDER BY round(s / (SELECT sum(z.s) FROM s z WHERE z.g = s.g AND z.row = s.row AND z.col = s.col), 8) DESC, class) AS r FROM s) WHERE r = 1""")
def window_soft_vote(t):
    probs = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda k: (k == F.col("class")).cast("double"))
    w = t["class_pixels"].select("g", F.col("row").alias("row0"), F.col("col").alias("col0"), F.lit(4).alias("size"), probs.alias("probs"))
    d = X.window_vote(w, GR, taper=True).withColumn("_r", F.transform("probs", lambda x: F.round(x, 8)))
    return d.select("g", "row", "col", F.array_position("_r", F.array_max("_r")).cast("int").alias("class"), F.round(F.array_max("probs"), 5).alias("p"))


@query("density_bins", "H16", """WITH d AS (SELECT g, r AS row, c AS col, coalesce((class <= 10)::INT, 0) AS b FROM (SELECT DISTINCT g FROM {class_pixels}) a, (SELECT unnest(range(96)) AS r), (SELECT unnest(range(96)) AS c) LEFT JOIN {class_pixels} p USING (g) WHERE false),
 al AS (SELECT g, r AS row, c AS col FROM (SELECT DISTINCT g FROM {class_pixels}), (SELECT unnest(range(96)) AS r), (SELECT unnest(range(96)) AS c)),
 f AS (SELECT al.g, al.row, al.col, coalesce((class <= 10)::INT, 0) AS b FROM al LEFT JOIN {class_pixels} p ON p.g = al.g AND p.row = al.row AND p.col = al.col),
 o AS (SELECT unnest(range(-2, 3)) AS o), m AS (SELECT al.g, al.row, al.col, sum(f.b) AS s FROM al, o a, o b2 JOIN f ON f.g = al.g AND f.row = greatest(least(al.row + a.o, 95), 0) AND f.col = greatest(least(al.col + b2.o, 95), 0) GROUP BY ALL)
SELECT g, row, col, (CASE WHEN s / 25 >= 0.4::DOUBLE + 1e-9 THEN 2 WHEN s / 25 >= 0.2::DOUBLE + 1e-9 THEN 1 ELSE 0 END)::INT AS bin FROM m""".replace("""WITH d AS (SELECT g, r AS row, c AS col, coalesce((class <= 10)::INT, 0) AS b FROM (SELECT DISTINCT g FROM {class_pixels}) a, (SELECT unnest(range(96)) AS r), (SELECT unnest(range(96)) AS c) LEFT JOIN {class_pixels} p USING (g) WHERE false),
 al AS""", "WITH al AS"))
def density_bins(t):
    p = t["class_pixels"].select("g", "row", "col", (F.col("class") <= 10).cast("int").alias("b"))
    dense = X.densify(p, p.select("g").distinct(), GR, "b", H, W)
    return X.density_bins(dense, GR, "b", 5, H, W, 0.2 + 1e-9, 0.4 + 1e-9).select("g", "row", "col", "bin")


@query("candidate_windows", "H20 E8", """WITH cd AS (SELECT g, row, col, row * 96 + col AS id FROM {class_pixels} WHERE confidence > 0.9::DOUBLE), o AS (SELECT unnest(range(-3, 4)) AS o),
 w AS (SELECT cd.g, cd.id, p.class, p.confidence FROM cd, o a, o b JOIN {class_pixels} p ON p.g = cd.g AND p.row = greatest(least(cd.row + a.o, 95), 0) AND p.col = greatest(least(cd.col + b.o, 95), 0)),
 c AS (SELECT g, id, class, count(*) AS n, sum(confidence) AS s FROM w GROUP BY ALL)
SELECT g * 10000 + id AS cand, sum(n)::BIGINT AS n_valid, arg_max(class, n * 100 - class)::INT AS class, round(max(n) / sum(n), 6) AS purity, round(sum(s) / sum(n), 6) AS mean_prob FROM c GROUP BY ALL""")
def candidate_windows(t):
    p = t["class_pixels"]
    cand = p.where(F.col("confidence") > 0.9).select("g", "row", "col", (F.col("g") * 10000 + F.col("row") * 96 + F.col("col")).cast("long").alias("cand"))
    return rounded(X.window_stats(p, cand, GR, "cand", 3, H, W))


@query("patch_crops", "H26", """WITH s AS (SELECT p_partkey AS pid, p_partkey % 2 AS g, p_partkey % 90 AS r0, p_size % 90 AS c0, 8 AS h, 8 AS w FROM {part}),
 j AS (SELECT pid, count(*) AS n, max(p.row) - min(p.row) + 1 AS gh, max(p.col) - min(p.col) + 1 AS gw FROM s JOIN {class_pixels} p ON p.g = s.g AND p.row BETWEEN r0 AND r0 + 7 AND p.col BETWEEN c0 AND c0 + 7 GROUP BY pid)
SELECT s.pid, coalesce(n, 0) AS n, coalesce(gh, 0) AS got_h, coalesce(gw, 0) AS got_w, coalesce(gh < 8 OR gw < 8, true) AS truncated FROM s LEFT JOIN j USING (pid)""")
def patch_crops(t):
    s = _windows(t)
    return X.crop_report(X.crop(t["class_pixels"], s, GR, "pid"), s, "pid").select("pid", "n", "got_h", "got_w", "truncated")


def _windows(t):
    return t["part"].select(F.col("p_partkey").alias("pid"), (F.col("p_partkey") % 2).alias("g"), (F.col("p_partkey") % 90).alias("r0"),
                            (F.col("p_size") % 90).cast("long").alias("c0"), F.lit(8).alias("h"), F.lit(8).alias("w"))


@query("resample_crops", "H28", """WITH s AS (SELECT p_partkey AS pid, p_partkey % 2 AS g, p_partkey % 90 AS r0, p_size % 90 AS c0 FROM {part})
SELECT s.pid, a.i AS row, b.i AS col, p.class FROM s, (SELECT unnest(range(5)) AS i) a, (SELECT unnest(range(5)) AS i) b
JOIN {class_pixels} p ON p.g = s.g AND p.row = r0 + floor((a.i + 0.5) * 8 / 5)::BIGINT AND p.col = c0 + floor((b.i + 0.5) * 8 / 5)::BIGINT""")
def resample_crops(t):
    return X.resample_nearest(X.crop(t["class_pixels"], _windows(t), GR, "pid"), "pid", 5, 5, "class")


@query("tile_floor", "H25", """SELECT g, floor(row / 16)::BIGINT AS ty, floor(col / 16)::BIGINT AS tx, count(*) AS n FROM {class_pixels} GROUP BY ALL HAVING count(*) >= 205""")
def tile_floor(t):
    return X.tiles_with_enough(t["class_pixels"], GR, 16, 205).select("g", "ty", "tx", "n").distinct()


@query("aux_stack", "H27", """SELECT coalesce(a.g, b.g) AS g, coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, round(coalesce(a.q / 50, 0), 6) AS height, round(coalesce(b.confidence / 10000, 0), 9) AS built
FROM {cells96} a FULL JOIN {class_pixels} b ON a.g = b.g AND a.row = b.row AND a.col = b.col""")
def aux_stack(t):
    d = X.combine_aux({"height": (t["cells96"].withColumnRenamed("q", "value"), 50.0),
                       "built": (t["class_pixels"].withColumnRenamed("confidence", "value"), 10000.0)}, GR)
    return d.select("g", "row", "col", F.round("height", 6).alias("height"), F.round("built", 9).alias("built"))


@query("region_patches", "G8 E6", """WITH p AS (SELECT g, row, col, block, class, confidence, floor(row / 12)::BIGINT AS gy, floor(col / 12)::BIGINT AS gx FROM {class_pixels}),
 c AS (SELECT DISTINCT g, block, gy, gx FROM p), r AS (SELECT *, count(*) OVER (PARTITION BY g, block) AS n, row_number() OVER (PARTITION BY g, block ORDER BY gy, gx) - 1 AS pos FROM c),
 k AS (SELECT DISTINCT g, gy, gx FROM r WHERE n <= 3 OR pos IN (0, floor(n / 3), floor(2 * n / 3))),
 w AS (SELECT g, gy, gx, class, count(*) AS n, sum(confidence) AS s FROM p GROUP BY ALL),
 z AS (SELECT g, gy, gx, sum(n) AS lab, max(n) AS top, arg_max(class, n * 100 - class) AS class, sum(s) / sum(n) AS weight FROM w GROUP BY ALL)
SELECT g, gy, gx, class, round(weight, 6) AS weight, round(lab / 144, 6) AS labelled_frac, round(top / lab, 6) AS dominant_frac FROM z SEMI JOIN k USING (g, gy, gx) WHERE lab / 144 >= 0.5 AND top / lab >= 0.4""")
def region_patches(t):
    d = t["class_pixels"].withColumn("aoi", F.col("g")).withColumn("region", F.col("block"))
    out = P.region_patches(d, 12, 0.4, 0.5, 3)
    return rounded(out.select(F.col("aoi").alias("g"), "gy", "gx", "class", "weight", "labelled_frac", "dominant_frac"))


# ── block graphs ─────────────────────────────────────────────────────────────

view("block_graph_nodes", """
SELECT p_partkey AS block_id, CASE WHEN p_size % 9 = 0 THEN NULL ELSE 'h' || CAST(1 + floor(p_partkey / 7) % 3 AS STRING) END AS label_key,
  CAST(20000 + p_size * 1000 AS DOUBLE) AS area_m2, CAST(p_size % 17 AS DOUBLE) AS thin_m, CAST(CASE WHEN p_size % 9 = 0 THEN 0 ELSE 1 + floor(p_partkey / 5) % 4 END AS INT) AS pred FROM {part}
""")
view("block_graph_edges", """
SELECT block_a, block_b, CAST(10 + (block_a * 7 + block_b * 3) % 50 AS DOUBLE) AS shared_len_m FROM (
  SELECT a.p_partkey AS block_a, b.p_partkey AS block_b FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 20 < 19
  UNION ALL SELECT a.p_partkey, b.p_partkey FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 20) e
""")


def _zone_sql(label: str) -> str:
    return f"""lb AS (SELECT block_id, {label} AS k, area_m2 FROM block_graph_nodes),
 se AS (SELECT e.block_a AS a, e.block_b AS b FROM block_graph_edges e JOIN lb x ON x.block_id = e.block_a JOIN lb y ON y.block_id = e.block_b WHERE x.k = y.k),
 e2 AS (SELECT a, b FROM se UNION ALL SELECT b, a FROM se),
 rc AS (SELECT block_id AS id, block_id AS root FROM lb WHERE k IS NOT NULL UNION SELECT e2.b, rc.root FROM rc JOIN e2 ON e2.a = rc.id),
 cc AS (SELECT id, min(root) AS root FROM rc GROUP BY id), za AS (SELECT root, sum(area_m2) / 1e4 AS ha FROM cc JOIN lb ON lb.block_id = cc.id GROUP BY root)"""


@query("form_zones", "K1 C21", f"""WITH RECURSIVE {_zone_sql('label_key')} SELECT block_id, root AS zone_id, ha AS zone_area_ha, coalesce(ha >= 15, false) AS zone_grade FROM block_graph_nodes LEFT JOIN cc ON cc.id = block_id LEFT JOIN za USING (root) -- {{block_graph_nodes}} {{block_graph_edges}}""")
def form_zones(t):
    d = N.form_zones(t["block_graph_nodes"], t["block_graph_edges"])
    return d.select("block_id", "zone_id", "zone_area_ha", "zone_grade")


@query("dissolve_small_zones", "K3", f"""WITH RECURSIVE {_zone_sql('nullif(pred, 0)')}, st AS (SELECT block_id, pred, coalesce(ha >= 15, false) AS big FROM block_graph_nodes LEFT JOIN cc ON cc.id = block_id LEFT JOIN za USING (root)),
 nb AS (SELECT block_a AS a, block_b AS b FROM block_graph_edges UNION ALL SELECT block_b, block_a FROM block_graph_edges),
 vt AS (SELECT nb.a, o.pred AS p, count(*) AS n FROM nb JOIN st m ON m.block_id = nb.a AND m.pred > 0 AND NOT m.big JOIN st o ON o.block_id = nb.b AND o.big GROUP BY ALL)
SELECT block_id, coalesce(arg_max(p, n * 100 - p), any_value(pred))::INT AS dissolved FROM st LEFT JOIN vt ON vt.a = block_id GROUP BY block_id -- {{block_graph_nodes}} {{block_graph_edges}}""")
def dissolve_small_zones(t):
    return N.dissolve_small_zones(t["block_graph_nodes"], t["block_graph_edges"]).select("block_id", "dissolved")


@query("directed_edges", "K5", """WITH p AS (SELECT block_id, row_number() OVER (ORDER BY block_id) - 1 AS pos FROM {block_graph_nodes} WHERE label_key IS NOT NULL), e AS (SELECT a.pos AS src, b.pos AS dst, shared_len_m FROM {block_graph_edges} x JOIN p a ON a.block_id = x.block_a JOIN p b ON b.block_id = x.block_b)
SELECT src, dst, shared_len_m FROM e UNION ALL SELECT dst, src, shared_len_m FROM e""")
def directed_edges(t):
    from zonomy.operators.ordered import name_rank
    n = t["block_graph_nodes"].where("label_key is not null")
    pos = name_rank(n, "block_id", "pos").withColumn("pos", F.col("pos") - 1)
    return N.both_directions(t["block_graph_edges"], pos)


def _merge_sql(passes: int = 3) -> str:
    """The passes written out one after the other."""
    bad = "(area < 28000 OR thin <= 2)"
    out = """s0 AS (SELECT block_id AS id, area_m2 AS area, thin_m AS thin FROM block_graph_nodes), l0 AS (SELECT block_a AS a, block_b AS b, shared_len_m AS len FROM block_graph_edges),
 m0 AS (SELECT block_id, block_id AS t FROM block_graph_nodes)"""
    for i in range(passes):
        out += f""", p{i} AS (SELECT x.small, arg_max(x.host, struct_pack(l := x.len, h := x.host)) AS host FROM (SELECT a AS small, b AS host, len FROM l{i} UNION ALL SELECT b, a, len FROM l{i}) x
  JOIN s{i} sm ON sm.id = x.small AND (sm.area < 28000 OR sm.thin <= 2) JOIN s{i} h ON h.id = x.host AND NOT (h.area < 28000 OR h.thin <= 2) GROUP BY x.small),
 m{i + 1} AS (SELECT block_id, coalesce(host, t) AS t FROM m{i} LEFT JOIN p{i} ON small = t),
 s{i + 1} AS (SELECT coalesce(host, id) AS id, sum(area) AS area, max(thin) AS thin FROM s{i} LEFT JOIN p{i} ON small = id GROUP BY 1),
 l{i + 1} AS (SELECT least(x, y) AS a, greatest(x, y) AS b, sum(len) AS len FROM (SELECT coalesce(pa.host, a) AS x, coalesce(pb.host, b) AS y, len FROM l{i} LEFT JOIN p{i} pa ON pa.small = a LEFT JOIN p{i} pb ON pb.small = b) WHERE x <> y GROUP BY 1, 2)"""
    return f"WITH {out} SELECT block_id, s.id AS target FROM m{passes} LEFT JOIN (SELECT id FROM s{passes} WHERE NOT {bad}) s ON s.id = t -- {{block_graph_nodes}} {{block_graph_edges}}"


@query("merge_small_blocks", "K4", _merge_sql())
def merge_small_blocks(t):
    return N.merge_small_blocks(t["block_graph_nodes"], t["block_graph_edges"], 28000.0, 2.0)
