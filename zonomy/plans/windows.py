"""Rectangle sums from summed-area tables, and neighbours by pivots, beside SQL that visits every pixel or pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.operators import distance as E
from zonomy.operators import neighbours as K
from zonomy.operators import prefix as S
from zonomy.plans.base import query
from zonomy.plans.metrics import rounded
from zonomy.plans.rasters import GAPS, GR, H, W


def _square(df, key, half):
    return df.select("g", F.col(key), *[(F.col(c) + s * half).alias(n) for c, n, s in (("row", "r0", -1), ("row", "r1", 1), ("col", "c0", -1), ("col", "c1", 1))])


@query("area_table_candidates", "H20 E8", """WITH cd AS (SELECT g, row, col, row * 96 + col AS id FROM {class_pixels} WHERE confidence > 0.9::DOUBLE), o AS (SELECT unnest(range(-5, 6)) AS o),
 w AS (SELECT cd.g, cd.id, p.class, p.confidence FROM cd, o a, o b JOIN {class_pixels} p ON p.g = cd.g AND p.row = greatest(least(cd.row + a.o, 95), 0) AND p.col = greatest(least(cd.col + b.o, 95), 0)),
 c AS (SELECT g, id, class, count(*) AS n, sum(confidence) AS s FROM w GROUP BY ALL)
SELECT g * 10000 + id AS cand, sum(n)::BIGINT AS n_valid, arg_max(class, n * 100 - class)::INT AS class, round(max(n) / sum(n), 6) AS purity, round(sum(s) / sum(n), 6) AS mean_prob FROM c GROUP BY ALL""")
def area_table_candidates(t):
    p = t["class_pixels"]
    cand = p.where(F.col("confidence") > 0.9).withColumn("cand", (F.col("g") * 10000 + F.col("row") * 96 + F.col("col")).cast("long"))
    return rounded(S.class_windows(p, _square(cand, "cand", 5), GR, "cand", range(1, 18), H, W, tile=32))


@query("area_table_density", "H16", """WITH al AS (SELECT g, r AS row, c AS col FROM (SELECT DISTINCT g FROM {class_pixels}), (SELECT unnest(range(96)) AS r), (SELECT unnest(range(96)) AS c)),
 f AS (SELECT al.g, al.row, al.col, coalesce((class <= 10)::INT, 0) AS b FROM al LEFT JOIN {class_pixels} p ON p.g = al.g AND p.row = al.row AND p.col = al.col),
 o AS (SELECT unnest(range(-4, 5)) AS o)
SELECT al.g, al.row, al.col, round(sum(f.b) / 81, 6) AS density FROM al, o a, o b JOIN f ON f.g = al.g AND f.row = greatest(least(al.row + a.o, 95), 0) AND f.col = greatest(least(al.col + b.o, 95), 0) GROUP BY ALL""")
def area_table_density(t):
    p = t["class_pixels"]
    span = F.sequence(F.lit(0), F.lit(H - 1))
    cells = p.select("g").distinct().withColumn("row", F.explode(span)).withColumn("col", F.explode(span)).withColumn("id", F.struct("g", "row", "col"))
    d = S.window_sums(p.where(F.col("class") <= 10), S.clamped(_square(cells, "id", 4), H, W), GR, "id", {"b": F.lit(1)}, tile=32)
    return rounded(d.select("id.*", (F.col("b").cast("double") / 81).alias("density")))


@query("area_table_zones", "H21 C27", """WITH j AS (SELECT z.zone_id, p.value FROM {zone_boxes} z JOIN {value_pixels} p ON p.col BETWEEN floor(z.minx / 10) AND ceil(z.maxx / 10) - 1 AND p.row BETWEEN floor(z.miny / 10) AND ceil(z.maxy / 10) - 1)
SELECT zone_id, coalesce(count(value), 0) AS n_pixels, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg((value > 500)::INT) FILTER (value IS NOT NULL), 6) AS share_above
FROM {zone_boxes} LEFT JOIN j USING (zone_id) GROUP BY zone_id""")
def area_table_zones(t):
    low, high = (lambda c: F.floor(F.col(c) / 10)), (lambda c: F.ceil(F.col(c) / 10) - 1)
    w = t["zone_boxes"].select("zone_id", low("minx").alias("c0"), high("maxx").alias("c1"), low("miny").alias("r0"), high("maxy").alias("r1"))
    return rounded(S.window_moments(t["value_pixels"], w, [], "zone_id", "value", 500.0))


@query("pivot_neighbours", "J1 J2 J4", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS v FROM {embeddings}),
 d AS (SELECT a.vec_id AS id, b.vec_id AS ref, round(1 - list_dot_product(a.v, b.v), 9) AS dist FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT id, ref, round(dist, 6) AS dist, nn::INT AS nn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ref) AS nn FROM d) WHERE nn <= 5""")
def pivot_neighbours(t):
    """Blocks of 64 references, so that pivots, shells and rounds are at work on tables of any size."""
    v = t["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rounded(K.knn(v, v, 5, exclude_self=True, block=64))


FAR = f"""{GAPS}, near AS (SELECT gap.g, gap.row, gap.col, (gap.row - p.row) ** 2 + (gap.col - p.col) ** 2 AS d2, p.row AS drow, p.col AS dcol, p.class
  FROM gap JOIN class_pixels p ON p.g = gap.g AND (gap.row - p.row) ** 2 + (gap.col - p.col) ** 2 <= 400 {{}}),
 best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY g, row, col ORDER BY d2, drow, dcol) = 1)"""


@query("gap_distances", "H10", f"""WITH {FAR.format("AND p.row % 12 = 0 AND p.col % 9 = 0")} SELECT g, row, col, d2::BIGINT AS d2, drow, dcol FROM best -- {{class_pixels}}""")
def gap_distances(t):
    """Square distance and place of the nearest donor, donors on a loose lattice."""
    p = t["class_pixels"]
    return E.nearest_donors(p, GR, f"g {dict(p.dtypes)['g']}", 20.0, H, W, p.where("row % 12 = 0 and col % 9 = 0"), tile=32)


@query("fill_far", "H11", f"""WITH {FAR.format("")} SELECT g, row, col, class FROM class_pixels UNION ALL SELECT g, row, col, class FROM best -- {{class_pixels}}""")
def fill_far(t):
    p = t["class_pixels"]
    return E.fill_far(p, GR, f"g {dict(p.dtypes)['g']}", 20.0, H, W)
