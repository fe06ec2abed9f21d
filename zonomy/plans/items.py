"""Training items: splits by mode, weighted weak labels, features of blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import geometry as G
from zonomy.functions import vectors as V
from zonomy.operators import items as I
from zonomy.operators import vectors as X
from zonomy.operators import zonal as Z
from zonomy.plans import inventory, spatial  # noqa: F401  (the views below read their views)
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

view("planned_patches", """
SELECT dataset, patch_id, lcz, p_size, CASE p_size % 8 WHEN 0 THEN 'held' WHEN 1 THEN 'test' WHEN 2 THEN 'validation' WHEN 3 THEN 'testing' ELSE 'train' END AS plan FROM {reference_patches}
""")
FOUND = "found AS (SELECT p.* FROM planned_patches p SEMI JOIN (SELECT * FROM scan WHERE family = 'fa') USING (dataset, patch_id))"
NAMED = "CASE {0} WHEN 'training' THEN 'train' WHEN 'train' THEN 'train' WHEN 'validation' THEN 'val' WHEN 'val' THEN 'val' WHEN 'testing' THEN 'test' WHEN 'test' THEN 'test' END"
TABLES = "-- {planned_patches} {scan}"


def _files(t):
    return t["scan"].where("family = 'fa'")


@query("column_splits", "B29 C38 C34", f"""WITH {FOUND} SELECT dataset, patch_id, (lcz - 1)::INT AS label, {NAMED.format("plan")} AS split FROM found WHERE plan <> 'held' {TABLES}""")
def column_splits(t):
    return I.split_items(t["planned_patches"], _files(t), "column", "plan")[0]


@query("hybrid_splits", "B29 C38", f"""WITH {FOUND} SELECT dataset, patch_id, (lcz - 1)::INT AS label, CASE WHEN dataset = 'testing' THEN 'test' WHEN {NAMED.format("plan")} = 'val' THEN 'val' ELSE 'train' END AS split
FROM found WHERE dataset = 'testing' OR plan <> 'held' {TABLES}""")
def hybrid_splits(t):
    return I.split_items(t["planned_patches"], _files(t), "hybrid", "plan")[0]


@query("unknown_splits", "B29", f"""WITH {FOUND} SELECT 'column' AS mode, plan AS value, count(*) AS n FROM found WHERE plan = 'held' GROUP BY plan
UNION ALL SELECT 'dataset', dataset, count(*) FROM found WHERE dataset = 'unlabeled' GROUP BY dataset {TABLES}""")
def unknown_splits(t):
    one = lambda mode, *a: I.split_items(t["planned_patches"], _files(t), mode, *a)[1].select(F.lit(mode).alias("mode"), "value", "n")
    return one("column", "plan").unionByName(one("dataset"))


@query("weak_items", "B30 C10", """WITH f AS (SELECT p.*, l.lon, l.lat FROM planned_patches p JOIN places l ON l.place_id = p.patch_id SEMI JOIN (SELECT * FROM scan WHERE family = 'fa') USING (dataset, patch_id))
SELECT dataset, patch_id, (lcz - 1)::INT AS label, 'train' AS split, round(p_size / 50.0::DOUBLE * 0.4, 6) AS weight FROM f p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE
 2 * 6371.0088::DOUBLE * asin(sqrt(least(1, sin(radians(s.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(s.lat)) * sin(radians(s.lon - p.lon) / 2) ** 2))) < 300) -- {planned_patches} {scan} {places} {sites}""")
def weak_items(t):
    at = t["places"].select(F.col("place_id").alias("patch_id"), "lon", "lat")
    weak = t["planned_patches"].join(at, "patch_id").withColumn("weight", F.col("p_size") / 50.0)
    return rounded(I.weak_items(weak, _files(t), t["sites"], 300.0, 0.4))


@query("block_features", "C35 D24", """WITH l AS (SELECT vec_id * 3 AS zone_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS ch FROM embeddings WHERE vec_id % 5 > 0),
 s AS (SELECT zone_id, 1 AS n, sum(x * ch) AS c FROM l GROUP BY zone_id)
SELECT z.zone_id, coalesce(n, 0)::BIGINT AS n, round(coalesce(c, 0), 6) AS checksum, 64 AS dims, (maxx - minx) * (maxy - miny) AS area_m2, round(4 * pi() * 10000 / 160000, 6) AS compactness, p_size % 9 AS floors
FROM {zone_boxes} z LEFT JOIN s USING (zone_id)""")
def block_features(t):
    v = t["embeddings"].select((F.col("vec_id") * 3).alias("zone_id"), F.when(F.col("vec_id") % 5 > 0, V.doubles("embedding")).otherwise(F.array_repeat(F.lit(0.0), 64)).alias("v"))
    blocks = spatial.zones(t)
    named = {k: c for k, c in Z.geometric_descriptors(F.col("lbox")).items() if k in ("area_m2", "compactness")}
    d = X.block_features(v, blocks, "zone_id", named, zonal=blocks.select("zone_id", (F.col("p_size") % 9).alias("floors")))
    w = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: k.cast("double"))
    return rounded(d.select("zone_id", "n", V.dot(F.col("features"), w).alias("checksum"), F.size("features").alias("dims"), "area_m2", "compactness", "floors"))
