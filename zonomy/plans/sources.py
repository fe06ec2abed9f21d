"""Scans, inventories, caches and writes over tables derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import geometry as G
from zonomy.operators import sketches as K
from zonomy.operators.manifest import content_hash
from zonomy.sources import cache as C
from zonomy.sources import layout as L
from zonomy.sources import patch_source as A
from zonomy.sources import scans as S
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded


def _themes(t):
    """The features as a theme tree in the shared scratch folder."""
    f = t["features"].select(
        "fid", "class", F.struct(F.col("x0").alias("xmin"), F.col("x1").alias("xmax"), F.col("y0").alias("ymin"), F.col("y1").alias("ymax")).alias("bbox"),
        F.when(F.col("class") == "building", "buildings").otherwise("base").alias("theme"),
        F.when(F.col("class") == "building", "building").when(F.col("class").isin("lake"), "water").otherwise("land").alias("type"))
    path = C.shared_folder(t.spark, "themes")
    f.write.partitionBy("theme", "type").parquet(path)
    return path


@query("theme_scan", "A1 A3", """SELECT fid, class, CASE WHEN class = 'lake' THEN 'water' ELSE 'land' END AS base_type FROM {features} WHERE coalesce(class, '') <> 'building' AND x0 <= 3000 AND x1 >= 500 AND y0 <= 2500 AND y1 >= 200""")
def theme_scan(t):
    root, box = _themes(t), (500.0, 200.0, 3000.0, 2500.0)
    parts = {k: S.read_theme(t.spark, root, "base", k, box, ["fid", "class"]) for k in ("water", "land")}
    return S.tagged_union(parts).select("fid", "class", "base_type")


@query("source_flags", "A2", """SELECT l_partkey AS partkey, count(*) AS n, count(*) FILTER (l_suppkey % 4 = 0 OR l_orderkey % 4 = 0) AS n_trusted, count(*) FILTER (l_suppkey % 4 = 2 OR l_orderkey % 4 = 2) AS n_other, count(DISTINCT 's' || l_suppkey % 4) AS n_primary FROM lineitem GROUP BY 1""")
def source_flags(t):
    s = lambda c: F.struct(F.concat(F.lit("s"), (F.col(c) % 4).cast("string")).alias("dataset"), F.lit(1.0).alias("confidence"))
    d = t["lineitem"].select(F.col("l_partkey").alias("partkey"), F.array(s("l_suppkey"), s("l_orderkey")).alias("sources"))
    d = d.withColumns(S.source_flags("sources", ["s0"], "s2"))
    return d.groupBy("partkey").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_trusted").alias("n_trusted"), F.count_if("is_other").alias("n_other"),
                                    F.countDistinct("primary_source").alias("n_primary"))


@query("segment_split", "A4", """SELECT kind, class, count(*) AS n FROM (SELECT class, CASE WHEN class IN ('lake', 'forest') THEN 'road' WHEN class IN ('works') THEN 'rail' END AS kind FROM {features}) WHERE kind IS NOT NULL GROUP BY ALL""")
def segment_split(t):
    parts = S.split_by(t["features"].select("class"), "class", {"road": ["lake", "forest"], "rail": ["works"]})
    return S.tagged_union(parts, "kind").groupBy("kind", "class").agg(F.count(F.lit(1)).alias("n"))


@query("informal_layer", "A5", """WITH m AS (SELECT median(p_retailprice) AS m FROM part) SELECT p_partkey, p_retailprice <= m AS informal, p_size % 10 >= 1 AS complex FROM part, m""")
def informal_layer(t):
    p = t["part"]
    a = S.informal_flag(p.select("p_partkey", F.col("p_retailprice").alias("access"))).select("p_partkey", "informal")
    b = S.informal_flag(p.select("p_partkey", (F.col("p_size") % 10).alias("k_complexity"))).select("p_partkey", F.col("informal").alias("complex"))
    return a.join(b, "p_partkey")


@query("tile_cells", "A9 A10 A11 G15", """WITH n AS (SELECT place_id, round(lon, 2) AS lon, round(lat * 0.9, 2) AS lat FROM {places})
SELECT place_id, round(lon - 0.05, 6) AS minx, round(lat - 0.05, 6) AS miny, lon - 0.05 < 60 AND lon + 0.05 > -30 AND lat - 0.05 < 50 AND lat + 0.05 > -20 AS hit FROM n""")
def tile_cells(t):
    num = lambda c: F.format_string("%.2f", c)
    n = t["places"].select("place_id", F.concat(F.lit("grid_"), num(F.round("lon", 2)), F.lit("_"), num(F.round(F.col("lat") * 0.9, 2))).alias("name"))
    d = S.tile_cells(n)
    hit = S.tiles_meeting(d, -30.0, -20.0, 60.0, 50.0).select("place_id", F.lit(True).alias("hit"))
    return rounded(d.join(hit, "place_id", "left").select("place_id", F.col("rbox.minx").alias("minx"), F.col("rbox.miny").alias("miny"), F.coalesce("hit", F.lit(False)).alias("hit")))


@query("tile_footprints", "G15 B9", """SELECT place_id, (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180) / 6) + 1)::INT AS epsg, true AS covers_cell, true AS tight FROM (SELECT place_id, round(lon, 2) AS lon, round(lat * 0.9, 2) AS lat FROM {places})""")
def tile_footprints(t):
    num = lambda c: F.format_string("%.2f", c)
    n = t["places"].select("place_id", F.concat(F.lit("grid_"), num(F.round("lon", 2)), F.lit("_"), num(F.round(F.col("lat") * 0.9, 2))).alias("name"))
    d = S.utm_footprints(S.tile_cells(n))
    r = lambda i, c: F.col("ring")[i][c]
    covers = (F.least(r(0, "x"), r(3, "x")) <= F.col("rbox.minx") + 1e-3) & (F.least(r(0, "y"), r(1, "y")) <= F.col("rbox.miny") + 1e-3)
    tight = (F.col("width") * 10 < 13_000) & (F.col("height") * 10 < 14_000)
    return d.select("place_id", "epsg", covers.alias("covers_cell"), tight.alias("tight"))


@query("local_tiles", "A10 F4", """SELECT c_custkey AS k, 'tiles/t' || c_custkey || '.tif' AS local, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS present FROM customer WHERE 2015 + c_nationkey % 4 = 2017""")
def local_tiles(t):
    idx = t["customer"].select(F.col("c_custkey").alias("k"), F.concat(F.lit("remote/a/t"), F.col("c_custkey").cast("string"), F.lit(".tif")).alias("url"), (2015 + F.col("c_nationkey") % 4).alias("year"))
    files = t["orders"].where("o_orderstatus = 'F'").select(F.concat(F.lit("tiles/t"), F.col("o_custkey").cast("string"), F.lit(".tif")).alias("path")).distinct()
    return S.local_tiles(idx, files, 2017, "tiles/").select("k", "local", "present")


@query("task_plan", "A30 F4", """SELECT dataset, patch_id FROM {reference_patches} WHERE p_size % 3 > 0 AND p_retailprice < 980 AND NOT EXISTS (SELECT 1 FROM {scan} s WHERE s.family = 'fa' AND s.dataset = reference_patches.dataset AND s.patch_id = reference_patches.patch_id)""")
def task_plan(t):
    done = t["scan"].where("family = 'fa'")
    return S.missing_tasks(t["reference_patches"], done, ["dataset", "patch_id"], F.col("p_size") % 3 > 0, F.col("p_retailprice") < 980).select("dataset", "patch_id")


@query("packed_shards", "A14 H25", """SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, true AS bounded FROM documents GROUP BY lang""")
def packed_shards(t):
    path = C.shared_folder(t.spark, "shards")
    C.pack(t["documents"].select("doc_id", "lang", "text", "n_chars"), path, "lang", 100)
    d = t.spark.read.parquet(path).select("lang", "n_chars", F.col("_metadata.file_path").alias("f"))
    per = d.groupBy("lang", "f").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("c"))
    return per.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("c").alias("chars"), (F.max("n") <= 100).alias("bounded"))


@query("stacked_runs", "A15 A16 A29", """SELECT run, count(*) AS n, count(x) AS n_x, count(extra) AS n_extra FROM (SELECT 'docs' AS run, n_chars AS x, lang AS extra FROM documents UNION ALL SELECT 'pages', length(html), NULL FROM pages) GROUP BY run""")
def stacked_runs(t):
    runs = {"docs": t["documents"].select(F.col("n_chars").alias("x"), F.col("lang").alias("extra")), "pages": t["pages"].select(F.length("html").cast("long").alias("x"))}
    return S.stack_runs(runs).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_x"), F.count("extra").alias("n_extra"))


@query("discovered_runs", "A15 A22", """SELECT 'docs' AS run, count(*) AS n, sum(n_chars)::BIGINT AS total, count(*) AS n_lang FROM documents UNION ALL SELECT 'convs', count(*), sum(length(text))::BIGINT, 0 FROM conversations""")
def discovered_runs(t):
    root = C.shared_folder(t.spark, "runs")
    t["documents"].select(F.col("n_chars").alias("x"), "lang").write.parquet(f"{root}/docs")
    t["conversations"].select(F.length("text").cast("long").alias("x")).write.parquet(f"{root}/convs")
    d = S.discover_runs(t.spark, f"{root}/*")
    return d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.count("lang").alias("n_lang"))


@query("cached_stage", "A17 A18 A19", """SELECT n_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def cached_stage(t):
    root = C.shared_folder(t.spark, "cache")
    cfg = {"year": 2017, "threshold": 0.5}
    scan = lambda: t["customer"].select("c_nationkey", "c_acctbal")
    C.cached_stage(t.spark, root, "scan", cfg, scan, only=["year"])
    again = C.cached_stage(t.spark, root, "scan", {**cfg, "threshold": 0.9}, lambda: scan().limit(0), only=["year"])
    return again.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("product_write", "A18 A19", """SELECT city, label, count(*) AS n, 'v1' AS release FROM (SELECT 'city' || p_partkey % 8 AS city, 1 + p_partkey % 17 AS label FROM part) GROUP BY ALL""")
def product_write(t):
    path, index = C.shared_folder(t.spark, "product"), C.shared_folder(t.spark, "index")
    p = t["part"].select(F.concat(F.lit("city"), (F.col("p_partkey") % 8).cast("string")).alias("city"), (1 + F.col("p_partkey") % 17).alias("label"))
    C.write_product(p, path, ["label"], "city", {"release": "v1"})
    C.write_both(t.spark.read.parquet(path), C.shared_folder(t.spark, "clean"), lambda d: d.groupBy("city", "label", "release").agg(F.count(F.lit(1)).alias("n")), index)
    return t.spark.read.parquet(index).select("city", "label", "n", "release")


@query("manifest_fingerprint", "A20", """SELECT count(*) AS n, true AS same_in_any_order, true AS differs_when_changed FROM {scan}""")
def manifest_fingerprint(t):
    s = t["scan"]
    a = C.write_manifest(s, C.shared_folder(t.spark, "manifest"))
    b = content_hash(s.repartition(5, "patch_id")).withColumnsRenamed({"n": "n2", "xor": "x2", "sum": "s2"})
    c = content_hash(s.withColumn("h", F.col("h") + F.when(F.col("patch_id") == 1, 1).otherwise(0))).withColumnsRenamed({"n": "n3", "xor": "x3", "sum": "s3"})
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(b).join(one(c), "_k").select(
        F.col("n2").alias("n"), ((F.col("x2") == a["xor"]) & (F.col("s2") == a["sum"])).alias("same_in_any_order"), (F.col("x3") != a["xor"]).alias("differs_when_changed"))


@query("appended_summary", "A22", """SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_value FROM events GROUP BY event_type""")
def appended_summary(t):
    path = C.shared_folder(t.spark, "summary")
    e = t["events"]
    C.append_rows(e.where(~F.coalesce(F.col("value") > 50, F.lit(False))).select("event_type"), path)
    d = C.append_rows(e.where(F.col("value") > 50).select("event_type", "value"), path)
    return d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"))


@query("faceted_points", "A29 A25 I6", """SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND value > 1 GROUP BY event_type""")
def faceted_points(t):
    e = t["events"].select("event_type", F.when(F.col("value") > 1, F.col("value")).alias("pca_x"), F.col("user_id").alias("pca_y"))
    if S.layout_methods(e.columns) != ["pca"]:
        raise ValueError("layout columns are missing")
    return S.read_facets(e, "pca", {"event_type": ["click", "view"]}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("city_bounds", "A7", """SELECT 'N' || n_nationkey AS key, n_name AS name, (n_nationkey * 2 + 3.5)::DOUBLE AS width FROM nation""")
def city_bounds(t):
    path = C.shared_folder(t.spark, "bounds")
    n = F.col("n_nationkey").cast("double")
    t["nation"].select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("SMOD_ID"), F.col("n_name").alias("JRC_NAME_MAIN"), (-n).alias("minx"), F.lit(0.0).alias("miny"),
                       (n + 3.5).alias("maxx"), F.lit(1.0).alias("maxy")).write.option("header", True).csv(path)
    b = S.read_bounds(t.spark, path)
    return b.select(F.col("SMOD_ID").alias("key"), F.col("JRC_NAME_MAIN").alias("name"), (F.col("rbox.maxx") - F.col("rbox.minx")).alias("width"))


# every vector as a patch of 64 channels and 8 x 8 pixels: hundreds of its components plus the pixel's number
view("patch_arrays", """
SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'training' WHEN 1 THEN 'validation' WHEN 2 THEN 'testing' ELSE 'unlabeled' END AS dataset,
  CAST(1000000 + vec_id AS STRING) AS patch_id, embedding FROM {embeddings}
""")


def _patch_tree(t):
    root = C.shared_folder(t.spark, "patches")
    pixels = F.sequence(F.lit(0), F.lit(63))
    data = F.flatten(F.transform("embedding", lambda x: F.transform(pixels, lambda k: (F.floor(100 * x.cast("double")) * 100 + k).cast("float"))))
    A.write_patches(t["patch_arrays"].select("dataset", "patch_id", F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("data")), root).collect()  # four rows
    return root


@query("patch_files", "A8", """SELECT dataset, patch_id, 16512 AS length FROM {patch_arrays} WHERE dataset IN ('training', 'testing')""")
def patch_files(t):
    d = A.read_patches(t.spark, _patch_tree(t)).where(F.col("dataset").isin("training", "testing"))
    return d.select("dataset", "patch_id", "length")


@query("patch_shapes", "A13", """SELECT dataset, patch_id, 8 AS h, 8 AS w, true AS header_only FROM {patch_arrays}""")
def patch_shapes(t):
    d = A.read_patches(t.spark, _patch_tree(t), "shapes")
    return d.select("dataset", "patch_id", "h", "w", (100 * F.col("bytes_read") < F.col("length")).alias("header_only"))


@query("patch_pixels", "A12", """WITH s AS (SELECT dataset, patch_id, list_sum(list_transform(embedding, lambda x: floor(100 * x::DOUBLE))) * 100 AS s FROM {patch_arrays} WHERE dataset = 'validation')
SELECT dataset, patch_id, k // 8 AS row, k % 8 AS col, s + 64 * k AS total FROM s, (SELECT unnest(range(64)) AS k)""")
def patch_pixels(t):
    d = A.read_patches(t.spark, _patch_tree(t), "pixels").where("dataset = 'validation'")
    return d.select("dataset", "patch_id", "row", "col", F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("curve_scan", "A1 A10 A14", """SELECT fid, class, true AS few_files FROM {features} WHERE x0 <= 900 AND x1 >= 700 AND y0 <= 500 AND y1 >= 300""")
def curve_scan(t):
    """Rows of a small box from a curve layout of about 60 files, of which a small part is opened."""
    f = t["features"].select("fid", "class", G.box("x0", "y0", "x1", "y1").alias("box"))
    rows = f.count()
    laid = L.write_layout(f, C.shared_folder(t.spark, "curve"), "box", file_bytes=max(1, rows * 100 // 60), row_bytes=F.lit(100))
    d = L.read_box(t.spark, laid, "box", 700.0, 300.0, 900.0, 500.0)
    opened, files = len(L.files_for(t.spark, laid, 700.0, 300.0, 900.0, 500.0)), t.spark.read.parquet(laid.bounds).count()
    return d.select("fid", "class", F.lit(4 * opened <= files).alias("few_files"))


@query("sketched_channels", "D27 D31", """WITH l AS (SELECT vec_id % 2 AS half, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::INT - 1 AS ch FROM embeddings)
SELECT half, ch, count(*) AS n, round(avg(x), 6) AS mean, round(greatest(stddev_pop(x), 1e-6), 6) AS std, min(x) AS low, max(x) AS high, quantile_disc(x, 0.25) AS q25, quantile_disc(x, 0.5) AS q50, quantile_disc(x, 0.9) AS q90 FROM l GROUP BY ALL""")
def sketched_channels(t):
    """Figures of halves of the table from states of tiles of 25 vectors, the last tiles added later; sketches as large as a half, so exact."""
    path, k = C.shared_folder(t.spark, "states"), 8192
    v = t["embeddings"].select((F.col("vec_id") % 2).alias("half"), F.floor(F.col("vec_id") / 50).alias("tile"), F.col("embedding").alias("v"))
    K.append_states(v.where("tile % 5 < 4"), ["half", "tile"], path, k=k)
    states = K.append_states(v, ["half", "tile"], path, k=k)
    d = K.state_figures(K.merged_states(states, ["half"], k), {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    return rounded(d, "low", "high", "q25", "q50", "q90")
