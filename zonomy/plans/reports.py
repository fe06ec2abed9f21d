"""Run histories from events, and reports, lookups and joins over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import geometry as G
from zonomy.operators import reports as R
from zonomy.operators.confusion import class_scores, confusion_counts, summary_scores
from zonomy.operators.ensemble import sweep
from zonomy.operators.pixels import majority_pool
from zonomy.operators.splits import require_unique
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

view("run_history", """
SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch,
  CASE WHEN event_type = 'error' THEN NULL ELSE floor(value / 5) / 100 END AS val_kappa, value / 500 AS val_f1, event_type
FROM {events}
""")
BEST = """b AS (SELECT run, epoch AS best_epoch, val_kappa, val_f1, stop_epoch FROM (SELECT *, max(epoch) OVER (PARTITION BY run) AS stop_epoch, row_number() OVER (PARTITION BY run ORDER BY val_kappa DESC NULLS LAST, epoch) AS r FROM run_history) WHERE r = 1)"""


def best(t):
    return R.best_epochs(t["run_history"], ["val_kappa", "val_f1"], "val_kappa")


@query("best_epochs", "D20 A24", f"""WITH {BEST} SELECT run, best_epoch, stop_epoch, round(val_kappa, 6) AS val_kappa, round(val_f1, 6) AS val_f1 FROM b -- {{run_history}}""")
def best_epochs(t):
    return rounded(best(t))


@query("run_group_summary", "D21 E10", f"""WITH {BEST} SELECT run % 7 AS grp, count(*) AS runs, array_to_string(list_sort(list(best_epoch)), ',') AS peaks, round(avg(val_f1), 6) AS val_f1_mean, round(coalesce(stddev_samp(val_f1), 0), 6) AS val_f1_sd,
 round(min(val_f1), 6) AS val_f1_min, round(max(val_f1), 6) AS val_f1_max FROM b GROUP BY 1 -- {{run_history}}""")
def run_group_summary(t):
    d = R.group_summary(best(t).withColumn("grp", F.col("run") % 7), ["grp"], ["val_f1"])
    return rounded(d.withColumn("peaks", F.array_join(F.col("peaks").cast("array<string>"), ",")))


@query("peak_gaps", "D21 E10", f"""WITH {BEST}, g AS (SELECT run % 7 AS grp, best_epoch, lead(best_epoch) OVER (PARTITION BY run % 7 ORDER BY best_epoch) - best_epoch AS gap FROM b)
SELECT grp, count(*) AS n, max(gap) AS widest_gap, max(best_epoch) - min(best_epoch) AS span, arg_max(best_epoch, struct_pack(g := gap, e := best_epoch)) FILTER (gap IS NOT NULL) AS gap_after, round(max(gap) / (max(best_epoch) - min(best_epoch)), 6) AS gap_fraction FROM g GROUP BY grp HAVING count(*) >= 3 -- {{run_history}}""")
def peak_gaps(t):
    return rounded(R.widest_gap(best(t).withColumn("grp", F.col("run") % 7), ["grp"]))


@query("default_run", "E16", f"""WITH {BEST} SELECT (SELECT run FROM b WHERE run % 3 = 0 ORDER BY val_kappa DESC, run LIMIT 1) AS run -- {{run_history}}""")
def default_run(t):
    d = best(t).withColumn("m", F.struct("val_kappa", -F.col("run")))
    return R.default_run(d, "m", F.col("run") % 3 == 0)


@query("class_deltas", "D49", """WITH c AS (SELECT region, truth, pred, count(*) AS n FROM {predictions} GROUP BY ALL), r AS (SELECT region, truth AS cls, sum(n) AS s, sum(n) FILTER (truth = pred) AS tp FROM c GROUP BY ALL), q AS (SELECT region, pred AS cls, sum(n) AS p FROM c GROUP BY ALL),
 f AS (SELECT region, cls, 2 * coalesce(tp, 0) / (coalesce(s, 0) + coalesce(p, 0)) AS f1 FROM r FULL JOIN q USING (region, cls)), d AS (SELECT *, f1 - lag(f1) OVER (PARTITION BY cls ORDER BY region) AS delta FROM f)
SELECT region, cls, round(f1, 6) AS f1, round(delta, 6) AS delta FROM d WHERE delta IS NOT NULL""")
def class_deltas(t):
    s = class_scores(confusion_counts(t["predictions"], keys=["region"]), ["region"])
    return rounded(R.class_deltas(s, "region").select("region", "cls", "f1", "delta"))


@query("confusion_count_check", "A23", """WITH c AS (SELECT city, truth, pred, count(*) AS n FROM {predictions} GROUP BY ALL), s AS (SELECT city, sum(n)::BIGINT AS n_confusion FROM c WHERE truth <> 17 OR pred <> 17 GROUP BY city), r AS (SELECT city, count(*) AS n_test FROM {predictions} GROUP BY city) SELECT city AS run, n_test, n_confusion FROM r LEFT JOIN s USING (city) WHERE n_test IS DISTINCT FROM n_confusion""")
def confusion_count_check(t):
    p = t["predictions"]
    c = confusion_counts(p, keys=["city"]).where("truth <> 17 or pred <> 17").select(F.col("city").alias("run"), F.col("n").alias("count"))
    return R.confusion_mismatches(c, p.groupBy(F.col("city").alias("run")).agg(F.count(F.lit(1)).alias("n_test")))


KNOWN = ["src0", "src1", "src2", "src3", "src4", "src5"]
LEGACY = {"fr": "src6", "de": "src7", "es": "src8"}


@query("resolved_names", "B40", f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN source || '+src1' END AS e, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN lang || '+de' END AS l FROM documents),
 m AS (SELECT *, e IS NOT NULL AND len(list_filter(string_split(e, '+'), lambda x: x NOT IN ({', '.join(repr(k) for k in KNOWN)}))) = 0 AS ok, list_transform(string_split(l, '+'), lambda x: CASE x WHEN 'fr' THEN 'src6' WHEN 'de' THEN 'src7' WHEN 'es' THEN 'src8' END) AS mp FROM d),
 i AS (SELECT *, l IS NOT NULL AND len(list_filter(mp, lambda x: x IS NULL)) = 0 AS inf FROM m)
SELECT doc_id, CASE WHEN ok THEN e WHEN inf THEN array_to_string(mp, '+') END AS name, CASE WHEN ok THEN 'explicit' WHEN inf THEN 'inferred' ELSE 'unresolved' END AS how FROM i""")
def resolved_names(t):
    i = F.col("doc_id")
    e = F.when(i % 4 == 0, F.col("source")).when(i % 4 == 1, F.concat("source", F.lit("+src1")))
    leg = F.when(i % 3 == 0, F.col("lang")).when(i % 3 == 1, F.concat("lang", F.lit("+de")))
    name, how = R.resolve_name(e, leg, KNOWN, LEGACY)
    return t["documents"].select("doc_id", name.alias("name"), how.alias("how"))


@query("fused_provenance", "B39", """WITH reg AS (SELECT c_custkey AS k, c_mktsegment AS product, CASE WHEN c_nationkey % 3 > 0 THEN 'v' || c_nationkey % 3 END AS version FROM customer), p AS (SELECT o_orderkey AS id, 1 AS pos, o_custkey AS k FROM orders UNION ALL SELECT o_orderkey, 2, (o_custkey + 1) % (SELECT count(*) FROM customer) FROM orders)
SELECT id, string_agg(k::VARCHAR, '+' ORDER BY pos) AS name, string_agg(coalesce(product, 'none'), '+' ORDER BY pos) AS product, string_agg(coalesce(version, 'none'), '+' ORDER BY pos) AS version FROM p LEFT JOIN reg USING (k) GROUP BY id""")
def fused_provenance(t):
    c = t["customer"]
    n = F.col("c_nationkey") % 3
    reg = c.select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("product"), F.when(n > 0, F.concat(F.lit("v"), n.cast("string"))).alias("version"))
    total = c.count()
    parts = t["orders"].select(F.col("o_orderkey").alias("id"), F.posexplode(F.array(F.col("o_custkey"), (F.col("o_custkey") + 1) % total)).alias("pos", "name"))
    return R.fused_provenance(parts, reg, "id", ("product", "version"))


@query("comparable_sources", "B39", """SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_mktsegment = b.c_mktsegment AND (CASE WHEN a.c_nationkey % 3 > 0 THEN a.c_nationkey END) IS NOT DISTINCT FROM (CASE WHEN b.c_nationkey % 3 > 0 THEN b.c_nationkey END) AS same FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1""")
def comparable_sources(t):
    v = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey"))
    c = t["customer"].select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("p"), v.alias("v"))
    d = c.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("p").alias("p2"), F.col("v").alias("v2"))
    return c.join(d, "a").select("a", "b", R.comparable([F.col("p"), F.col("v")], [F.col("p2"), F.col("v2")]).alias("same"))


@query("city_inventory", "D3", """SELECT city, count(*) AS n_patches, count(DISTINCT lcz) AS n_classes, count(*) FILTER (dataset = 'training') AS training, count(*) FILTER (dataset = 'validation') AS validation, count(*) FILTER (dataset = 'testing') AS testing,
 count(*) < 880 OR count(DISTINCT lcz) < 8 AS sparse FROM {scan} GROUP BY city""")
def city_inventory(t):
    return R.city_inventory(t["scan"], ["training", "validation", "testing"], max_patches=880)


@query("city_summary", "D47", """SELECT 'n' || nation AS city, CASE WHEN place_id % 5 = 0 THEN 'culture' ELSE 'pool' END AS role, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, count(*) FILTER (place_id % 4 < 2) AS n_train, count(*) FILTER (place_id % 4 = 2) AS n_val, count(*) FILTER (place_id % 4 = 3) AS n_test, count(*) AS n_total FROM {places} GROUP BY ALL""")
def city_summary(t):
    i = F.col("place_id")
    d = t["places"].select("lon", "lat", F.concat(F.lit("n"), F.col("nation").cast("string")).alias("city"), F.when(i % 5 == 0, "culture").otherwise("pool").alias("role"),
                           F.when(i % 4 < 2, "train").when(i % 4 == 2, "val").otherwise("test").alias("split"))
    return rounded(R.city_summary(d))


@query("unmapped_splits", "B29", """SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY lang""")
def unmapped_splits(t):
    return R.map_split(t["documents"].select("doc_id", "lang"), "lang", {"en": "train", "fr": "val"})[1]


@query("mapped_splits", "B29", """SELECT split, count(*) AS n FROM (SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' END AS split FROM documents) WHERE split IS NOT NULL GROUP BY split""")
def mapped_splits(t):
    return R.map_split(t["documents"].select("doc_id", "lang"), "lang", {"en": "train", "fr": "val"})[0].groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("region_capacity", "D41", """WITH p AS (SELECT s.s_suppkey % 40 AS aoi, n.n_nationkey AS iso, n.n_regionkey AS rk, 1 + l_partkey % 17 AS class, 1 - l_discount AS w, l_returnflag AS sp FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey),
 g AS (SELECT 'all' AS region, * FROM p UNION ALL SELECT 'south', * FROM p WHERE rk IN (0, 1) UNION ALL SELECT 'islands', * FROM p WHERE iso % 4 = 1),
 a AS (SELECT region, count(*) FILTER (n >= 1500) AS aois_big, count(*) FILTER (k >= 8) AS aois_wide FROM (SELECT region, aoi, count(*) AS n, count(DISTINCT class) AS k FROM g GROUP BY ALL) GROUP BY region), k AS (SELECT region, count(*) AS classes, count(*) FILTER (n >= 1500) AS classes_big FROM (SELECT region, class, count(*) AS n FROM g GROUP BY ALL) GROUP BY region)
SELECT region, count(DISTINCT aoi) AS aois, count(DISTINCT iso) AS countries, count(*) AS patches, round(avg(w), 4) AS mean_weight, count(*) FILTER (sp = 'A') AS n_train, count(*) FILTER (sp = 'N') AS n_val, count(*) FILTER (sp = 'R') AS n_test,
 any_value(aois_big) AS aois_big, any_value(aois_wide) AS aois_wide, any_value(classes) AS classes, any_value(classes_big) AS classes_big FROM g JOIN a USING (region) JOIN k USING (region) GROUP BY region""")
def region_capacity(t):
    p = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    sp = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    p = p.select((F.col("s_suppkey") % 40).alias("aoi"), F.col("n_nationkey").alias("iso"), F.col("n_regionkey").alias("rk"), (1 + F.col("l_partkey") % 17).alias("class"), (1 - F.col("l_discount")).alias("weight"), sp.alias("split"))
    d = R.region_capacity(p, {"all": F.lit(True), "south": F.col("rk").isin(0, 1), "islands": F.col("iso") % 4 == 1}, big=1500)
    return d.withColumn("mean_weight", F.round("mean_weight", 4))


@query("labelled_area", "D42", """SELECT g, round(sum(100 * cos(radians(row))) / 1e6, 6) AS labelled_km2, count(DISTINCT class) AS n_classes, count(*) AS n_pixels FROM {class_pixels} GROUP BY g""")
def labelled_area(t):
    return rounded(R.labelled_area(t["class_pixels"], ["g"], 100 * F.cos(F.radians("row"))))


@query("cell_coverage", "D42 G5", """SELECT g, row // 12 AS cy, col // 12 AS cx, round(count(*) / 144, 6) AS coverage, count(*) / 144 BETWEEN 0.8::DOUBLE AND 0.9::DOUBLE AS valid FROM {class_pixels} GROUP BY ALL""")
def cell_coverage(t):
    return rounded(R.cell_coverage(t["class_pixels"], ["g"], 12, 0.8, 0.9))


@query("class_mix", "D43 D52", """WITH c AS (SELECT city, lcz, count(*) AS n FROM {scan} WHERE lcz <> 9 GROUP BY ALL), g AS (SELECT DISTINCT city, k FROM {scan}, (SELECT unnest(range(1, 18))::INT AS k))
SELECT g.city, k AS class, round(100 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.city), 6) AS pct FROM g LEFT JOIN c ON c.city = g.city AND c.lcz = k""")
def class_mix(t):
    return rounded(R.class_mix(t["scan"].where("lcz <> 9"), ["city"], "lcz"))


@query("class_weights", "D45", """WITH a AS (SELECT k, sum(h * w)::DOUBLE AS a FROM (SELECT unnest(range(1, 18))::INT AS k) LEFT JOIN (SELECT * FROM {scan} WHERE lcz <> 9) ON lcz = k GROUP BY k), i AS (SELECT k, coalesce(sqrt(1 / a), avg(sqrt(1 / a)) OVER ()) AS w FROM a) SELECT k AS class, round(w / avg(w) OVER (), 6) AS weight FROM i""")
def class_weights(t):
    d = t["scan"].where("lcz <> 9").select(F.col("lcz").alias("class"), (F.col("h") * F.col("w")).cast("double").alias("area"))
    return rounded(R.class_weights(d, "sqrt_inv_freq"))


@query("set_draw_weights", "D46", """WITH s AS (SELECT *, CASE WHEN (row + col) % 3 = 0 THEN bitmask | 5 ELSE bitmask END AS m FROM {set_pixels}), b AS (SELECT g, row, col, m, unnest(list_filter(range(17), lambda i: (m >> i) & 1 = 1)) AS c FROM s), h AS (SELECT c, 1 / count(*) AS iv FROM b WHERE bit_count(m) = 1 GROUP BY c)
SELECT g, row, col, round(avg(coalesce(iv, 0)), 9) AS weight FROM b LEFT JOIN h USING (c) GROUP BY g, row, col""")
def set_draw_weights(t):
    m = F.when((F.col("row") + F.col("col")) % 3 == 0, F.col("bitmask").bitwiseOR(F.lit(5).cast("long"))).otherwise(F.col("bitmask"))
    d = R.set_draw_weights(t["set_pixels"].withColumn("bitmask", m))
    return d.select("g", "row", "col", F.round("weight", 9).alias("weight"))


@query("density_grid", "D33 A25", """WITH p AS (SELECT o_totalprice AS x, o_custkey::DOUBLE AS y, o_orderstatus AS s, o_orderpriority AS p FROM orders), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
 c AS (SELECT f.f AS facet, CASE f.f WHEN 'status' THEN s ELSE p END AS v, least(floor((x - x0) / ((x1 - x0) / 30)), 29) AS i, least(floor((y - y0) / ((y1 - y0) / 30)), 29) AS j, x0, x1, y0, y1 FROM p, e, (VALUES ('status'), ('priority')) f(f))
SELECT facet, v AS facet_value, round(any_value(x0) + (i + 0.5) * (any_value(x1) - any_value(x0)) / 30, 4) AS bin_x, round(any_value(y0) + (j + 0.5) * (any_value(y1) - any_value(y0)) / 30, 4) AS bin_y, count(*) AS n FROM c GROUP BY facet, v, i, j""")
def density_grid(t):
    p = t["orders"].select(F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    d = R.density_grid(p, ["status", "priority"], 30)
    return d.withColumns({"bin_x": F.round("bin_x", 4), "bin_y": F.round("bin_y", 4)})


@query("robust_limits", "E14", """WITH q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events) SELECT round(a - 0.04 * (b - a), 6) AS lo, round(b + 0.04 * (b - a), 6) AS hi FROM q""")
def robust_limits(t):
    return rounded(R.robust_limits(t["events"], "value"))


@query("depth_order", "E14 E4", """SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS depth FROM events""")
def depth_order(t):
    return R.depth_order(t["events"].select("event_id", "value"), "value", "event_id", descending=True).select("event_id", "depth")


@query("top_levels", "E15", """WITH c AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 6) SELECT coalesce(c.source, 'Other') AS source_top, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents d LEFT JOIN c ON c.source = d.source GROUP BY 1""")
def top_levels(t):
    d = R.top_levels(t["documents"].select("source", "n_chars"), "source", 6)
    return d.groupBy("source_top").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("class_labels", "B44", """SELECT dataset || '/' || patch_id AS uid, city, lcz, CASE lcz WHEN 1 THEN 'LCZ 1: Compact high-rise' WHEN 11 THEN 'LCZ A: Dense trees' WHEN 17 THEN 'LCZ G: Water' ELSE 'other' END AS name FROM {reference_patches}""")
def class_labels(t):
    code, name = R.class_labels(F.col("lcz"))
    shown = F.when(code.isin("1", "A", "G"), name).otherwise("other")
    return t["reference_patches"].select(F.concat_ws("/", "dataset", "patch_id").alias("uid"), "city", "lcz", shown.alias("name"))


@query("common_rescore", "C20", """WITH a AS (SELECT block_id AS k, orderkey AS o, linenumber AS l, city, max(truth) AS truth, max(pred) AS pred FROM {predictions} GROUP BY ALL), j AS (SELECT a.truth, a.pred AS pa, 1 + (a.pred + a.o) % 17 AS pb FROM a WHERE o % 3 > 0),
 u AS (SELECT 'a' AS model, truth, pa AS pred FROM j UNION ALL SELECT 'b', truth, pb FROM j) SELECT model, count(*) AS n, round(avg((truth = pred)::INT), 6) AS oa FROM u GROUP BY model""")
def common_rescore(t):
    a = t["predictions"].groupBy(F.col("block_id").alias("k"), F.col("orderkey").alias("o"), F.col("linenumber").alias("l"), "city").agg(F.max("truth").alias("label"), F.max("pred").alias("pred"))
    b = a.where(F.col("o") % 3 > 0).withColumn("pred", 1 + (F.col("pred") + F.col("o")) % 17)
    long, bad = R.common_rescore(a, b, ["k", "o", "l", "city"])
    return rounded(summary_scores(confusion_counts(long, keys=["model"]), ["model"]).select("model", "n", "oa"))


@query("many_to_one_unmatched", "C22", """SELECT count(*) FILTER (c_custkey IS NULL) AS n_unmatched, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 7""")
def many_to_one_unmatched(t):
    left = t["orders"].select((F.col("o_custkey") + 7).alias("k"), "o_orderkey")
    return R.many_to_one(left, t["customer"].select(F.col("c_custkey").alias("k"), "c_name"), "k")[1]


@query("many_to_one_rows", "C22 C21 A21", """SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey + 7""")
def many_to_one_rows(t):
    left = t["orders"].select((F.col("o_custkey") + 7).alias("k"), "o_orderkey")
    return R.many_to_one(left, t["customer"].select(F.col("c_custkey").alias("k"), "c_name"), "k")[0].select("o_orderkey", "c_name")


@query("incremental_fill", "C24 F4", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'cached' ELSE 'fresh' END AS origin, length(html) AS size FROM pages""")
def incremental_fill(t):
    p = t["pages"].select("page_id", F.length("html").cast("long").alias("size"))
    cache = p.where(F.col("page_id") % 3 == 0).withColumn("origin", F.lit("cached"))
    return R.incremental_fill(p, cache, "page_id", lambda d: d.withColumn("origin", F.lit("fresh"))).select("page_id", "origin", "size")


@query("column_blocks", "C25", """SELECT d.doc_id, d.lang, d.n_chars AS text_n_chars, l.quality AS labels_quality, l.toxic AS labels_toxic FROM documents d JOIN labels l USING (doc_id)""")
def column_blocks(t):
    runs = {"text": t["documents"].select("doc_id", "lang", "n_chars"), "labels": t["labels"].select("doc_id", "quality", "toxic")}
    return R.column_blocks(runs, "doc_id", ["lang"])


@query("resolved_places", "C28", """WITH pl AS (SELECT s_name AS place, lower(trim(replace(s_name, '_', ' '))) AS k FROM supplier), nm AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'SUPPLIER#' || lpad((c_custkey % 200)::VARCHAR, 9, '0') WHEN c_custkey % 3 = 1 THEN 'supplX_' || c_custkey ELSE 'other ' || c_custkey END AS name FROM customer),
 k AS (SELECT *, lower(trim(replace(name, '_', ' '))) AS k FROM nm), e AS (SELECT c_custkey, min(place) AS e, count(*) AS ne FROM k JOIN pl USING (k) GROUP BY 1), f AS (SELECT c_custkey, min(place) AS f, count(*) AS nf FROM k JOIN (SELECT place, substr(k, 1, 5) AS p5 FROM pl) p ON p.p5 = substr(k.k, 1, 5) GROUP BY 1)
SELECT c_custkey, coalesce(e, f) AS place, CASE WHEN ne = 1 THEN 'exact' WHEN ne > 1 THEN 'exact, ambiguous' WHEN nf = 1 THEN 'prefix' WHEN nf > 1 THEN 'prefix, ambiguous' ELSE 'none' END AS how FROM nm LEFT JOIN e USING (c_custkey) LEFT JOIN f USING (c_custkey)""")
def resolved_places(t):
    i = F.col("c_custkey")
    n = t["customer"].select(i, F.when(i % 3 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((i % 200).cast("string"), 9, "0"))).when(
        i % 3 == 1, F.concat(F.lit("supplX_"), i.cast("string"))).otherwise(F.concat(F.lit("other "), i.cast("string"))).alias("name"))
    d = R.resolve_places(n.select("name").distinct(), t["supplier"].select(F.col("s_name").alias("place")))
    return n.join(d, "name").select("c_custkey", "place", "how")


@query("overridden_places", "C28", """WITH pl AS (SELECT s_name AS place, lower(trim(replace(s_name, '_', ' '))) AS k FROM supplier), nm AS (SELECT n_nationkey, n_name AS name FROM nation)
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN 'Supplier#' || lpad((n_nationkey + 1)::VARCHAR, 9, '0') WHEN substr(lower(name), 1, 5) = 'suppl' THEN (SELECT min(place) FROM pl) END AS place,
 CASE WHEN n_nationkey % 4 = 1 THEN 'override' ELSE 'none' END AS how FROM nm""")
def overridden_places(t):
    n = t["nation"].select("n_nationkey", F.col("n_name").alias("name"))
    own = n.where("n_nationkey % 4 = 1").select("name", F.concat(F.lit("Supplier#"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 9, "0")).alias("place"))
    d = R.resolve_places(n.select("name").distinct(), t["supplier"].select(F.col("s_name").alias("place")), overrides=own)
    return n.join(d, "name").select("n_nationkey", "place", "how")


@query("place_context", "C23 C37", """WITH c AS (SELECT point_id, aoi AS country, inside FROM (SELECT p.point_id, a.aoi, p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy AS inside, row_number() OVER (PARTITION BY point_id ORDER BY NOT (p.x BETWEEN minx AND maxx AND p.y BETWEEN miny AND maxy), sqrt((p.x - (minx + maxx) / 2) ** 2 + (p.y - (miny + maxy) / 2) ** 2), aoi) AS r FROM {points} p, {aoi_boxes} a) WHERE r = 1),
 s AS (SELECT p.point_id, arg_max(s.shape_id, struct_pack(l := s.p_size % 3, a := (s.x1 - s.x0) * (s.y1 - s.y0), k := s.shape_id)) AS place FROM {points} p JOIN {shapes} s ON p.x BETWEEN s.x0 AND s.x1 AND p.y BETWEEN s.y0 AND s.y1 GROUP BY p.point_id)
SELECT p.point_id, country, inside, value AS climate, place, place IS NOT NULL AS urban FROM {points} p JOIN c USING (point_id) LEFT JOIN s USING (point_id) LEFT JOIN {value_pixels} v ON v.row = floor(p.y / 10) AND v.col = floor(p.x / 10)""")
def place_context(t):
    countries = t["aoi_boxes"].select(F.col("aoi").alias("country"), G.box("minx", "miny", "maxx", "maxy").alias("rbox"))
    b = G.box("x0", "y0", "x1", "y1")
    towns = t["shapes"].select(F.col("shape_id").alias("place"), (F.col("p_size") % 3).alias("level"), G.area(b).alias("size"), b.alias("rbox"))
    d = R.place_context(t["points"], countries, t["value_pixels"].withColumnRenamed("value", "climate"), towns, "point_id", 512.0, 10.0, 400.0, 8000.0)
    return d.select("point_id", "country", "inside", "climate", "place", "urban")


FIXED = {"lake": 17, "forest": 11, "scrub": 13, "dune": 16, "scree": 15, "parking": 15, "works": 10, "grass": 14}


@query("feature_lut", "B41", """SELECT fid, CASE class WHEN 'lake' THEN 17 WHEN 'forest' THEN 11 WHEN 'scrub' THEN 13 WHEN 'dune' THEN 16 WHEN 'scree' THEN 15 WHEN 'parking' THEN 15 WHEN 'works' THEN 10 WHEN 'grass' THEN 14
 WHEN 'building' THEN CASE orderkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 6 ELSE 3 END END::INT AS cls FROM {features}""")
def feature_lut(t):
    d = t["features"].withColumn("bin", (F.col("orderkey") % 3).cast("int"))
    return d.select("fid", R.lut_classes(d, FIXED, {"building": (9, 6, 3)}, "class", "bin").cast("int").alias("cls"))


# fixed values: tag rules (key, value, class, buffer in metres)
RULES = [("natural", "lake", 17, None), ("natural", "forest", 11, None), ("landuse", "grass", 14, None), ("natural", "dune", 16, None),
         ("natural", "scree", 15, None), ("aeroway", "parking", 15, 15.0), ("landuse", "works", 10, None), ("natural", "scrub", 13, None)]
ORDER = [10, 14, 13, 11, 16, 15, 17]


@query("tag_rule_classes", "B43", """WITH f AS (SELECT zone_id, class AS value, CASE WHEN class IN ('grass', 'works') THEN 'landuse' WHEN class = 'parking' THEN 'aeroway' ELSE 'natural' END AS k FROM (SELECT partkey AS zone_id, class FROM {features})),
 c AS (SELECT zone_id, CASE value WHEN 'lake' THEN 17 WHEN 'forest' THEN 11 WHEN 'grass' THEN 14 WHEN 'dune' THEN 16 WHEN 'scree' THEN 15 WHEN 'parking' THEN 15 WHEN 'works' THEN 10 WHEN 'scrub' THEN 13 END AS cls, CASE value WHEN 'parking' THEN 15.0 END AS buf FROM f)
SELECT zone_id, arg_max(cls, CASE cls WHEN 10 THEN 0 WHEN 14 THEN 1 WHEN 13 THEN 2 WHEN 11 THEN 3 WHEN 16 THEN 4 WHEN 15 THEN 5 ELSE 6 END)::INT AS top_class, count(cls) AS n_matched, count(buf) AS n_buffered FROM c WHERE cls IS NOT NULL GROUP BY zone_id""")
def tag_rule_classes(t):
    k = F.when(F.col("class").isin("grass", "works"), "landuse").when(F.col("class") == "parking", "aeroway").otherwise("natural")
    d = t["features"].select(F.col("partkey").alias("zone_id"), F.col("class").alias("value"), k.alias("key"))
    cls, buf, rank = R.tag_rules(RULES, ORDER)
    d = d.withColumns({"cls": cls, "buf": buf, "rank": rank}).where(F.col("cls").isNotNull())
    return d.groupBy("zone_id").agg(F.max_by("cls", "rank").alias("top_class"), F.count("cls").alias("n_matched"), F.count("buf").alias("n_buffered"))


@query("coarsen_sweep", "L8", """WITH f(f) AS (VALUES (4), (8), (16)),
 c AS (SELECT f, g, row // f AS br, col // f AS bc, class, count(*) AS n FROM {class_pixels}, f GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, g, br, bc ORDER BY n DESC, class) AS r FROM c) WHERE r = 1),
 tr AS (SELECT DISTINCT f, g, row // f AS br, col // f AS bc, 1 + (row // 16 * 3 + col // 16 * 5) % 17 AS truth FROM {class_pixels}, f)
SELECT 'mode' || f AS config, count(*) AS n, round(avg((class = truth)::INT), 6) AS oa FROM m JOIN tr USING (f, g, br, bc) GROUP BY f""")
def coarsen_sweep(t):
    p = t["class_pixels"]
    out = {}
    for f in (4, 8, 16):
        truth = 1 + (F.floor(F.col("brow") * f / 16) * 3 + F.floor(F.col("bcol") * f / 16) * 5) % 17
        out[f"mode{f}"] = majority_pool(p, ["g"], f).select(truth.cast("int").alias("truth"), F.col("class").alias("pred"))
    return rounded(sweep(out).select("config", "n", "oa"))


@query("patch_metadata", "C37 C38", """SELECT r.dataset || '/' || r.patch_id AS uid, r.city, r.lcz, round(avg(s.invalid_frac), 6) AS mean_invalid, count(s.family) AS n_families FROM {reference_patches} r LEFT JOIN {scan} s USING (dataset, patch_id) GROUP BY ALL""")
def patch_metadata(t):
    r = require_unique(t["reference_patches"].select("dataset", "patch_id", "city", "lcz"), ["dataset", "patch_id"])
    j = r.join(t["scan"].select("dataset", "patch_id", "family", "invalid_frac"), ["dataset", "patch_id"], "left")
    return rounded(j.groupBy(F.concat_ws("/", "dataset", "patch_id").alias("uid"), "city", "lcz").agg(
        F.avg("invalid_frac").alias("mean_invalid"), F.count("family").alias("n_families")))


@query("score_ladder", "D49 A28", """WITH s AS (SELECT region, count(*) AS n, avg((truth = pred)::INT) AS oa FROM {predictions} GROUP BY region)
SELECT region, round(oa, 6) AS oa, round(oa - lag(oa) OVER (ORDER BY region), 6) AS d_oa FROM s""")
def score_ladder(t):
    s = summary_scores(confusion_counts(t["predictions"], keys=["region"]), ["region"])
    return rounded(R.ladder(s, "region", ["oa"]))


@query("strict_relaxed_union", "F1 F2 A21", """SELECT 's' || p_partkey AS pid, 'strict' AS part, p_size FROM part WHERE p_size > 20 UNION ALL SELECT 'r' || p_partkey, 'relaxed', p_size FROM part WHERE p_size <= 30""")
def strict_relaxed_union(t):
    p = t["part"]
    pid = lambda c: F.concat(F.lit(c), F.col("p_partkey").cast("string")).alias("pid")
    return R.union_checked({"strict": p.where("p_size > 20").select(pid("s"), "p_size"), "relaxed": p.where("p_size <= 30").select(pid("r"), "p_size")}, "pid").select("pid", "part", "p_size")
