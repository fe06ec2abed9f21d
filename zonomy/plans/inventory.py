"""Patch inventories of three families, manifests and audits over them, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import geometry as G
from zonomy.functions.common import crc_keep
from zonomy.operators import manifest as M
from zonomy.operators import splits as S
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

FAM = ["fa", "fb", "fc"]
view("scan", """
SELECT family, dataset, patch_id, h, w, n_invalid, h * w AS n_pixels, n_invalid / CAST(h * w AS DOUBLE) AS invalid_frac,
  'city' || CAST(patch_id % 20 AS STRING) AS city, CAST(1 + patch_id % 17 AS INT) AS lcz FROM (
 SELECT family, dataset, patch_id, CAST(CASE WHEN mq % 11 = 0 THEN 9 + mq % 13 ELSE 32 + patch_id % 3 END AS BIGINT) AS h,
   CAST(CASE WHEN mq % 13 = 1 THEN 8 + n % 9 ELSE 32 + n % 3 END AS BIGINT) AS w, CAST(CASE WHEN mq % 4 = 0 THEN (patch_id * 7 + mq * 3) % 64 ELSE 0 END AS BIGINT) AS n_invalid FROM (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN 'fa' WHEN 1 THEN 'fb' ELSE 'fc' END AS family,
    CASE l_returnflag WHEN 'A' THEN 'training' WHEN 'N' THEN 'validation' ELSE 'testing' END AS dataset,
    l_partkey AS patch_id, max(l_quantity) AS mq, count(*) AS n FROM {lineitem} GROUP BY 1, 2, 3) x) y
""")
_REF = "SELECT '{d}' AS dataset, p_partkey AS patch_id, 'city' || CAST(p_partkey % 20 AS STRING) AS city, CAST(1 + p_partkey % 17 AS INT) AS lcz, p_size, p_retailprice FROM {{part}}"
view("reference_patches", " UNION ALL ".join(_REF.format(d=d) for d in ("training", "validation", "testing", "unlabeled")))

NATIVE = """md AS (SELECT family, median((h * w)::DOUBLE) AS ea FROM scan WHERE dataset = 'training' GROUP BY family),
 nt AS (SELECT scan.*, h * w / ea AS nf, coalesce(invalid_frac <= 0.25::DOUBLE AND h * w / ea >= 0.5::DOUBLE, false) AS ok FROM scan LEFT JOIN md USING (family))"""
MAN = NATIVE + ", man AS (SELECT dataset, patch_id, min(city) AS city, min(lcz) AS lcz, " + ", ".join(
    f"max(invalid_frac) FILTER (family = '{f}') AS if_{f}, max(nf) FILTER (family = '{f}') AS nf_{f}, count(*) FILTER (family = '{f}') > 0 AS pr_{f}, coalesce(bool_or(ok) FILTER (family = '{f}'), false) AS ok_{f}"
    for f in FAM) + " FROM nt GROUP BY dataset, patch_id), mem AS (SELECT *, ok_fa AND ok_fb AND ok_fc AS m FROM man)"


def _man(t):
    return M.build_manifest(t["scan"], FAM)


@query("common_manifest", "D35 X7", f"""WITH {MAN} SELECT dataset, patch_id, city, lcz, {', '.join(f"round(if_{f}, 6) AS invalid_frac_{f}, round(nf_{f}, 6) AS native_frac_{f}, pr_{f} AS present_{f}, ok_{f}" for f in FAM)}, m AS in_manifest FROM mem -- {{scan}}""", headline=True)
def common_manifest(t):
    return rounded(_man(t))


@query("filter_by_invalid", "C19", """WITH w AS (SELECT dataset, patch_id, max(invalid_frac) AS f FROM {scan} WHERE family IN ('fa', 'fb') GROUP BY ALL)
SELECT r.dataset, r.patch_id FROM {reference_patches} r LEFT JOIN w USING (dataset, patch_id) WHERE f IS NULL OR f <= 0.02::DOUBLE""")
def filter_by_invalid(t):
    return M.filter_invalid(t["reference_patches"], t["scan"], 0.02, ["fa", "fb"]).select("dataset", "patch_id")


@query("filter_by_native", "C19", f"""WITH {MAN} SELECT r.dataset, r.patch_id FROM reference_patches r LEFT JOIN man USING (dataset, patch_id) WHERE coalesce(least(nf_fa, nf_fc), 1) >= 0.9::DOUBLE -- {{scan}} {{reference_patches}}""")
def filter_by_native(t):
    return M.filter_native(t["reference_patches"], _man(t), 0.9, ["fa", "fc"]).select("dataset", "patch_id")


@query("filter_by_manifest", "C19 F4", f"""WITH {MAN} SELECT r.dataset, r.patch_id FROM reference_patches r LEFT JOIN mem USING (dataset, patch_id) WHERE coalesce(m, true) -- {{scan}} {{reference_patches}}""")
def filter_by_manifest(t):
    return M.filter_members(t["reference_patches"], _man(t)).select("dataset", "patch_id")


@query("ids_in_every_family", "C18 C29 F3", """SELECT dataset, patch_id FROM {scan} GROUP BY ALL HAVING count(DISTINCT family) = 3""")
def ids_in_every_family(t):
    return M.in_every_source(t["scan"], FAM)


@query("coverage_summary", "D32", """WITH m AS (SELECT family, dataset, median(h) AS mh, median(w) AS mw FROM {scan} GROUP BY ALL), r AS (SELECT dataset, count(DISTINCT patch_id) AS n FROM {reference_patches} GROUP BY dataset)
SELECT family, dataset, mh AS med_h, count(*) AS n_on_disk, round(sum(n_invalid) / sum(n_pixels), 6) AS total_invalid_px_frac, round(avg((invalid_frac > 0)::INT), 6) AS frac_any_invalid,
 count(*) FILTER (invalid_frac > 0.01::DOUBLE) AS n_above_1, count(*) FILTER (h < 0.85::DOUBLE * mh OR w < 0.85::DOUBLE * mw) AS n_truncated, round(max(invalid_frac), 6) AS max,
 round(quantile_cont(invalid_frac, 0.5), 6) AS p50, round(quantile_cont(invalid_frac, 0.9), 6) AS p90, round(quantile_cont(invalid_frac, 0.99), 6) AS p99, any_value(n) AS n_reference, any_value(n) - count(*) AS n_missing
FROM {scan} JOIN m USING (family, dataset) JOIN r USING (dataset) GROUP BY family, dataset, mh""".replace("mh AS med_h, ", "").replace("GROUP BY family, dataset, mh", "GROUP BY family, dataset").replace("count(*) FILTER (invalid_frac > 0.01::DOUBLE) AS n_above_1", "count(*) FILTER (invalid_frac > 0) AS n_above_0, count(*) FILTER (invalid_frac > 0.1::DOUBLE) AS n_above_10, count(*) FILTER (invalid_frac > 0.25::DOUBLE) AS n_above_25, count(*) FILTER (invalid_frac > 0.5::DOUBLE) AS n_above_50, count(*) FILTER (invalid_frac > 0.75::DOUBLE) AS n_above_75"))
def coverage_summary(t):
    return rounded(M.coverage_summary(t["scan"], t["reference_patches"]))


@query("invalid_histogram", "D32", """SELECT family, CASE WHEN invalid_frac < 1e-12 THEN 'exactly 0' WHEN invalid_frac < 0.001::DOUBLE THEN '0-0.1%' WHEN invalid_frac < 0.01::DOUBLE THEN '0.1-1%' WHEN invalid_frac < 0.05::DOUBLE THEN '1-5%'
 WHEN invalid_frac < 0.1::DOUBLE THEN '5-10%' WHEN invalid_frac < 0.25::DOUBLE THEN '10-25%' WHEN invalid_frac < 0.5::DOUBLE THEN '25-50%' WHEN invalid_frac < 0.75::DOUBLE THEN '50-75%' ELSE '75-100%' END AS bucket, count(*) AS n FROM {scan} GROUP BY ALL""")
def invalid_histogram(t):
    return M.invalid_histogram(t["scan"])


@query("native_area_report", "D36", f"""WITH {NATIVE}, md2 AS (SELECT family, median(h) AS mh, median(w) AS mw FROM scan WHERE dataset = 'training' GROUP BY family)
SELECT family, min((h * w)::DOUBLE) AS area_min, max((h * w)::DOUBLE) AS area_max, count(*) FILTER (nf < 0.25) AS below_25, count(*) FILTER (nf >= 0.25 AND nf < 0.5) AS below_50, count(*) FILTER (nf >= 0.5 AND nf < 0.75) AS below_75,
 count(*) FILTER (nf >= 0.75 AND nf < 0.95::DOUBLE) AS below_95, count(*) FILTER (nf >= 0.95::DOUBLE) AS full, count(*) FILTER (nf < 0.5) AS below_area_rule, count(*) FILTER (h < 0.85::DOUBLE * mh OR w < 0.85::DOUBLE * mw) AS below_side_rule,
 round(quantile_cont((h * w)::DOUBLE, 0.01), 6) AS area_p1, quantile_cont((h * w)::DOUBLE, 0.5) AS area_p50, round(quantile_cont((h * w)::DOUBLE, 0.99), 6) AS area_p99 FROM nt JOIN md2 USING (family) GROUP BY family -- {{scan}}""")
def native_area_report(t):
    return rounded(M.native_area_report(t["scan"]))


@query("modal_shapes", "D36 E13", """SELECT family, h, w, n FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, h, w) AS r FROM (SELECT family, h, w, count(*) AS n FROM {scan} WHERE dataset = 'training' GROUP BY ALL)) WHERE r <= 5""")
def modal_shapes(t):
    return M.modal_shapes(t["scan"])


@query("independence_audit", "D37", """WITH b AS (SELECT s.*, EXISTS (SELECT 1 FROM {scan} o WHERE o.family = 'fb' AND o.dataset = s.dataset AND o.patch_id = s.patch_id) AS hb, EXISTS (SELECT 1 FROM {scan} o WHERE o.family = 'fc' AND o.dataset = s.dataset AND o.patch_id = s.patch_id) AS hc FROM {scan} s WHERE family = 'fa')
SELECT dataset, count(*) FILTER (invalid_frac > 0.75) AS n_severe, count(*) FILTER (invalid_frac > 0.25) AS n_above_max, count(*) FILTER (invalid_frac > 0.75 AND NOT hb) AS severe_absent_fb, round(avg((NOT hb)::INT), 6) AS base_absence_fb,
 count(*) FILTER (invalid_frac > 0.75 AND NOT hc) AS severe_absent_fc, round(avg((NOT hc)::INT), 6) AS base_absence_fc FROM b GROUP BY dataset""")
def independence_audit(t):
    return rounded(M.independence_audit(t["scan"], "fa", ["fb", "fc"]))


@query("loss_tables", "D38", f"""WITH {MAN}, g AS (SELECT dataset, city, lcz, grouping(city) AS gc, count(*) AS n, count(*) FILTER (m) AS kept FROM mem GROUP BY GROUPING SETS ((dataset, city), (dataset, lcz)))
SELECT dataset, CASE WHEN gc = 0 THEN 'city' ELSE 'lcz' END AS cut, CASE WHEN gc = 0 THEN city ELSE lcz::VARCHAR END AS level, n, kept, n - kept AS lost, round(100 * (n - kept) / n, 6) AS loss_pct FROM g -- {{scan}}""")
def loss_tables(t):
    return rounded(M.loss_tables(_man(t)))


@query("composition_shift", "D38", f"""WITH {MAN}, p AS (SELECT dataset, lcz, count(*) AS n, count(*) FILTER (m) AS k FROM mem GROUP BY ALL), s AS (SELECT *, 100 * n / sum(n) OVER (PARTITION BY dataset) AS b, coalesce(100 * k / nullif(sum(k) OVER (PARTITION BY dataset), 0), 0) AS a FROM p)
SELECT dataset, lcz, round(b, 6) AS before_pct, round(a, 6) AS after_pct, round(a - b, 6) AS delta_pp FROM s -- {{scan}}""")
def composition_shift(t):
    return rounded(M.composition_shift(_man(t)))


@query("manifest_blame", "D38", f"""WITH {MAN} SELECT dataset, count(*) AS n_lost, {', '.join(f"count(*) FILTER (NOT pr_{f}) AS absent_{f}, count(*) FILTER (pr_{f} AND NOT ok_{f}) AS failed_{f}" for f in FAM)} FROM mem WHERE NOT m GROUP BY dataset -- {{scan}}""")
def manifest_blame(t):
    return M.blame(_man(t), FAM)


@query("family_loss", "D38", f"""WITH {MAN}, o AS (SELECT family, dataset, count(*) AS on_disk, count(*) FILTER (ok) AS own_filtered FROM nt GROUP BY ALL), e AS (SELECT dataset, count(*) FILTER (m) AS members FROM mem GROUP BY dataset)
SELECT family, dataset, on_disk, own_filtered, members, round((own_filtered - members) / own_filtered, 6) AS loss_vs_own FROM o JOIN e USING (dataset) -- {{scan}}""")
def family_loss(t):
    return rounded(M.family_loss(t["scan"], _man(t)))


@query("city_coverage", "D34", """WITH m AS (SELECT family, median(h) AS mh, median(w) AS mw FROM {scan} GROUP BY family), d AS (SELECT s.*, h < 0.85::DOUBLE * mh OR w < 0.85::DOUBLE * mw AS cut FROM {scan} s JOIN m USING (family)),
 r AS (SELECT city, count(*) AS n_patches FROM {reference_patches} WHERE dataset <> 'unlabeled' GROUP BY city)
SELECT r.city, r.city IN ('city3', 'city7') AS held_out, n_patches, """ + ", ".join(f"round(coalesce(sum(n_invalid) FILTER (family = '{f}') / sum(n_pixels) FILTER (family = '{f}'), 0), 6) AS invalid_frac_{f}, count(*) FILTER (family = '{f}' AND invalid_frac > 0.25) AS n_above_{f}, n_patches - count(*) FILTER (family = '{f}') AS n_missing_{f}, count(*) FILTER (family = '{f}' AND cut) AS n_truncated_{f}" for f in FAM) + " FROM r LEFT JOIN d USING (city) GROUP BY r.city, n_patches")
def city_coverage(t):
    ref = t["reference_patches"].where("dataset <> 'unlabeled'")
    return rounded(M.city_coverage(t["scan"], ref, FAM, ("city3", "city7")))


def _status(t):
    s = F.when(F.col("invalid_frac") == 0, "full").when(F.col("invalid_frac") < 0.03, "partial").otherwise("none")
    return t["scan"].withColumn("status", s)


@query("recovery_counts", "D39", """SELECT family, city, count(*) AS n, count(*) FILTER (invalid_frac = 0) AS "full", count(*) FILTER (invalid_frac > 0 AND invalid_frac < 0.03::DOUBLE) AS partial, count(*) FILTER (invalid_frac >= 0.03::DOUBLE) AS "none",
 round(100 * count(*) FILTER (invalid_frac = 0) / count(*), 6) AS full_pct FROM {scan} GROUP BY ALL""")
def recovery_counts(t):
    return rounded(M.recovery_counts(_status(t), ["family", "city"]))


@query("truncation_by_zones", "D39 C26", """WITH p AS (SELECT patch_id, count(DISTINCT dataset) AS nz, bool_or(h < 30 OR w < 30) AS tr FROM {scan} WHERE family = 'fa' GROUP BY patch_id), a AS (SELECT count(*) FILTER (nz > 1) AS n_multi, count(*) FILTER (nz <= 1) AS n_single, avg(tr::INT) FILTER (nz > 1) AS rm, avg(tr::INT) FILTER (nz <= 1) AS rs FROM p)
SELECT n_multi, n_single, round(rm, 6) AS rate_multi, round(rs, 6) AS rate_single, round(rm / nullif(rs, 0), 6) AS ratio FROM a""")
def truncation_by_zones(t):
    p = t["scan"].where("family = 'fa'").groupBy("patch_id").agg(
        F.countDistinct("dataset").alias("n_zones"), F.max((F.col("h") < 30) | (F.col("w") < 30)).alias("truncated"))
    return rounded(M.truncation_by_zones(p))


@query("size_rank_correlation", "D40 E11", """WITH r AS (SELECT (rank() OVER (ORDER BY n_chars)) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rx, (rank() OVER (ORDER BY len)) + (count(*) OVER (PARTITION BY len) - 1) / 2 AS ry
 FROM (SELECT n_chars, length(lang) + doc_id % 97 + n_chars / 50 AS len FROM documents)) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r""")
def size_rank_correlation(t):
    d = t["documents"].select("n_chars", (F.length("lang") + F.col("doc_id") % 97 + F.col("n_chars") / 50).alias("len"))
    return rounded(M.spearman(d, "n_chars", "len"))


# ── splits ───────────────────────────────────────────────────────────────────

view("areas", """
SELECT 'a' || CAST(s_suppkey AS STRING) AS aoi, CAST(s_nationkey % 6 AS STRING) AS iso, s_suppkey AS sid, s_acctbal AS weight, s_suppkey % 17 = 3 AS forced FROM {supplier}
""")
REGION = {"0": "Europe", "1": "Asia", "2": "Africa", "3": "Americas", "4": "Oceania"}
FRAC = "('0x' || substr(sha256('{salt}:' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
REG = "CASE iso WHEN '0' THEN 'Europe' WHEN '1' THEN 'Asia' WHEN '2' THEN 'Africa' WHEN '3' THEN 'Americas' WHEN '4' THEN 'Oceania' ELSE 'Unknown' END"


def _areas(t):
    return t["areas"].withColumn("region", S.lookup_group(t["areas"], REGION, F.col("iso")))


@query("region_splits", "I1 I2 I5 X6", f"""WITH r AS (SELECT *, {REG} AS region FROM areas), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {FRAC.format(salt='areas-v1', key='aoi')}, aoi) AS r, count(*) OVER (PARTITION BY region) AS n FROM r),
 q AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.15::DOUBLE, 0)) ELSE 0 END AS nt FROM k)
SELECT aoi, region, CASE WHEN forced THEN 'test' WHEN r <= nt THEN 'test' WHEN r <= 2 * nt THEN 'val' ELSE 'train' END AS split FROM q -- {{areas}}""")
def region_splits(t):
    return S.region_splits(_areas(t), forced="forced").select("aoi", "region", "split")


@query("train_val_splits", "I3 C34", f"""WITH r AS (SELECT *, {REG} AS region FROM areas), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {FRAC.format(salt='cities-v1', key='aoi')}, aoi) AS r, count(*) OVER (PARTITION BY region) AS n FROM r WHERE NOT forced)
SELECT aoi, CASE WHEN n < 2 OR r <= least(greatest(1, round_even(n * 0.8::DOUBLE, 0)), n - 1) THEN 'train' ELSE 'val' END AS split FROM k UNION ALL SELECT aoi, 'test' FROM r WHERE forced -- {{areas}}""")
def train_val_splits(t):
    d = S.train_val_splits(_areas(t), "aoi", "region", "forced")
    S.require_empty(S.split_violations(d, "aoi", held_out=d.where("forced")), "split leakage")
    return d.select("aoi", "split")


@query("city_roles", "I4", f"""WITH r AS (SELECT *, {REG} AS region FROM areas), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY weight DESC, aoi) AS r, count(*) OVER (PARTITION BY region) AS n FROM r WHERE NOT forced),
 p AS (SELECT aoi FROM k ORDER BY r, n DESC, region, aoi LIMIT 9)
SELECT aoi, CASE WHEN forced THEN 'culture' WHEN aoi IN (SELECT aoi FROM p) THEN 'val_inner' ELSE 'train' END AS role FROM areas -- {{areas}}""")
def city_roles(t):
    return S.city_roles(_areas(t), 9, "aoi", "region", "weight", "forced").select("aoi", "role")


view("cell_patches", """
SELECT 'city' || CAST(k % 4 AS STRING) AS city, k AS patch_id, floor(k / 80) * 10 + floor(k / 4) % 10 AS grid_id,
  CASE WHEN floor(k / 4) % 10 < 5 THEN CASE WHEN s % 11 = 0 THEN 'val' ELSE 'test' END WHEN s % 9 = 0 THEN 'train' ELSE 'val' END AS role,
  CAST((floor(k / 4) % 10) * 1280 + (s % 4) * 320 AS DOUBLE) AS x0, CAST(floor(k / 80) * 1280 + (s % 3) * 320 AS DOUBLE) AS y0
FROM (SELECT p_partkey AS k, p_size AS s FROM {part}) p
""")


@query("cell_splits", "C31 C38 B29", """WITH c AS (SELECT DISTINCT city, grid_id, CASE city WHEN 'city0' THEN 'train' WHEN 'city1' THEN 'val_inner' ELSE 'culture' END AS cr, (grid_id % 10) * 1280.0::DOUBLE AS gx, floor(grid_id / 10) * 1280.0::DOUBLE AS gy FROM {cell_patches}),
 u AS (SELECT c.*, p.role, cr = 'culture' AND p.role = 'train' AS skip, greatest(least(gx + 1280, p.x0 + 320) - greatest(gx, p.x0), 0) * greatest(least(gy + 1280, p.y0 + 320) - greatest(gy, p.y0), 0) AS a FROM c JOIN {cell_patches} p USING (city, grid_id)),
 g AS (SELECT city, grid_id, any_value(cr) AS cr, any_value(gx) AS gx, any_value(gy) AS gy, min(role) FILTER (NOT skip) AS lo, max(role) FILTER (NOT skip) AS hi, count(*) FILTER (skip) AS tr, sum(a) AS a FROM u GROUP BY city, grid_id),
 n AS (SELECT g.*, cr = 'culture' AND lo = hi AND EXISTS (SELECT 1 FROM {cell_patches} p WHERE p.city = g.city AND p.role = CASE WHEN lo = 'test' THEN 'val' ELSE 'test' END AND p.x0 <= gx + 1480 AND p.x0 + 320 >= gx - 200 AND p.y0 <= gy + 1480 AND p.y0 + 320 >= gy - 200) AS near FROM g),
 r AS (SELECT *, CASE WHEN lo IS NULL THEN CASE WHEN tr > 0 THEN 'culture_train' ELSE 'no_labels' END WHEN lo <> hi THEN 'mixed_split' WHEN near THEN 'buffer' WHEN a / 1638400 < 0.07::DOUBLE THEN 'sparse' END AS drop_reason FROM n)
SELECT city, grid_id::BIGINT AS grid_id, drop_reason, CASE WHEN drop_reason IS NULL THEN CASE cr WHEN 'train' THEN 'train' WHEN 'val_inner' THEN 'val' ELSE CASE WHEN lo = 'test' THEN 'test' ELSE 'culture_val' END END END AS split FROM r""")
def cell_splits(t):
    p = t["cell_patches"].withColumn("rbox", G.box(F.col("x0"), F.col("y0"), F.col("x0") + 320, F.col("y0") + 320))
    role = F.when(F.col("city") == "city0", "train").when(F.col("city") == "city1", "val_inner").otherwise("culture")
    gx, gy = (F.col("grid_id") % 10) * 1280, F.floor(F.col("grid_id") / 10) * 1280
    cells = p.select("city", "grid_id").distinct().withColumn("city_role", role).withColumn("lbox", G.box(gx, gy, gx + 1280, gy + 1280))
    d = S.cell_splits(cells, p.select("city", "grid_id", "role", "rbox"), 2560.0, 200.0, 0.07)
    return d.withColumn("grid_id", F.col("grid_id").cast("long"))


# ── samples ──────────────────────────────────────────────────────────────────


@query("hash_subsample", "I6", """WITH RECURSIVE b AS (SELECT doc_id, 'd/' || doc_id AS s FROM documents), c(doc_id, s, i, crc) AS (SELECT doc_id, s, 1, 4294967295::BIGINT FROM b
  UNION ALL SELECT doc_id, s, i + 1, (WITH t0 AS (SELECT xor(crc, ord(substr(s, i, 1))::BIGINT) AS v) SELECT list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) FROM t0) FROM c WHERE i <= length(s))
SELECT doc_id FROM c WHERE i = length(s) + 1 AND xor(crc, 4294967295::BIGINT) % 1000 < 300""")
def hash_subsample(t):
    return t["documents"].where(crc_keep(F.concat(F.lit("d/"), F.col("doc_id").cast("string")), 300)).select("doc_id")


def _first_sql(salt, src, keys, key, n):
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {FRAC.format(salt=salt, key=key)}, {key}) AS rk FROM {src}) WHERE rk <= {n})"


@query("stratified_sample", "I7", f"""WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), q AS (SELECT label, least(n, greatest(floor(n * 200 / sum(n) OVER ()), least(n, 15)))::BIGINT AS sh FROM s),
 r AS (SELECT e.vec_id, e.label, sh, row_number() OVER (PARTITION BY label ORDER BY {FRAC.format(salt='s', key='vec_id')}, vec_id) AS rk FROM embeddings e JOIN q USING (label)) SELECT vec_id, label FROM r WHERE rk <= sh""")
def stratified_sample(t):
    return S.stratified_sample(t["embeddings"].select("vec_id", "label"), 200, "vec_id", floor=15)


@query("shots_per_class", "E7", f"""SELECT dataset, city, lcz, patch_id FROM {_first_sql('s', "(SELECT * FROM reference_patches WHERE dataset = 'training')", 'city, lcz', 'patch_id', 3)} UNION ALL SELECT dataset, city, lcz, patch_id FROM reference_patches WHERE dataset <> 'training' -- {{reference_patches}}""")
def shots_per_class(t):
    d = S.first_per_group(t["reference_patches"], ["city", "lcz"], 3, "patch_id", apply_to=F.col("dataset") == "training")
    return d.select("dataset", "city", "lcz", "patch_id")


@query("capped_sample", "E8", f"""WITH f AS (SELECT *, dataset || patch_id AS uid FROM reference_patches), a AS (SELECT * EXCLUDE (rk) FROM {_first_sql('s', '(SELECT * FROM f WHERE lcz NOT IN (1, 4))', 'city, lcz', 'uid', 5)})
SELECT uid FROM {_first_sql('s', 'a', 'lcz', 'uid', 40)} UNION ALL SELECT uid FROM f WHERE lcz IN (1, 4) -- {{reference_patches}}""")
def capped_sample(t):
    d = t["reference_patches"].withColumn("uid", F.concat("dataset", F.col("patch_id").cast("string")))
    return S.capped_sample(d, "uid", 5, 40, (1, 4), tile="city", cls="lcz").select("uid")


@query("balanced_sample", "I8", f"""WITH f AS (SELECT dataset || patch_id AS uid, city, lcz % 4 AS c4 FROM reference_patches), g AS (SELECT count(*) AS g FROM (SELECT DISTINCT city, c4 FROM f)),
 r AS (SELECT f.*, ceil(500.0::DOUBLE / g) AS q, g, {FRAC.format(salt='s', key='uid')} AS h, row_number() OVER (PARTITION BY city, c4 ORDER BY {FRAC.format(salt='s', key='uid')}, uid) AS r FROM f, g)
SELECT uid FROM (SELECT uid, q, g, row_number() OVER (ORDER BY CASE WHEN r <= q THEN h ELSE 1 + h END, uid) AS o FROM r) WHERE o <= q * g -- {{reference_patches}}""")
def balanced_sample(t):
    d = t["reference_patches"].select(F.concat("dataset", F.col("patch_id").cast("string")).alias("uid"), "city", (F.col("lcz") % 4).alias("c4"))
    return S.balanced_sample(d, 500, "uid", ["city", "c4"]).select("uid")


@query("paired_ids", "I9 I11", f"""SELECT uid FROM (SELECT dataset || patch_id AS uid FROM scan GROUP BY ALL HAVING count(DISTINCT family) = 3) ORDER BY {FRAC.format(salt='s', key='uid')}, uid LIMIT 300 -- {{scan}}""")
def paired_ids(t):
    d = t["scan"].withColumn("uid", F.concat("dataset", F.col("patch_id").cast("string")))
    return S.paired_ids(d, FAM, 300)


@query("members_per_block", "I10", f"""SELECT city, array_to_string(list_sort(list(patch_id)), ',') AS members, count(*) AS n_members FROM {_first_sql('s', "(SELECT * FROM reference_patches WHERE dataset = 'training')", 'city', 'patch_id', 6)} GROUP BY city -- {{reference_patches}}""")
def members_per_block(t):
    d = S.members_per_block(t["reference_patches"].where("dataset = 'training'"), "city", 6, "patch_id")
    return d.select("city", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "n_members")


@query("weighted_draws", "I12", f"""WITH c AS (SELECT p_partkey AS pk, 1 / count(*) OVER (PARTITION BY p_brand) AS w FROM part), r AS (SELECT pk, w, sum(w) OVER (ORDER BY {FRAC.format(salt='draw', key='pk')}, pk) AS hi, sum(w) OVER () AS t FROM c),
 d AS (SELECT i AS draw, {FRAC.format(salt='draw-u', key='i')} AS u FROM (SELECT unnest(range(1000)) AS i))
SELECT draw, pk AS p_partkey FROM d JOIN r ON u * t < hi AND u * t >= hi - w""")
def weighted_draws(t):
    d = S.class_draw_weights(t["part"].select("p_partkey", "p_brand"), "p_brand")
    return S.draw_weighted(d, 1000, F.col("draw_weight"), "p_partkey").select("draw", "p_partkey")


@query("patch_scans", "D31", """SELECT l_returnflag AS family, l_linestatus AS dataset, l_suppkey AS patch_id, max(l_linenumber) + 1 AS h, max(l_partkey % 48) + 1 AS w,
  count(*) FILTER (l_tax < 0.02) AS n_invalid, count(*) AS n_pixels, count(*) FILTER (l_tax < 0.02) / count(*)::DOUBLE AS invalid_frac FROM lineitem GROUP BY ALL""")
def patch_scans(t):
    px = t["lineitem"].select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("dataset"), F.col("l_suppkey").alias("patch_id"),
                              F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 48).alias("col"), "l_tax")
    return M.scan_patches(px, F.col("l_tax") < 0.02)
