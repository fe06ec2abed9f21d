"""Dirty submissions cleaned, gated and weighted; zonal rows classified."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions import clean as K
from zonomy.functions import labelsets as L
from zonomy.functions import rules as R
from zonomy.functions import weights as W
from zonomy.functions.common import isin_safe
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

view("submissions", """
SELECT o.o_orderkey AS submission_id, c.c_nationkey AS nation,
  CASE WHEN o.o_orderkey % 13 = 0 THEN 'x' WHEN o.o_orderkey % 13 = 1 THEN '18' WHEN o.o_orderkey % 13 = 2 THEN '0'
       ELSE CAST(1 + o.o_custkey % 17 AS STRING) END AS class_raw,
  CASE o.o_custkey % 7 WHEN 0 THEN 'False' WHEN 1 THEN ' t ' WHEN 2 THEN 'maybe' ELSE 'True' END AS qc1,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'F' WHEN 1 THEN 'T' WHEN 2 THEN 'n/a' ELSE 'True' END AS qc2,
  CASE o.o_orderkey % 9 WHEN 0 THEN '0' WHEN 1 THEN 'YES' ELSE 'True' END AS qc3,
  CASE WHEN o.o_orderkey % 7 = 0 THEN '2117-03-01' WHEN o.o_orderkey % 7 = 1 THEN 'unknown' WHEN o.o_orderkey % 7 = 2 THEN NULL
       ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS rep_date,
  CASE WHEN o.o_orderkey % 21 = 0 THEN '1066-10-14' ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS sub_date,
  CASE WHEN o.o_custkey % 6 = 0 THEN '' WHEN o.o_custkey % 6 = 1 THEN NULL ELSE c.c_name END AS lastname,
  CASE WHEN o.o_custkey % 6 < 3 THEN ' ' ELSE c.c_mktsegment END AS firstname,
  CASE WHEN o.o_custkey % 12 = 0 THEN NULL WHEN o.o_custkey % 12 = 1 THEN ' ' ELSE o.o_orderpriority END AS reference,
  CASE WHEN o.o_custkey % 24 = 0 THEN 'Study / of ' || o.o_orderstatus END AS cite_as,
  CASE WHEN o.o_custkey % 10 = 3 THEN NULL ELSE (o.o_totalprice % 1000) / 1000 END AS oa,
  CASE WHEN o.o_custkey % 10 < 4 THEN NULL ELSE (o.o_totalprice % 777) / 777 END AS oau,
  CASE WHEN o.o_custkey % 10 = 5 THEN NULL ELSE (o.o_totalprice % 501) / 501 END AS class_f1,
  (o.o_totalprice % 6007) / 1000 AS area_km2, CAST(3 + o.o_orderkey % 9 AS INT) AS vertices,
  (o.o_totalprice % 2500) / 10 AS nbr_dist_m
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
""")

TRI = "CASE WHEN lower(trim({0})) IN ('true','t','1','yes','y') THEN true WHEN lower(trim({0})) IN ('false','f','0','no','n') THEN false END"
SLUG = r"(CASE WHEN regexp_replace(regexp_replace(regexp_replace(trim({0}), '[\s\p{{Z}}/\\]+', '_', 'g'), '[^\p{{L}}\p{{N}}_.-]', '', 'g'), '^[_.]+|[_.]+$', '', 'g') = '' THEN 'unnamed' ELSE regexp_replace(regexp_replace(regexp_replace(trim({0}), '[\s\p{{Z}}/\\]+', '_', 'g'), '[^\p{{L}}\p{{N}}_.-]', '', 'g'), '^[_.]+|[_.]+$', '', 'g') END)"
YEAR = "CASE WHEN year(try_cast({0} AS TIMESTAMP)) BETWEEN 1990 AND 2025 THEN year(try_cast({0} AS TIMESTAMP)) END"
BASE = f"""cl AS (SELECT *, try_cast(class_raw AS DOUBLE)::INT AS class, {TRI.format('qc1')} AS qc_step1,
  {TRI.format('qc2')} AS qc_step2, {TRI.format('qc3')} AS qc_step3,
  coalesce({YEAR.format('rep_date')}, {YEAR.format('sub_date')}) AS label_year
  FROM submissions WHERE try_cast(class_raw AS DOUBLE) BETWEEN 1 AND 17)"""


def cleaned(t):
    kept, _ = K.class_gate(t["submissions"])
    key, src = K.annotator("lastname", "firstname", "reference", "cite_as", "submission_id")
    return kept.withColumns({
        "qc_step1": K.tri_state("qc1"), "qc_step2": K.tri_state("qc2"), "qc_step3": K.tri_state("qc3"),
        "label_year": K.label_year("rep_date", "sub_date"), "annotator_raw": key, "annotator_src": src,
    })


@query("class_gate_dropped", "B1", """SELECT class_raw AS value, count(*) AS n FROM {submissions}
WHERE NOT coalesce(try_cast(class_raw AS DOUBLE) BETWEEN 1 AND 17, false) GROUP BY 1""")
def class_gate_dropped(t):
    return K.class_gate(t["submissions"])[1]


@query("submissions_clean", "B1 B2 B4 B5 B6 A6", f"""WITH {BASE}, nm AS (SELECT *,
   lower(trim(coalesce(lastname, ''))) AS ln, lower(trim(coalesce(firstname, ''))) AS fn,
   trim(coalesce(reference, cite_as, '')) AS st FROM cl), an AS (SELECT *,
   CASE WHEN ln <> '' OR fn <> '' THEN 'name:' || {SLUG.format('ln')} || '|' || {SLUG.format('fn')}
        WHEN st <> '' THEN 'study:' || {SLUG.format('st')} ELSE 'blank:' || submission_id END AS a,
   CASE WHEN ln <> '' OR fn <> '' THEN 'name' WHEN st <> '' THEN 'study' ELSE 'blank' END AS src FROM nm)
SELECT submission_id, class, qc_step1, qc_step2, qc_step3, label_year::INT AS label_year, src AS annotator_src,
  CASE WHEN src = 'blank' THEN 'blank:n' || nation ELSE a END AS annotator_id FROM an -- {{submissions}}""", headline=True)
def submissions_clean(t):
    aoi = F.concat(F.lit("n"), F.col("nation").cast("string"))
    return cleaned(t).select(
        "submission_id", "class", "qc_step1", "qc_step2", "qc_step3", "label_year", "annotator_src",
        K.resolve_blank("annotator_raw", "annotator_src", aoi).alias("annotator_id"))


@query("text_slugs", "B3", f"""SELECT page_id, {SLUG.format('url')} || '__' || page_id AS url_key,
  md5({SLUG.format('html')}) AS html_slug_md5 FROM pages""")
def text_slugs(t):
    return t["pages"].select(
        "page_id", K.aoi_key("url", "page_id").alias("url_key"), F.md5(K.slug("html")).alias("html_slug_md5"))


@query("folded_names", "C39", """SELECT conv_id, turn, md5(regexp_replace(translate(lower(text),
 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]', '', 'g')) AS key_md5 FROM conversations""")
def folded_names(t):
    return t["conversations"].select("conv_id", "turn", F.md5(K.folded_name("text")).alias("key_md5"))


@query("place_keys", "C39", """SELECT doc_id, md5(trim(regexp_replace(strip_accents(replace(replace(replace(lower(text), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')), '[^a-z0-9]+', ' ', 'g'))) AS key_md5 FROM documents""")
def place_keys(t):
    return t["documents"].select("doc_id", F.md5(K.place_key("text")).alias("key_md5"))


GATE = """g AS (SELECT *, NOT coalesce(qc_step1, false) AS g1, NOT coalesce(oa >= 0.3::DOUBLE, false) AS g2,
  class <= 10 AND NOT coalesce(oau >= 0.2::DOUBLE, false) AS g3, NOT coalesce(class_f1 >= 0.1::DOUBLE, false) AS g4,
  NOT area_km2 >= 0.0012::DOUBLE AS g5, NOT area_km2 <= 5 AS g6, NOT vertices >= 4 AS g7 FROM cl)"""


@query("quality_gate_counts", "B11", f"""WITH {BASE}, {GATE}
SELECT nation, count(*) AS n_in, count(*) FILTER (NOT (g1 OR g2 OR g3 OR g4 OR g5 OR g6 OR g7)) AS n_kept,
  count(*) FILTER (g1) AS drop_qc_step1, count(*) FILTER (g2) AS drop_min_oa, count(*) FILTER (g3) AS drop_min_oau,
  count(*) FILTER (g4) AS drop_min_f1, count(*) FILTER (g5) AS drop_min_area, count(*) FILTER (g6) AS drop_max_area,
  count(*) FILTER (g7) AS drop_min_vertices FROM g GROUP BY nation -- {{submissions}}""")
def quality_gate_counts(t):
    gates = K.quality_gates(min_oa=0.3, min_oau=0.2, min_f1=0.1, max_area=5.0)
    return K.gate_counts(cleaned(t), gates, ("nation",))


@query("vote_weights", "B22 B13 E12", f"""WITH {BASE}, m AS (SELECT class, median(class_f1) AS med FROM cl GROUP BY class),
 w AS (SELECT submission_id, (CASE WHEN qc_step1 THEN 1 ELSE 0 END) * (CASE WHEN NOT qc_step2 OR NOT qc_step3 THEN 0.6::DOUBLE ELSE 1 END) AS w_qc,
  least(1, greatest(0.05::DOUBLE, (coalesce(CASE WHEN class <= 10 THEN coalesce(oau, oa) ELSE oa END, 0) - 0.4::DOUBLE) / 0.5::DOUBLE))
   * least(2, greatest(0.25::DOUBLE, coalesce(class_f1 / nullif(med, 0), 1))) AS w_acc,
  exp(-abs(coalesce(label_year, 2017) - 2017) / 3.0::DOUBLE) AS w_time,
  CASE WHEN area_km2 < 0.02::DOUBLE THEN 0.4::DOUBLE + 0.6::DOUBLE * greatest(0, least(1, (area_km2 - 0.005::DOUBLE) / 0.015::DOUBLE))
       WHEN area_km2 > 1 THEN 1 - 0.4::DOUBLE * greatest(0, least(1, (area_km2 - 1) / 4)) ELSE 1 END AS w_size
  FROM cl JOIN m USING (class))
SELECT submission_id, round(w_qc, 6) AS w_qc, round(w_acc, 6) AS w_acc, round(w_time, 6) AS w_time, round(w_size, 6) AS w_size,
  round(w_qc * w_acc * w_time * w_size, 6) AS weight FROM w -- {{submissions}}""")
def vote_weights(t):
    return rounded(W.vote_weights(cleaned(t), 2017).select("submission_id", "w_qc", "w_acc", "w_time", "w_size", "weight"))


@query("training_weights", "B23 B24 B13", f"""WITH {BASE}, ny AS (SELECT *, CASE WHEN label_year IS NULL THEN 2025
   WHEN abs(label_year - 2017) <= abs(label_year - 2025) THEN 2017 ELSE 2025 END AS ey FROM cl),
 lg AS (SELECT *, abs(label_year - ey)::DOUBLE AS lag0 FROM ny), md AS (SELECT median(lag0) AS med FROM lg),
 f AS (SELECT submission_id, ey, coalesce(lag0, med) AS lag, CASE WHEN class <= 10 THEN coalesce(oau, oa) ELSE oa END AS acc, area_km2, nbr_dist_m FROM lg, md),
 w AS (SELECT submission_id, ey, lag, exp(-lag / 8) AS w_time,
  coalesce(least(1, greatest(0.05::DOUBLE, CASE WHEN acc IS NOT NULL THEN (acc - 0.4::DOUBLE) / 0.5::DOUBLE END)), 1) AS w_acc0, acc,
  least(1, greatest(0.5::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * sqrt(area_km2))) AS w_area,
  least(1, greatest(0.5::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * least(nbr_dist_m, 100) / 100)) AS w_nbr FROM f)
SELECT submission_id, ey::INT AS embedding_year, lag AS year_lag, round(CASE WHEN acc IS NULL THEN 1 ELSE w_acc0 END, 6) AS w_acc,
  round(w_area, 6) AS w_area, round(w_nbr, 6) AS w_nbr, round(w_time, 6) AS w_time,
  round((CASE WHEN acc IS NULL THEN 1 ELSE w_acc0 END) * w_time * w_area * w_nbr, 6) AS weight FROM w -- {{submissions}}""")
def training_weights(t):
    d = W.temporal_alignment(cleaned(t))
    acc = K.class_accuracy("class", "oa", "oau")
    d = d.withColumns(W.training_weight(acc, F.col("w_time"), F.col("area_km2"), F.col("nbr_dist_m")))
    return rounded(d.select("submission_id", "embedding_year", "year_lag", "w_acc", "w_area", "w_nbr", "w_time", "weight"))


@query("accuracy_gates", "B13 B25", f"""WITH {BASE}
SELECT submission_id, coalesce(oa >= 0.5::DOUBLE, true) AS gate_oa, class > 10 OR coalesce(oau >= 0.4::DOUBLE, true) AS gate_oau,
  coalesce(class_f1 >= 0.3::DOUBLE, true) AS gate_f1, coalesce(oa >= 0.5::DOUBLE, true) AND (class > 10 OR coalesce(oau >= 0.4::DOUBLE, true))
  AND coalesce(class_f1 >= 0.3::DOUBLE, true) AND area_km2 >= 0.04::DOUBLE AS qc_pass FROM cl -- {{submissions}}""")
def accuracy_gates(t):
    d = cleaned(t).withColumns({
        "gate_oa": K.passes(F.col("oa"), 0.5),
        "gate_oau": ~F.col("class").isin(*range(1, 11)) | K.passes(F.col("oau"), 0.4),
        "gate_f1": K.passes(F.col("class_f1"), 0.3)})
    ok = F.col("gate_oa") & F.col("gate_oau") & F.col("gate_f1") & (F.col("area_km2") >= 0.04)
    return d.select("submission_id", "gate_oa", "gate_oau", "gate_f1", ok.alias("qc_pass"))


view("tagged_buildings", """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
  CASE WHEN l_orderkey % 4 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ' m' WHEN l_orderkey % 4 = 1 THEN CAST(CAST(l_quantity AS INT) AS STRING) || ';7'
       WHEN l_orderkey % 4 = 2 THEN 'tall' END AS height_tag,
  CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber AS STRING) WHEN l_orderkey % 3 = 1 THEN '2 ft' END AS levels_tag,
  CASE WHEN l_suppkey % 3 > 0 THEN l_quantity * 1.5 END AS explicit_h, l_suppkey % 5 > 0 AS trusted,
  CASE WHEN l_partkey % 4 > 0 THEN l_linenumber - 1 END AS floors, CASE WHEN l_partkey % 3 = 0 THEN 1.5 END AS roof,
  CASE WHEN l_partkey % 7 > 2 THEN l_quantity * 0.5 END AS raster_h,
  CASE l_partkey % 6 WHEN 0 THEN 'warehouse' WHEN 1 THEN 'apartments' WHEN 2 THEN 'house' WHEN 3 THEN NULL ELSE 'shed' END AS class
FROM {lineitem}
""")


@query("tag_heights", "B15", """WITH p AS (SELECT *, try_cast(trim(regexp_replace(trim(split_part(height_tag, ';', 1)), 'm+$', '')) AS DOUBLE) AS h,
  try_cast(trim(regexp_replace(trim(split_part(levels_tag, ';', 1)), 'm+$', '')) AS DOUBLE) AS lv FROM {tagged_buildings}),
 x AS (SELECT partkey, coalesce(h, lv * 3) AS hm FROM p)
SELECT partkey, count(*) AS n, count(hm) AS n_height, round(sum(hm), 4) AS sum_height, count(*) FILTER (hm > 0 AND hm <= 10) AS n_low,
  count(*) FILTER (hm > 10 AND hm <= 25) AS n_mid, count(*) FILTER (hm > 25) AS n_high FROM x GROUP BY partkey""")
def tag_heights(t):
    d = t["tagged_buildings"].withColumn("hm", K.tag_height("height_tag", "levels_tag"))
    return d.groupBy("partkey").agg(
        F.count(F.lit(1)).alias("n"), F.count("hm").alias("n_height"), F.round(F.sum("hm"), 4).alias("sum_height"),
        F.count_if(K.in_bucket("hm", 0, 10)).alias("n_low"), F.count_if(K.in_bucket("hm", 10, 25)).alias("n_mid"),
        F.count_if(K.in_bucket("hm", 25, None)).alias("n_high"))


@query("building_height_tiers", "B14 B16", """WITH x AS (SELECT partkey, class,
  CASE WHEN trusted AND explicit_h BETWEEN 2 AND 1000 THEN explicit_h WHEN trusted AND floors > 0 THEN floors * 3.2 + coalesce(roof, 0)
   WHEN raster_h > 0 THEN raster_h END::DOUBLE AS h,
  CASE WHEN trusted AND explicit_h BETWEEN 2 AND 1000 THEN 'explicit' WHEN trusted AND floors > 0 THEN 'levels' WHEN raster_h > 0 THEN 'raster' ELSE 'none' END AS tier
  FROM {tagged_buildings})
SELECT partkey, tier, count(*) AS n, round(avg(h), 6) AS mean_h, count(*) FILTER (class IN ('warehouse', 'shed')) AS n_large,
  count(*) FILTER (class IN ('apartments')) AS n_tower FROM x GROUP BY ALL""")
def building_height_tiers(t):
    h, tier = K.building_height(*[F.col(c) for c in ("explicit_h", "trusted", "floors", "roof", "raster_h")])
    d = t["tagged_buildings"].select("partkey", "class", h.alias("h"), tier.alias("tier"))
    return rounded(d.groupBy("partkey", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean_h"),
        F.count_if(isin_safe("class", ("warehouse", "shed"))).alias("n_large"),
        F.count_if(isin_safe("class", ("apartments",))).alias("n_tower")))


# zonal parameter rows: shares on a 1/20 lattice so that every threshold side is visited
view("zonal_rows", """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey,
  CASE WHEN l_orderkey % 3 = 0 THEN (l_partkey % 5) / 100 ELSE (l_partkey % 97) / 100 END AS bsf,
  CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE CAST(l_orderkey % 37 AS DOUBLE) END AS h_mean,
  CAST((l_orderkey % 41) * 3 AS DOUBLE) / 2 AS h_max, l_linenumber % 5 AS n_tower,
  CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE (l_orderkey % 11) / 10 END AS height_evidence_frac,
  CASE WHEN l_suppkey % 5 = 0 THEN (l_orderkey % 13) / 12 ELSE 0.0 END AS height_none_frac,
  CAST((l_partkey % 23) * 60 AS DOUBLE) AS mean_footprint_area, CASE WHEN l_partkey % 9 > 0 THEN CAST((l_partkey % 31) * 8 AS DOUBLE) END AS median_footprint_area,
  (l_orderkey % 17) / 10 AS footprint_area_cv, CAST((l_orderkey % 19) * 600 AS DOUBLE) AS building_count_density, (l_partkey % 7) / 6 AS f_google_source,
  (l_suppkey % 9) / 8 AS large_lowrise_frac, CASE WHEN l_partkey % 6 = 0 THEN 1.0 ELSE 0.5 END AS built_area_ml_frac,
  CASE WHEN l_orderkey % 10 = 0 THEN 0.8 ELSE 0.0 END AS f_water, CASE WHEN l_orderkey % 10 IN (1, 2) THEN (l_suppkey % 11) / 10 ELSE 0.1 END AS f_trees,
  CASE WHEN l_orderkey % 10 IN (2, 3, 4) THEN (l_partkey % 11) / 10 ELSE 0.3 END AS f_lowplants,
  CASE WHEN l_orderkey % 10 = 5 THEN 0.65 ELSE 0.0 END AS f_shrub, CASE WHEN l_orderkey % 10 = 6 THEN 0.6 ELSE 0.0 END AS f_sand,
  CASE WHEN l_orderkey % 10 = 7 THEN 0.7 ELSE 0.0 END AS f_bare_rock, CASE WHEN l_orderkey % 10 = 8 THEN 0.66 END AS f_paved_infra,
  CASE WHEN l_suppkey % 6 = 1 THEN 0.6 ELSE 0.1 END AS f_industrial_lu, l_linenumber % 2 AS n_heavy_industry_poi,
  CAST((l_orderkey % 12) * 1 AS DOUBLE) AS road_length_density, CAST((l_orderkey % 29) * 12 AS DOUBLE) AS buildings_per_road_km,
  CASE WHEN l_suppkey % 7 = 0 THEN (l_orderkey % 3) / 2 END AS mn_informal_frac,
  CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE (l_linenumber - 1) * 3 / 100 END AS ghs_built_s
FROM {lineitem}
""")

CLASSIFY_SQL = """WITH r AS (SELECT orderkey, linenumber, partkey, suppkey, bsf::DOUBLE AS b, h_mean::DOUBLE AS h, h_max::DOUBLE AS hx, n_tower AS nt,
   height_evidence_frac::DOUBLE AS ev, height_none_frac::DOUBLE AS nf, mean_footprint_area::DOUBLE AS mf, coalesce(median_footprint_area, 0)::DOUBLE AS fp,
   footprint_area_cv::DOUBLE AS cv, building_count_density::DOUBLE AS cd, f_google_source::DOUBLE AS gg, large_lowrise_frac::DOUBLE AS ll,
   built_area_ml_frac::DOUBLE AS ml, f_water::DOUBLE AS fw, f_trees::DOUBLE AS ft, f_lowplants::DOUBLE AS fl, f_shrub::DOUBLE AS fs, f_sand::DOUBLE AS fd,
   f_bare_rock::DOUBLE AS fr, coalesce(f_paved_infra, 0)::DOUBLE AS fv, f_industrial_lu::DOUBLE AS fi, n_heavy_industry_poi AS np,
   road_length_density::DOUBLE AS rd, buildings_per_road_km::DOUBLE AS bp, mn_informal_frac::DOUBLE AS mn, ghs_built_s::DOUBLE AS g FROM {zonal_rows}),
 a AS (SELECT *, CASE WHEN h >= 25 OR (hx >= 25 AND nt >= 3) THEN 'high' WHEN h >= 10 THEN 'mid' WHEN h IS NOT NULL THEN 'low' END AS hc,
   CASE WHEN b >= 0.4::DOUBLE THEN 'compact' WHEN b >= 0.2::DOUBLE THEN 'open' WHEN b >= 0.05::DOUBLE THEN 'sparse' END AS dc,
   CASE WHEN fw >= 0.75::DOUBLE THEN 17 WHEN ft >= 0.75::DOUBLE THEN 11 WHEN ft >= 0.35::DOUBLE AND fl + ft >= 0.75::DOUBLE THEN 12 WHEN fs >= 0.6::DOUBLE THEN 13
        WHEN fl >= 0.75::DOUBLE THEN 14 WHEN fr >= 0.6::DOUBLE OR fv >= 0.6::DOUBLE THEN 15 WHEN fd >= 0.6::DOUBLE THEN 16 END AS nat,
   abs(b - 0.4::DOUBLE) <= 0.03::DOUBLE OR abs(b - 0.2::DOUBLE) <= 0.03::DOUBLE OR abs(b - 0.05::DOUBLE) <= 0.03::DOUBLE AS near,
   coalesce(b >= 0.05::DOUBLE AND g < 0.02::DOUBLE AND ml > 0.99::DOUBLE, false) AS susp,
   mf >= 800 AND ll >= 0.5::DOUBLE AND b >= 0.25::DOUBLE AND coalesce(h < 10, true) AS lg,
   fp > 0 AND fp <= 60 AND cd >= 6000 AND cv >= 0.7::DOUBLE AS inf, bp >= 250 OR (rd < 5 AND cd >= 6000) AS def,
   coalesce(mn >= 0.5::DOUBLE, false) AS lay, gg < 0.5::DOUBLE AND cd < 2000 AND b >= 0.4::DOUBLE AS blob FROM r),
 c AS (SELECT *, (CASE WHEN near THEN 0.7::DOUBLE ELSE 1 END) * (CASE WHEN susp THEN 0.5::DOUBLE ELSE 1 END) AS pen,
   fp >= 100 AND ev >= 0.3::DOUBLE AND NOT def AS frm,
   CASE WHEN hc = 'high' AND dc = 'compact' THEN 1 WHEN hc = 'high' AND dc = 'open' THEN 4 WHEN hc = 'mid' AND dc = 'compact' THEN 2
        WHEN hc = 'mid' AND dc = 'open' THEN 5 WHEN hc = 'low' AND dc = 'open' THEN 6 WHEN hc = 'low' AND dc = 'sparse' AND fl + ft >= 0.4::DOUBLE THEN 9 END AS mx FROM a),
 v AS (SELECT *, CASE
   WHEN b < 0.05::DOUBLE THEN CASE WHEN nat IS NULL THEN 'no_positive_evidence' WHEN g > 0.15::DOUBLE THEN 'completeness_trap' WHEN g >= 0.1::DOUBLE THEN 'built_signal_present' ELSE 'nat' END
   WHEN fi >= 0.5::DOUBLE AND np >= 1 THEN 'h10' WHEN lg THEN CASE WHEN fi >= 0.5::DOUBLE THEN 'c8,10' ELSE 'h8' END
   WHEN hc IS NULL THEN 'no_height_class'
   WHEN hc = 'low' AND dc = 'compact' THEN CASE WHEN blob THEN 'c3,7' WHEN (inf AND def) OR lay THEN 'h7' WHEN frm THEN 'h3' ELSE 'c3,7' END
   WHEN mx IS NULL THEN 'matrix_unlabelled' WHEN nf > 0.5::DOUBLE THEN 'insufficient_height_evidence' ELSE 'mx' END AS k FROM c)"""


@query("zonal_classes", "B17 B18 B19 B27", CLASSIFY_SQL + """
SELECT orderkey, linenumber, partkey, suppkey, CASE k WHEN 'nat' THEN 'h' || nat WHEN 'mx' THEN 'h' || mx ELSE CASE WHEN k[1] IN ('h', 'c') AND k <> 'completeness_trap' THEN k END END AS label_key,
  CASE WHEN k IN ('nat', 'mx') OR (k[1] IN ('h', 'c') AND k <> 'completeness_trap') THEN NULL ELSE k END AS reject_reason,
  round(CASE WHEN k = 'nat' THEN least(1, CASE nat WHEN 17 THEN fw WHEN 11 THEN ft WHEN 12 THEN fl + ft WHEN 13 THEN fs WHEN 14 THEN fl WHEN 15 THEN greatest(fr, fv) ELSE fd END)
    WHEN k = 'mx' THEN (CASE WHEN ev < 0.5::DOUBLE THEN 0.6::DOUBLE ELSE 1 END) * pen
    WHEN k = 'h7' THEN least(pen, CASE WHEN lay THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END)
    WHEN k[1] IN ('h', 'c') AND k <> 'completeness_trap' THEN pen ELSE 0 END, 6) AS confidence FROM v""", headline=True)
def zonal_classes(t):
    d = R.classify(t["zonal_rows"])
    return d.select(
        "orderkey", "linenumber", "partkey", "suppkey",
        L.dissolve_key("label_type", "lcz", "lcz_set").alias("label_key"),
        "reject_reason", F.round("confidence", 6).alias("confidence"))


@query("label_set_masks", "B26 B46", """WITH s AS (SELECT partkey, list_distinct(list(1 + orderkey % 17)) AS cs FROM {zonal_rows} GROUP BY partkey)
SELECT partkey, list_aggregate(list_transform(cs, lambda c: (1::BIGINT << (c - 1)::INT)), 'sum')::BIGINT AS mask, len(cs)::INT AS n_classes,
  array_to_string(list_sort(cs), ',') AS members, CASE WHEN len(cs) = 1 THEN cs[1]::INT ELSE 0 END AS hard FROM s""")
def label_set_masks(t):
    d = t["zonal_rows"].groupBy("partkey").agg(
        F.collect_set((1 + F.col("orderkey") % 17).cast("int")).alias("cs"))
    d = d.withColumn("mask", L.encode("cs"))
    return d.select("partkey", "mask", L.size("mask").alias("n_classes"),
                    F.array_join(L.decode("mask").cast("array<string>"), ",").alias("members"), L.hard_class("mask").alias("hard"))


@query("change_stability", "B21 B28", """WITH z AS (SELECT *, (orderkey % 23) / 100.0::DOUBLE AS b1, ((orderkey + suppkey) % 29) / 100.0::DOUBLE AS b0, (orderkey % 31)::DOUBLE AS h1 FROM {zonal_rows}),
 s AS (SELECT *, coalesce(CASE WHEN ghs_built_s IS NULL THEN NULL ELSE abs(b1 - b0) < 0.1::DOUBLE END, false) AND
   (CASE WHEN h_mean IS NULL THEN 'none' WHEN h_mean >= 25 THEN 'high' WHEN h_mean >= 10 THEN 'mid' WHEN h_mean > 0 THEN 'low' ELSE 'nb' END) =
   (CASE WHEN h1 >= 25 THEN 'high' WHEN h1 >= 10 THEN 'mid' WHEN h1 > 0 THEN 'low' ELSE 'nb' END) AS stable FROM z),
 y AS (SELECT partkey, stable, (2018 + linenumber % 4)::INT AS label_year, unnest(CASE WHEN stable THEN [2017, 2018, 2019, 2020, 2021] ELSE [2018 + linenumber % 4] END)::INT AS year FROM s)
SELECT partkey, year, count(*) AS n, count(*) FILTER (stable) AS n_stable FROM y GROUP BY ALL""")
def change_stability(t):
    z = t["zonal_rows"]
    b1 = F.when(F.col("ghs_built_s").isNotNull(), (F.col("orderkey") % 23) / 100)
    b0 = ((F.col("orderkey") + F.col("suppkey")) % 29) / 100
    z = z.withColumn("stable", R.stable(b0, F.col("h_mean").cast("double"), b1, (F.col("orderkey") % 31).cast("double")))
    z = z.withColumn("label_year", (2018 + F.col("linenumber") % 4).cast("int"))
    pairs = R.training_years(z, (2017, 2018, 2019, 2020, 2021))
    return pairs.groupBy("partkey", "year").agg(F.count(F.lit(1)).alias("n"), F.count_if("stable").alias("n_stable"))


@query("zone_grade_penalty", "B20", """SELECT l.l_orderkey, l.l_linenumber, round(CASE WHEN l_returnflag <> 'N' AND NOT coalesce(o_totalprice >= 150000, false)
  THEN 10 * l_discount * 0.7::DOUBLE ELSE 10 * l_discount END, 6) AS confidence
FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey AND o_orderpriority <> '5-LOW'""")
def zone_grade_penalty(t):
    zones = t["orders"].where(F.col("o_orderpriority") != "5-LOW").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") >= 150000).alias("grade"))
    d = t["lineitem"].join(zones, "l_orderkey", "left")
    c = R.zone_penalty(10 * F.col("l_discount"), F.col("l_returnflag") != "N", F.col("grade"))
    return d.select("l_orderkey", "l_linenumber", F.round(c, 6).alias("confidence"))
