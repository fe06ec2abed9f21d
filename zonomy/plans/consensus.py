"""Votes, consensus and the audit of the consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.operators import votes as V
from zonomy.plans.base import query, view
from zonomy.plans.metrics import rounded

view("votes", """
SELECT 'aoi' || CAST(l.l_partkey % 20 AS STRING) AS aoi, l.l_partkey AS pixel, l.l_suppkey AS annotator,
       l.l_orderkey AS submission, o.o_orderdate AS date,
       CAST(1 + CASE WHEN l.l_orderkey % 3 < 2 THEN l.l_partkey * 5 % 17 ELSE (l.l_orderkey + 7 * l.l_linenumber) % 17 END AS INT) AS class,
       1 - 8 * l.l_discount AS weight, l.l_quantity / 50 AS area,
       l.l_tax AS oa, l.l_linenumber AS linenumber
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
""")
view("pixel_truth", """
SELECT 'aoi' || CAST(p_partkey % 20 AS STRING) AS aoi, p_partkey AS pixel,
       CAST(1 + CASE WHEN p_size % 4 > 0 THEN p_partkey * 5 % 17 ELSE p_size % 17 END AS INT) AS truth
FROM {part}
""")

NEW = """nv AS (SELECT aoi, pixel, annotator, class, weight FROM (SELECT *, row_number() OVER (
   PARTITION BY aoi, pixel, annotator ORDER BY date DESC, submission DESC, class DESC, weight DESC) AS r
   FROM votes WHERE weight > 0) WHERE r = 1)"""


def decide_sql(src: str, part: str) -> str:
    """Window form of the decision for a vote table ``src`` partitioned by ``part`` (aoi or aoi, held)."""
    return f"""px AS (SELECT {part}, pixel, sum(weight) AS w1, sum(weight * weight) AS w2 FROM {src} GROUP BY ALL),
 pc AS (SELECT {part}, pixel, class, sum(weight) AS s FROM {src} GROUP BY ALL),
 pr AS (SELECT {part}, class, sum(s) / sum(sum(s)) OVER (PARTITION BY {part}) AS prior FROM pc GROUP BY {part}, class),
 al AS (SELECT {part}, avg(w2 / w1) AS alpha FROM px GROUP BY {part}),
 full17 AS (SELECT px.*, c.c AS class, (coalesce(s, 0) + alpha * coalesce(prior, 0)) / (w1 + alpha) AS p
   FROM px CROSS JOIN (SELECT unnest(range(1, 18))::INT AS c) c JOIN al USING ({part})
   LEFT JOIN pc ON (pc.pixel = px.pixel AND pc.class = c.c AND {' AND '.join(f'pc.{k} = px.{k}' for k in part.split(', '))})
   LEFT JOIN pr ON (pr.class = c.c AND {' AND '.join(f'pr.{k} = px.{k}' for k in part.split(', '))})),
 rk AS (SELECT *, row_number() OVER w AS r, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) - p AS before FROM full17
   WINDOW w AS (PARTITION BY {part}, pixel ORDER BY p DESC, class)),
 st AS (SELECT {part}, pixel, any_value(w1) AS w1, any_value(w2) AS w2, max(p) AS p_top, max_by(class, p) AS top,
   sum(p) FILTER (before < 0.65::DOUBLE) AS p_set, count(*) FILTER (before < 0.65::DOUBLE) AS k,
   sum(1::BIGINT << (class - 1)) FILTER (before < 0.65::DOUBLE) AS mask FROM rk WHERE r <= 4 GROUP BY {part}, pixel),
 dec AS (SELECT {part}, pixel, mask::BIGINT AS bitmask, least(1, p_set * least(1, 0.4::DOUBLE + 0.15::DOUBLE * w1 * w1 / w2)) AS confidence,
   top AS top_class, p_top, p_set, w1 * w1 / w2 AS n_eff, k AS set_size FROM st WHERE k <= 3 AND p_top >= 0.35::DOUBLE)"""


@query("vote_accumulation", "D4 E1", f"""WITH {NEW}
SELECT aoi, pixel, class, round(sum(weight), 6) AS class_weight, count(*) AS voters FROM nv GROUP BY ALL -- {{votes}}""")
def vote_accumulation(t):
    v = V.newest_votes(t["votes"])
    return rounded(v.groupBy("aoi", "pixel", "class").agg(F.sum("weight").alias("class_weight"), F.count(F.lit(1)).alias("voters")))


@query("vote_consensus", "D4 D5 E1 E9", f"""WITH {NEW}, {decide_sql('nv', 'aoi')}
SELECT aoi, pixel, bitmask, round(confidence, 6) AS confidence, top_class, round(p_top, 6) AS p_top,
  round(p_set, 6) AS p_set, round(n_eff, 6) AS n_eff, set_size::INT AS set_size FROM dec -- {{votes}}""", headline=True)
def vote_consensus(t):
    return rounded(V.consensus(t["votes"]))


@query("smallest_shape_labels", "D6", """SELECT aoi, pixel, class FROM (SELECT *, row_number() OVER (
  PARTITION BY aoi, pixel ORDER BY area, submission, class) AS r FROM {votes}) WHERE r = 1""")
def smallest_shape_labels(t):
    return V.smallest_shape_wins(t["votes"])


AUTH = """ah AS (SELECT aoi, annotator, count(DISTINCT submission) AS shapes,
   ('0x' || substr(sha256('author:' || aoi || ':' || annotator), 1, 13))::BIGINT AS h FROM votes GROUP BY ALL),
 ring AS (SELECT *, coalesce(lead(annotator) OVER (PARTITION BY aoi ORDER BY h, annotator),
   first_value(annotator) OVER (PARTITION BY aoi ORDER BY h, annotator)) AS peer FROM ah),
 fit AS (SELECT *, count(*) OVER (PARTITION BY aoi) AS na, row_number() OVER (PARTITION BY aoi ORDER BY h, annotator) AS k
   FROM ring WHERE shapes >= 5),
 au AS (SELECT aoi, annotator AS held, peer FROM fit WHERE na >= 3)"""


@query("leave_one_author_out", "D7", f"""WITH {NEW}, {AUTH},
 ov AS (SELECT nv.aoi, au.held, nv.pixel, nv.class, nv.weight FROM nv JOIN au ON nv.aoi = au.aoi AND nv.annotator <> au.held),
 {decide_sql('ov', 'aoi, held')},
 sc AS (SELECT d.aoi, ((d.bitmask >> (o.class - 1)) & 1) AS ok, o.class AS truth, p.class AS pc
  FROM dec d JOIN au USING (aoi, held) JOIN nv o ON o.aoi = d.aoi AND o.pixel = d.pixel AND o.annotator = d.held
  LEFT JOIN nv p ON p.aoi = d.aoi AND p.pixel = d.pixel AND p.annotator = au.peer)
SELECT aoi, count(*) AS n_consensus, round(avg(ok), 6) AS loao_consensus, count(pc) AS n_peer,
  round(avg((pc = truth)::INT), 6) AS loao_peer FROM sc GROUP BY aoi -- {{votes}}""")
def leave_one_author_out(t):
    v = t["votes"]
    return rounded(V.leave_one_out(v, V.pick_authors(v)))


@query("signal_terciles", "D9 E12", """WITH sh AS (SELECT submission, avg(v.weight) AS weight, avg(v.area) AS area, avg(v.oa) AS oa,
   count(*) AS n_px, count(*) FILTER (v.class = g.truth) AS n_ok
   FROM {votes} v JOIN {pixel_truth} g ON v.aoi = g.aoi AND v.pixel = g.pixel GROUP BY submission),
 cut AS (SELECT quantile_cont(weight, [1/3, 2/3]) AS w, quantile_cont(area, [1/3, 2/3]) AS a, quantile_cont(oa, [1/3, 2/3]) AS o FROM sh),
 lg AS (SELECT 'weight' AS signal, weight AS x, w AS c, n_px, n_ok FROM sh, cut
   UNION ALL SELECT 'area', area, a, n_px, n_ok FROM sh, cut UNION ALL SELECT 'oa', oa, o, n_px, n_ok FROM sh, cut)
SELECT signal, CASE WHEN x <= c[1] THEN 0 WHEN x <= c[2] THEN 1 ELSE 2 END AS tier, count(*) AS shapes,
  round(sum(n_ok) / sum(n_px), 6) AS share_ok FROM lg GROUP BY ALL""")
def signal_terciles(t):
    v = t["votes"].join(t["pixel_truth"], ["aoi", "pixel"])
    # one mean per shape: weights are multiples of 0.08, so averages are rounded before they are cut
    sh = v.groupBy("submission").agg(
        F.avg("weight").alias("weight"), F.avg("area").alias("area"), F.avg("oa").alias("oa"),
        F.count(F.lit(1)).alias("n_px"), F.count_if(F.col("class") == F.col("truth")).alias("n_ok"))
    return rounded(V.polygon_signal(sh, ["weight", "area", "oa"]))


@query("area_audit", "D10 B26", f"""WITH {NEW}, {decide_sql('nv', 'aoi')},
 nu AS (SELECT aoi, pixel, class FROM (SELECT *, row_number() OVER (PARTITION BY aoi, pixel ORDER BY area, submission, class) AS r FROM votes) WHERE r = 1),
 head AS (SELECT aoi, count(*) AS n_votes, count(DISTINCT submission) AS n_submissions, count(DISTINCT annotator) AS n_annotators FROM votes GROUP BY aoi),
 cons AS (SELECT d.aoi, count(*) AS px_consensus, avg((set_size = 1)::INT) AS hard_frac, avg(confidence) AS mean_conf, avg(n_eff) AS mean_n_eff,
   count(truth) AS px_compared, avg((bitmask >> (truth - 1)) & 1) AS oa_consensus,
   avg((top_class = truth)::INT) FILTER (set_size = 1) AS oa_hard_only FROM dec d LEFT JOIN pixel_truth g USING (aoi, pixel) GROUP BY d.aoi),
 nai AS (SELECT nu.aoi, avg((class = truth)::INT) AS oa_naive FROM nu JOIN pixel_truth g USING (aoi, pixel) GROUP BY nu.aoi)
SELECT aoi, n_votes, n_submissions, n_annotators, px_consensus, px_compared, round(hard_frac, 6) AS hard_frac,
  round(mean_conf, 6) AS mean_conf, round(mean_n_eff, 6) AS mean_n_eff, round(oa_consensus, 6) AS oa_consensus,
  round(oa_hard_only, 6) AS oa_hard_only, round(oa_naive, 6) AS oa_naive
FROM head LEFT JOIN cons USING (aoi) LEFT JOIN nai USING (aoi) -- {{votes}} {{pixel_truth}}""", headline=True)
def area_audit(t):
    return rounded(V.area_audit(t["votes"], t["pixel_truth"]))
