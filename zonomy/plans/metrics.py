"""Predictions scored by city: confusion tables, agreement figures, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonomy.functions.similarity import trait_similarity
from zonomy.operators import confusion as C
from zonomy.plans.base import query, view

# truth and prediction of every order line; city is the supplier's nation
view("predictions", """
SELECT n.n_name AS city, n.n_regionkey AS region,
       CAST(1 + l.l_partkey % 17 AS INT) AS truth,
       CAST(CASE WHEN (l.l_orderkey + l.l_linenumber) % 10 < 7 THEN 1 + l.l_partkey % 17
            ELSE 1 + (l.l_partkey * 3 + l.l_orderkey) % 17 END AS INT) AS pred,
       1 - 4 * l.l_discount AS confidence,
       l.l_partkey AS block_id, l.l_orderkey AS orderkey, l.l_linenumber AS linenumber
FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
""")
# the same rows with label sets: every fifth label is a coarse pair
view("set_labels", """
SELECT city, truth, pred AS lcz, confidence, block_id,
       CASE WHEN orderkey % 11 = 0 THEN 'unlabelled' WHEN orderkey % 5 = 0 THEN 'coarse' ELSE 'hard' END AS label_type,
       CAST(CASE WHEN orderkey % 5 = 0 AND orderkey % 11 <> 0 THEN
            CASE WHEN pred IN (3, 7) THEN 7 WHEN pred < 17 THEN pred + 1 ELSE 1 END ELSE pred END AS INT) AS second
FROM {predictions}
""")

CONF = "conf AS (SELECT city, truth, pred, count(*) AS n FROM predictions GROUP BY ALL)"
CLS = """per AS (SELECT city, cls, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
  SELECT city, truth AS cls, n AS t, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM conf
  UNION ALL SELECT city, pred, 0, n, 0 FROM conf) GROUP BY city, cls),
 f AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0 END AS f1 FROM per)"""
SUMM = """summ AS (SELECT city, sum(support)::BIGINT AS n, sum(tp) / sum(support) AS oa, avg(f1) AS f1_macro,
  sum(recall) / 17.0::DOUBLE AS acc_macro, sum(support::DOUBLE * predicted) / (sum(support)::DOUBLE * sum(support)) AS pe
  FROM f GROUP BY city)"""


def _conf(t):
    return C.confusion_counts(t["predictions"], keys=["city"])


def rounded(df, *skip):
    return df.select(*[F.round(c, 6).alias(c) if d in ("double",) and c not in skip else F.col(c) for c, d in df.dtypes])


@query("confusion_dense", "D14", f"""WITH {CONF}, g AS (
  SELECT DISTINCT city, i.c AS truth, j.c AS pred FROM predictions,
    (SELECT unnest(range(1, 18))::INT AS c) i, (SELECT unnest(range(1, 18))::INT AS c) j)
SELECT g.city, g.truth, g.pred, coalesce(n, 0)::BIGINT AS n FROM g LEFT JOIN conf USING (city, truth, pred)
-- {{predictions}}""")
def confusion_dense(t):
    return C.dense_confusion(_conf(t), ["city"])


@query("confusion_row_share", "D19", f"""WITH {CONF}
SELECT city, truth, pred, n::BIGINT AS n, sum(n) OVER (PARTITION BY city, truth)::BIGINT AS support,
  round(n / sum(n) OVER (PARTITION BY city, truth), 6) AS share FROM conf -- {{predictions}}""")
def confusion_row_share(t):
    return rounded(C.row_normalised(_conf(t), ["city"]))


@query("class_scores_by_city", "D15", f"""WITH {CONF}, {CLS}
SELECT city, cls, support::BIGINT AS support, predicted::BIGINT AS predicted, tp::BIGINT AS tp,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f -- {{predictions}}""")
def class_scores_by_city(t):
    return rounded(C.class_scores(_conf(t), ["city"]))


@query("city_scores", "D15 D17", f"""WITH {CONF}, {CLS}, {SUMM}
SELECT city, n, round(oa, 6) AS oa, round(f1_macro, 6) AS f1_macro, round(acc_macro, 6) AS acc_macro,
  round((oa - pe) / (1 - pe), 6) AS kappa, round(oa, 6) AS f1_micro FROM summ -- {{predictions}}""", headline=True)
def city_scores(t):
    return rounded(C.summary_scores(_conf(t), ["city"]))


@query("city_kappa_spread", "D17", f"""WITH {CONF}, {CLS}, {SUMM}, k AS (SELECT (oa - pe) / (1 - pe) AS kappa FROM summ)
SELECT count(*) AS n_groups, round(avg(kappa), 6) AS kappa_mean, round(stddev_pop(kappa), 6) AS kappa_std,
  round(min(kappa), 6) AS kappa_min, round(max(kappa), 6) AS kappa_max FROM k -- {{predictions}}""")
def city_kappa_spread(t):
    return rounded(C.spread(C.summary_scores(_conf(t), ["city"], macro="all")))


_W = ", ".join(f"({i + 1}, {j + 1}, {v}::DOUBLE)" for i, r in enumerate(trait_similarity()) for j, v in enumerate(r))


@query("city_weighted_scores", "D16", f"""WITH {CONF}, w(i, j, w) AS (VALUES {_W}),
 r AS (SELECT city, truth AS i, sum(n)::DOUBLE AS r FROM conf GROUP BY ALL),
 c AS (SELECT city, pred AS j, sum(n)::DOUBLE AS c FROM conf GROUP BY ALL),
 e AS (SELECT r.city, sum(w.w * r.r * c.c) AS e FROM r JOIN c ON r.city = c.city JOIN w ON w.i = r.i AND w.j = c.j GROUP BY 1),
 o AS (SELECT city, sum(n)::DOUBLE AS n, sum(w.w * n) AS wn,
   sum(CASE WHEN truth <= 10 AND pred <= 10 THEN n ELSE 0 END)::DOUBLE AS bn,
   sum(CASE WHEN truth <= 10 AND pred = truth THEN n ELSE 0 END)::DOUBLE AS bc,
   sum(CASE WHEN (truth <= 10) = (pred <= 10) THEN n ELSE 0 END)::DOUBLE AS same
   FROM conf JOIN w ON w.i = truth AND w.j = pred GROUP BY city)
SELECT o.city, o.n::BIGINT AS n, round(bc / bn, 6) AS oa_urban, round(same / n, 6) AS oa_built_natural,
  round(wn / n, 6) AS oa_weighted, round((wn / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa_weighted
FROM o JOIN e USING (city) -- {{predictions}}""")
def city_weighted_scores(t):
    return rounded(C.weighted_scores(_conf(t), trait_similarity(), ["city"]))


def _sets(t):
    second = F.when(F.col("label_type") == "coarse", F.array_sort(F.array("lcz", "second"))).otherwise(F.array("lcz"))
    return t["set_labels"].withColumn("lcz_set", F.array_distinct(second))


MATCH = """m AS (SELECT *, truth = lcz OR (label_type = 'coarse' AND truth = second) AS ok,
 confidence >= 0.8::DOUBLE AS hi FROM set_labels WHERE label_type <> 'unlabelled')"""


@query("set_aware_validation", "D11", f"""WITH {MATCH}, aa AS (SELECT city, avg(a) AS aa FROM (
  SELECT city, truth, avg(ok::INT) AS a FROM m WHERE hi GROUP BY ALL) GROUP BY city)
SELECT m.city, count(*) AS n_matched, round(avg(ok::INT), 6) AS oa_all, count(*) FILTER (hi) AS n_high_conf,
  round(avg(ok::INT) FILTER (hi), 6) AS oa_high, round(any_value(aa), 6) AS aa_high,
  count(*) FILTER (label_type = 'coarse') AS n_coarse, round(avg((label_type = 'coarse')::INT), 6) AS coarse_frac
FROM m JOIN aa USING (city) GROUP BY m.city -- {{set_labels}}""")
def set_aware_validation(t):
    return rounded(C.set_aware_report(_sets(t), ["city"]))


@query("top_confusions", "D11 E13", f"""WITH {MATCH}
SELECT truth, lcz AS pred, count(*) AS n FROM m WHERE hi AND label_type = 'hard' AND NOT ok
GROUP BY ALL ORDER BY n DESC, truth, pred LIMIT 5 -- {{set_labels}}""")
def top_confusions(t):
    return C.top_confusions(_sets(t))


@query("confidence_sweep", "D8 E10", f"""WITH {MATCH}, th(t) AS (VALUES (0.0::DOUBLE), (0.2), (0.4), (0.6), (0.8), (0.9)),
 s AS (SELECT city, t, count(*) AS n, avg(ok::INT) AS a FROM m JOIN th ON confidence >= t GROUP BY ALL),
 d AS (SELECT *, a - lag(a) OVER (PARTITION BY city ORDER BY t) AS step FROM s)
SELECT city, t::DOUBLE AS threshold, n, round(a, 6) AS accuracy,
  min(coalesce(step, 0)) OVER (PARTITION BY city) >= -1e-9 AS monotone FROM d -- {{set_labels}}""")
def confidence_sweep(t):
    return rounded(C.confidence_sweep(C.labelled_pairs(_sets(t)), (0.0, 0.2, 0.4, 0.6, 0.8, 0.9), ["city"]), "threshold")


@query("single_class_audit", "D12", f"""WITH {MATCH}, s AS (SELECT city, count(*) FILTER (truth = 7) AS n_truth,
  count(*) FILTER (label_type = 'hard' AND lcz = 7) AS n_pred_hard,
  count(*) FILTER (truth = 3 AND label_type = 'hard' AND lcz = 7) AS rival_to_hard,
  count(*) FILTER (truth = 7 AND label_type = 'hard' AND lcz = 7) AS tp,
  count(*) FILTER (truth = 7 AND label_type = 'hard' AND lcz = 3) AS rv,
  count(*) FILTER (truth = 7 AND label_type = 'coarse' AND least(lcz, second) = 3 AND greatest(lcz, second) = 7) AS pr
  FROM m GROUP BY city)
SELECT city, n_truth, n_pred_hard, rival_to_hard, round(tp / n_pred_hard, 6) AS precision, round(tp / n_truth, 6) AS recall,
  round(pr / n_truth, 6) AS to_coarse_pair, round(rv / n_truth, 6) AS contamination,
  round((n_truth - tp - rv - pr) / n_truth, 6) AS to_other FROM s -- {{set_labels}}""")
def single_class_audit(t):
    return rounded(C.single_class_audit(_sets(t), keys=["city"]))




@query("block_scores", "D13", """WITH b AS (SELECT *, CASE WHEN block_id % 4 > 0 THEN truth ELSE lcz END AS p
  FROM set_labels WHERE label_type <> 'unlabelled'),
 h AS (SELECT city, lcz AS g, p, count(*) AS n FROM b WHERE label_type = 'hard' GROUP BY ALL),
 per AS (SELECT city, c, sum(s) AS s, sum(q) AS q, sum(tp) AS tp FROM (
   SELECT city, g AS c, n AS s, 0 AS q, CASE WHEN g = p THEN n ELSE 0 END AS tp FROM h
   UNION ALL SELECT city, p, 0, n, 0 FROM h) GROUP BY ALL),
 f AS (SELECT city, avg(2.0::DOUBLE * tp / (s + q)) FILTER (s > 0) AS f1, sum(tp) / sum(s) AS hoa FROM per GROUP BY city)
SELECT b.city, count(*) AS n, round(avg((p = lcz OR (label_type = 'coarse' AND p = second))::INT), 6) AS oa,
  count(*) FILTER (label_type = 'coarse') AS n_coarse, round(avg((label_type = 'coarse')::INT), 6) AS coarse_frac,
  round(avg((p = lcz OR p = second)::INT) FILTER (label_type = 'coarse'), 6) AS coarse_oa,
  round(any_value(f1), 6) AS f1_macro, round(any_value(hoa), 6) AS hard_oa
FROM b JOIN f USING (city) GROUP BY b.city -- {set_labels}""")
def block_scores(t):
    df = _sets(t).withColumn("pred", F.when(F.col("block_id") % 4 > 0, F.col("truth")).otherwise(F.col("lcz")))
    return rounded(C.block_scores(df, ["city"]))


@query("block_majority_vote", "D22", """WITH c AS (SELECT block_id, pred, count(*) AS n FROM {predictions} GROUP BY ALL)
SELECT block_id, pred, votes FROM (SELECT block_id, pred, sum(n) OVER (PARTITION BY block_id)::BIGINT AS votes,
 row_number() OVER (PARTITION BY block_id ORDER BY n DESC, pred) AS r FROM c) WHERE r = 1""")
def block_majority_vote(t):
    return C.majority_vote(t["predictions"])


@query("label_entropy", "D23", """WITH c AS (SELECT block_id, pred, count(*) AS n FROM {predictions} GROUP BY ALL),
 s AS (SELECT block_id, n, n / sum(n) OVER (PARTITION BY block_id) AS p FROM c)
SELECT block_id, sum(n)::BIGINT AS n, round(greatest(sum(-p * log2(p)), 0), 6) AS entropy FROM s GROUP BY block_id""")
def label_entropy(t):
    return rounded(C.entropy_bits(t["predictions"], ["block_id"], "pred"))
