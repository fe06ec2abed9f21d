"""Exact cosine neighbours and the figures built on them.

References are cut into blocks of bounded size; a task multiplies bounded matrices and keeps only the k best rows
per query, so the pairs themselves are never written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from zonomy.functions import vectors as V
from zonomy.operators.ordered import exact_quantiles
from zonomy.operators.pivots import search, top_pairs
from zonomy.operators.vectors import mean_vectors

BLOCK = 8192
GROUPS = 2000


def _blocks(n: int, block: int) -> int:
    return max(1, -(-n // block))


def _all_blocks(queries: DataFrame, refs: DataFrame, k: int, key: str, vec: str, exclude_self: bool, nq: int) -> DataFrame:
    """(q, r, dist): the k best references of every query, for references that fit one block."""
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(F.col(key).alias("q"), V.doubles(vec).alias("v")).withColumn("qb", slot("q", nq))
    r = refs.select(F.col(key).alias("r"), V.doubles(vec).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    key_type = dict(queries.dtypes)[key]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": left["q"][:0], "r": right["r"][:0], "dist": np.zeros(0)})
        def unit(s: pd.Series) -> np.ndarray:
            x = np.stack(s.to_numpy())
            return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)

        right = right.sort_values("r", kind="stable")
        rid, rv = right["r"].to_numpy(), unit(right["v"])
        out = []
        for start in range(0, len(left), 1024):
            part = left.iloc[start:start + 1024]
            qid = part["q"].to_numpy()
            d = np.round(1.0 - unit(part["v"]) @ rv.T, 9)
            if exclude_self:
                d[qid[:, None] == rid[None, :]] = np.inf
            top = np.argsort(d, axis=1, kind="stable")[:, :k]
            dist = np.take_along_axis(d, top, axis=1)
            keep = np.isfinite(dist)
            out.append(pd.DataFrame({"q": np.repeat(qid, top.shape[1])[keep.ravel()], "r": rid[top][keep], "dist": dist[keep]}))
        return pd.concat(out, ignore_index=True)

    return q.groupBy("qb").cogroup(r.groupBy("qb")).applyInPandas(best, f"q {key_type}, r {key_type}, dist double")


def knn(queries: DataFrame, refs: DataFrame, k: int, key: str = "id", vec: str = "v", exclude_self: bool = False,
        block: int = BLOCK) -> DataFrame:
    """(key, ref, dist, nn) of the k nearest references by cosine distance, ties by reference id.

    References that fit one block meet every query there; more are searched by pivots (``pivots.search``), where a query
    visits only the blocks that its k-th distance so far can reach. Distances are rounded to 1e-9 so that the
    order does not depend on the block layout.
    """
    n_refs = refs.count()
    if n_refs <= block:
        pairs = _all_blocks(queries, refs, k, key, vec, exclude_self, _blocks(queries.count(), block))
    else:
        pairs, _ = search(queries, refs, k, key, vec, exclude_self, block, n_refs)
    return top_pairs(pairs, k).select(F.col("q").alias(key), F.col("r").alias("ref"), "dist", "nn")


def knn_vote(pairs: DataFrame, labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """Most frequent neighbour label, lowest on ties; unlabelled (-1) neighbours do not vote."""
    lab = labels.select(F.col(key).alias("ref"), F.col(label).alias("_l")).where(F.col("_l") >= 0)
    c = pairs.join(lab, "ref").groupBy(key, "_l").agg(F.count(F.lit(1)).alias("_n"))
    voted = c.groupBy(key).agg(F.max_by("_l", F.struct("_n", -F.col("_l"))).alias("pred"))
    return pairs.select(key).distinct().join(voted, key, "left").withColumn("pred", F.coalesce("pred", F.lit(-1)))


def neighbour_groups(pairs: DataFrame, facets: DataFrame, key: str, facet: str) -> DataFrame:
    """(group_a, group_b, n, share): how often a neighbour of group a lies in group b."""
    a = facets.select(F.col(key), F.col(facet).alias("group_a"))
    b = facets.select(F.col(key).alias("ref"), F.col(facet).alias("group_b"))
    c = pairs.join(a, key).join(b, "ref").groupBy("group_a", "group_b").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("group_a").agg(F.sum("n").alias("_t"))
    return c.join(t, "group_a").withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def entangled_pairs(matrix: DataFrame, top: int = 15) -> DataFrame:
    """The ordered pairs of different groups with the largest neighbour share."""
    return matrix.where(F.col("group_a") != F.col("group_b")).orderBy(F.desc("share"), "group_a", "group_b").limit(top)


def label_agreement(pairs: DataFrame, facets: DataFrame, key: str, facet: str) -> DataFrame:
    """Mean share of neighbours with the same label, its chance level and the adjusted figure."""
    lab_a = facets.select(F.col(key), F.col(facet).alias("_a"))
    lab_b = facets.select(F.col(key).alias("ref"), F.col(facet).alias("_b"))
    same = pairs.join(lab_a, key).join(lab_b, "ref").groupBy(key).agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("s"))
    agr = same.groupBy().agg(F.avg("s").alias("agreement"))
    n = facets.groupBy(facet).agg(F.count(F.lit(1)).alias("_n"))
    p = n.groupBy().agg(F.count(F.lit(1)).alias("n_groups"), (F.sum(F.col("_n") * F.col("_n")) / F.pow(F.sum("_n"), F.lit(2))).alias("chance"))
    one = F.lit(1)
    d = agr.withColumn("_k", one).join(p.withColumn("_k", one), "_k").drop("_k")  # one row each
    adj = F.when(F.col("chance") < 1, (F.col("agreement") - F.col("chance")) / (1 - F.col("chance")))
    return d.select(F.lit(facet).alias("facet"), "n_groups", "agreement", "chance", adj.alias("adjusted"))


def silhouette(df: DataFrame, key: str, facet: str, vec: str = "v") -> DataFrame:
    """Mean cosine silhouette of a facet, exact and linear in the rows.

    With unit vectors the mean distance to a group is one minus a product with its vector
    sum, so only one sum per group is needed. Every row meets the groups in blocks of about
    ``GROUPS``, whatever their number.
    """
    u = df.select(key, F.col(facet).alias("g"), V.unit(V.doubles(vec)).alias("u"))
    sums = mean_vectors(u, ["g"], "u", skip_zero=False).select("g", "n", F.transform("mean", lambda m: m * F.col("n")).alias("s"))
    blocks = _blocks(sums.count(), GROUPS)
    packed = sums.groupBy(F.pmod(F.xxhash64("g"), F.lit(blocks)).alias("_k")).agg(F.collect_list(F.struct("g", "n", "s")).alias("groups"))
    d = u.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "_k")
    own = F.get(F.filter("groups", lambda x: x["g"].eqNullSafe(F.col("g"))), 0)
    others = F.filter("groups", lambda x: ~x["g"].eqNullSafe(F.col("g")))
    b = F.array_min(F.transform(others, lambda x: 1 - V.dot(F.col("u"), x["s"]) / x["n"]))
    a = (own["n"] - V.dot(F.col("u"), own["s"])) / (own["n"] - 1)
    d = d.select(key, a.alias("a"), b.alias("b"), own["n"].alias("n")).groupBy(key).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("n").alias("n"))
    s = F.when(F.col("n") < 2, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return d.groupBy().agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n")).select(F.lit(facet).alias("facet"), "silhouette", "n")


def centroid_drift(df: DataFrame, cls: str, split: str, vec: str = "v") -> DataFrame:
    """Distance between the train and test centroids of every class that has both."""
    long = df.select(cls, split, F.posexplode(V.doubles(vec)).alias("ch", "x"))
    on = lambda s: F.avg(F.when(F.col(split) == s, F.col("x")))
    n = lambda s: F.count_if(F.col(split) == s)
    m = long.groupBy(cls, "ch").agg(on("train").alias("a"), on("test").alias("b"), n("train").alias("na"), n("test").alias("nb"))
    d = (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))
    return m.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy(cls).agg(
        F.max("na").alias("n_train"), F.max("nb").alias("n_test"), F.sqrt(F.sum(d)).alias("centroid_dist"))


def density(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.avg("dist").alias("density"))


def sparse_share(train_pairs: DataFrame, test_pairs: DataFrame, key: str, pct: float = 0.95) -> DataFrame:
    """Share of test rows further from the train rows than a percentile of the train rows are from each other."""
    cut = exact_quantiles(density(train_pairs, key), [], F.col("density"), {"threshold": pct}).withColumn("_k", F.lit(1))
    d = density(test_pairs, key).withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k")  # one row
    return d.groupBy().agg(F.max("threshold").alias("threshold"), F.avg("density").alias("mean_test_density"),
                           F.avg((F.col("density") > F.col("threshold")).cast("double")).alias("frac_sparse"))
