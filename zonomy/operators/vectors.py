"""Vector tables: pooling, channel statistics, paired comparisons, projections.

Channels are exploded only below an aggregate that combines on the map side, so what is
shuffled is groups x channels, never rows x channels.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions import vectors as V
from zonomy.functions.common import stable_fraction
from zonomy.operators.ordered import exact_quantiles, quantiles_of, with_rank

# Pooling recipes and their block order.
RECIPES = {
    "gap": ("mean",), "mean_std": ("mean", "std"), "center": ("center",), "quantile": ("q10", "q50", "q90"),
    "ring": ("mean", "ring_in", "ring_out"),
    "rich": ("mean", "std", "center", "q10", "q50", "q90", "ring_in", "ring_out"),
}


def _gather(long: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Channel rows back to arrays; a group has one row per channel."""
    packed = F.array_sort(F.collect_list(F.struct("ch", *values)))
    d = long.groupBy(*keys).agg(packed.alias("_p"))
    field = lambda name: lambda p: p[name]  # noqa: E731  (a default argument would be read as the array index)
    return d.select(*keys, *[F.transform("_p", field(v)).alias(v) for v in values])


def mean_vectors(df: DataFrame, keys: Sequence[str], vec: str = "v", skip_zero: bool = True) -> DataFrame:
    """Mean vector and row count per group; all-zero vectors do not count."""
    d = df.where(F.exists(vec, lambda x: x != 0)) if skip_zero else df
    long = d.select(*keys, F.posexplode(V.doubles(vec)).alias("ch", "x"))
    m = long.groupBy(*keys, "ch").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    n = m.groupBy(*keys).agg(F.max("n").alias("n"))
    return _gather(m, keys, ["mean"]).join(n, list(keys))


def block_vectors(df: DataFrame, blocks: DataFrame, key: str, vec: str = "v", dim: int = 64) -> DataFrame:
    """Mean vector of every block; a block without usable rows gets zeros."""
    m = mean_vectors(df, [key], vec)
    zeros = F.array_repeat(F.lit(0.0), dim)
    return blocks.join(m, key, "left").select(
        *blocks.columns, F.coalesce("mean", zeros).alias("mean"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def block_features(vectors: DataFrame, blocks: DataFrame, key: str, descriptors: dict[str, Column], vec: str = "v", dim: int = 64, zonal: DataFrame | None = None) -> DataFrame:
    """(key, n, features, descriptors, zonal columns): the pooled vector of every block beside figures of its shape.

    A block without usable rows has zeros and ``n`` 0. Zonal columns come along only when their table is given; a block that it
    lacks has nulls there.
    """
    d = block_vectors(vectors, blocks.select(key, *[c.alias(n) for n, c in descriptors.items()]), key, vec, dim)
    d = d.select(key, "n", F.col("mean").alias("features"), *descriptors)
    return d if zonal is None else d.join(zonal, key, "left")


def pool_patches(pixels: DataFrame, keys: Sequence[str], h: Column, w: Column, vec: str = "v", valid: str = "valid", fallback: bool = True) -> DataFrame:
    """Eight pooled values per patch and channel: mean, std, centre, three quantiles, inner and outer ring.

    Invalid pixels are left out; a patch, ring or centre without valid pixels falls back to
    the wider set, or is null without ``fallback`` (the centre still widens step by step). A patch
    holds a fixed small number of pixels, so its quantiles are exact aggregates.
    """
    half = lambda n: F.greatest((n - 1) / 2, F.lit(1e-9))
    radius = F.greatest(F.abs(F.col("row") - (h - 1) / 2) / half(h), F.abs(F.col("col") - (w - 1) / 2) / half(w))
    # distance in pixels from the central pixel (odd side) or pair (even side)
    off = lambda c, n: F.greatest(
        F.when(n % 2 == 1, F.floor(n / 2)).otherwise(F.floor(n / 2) - 1) - c, c - F.floor(n / 2), F.lit(0))
    pad = F.greatest(off(F.col("row"), h), off(F.col("col"), w))
    d = pixels.select(*keys, F.coalesce(F.col(valid), F.lit(True)).alias("_ok"), (radius <= 0.5).alias("_in"),
                      pad.alias("_pad"), F.posexplode(V.doubles(vec)).alias("ch", "x"))
    x, ok = F.col("x"), F.col("_ok")
    good = F.when(ok, x)
    pick = lambda c: F.avg(F.when(c & ok, x))
    none = F.count_if(ok) == 0
    everything = F.avg(x)
    mean = F.coalesce(F.avg(good), everything)
    ring = lambda c: F.when(none, F.avg(F.when(c, x))).otherwise(F.coalesce(pick(c), mean))
    q = lambda p: F.coalesce(F.percentile(good, F.lit(p)), F.percentile(x, F.lit(p)))
    inner = F.col("_in")
    if not fallback:
        return d.groupBy(*keys, "ch").agg(
            F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), F.coalesce(*[pick(F.col("_pad") <= p) for p in range(4)], F.avg(good)).alias("center"),
            *[F.percentile(good, F.lit(p)).alias(n) for n, p in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))],
            pick(inner).alias("ring_in"), pick(~inner).alias("ring_out"))
    centre_all = F.avg(F.when(F.col("_pad") == 0, x))
    return d.groupBy(*keys, "ch").agg(
        mean.alias("mean"), F.coalesce(F.stddev_pop(good), F.stddev_pop(x)).alias("std"),
        F.when(none, centre_all).otherwise(
            F.coalesce(*[pick(F.col("_pad") <= p) for p in range(4)], mean)).alias("center"),
        q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"),
        ring(inner).alias("ring_in"), ring(~inner).alias("ring_out"))


def compose(pooled: DataFrame, keys: Sequence[str], recipe: str) -> DataFrame:
    """Feature vector of a named recipe: its blocks concatenated in fixed order."""
    blocks = RECIPES[recipe]
    d = _gather(pooled, keys, blocks)
    return d.select(*keys, F.concat(*blocks).alias("features"))


def channel_stats(df: DataFrame, vec: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Per channel: count, mean, deviation (at least 1e-6) and skewness."""
    long = df.select(*keys, F.posexplode(V.doubles(vec)).alias("ch", "x"))
    return long.groupBy(*keys, "ch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"),
        F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("std"), F.skewness("x").alias("skew"))


def channel_quantiles(df: DataFrame, probs: dict[str, float], vec: str = "v") -> DataFrame:
    """Exact quantiles per channel."""
    long = df.select(F.posexplode(V.doubles(vec)).alias("ch", "x"))
    return exact_quantiles(long, ["ch"], F.col("x"), probs)


def norm_summary(df: DataFrame, vec: str = "v") -> DataFrame:
    """Distribution of vector lengths and the share within one percent of 1."""
    d = df.select(V.norm(V.doubles(vec)).alias("_n"))
    a = d.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.avg("_n").alias("mean"), F.stddev_pop("_n").alias("std"),
        F.avg((F.abs(F.col("_n") - 1) < 0.01).cast("double")).alias("near_one"),
        F.avg((F.col("_n") == 0).cast("double")).alias("all_zero"))
    q = exact_quantiles(d, [], F.col("_n"), {"p1": 0.01, "p50": 0.5, "p99": 0.99})
    one = F.lit(1)
    return a.withColumn("_k", one).join(F.broadcast(q.withColumn("_k", one)), "_k").drop("_k")  # one row each


def weighted_moments(df: DataFrame, weight: Column, vec: str = "v", keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean and deviation per channel from three additive sums."""
    long = df.select(*keys, weight.cast("double").alias("_w"), F.posexplode(V.doubles(vec)).alias("ch", "x"))
    s = long.groupBy(*keys, "ch").agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("x")).alias("_1"), F.sum(F.col("_w") * F.col("x") * F.col("x")).alias("_2"))
    n = F.greatest(F.col("w"), F.lit(1.0))
    mean = F.col("_1") / n
    return s.select(*keys, "ch", "w", mean.alias("mean"), F.sqrt(F.greatest(F.col("_2") / n - mean * mean, F.lit(0.0))).alias("std"))


def variance_share(df: DataFrame, valid: Column, vec: str = "v") -> DataFrame:
    """Share of the per-channel variance that invalid rows add, on median deviations."""
    a = weighted_moments(df, F.lit(1.0), vec).select("ch", F.col("std").alias("_a"))
    b = weighted_moments(df, valid.cast("double"), vec).select("ch", F.col("std").alias("_b"))
    # one row per channel
    m = a.join(b, "ch").groupBy().agg(F.percentile("_a", F.lit(0.5)).alias("std_all"), F.percentile("_b", F.lit(0.5)).alias("std_valid"))
    ratio = F.col("std_valid") / F.col("std_all")
    return m.withColumn("share", F.when(F.col("std_all") > 0, F.greatest(1 - ratio * ratio, F.lit(0.0))).otherwise(0.0))


def pair_correlation(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Per channel: Pearson r, RMSE and deviation ratio of two decodings of the same rows."""
    z = F.arrays_zip(V.doubles(a).alias("p"), V.doubles(b).alias("q"))
    long = pairs.select(F.posexplode(z).alias("ch", "z")).select("ch", F.col("z.p").alias("p"), F.col("z.q").alias("q"))
    d = F.col("p") - F.col("q")
    return long.groupBy("ch").agg(
        F.corr("p", "q").alias("r"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.stddev_pop("q") / F.greatest(F.stddev_pop("p"), F.lit(1e-12))).alias("std_ratio"))


# ── moments of vector pairs ──────────────────────────────────────────────────


def _moment_rows(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    acc: dict[tuple, np.ndarray] = {}
    for pdf in batches:
        for key, part in pdf.groupby(list(keys), dropna=False, sort=False) if keys else [((), pdf)]:
            x = np.column_stack([np.ones(len(part)), np.stack(part["_x"].to_numpy())]).astype("float64")
            g = x.T @ x
            k = key if isinstance(key, tuple) else (key,)
            acc[k] = acc[k] + g if k in acc else g
    for k, g in acc.items():
        out = pd.DataFrame({"i": np.repeat(np.arange(len(g)), len(g)), "j": np.tile(np.arange(len(g)), len(g)), "s": g.ravel()})
        for name, value in zip(keys, k):
            out[name] = value
        yield out[[*keys, "i", "j", "s"]]


def gram(df: DataFrame, vec: Column, keys: Sequence[str] = (), key_types: str = "") -> DataFrame:
    """Sums of products of [1, vector] with itself, per group: (keys, i, j, s); index 0 is the constant.

    Each task adds its own matrix and emits it once; the matrices are summed by cell, so
    nothing but channel x channel cells is shuffled.
    """
    keyed = df.select(*keys, vec.cast("array<double>").alias("_x"))
    schema = (key_types + ", " if keys else "") + "i int, j int, s double"
    rows = keyed.mapInPandas(lambda it: _moment_rows(it, keys), schema)
    return rows.groupBy(*keys, "i", "j").agg(F.sum("s").alias("s"))


def gram_matrix(g: DataFrame) -> np.ndarray:
    """The summed matrix of one group on the driver: (channels + 1) squared numbers."""
    cells = g.select("i", "j", "s").toPandas()
    n = int(cells["i"].max()) + 1
    out = np.zeros((n, n))
    out[cells["i"], cells["j"]] = cells["s"]
    return out


def covariance(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population covariance) from a moment matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return mean, m[1:, 1:] / n - np.outer(mean, mean)


def cross_channel(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For every channel of ``a``: its correlation with the same channel of ``b`` and the best over all channels."""
    m = gram_matrix(gram(pairs, F.concat(V.doubles(a), V.doubles(b))))
    _, cov = covariance(m)
    c = len(cov) // 2
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    r = cov[:c, c:] / np.outer(sd[:c], sd[c:])
    best = np.abs(r).argmax(axis=1)
    rows = [(int(k), float(r[k, k]), int(best[k]), float(abs(r[k, best[k]]))) for k in range(c)]
    return pairs.sparkSession.createDataFrame(rows, "ch int, r_matched double, best_ch int, r_best double")


def _map_r2(train: np.ndarray, test: np.ndarray, mean: np.ndarray, c: int) -> float:
    def centred(m: np.ndarray) -> np.ndarray:
        n, s = m[0, 0], m[0, 1:]
        return m[1:, 1:] - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)

    tr, te = centred(train), centred(test)
    coef = np.linalg.lstsq(tr[:c, :c], tr[:c, c:], rcond=None)[0]
    sse = np.trace(te[c:, c:]) - 2 * np.sum(coef * te[:c, c:]) + np.sum(coef * (te[:c, :c] @ coef))
    return float(1 - sse / max(np.trace(te[c:, c:]), 1e-12))


def linear_map_r2(pairs: DataFrame, group: str, key: str, a: str = "a", b: str = "b", salt: str = "half") -> DataFrame:
    """R2 of the best linear map from ``a`` to ``b``, fitted on half of the groups and scored on
    the rest, beside the same figure when rows are paired half the table apart."""
    d = pairs.select(key, group, V.doubles(a).alias("a"), V.doubles(b).alias("b"))
    d = d.withColumn("_test", (stable_fraction(group, salt) >= 0.5).cast("int"))
    ranked = with_rank(d, [], stable_fraction(key, salt + "-order"), [F.col(key), F.col(group).cast("string")], name="_p", total="_n")
    shifted = ranked.select(((F.col("_p") - 1 + F.floor(F.col("_n") / 2)) % F.col("_n") + 1).alias("_p"), F.col("b").alias("_b2"))
    out = []
    for name, table, other in (("paired", d, "b"), ("shuffled", ranked.join(shifted, "_p"), "_b2")):
        g = gram(table, F.concat("a", F.col(other)), ["_test"], "_test int").toPandas()
        m = []
        for side in (0, 1):
            cells = g[g["_test"] == side]
            n = int(g["i"].max()) + 1
            x = np.zeros((n, n))
            x[cells["i"], cells["j"]] = cells["s"]
            m.append(x)
        total = m[0] + m[1]
        mean = total[0, 1:] / total[0, 0]
        out.append((name, _map_r2(m[0], m[1], mean, (len(total) - 1) // 2)))
    return pairs.sparkSession.createDataFrame(out, "pairing string, r2 double")


# ── principal components and colour ──────────────────────────────────────────


def principal_axes(df: DataFrame, vec: str = "v", k: int = 3, where: Column | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k axes, explained shares); the largest loading of every axis is positive."""
    d = df.where(where) if where is not None else df
    mean, cov = covariance(gram_matrix(gram(d, V.doubles(vec))))
    value, axes = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1][:k]
    comp = axes[:, order].T
    sign = np.sign(comp[np.arange(len(comp)), np.abs(comp).argmax(axis=1)])
    return mean, comp * np.where(sign == 0, 1.0, sign)[:, None], value[order] / value.sum()


def colour_table(df: DataFrame, key: str, vec: str = "v", low: float = 0.02, high: float = 0.98, local: bool = False) -> DataFrame:
    """Three principal components per row stretched to 0..255.

    One common range (that of the first component) around each component's median keeps
    relative variance; ``local`` stretches every component to its own range.
    """
    mean, comp, _ = principal_axes(df, vec)
    z = V.project(V.doubles(vec), comp.tolist(), mean.tolist())
    d = df.select(key, *[c.alias(f"z{i}") for i, c in enumerate(z)])
    cuts = quantiles_of(d, [], {f"z{i}": F.col(f"z{i}") for i in range(3)}, {"lo": low, "md": 0.5, "hi": high})
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(cuts.withColumn("_k", F.lit(1))), "_k")  # one row
    half = F.greatest(F.col("z0_hi") - F.col("z0_lo"), F.lit(1e-12)) / 2
    out = []
    for i in range(3):
        lo = F.col(f"z{i}_lo") if local else F.col(f"z{i}_md") - half
        hi = F.col(f"z{i}_hi") if local else F.col(f"z{i}_md") + half
        share = (F.col(f"z{i}") - lo) / F.greatest(hi - lo, F.lit(1e-12))
        out.append(F.rint(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias("rgb"[i]))
    return d.select(key, *out)


def raw_colour(df: DataFrame, key: str, bands: Sequence[int], vec: str = "v", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Three raw channels stretched between two exact quantiles of the table."""
    d = df.select(key, *[F.get(V.doubles(vec), F.lit(b)).alias(f"z{i}") for i, b in enumerate(bands)])
    cuts = quantiles_of(d, [], {f"z{i}": F.col(f"z{i}") for i in range(len(bands))}, {"lo": low, "hi": high})
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(cuts.withColumn("_k", F.lit(1))), "_k")  # one row

    def part(i: int) -> Column:
        z, lo, hi = (F.col(c) for c in (f"z{i}", f"z{i}_lo", f"z{i}_hi"))
        return F.least(F.greatest((z - lo) / F.greatest(hi - lo, F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))

    return d.select(key, *[F.rint(part(i) * 255).cast("int").alias("rgb"[i]) for i in range(len(bands))])


def subspace_angles(df: DataFrame, key: str, vec: str = "v", k: int = 3, salt: str = "half") -> DataFrame:
    """Principal angles in degrees between the axes of two halves of the rows."""
    half = stable_fraction(key, salt) < 0.5
    a = principal_axes(df, vec, k, half)[1]
    b = principal_axes(df, vec, k, ~half)[1]
    cos = np.clip(np.linalg.svd(a @ b.T, compute_uv=False), -1, 1)
    rows = [(i, float(v)) for i, v in enumerate(np.degrees(np.arccos(cos)))]
    return df.sparkSession.createDataFrame(rows, "axis int, degrees double")


# ── aligned sources ──────────────────────────────────────────────────────────


def masked_fill(pixels: DataFrame, sentinel: float | None, vec: str = "v", offset: float = 0.0) -> DataFrame:
    """Nodata vectors replaced by the channel means of the valid ones; adds ``valid``."""
    bad = V.is_nodata(V.doubles(vec), sentinel)
    d = pixels.withColumn("valid", ~bad)
    stats = channel_stats(d.where("valid"), vec).select("ch", (F.col("mean") + offset).alias("mean"))
    fill = _gather(stats.withColumn("_k", F.lit(1)), ["_k"], ["mean"])
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(fill), "_k", "left")  # one mean vector
    return d.withColumn(vec, F.when(F.col("valid"), V.doubles(vec)).otherwise(F.col("mean"))).drop("_k", "mean")


def fuse_sources(left: DataFrame, right: DataFrame, keys: Sequence[str], vec: str = "v") -> DataFrame:
    """Concatenated vectors of two sources of the same pixels; valid only where both are."""
    r = right.select(*keys, F.col(vec).alias("_v2"), F.col("valid").alias("_ok2"))
    return left.join(r, list(keys)).select(
        *keys, F.concat(vec, "_v2").alias(vec), (F.col("valid") & F.col("_ok2")).alias("valid"))


def pair_pixels(a: DataFrame, b: DataFrame, patch: Sequence[str], vec: str = "v") -> tuple[DataFrame, DataFrame]:
    """Pixels of patches that have the same shape in both sources, and the count of shape mismatches."""
    size = lambda d, n: d.groupBy(*patch).agg(F.max("row").alias(f"h{n}"), F.max("col").alias(f"w{n}"))
    s = size(a, 1).join(size(b, 2), list(patch))
    same = (F.col("h1") == F.col("h2")) & (F.col("w1") == F.col("w2"))
    ok = s.where(same).select(*patch)
    at = [*patch, "row", "col"]
    j = a.join(ok, list(patch), "left_semi").select(*at, F.col(vec).alias("a")).join(b.select(*at, F.col(vec).alias("b")), at)
    return j, s.groupBy().agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~same).alias("n_mismatch"))


def impute_standardise(df: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    """Missing values become the median of the fit rows, then every column is centred and scaled by
    the fit rows' statistics."""
    one = F.lit(1)
    d = df.withColumn("_fit", fit).withColumn("_k", one)
    val = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    med = quantiles_of(d.where("_fit"), [], {f"_m_{c}": val(c) for c in columns}, {"q": 0.5}).withColumn("_k", one)
    d = d.join(F.broadcast(med), "_k", "left")  # one row of medians
    d = d.select(*[x for x in d.columns if x not in columns and not x.startswith("_m_")],
                 *[F.coalesce(val(c), F.col(f"_m_{c}_q"), F.lit(0.0)).alias(c) for c in columns])
    stats = d.where("_fit").groupBy("_k").agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    d = d.join(F.broadcast(stats), "_k", "left")
    return d.select(*[x for x in df.columns if x not in columns],
                    *[((F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_s_{c}") + 1e-8)).alias(c) for c in columns])
