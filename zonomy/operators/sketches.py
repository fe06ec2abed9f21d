"""Stored figures of tiles that can be put together: counts, moments and quantile sketches per tile and channel.

A state row holds what any union of tiles needs, so figures of a city, a split or the whole table come from states and read no
pixels, and a new tile adds its own row. Moments are merged about their means; quantiles come from KLL sketches, whose
rank error is about 1.7 / k and which are exact up to k values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from zonomy.functions import vectors as V
from zonomy.sources.cache import exists

#: Size of a sketch; its rank error goes with the inverse.
SKETCH = 400


def channel_states(pixels: DataFrame, tile: Sequence[str], vec: str = "v", k: int = SKETCH) -> DataFrame:
    """(tile, ch, n, mean, m2, low, high, sketch) per tile and channel; null and NaN components do not count."""
    long = pixels.select(*tile, F.posexplode(V.doubles(vec)).alias("ch", "x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return long.groupBy(*tile, "ch").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count(F.lit(1))).alias("m2"),
        F.min("x").alias("low"), F.max("x").alias("high"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))


def merged_states(states: DataFrame, keys: Sequence[str] = (), k: int = SKETCH) -> DataFrame:
    """States of larger groups, which can be merged again. Two passes over the states: the common mean, then what each lies off it."""
    by = [*keys, "ch"]
    mean = states.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    d = states.join(mean, by)
    off = F.col("mean") - F.col("_mean")
    return d.groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def state_figures(states: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Mean, deviation (at least 1e-6), ends and quantiles of every state row; the state columns are dropped.

    A quantile is the smallest value whose share of values up to it reaches the probability.
    """
    keys = [c for c in states.columns if c not in ("n", "mean", "m2", "low", "high", "sketch")]
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return states.select(*keys, "n", "mean", F.greatest(F.sqrt(F.col("m2") / F.col("n")), F.lit(1e-6)).alias("std"), "low", "high", *at)


def append_states(pixels: DataFrame, tile: Sequence[str], path: str, vec: str = "v", k: int = SKETCH) -> DataFrame:
    """Add the states of tiles that the table at ``path`` does not hold yet and return the table.

    Pixels of known tiles are left out before they are read further; their states stay as they were written.
    """
    spark = pixels.sparkSession
    if exists(spark, f"{path}/_SUCCESS"):
        pixels = pixels.join(spark.read.parquet(path).select(*tile).distinct(), list(tile), "left_anti")
    channel_states(pixels, tile, vec, k).write.mode("append").parquet(path)
    return spark.read.parquet(path)
