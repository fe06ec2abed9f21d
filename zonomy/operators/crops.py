"""How the size of crops drifts over the map: resolution figures, cities, latitude bands, shapes and rank correlations.

A crop table has h, w (pixels), lon, lat and city. Truncated crops, with a side below a share of the median, are a gap of coverage and
no drift, so all but the shape counts leave them out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions import geometry as G
from zonomy.operators.manifest import TRUNCATION, median_shape, spearman
from zonomy.session import broadcast_if_small, cut_lineage

#: Upper ends of the latitude bands, in degrees from the equator; the last takes the rest.
BANDS = (15, 30, 40, 50, 90)
#: Metres of a pixel on the ground, and pixels of a side after resampling.
PIXEL_M, SIDE_PX = 10.0, 32.0


def resolution(pixels: Column) -> Column:
    """Metres of ground that a resampled pixel covers along a side of so many pixels."""
    return pixels * PIXEL_M / SIDE_PX


def whole_crops(crops: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Crops that are not truncated, with abs_lat, dist_meridian (degrees to the zone's meridian), res_h, res_w and res_geo.

    The median is taken per ``keys``, over the whole table without any.
    """
    d = crops.withColumn("_all", F.lit(1))
    by = list(keys) or ["_all"]
    med = broadcast_if_small(cut_lineage(median_shape(d, by)), 10_000)
    d = d.join(med, by).where((F.col("h") >= TRUNCATION * F.col("med_h")) & (F.col("w") >= TRUNCATION * F.col("med_w"))).drop("_all", "med_h", "med_w")
    meridian = G.utm_meridian(G.utm_zone("lon"))
    return d.withColumns({"abs_lat": F.abs("lat"), "dist_meridian": F.abs(F.col("lon") - meridian), "res_h": resolution(F.col("h")), "res_w": resolution(F.col("w")),
                          "res_geo": resolution(F.sqrt(F.col("h") * F.col("w")))})


def _means() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("h", "w", "res_h", "res_w", "res_geo")]]


def city_drift(whole: DataFrame, held_out: Sequence[str] = ()) -> DataFrame:
    """Per city mean place, sizes with their spread, and resolutions, and whether it is held out."""
    d = whole.groupBy("city").agg(*_means(), F.avg("lat").alias("lat"), F.stddev_samp("h").alias("h_std"), F.stddev_samp("w").alias("w_std"))
    return d.withColumn("held_out", F.col("city").isin(*held_out) if held_out else F.lit(False))


def band_drift(whole: DataFrame, bands: Sequence[int] = BANDS) -> DataFrame:
    """Mean sizes and resolutions per band of absolute latitude, lower end excluded, named like ``(15, 30]``; the equator is in no band."""
    name, low = None, 0
    for high in bands:
        hit, text = (F.col("abs_lat") > low) & (F.col("abs_lat") <= high), f"({low}, {high}]"
        name, low = F.when(hit, text) if name is None else name.when(hit, text), high
    return whole.withColumn("band", name).where(F.col("band").isNotNull()).groupBy("band").agg(*_means())


def shape_counts(crops: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent shapes, truncated ones too; ties by height, then width."""
    return crops.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "h", "w").limit(top)


def drift_correlations(whole: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, rho, n): rank correlation of each pair of columns."""
    out = None
    for a, b in pairs:
        one = spearman(whole, a, b).select(F.lit(f"{a}_vs_{b}").alias("pair"), "rho", "n")
        out = one if out is None else out.unionByName(one)
    return out
