"""Vote weights and training weights as expressions (fixed values in the defaults)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions.clean import class_accuracy
from zonomy.functions.common import N_CLASSES, clip, col
from zonomy.operators.ordered import exact_quantiles


def trapezoid(x: Column, lo_off: float, lo_on: float, hi_on: float, hi_off: float, low: float, high: float) -> Column:
    """1 between ``lo_on`` and ``hi_on``; linear down to ``low`` at ``lo_off`` and to ``high`` at ``hi_off``."""
    rise = low + (1 - low) * clip((x - lo_off) / (lo_on - lo_off), 0, 1)
    fall = 1 - (1 - high) * clip((x - hi_on) / (hi_off - hi_on), 0, 1)
    return F.when(x < lo_on, rise).when(x > hi_on, fall).otherwise(F.lit(1.0))


def vote_weights(df: DataFrame, target_year: int | None = None) -> DataFrame:
    """Adds w_qc, w_acc, w_time, w_size and their product.

    Needs class, qc_step1..3, oa, oau, class_f1, label_year, area_km2. The F1 factor is
    relative to the exact median of the class, joined back from a 17-row table.
    """
    step1 = F.coalesce(F.col("qc_step1"), F.lit(False))
    soft = ~F.coalesce(F.col("qc_step2"), F.lit(True)) | ~F.coalesce(F.col("qc_step3"), F.lit(True))
    w_qc = F.when(step1, 1.0).otherwise(0.0) * F.when(soft, 0.6).otherwise(1.0)
    med = exact_quantiles(df, ["class"], F.col("class_f1"), {"_med": 0.5})
    med = med.where(F.col("class").between(1, N_CLASSES))  # at most 17 rows, so it may be broadcast
    d = df.join(F.broadcast(med), "class", "left")
    acc = F.coalesce(class_accuracy("class", "oa", "oau"), F.lit(0.0))
    ratio = F.when(F.col("class_f1").isNotNull() & (F.col("_med") > 0), F.col("class_f1") / F.col("_med")).otherwise(1.0)
    w_acc = clip((acc - 0.40) / 0.50, 0.05, 1.0) * clip(ratio, 0.25, 2.0)
    if target_year is None:
        w_time = F.lit(1.0)
    else:
        gap = F.abs(F.coalesce(F.col("label_year"), F.lit(target_year)) - target_year)
        w_time = F.exp(-gap / 3.0)
    w_size = trapezoid(F.col("area_km2"), 0.005, 0.02, 1.0, 5.0, 0.4, 0.6)
    d = d.withColumns({"w_qc": w_qc, "w_acc": w_acc, "w_time": w_time, "w_size": w_size}).drop("_med")
    return d.withColumn("weight", F.col("w_qc") * F.col("w_acc") * F.col("w_time") * F.col("w_size"))


def nearest_year(year: Column | str, available: Sequence[int]) -> Column:
    """Closest available year, the earlier one on ties; null year gives the middle entry."""
    ys = sorted(available)
    if not ys:
        raise ValueError("no years to match against")
    y = col(year)
    options = F.array(*[F.struct(F.abs(y - F.lit(a)).alias("lag"), F.lit(a).alias("year")) for a in ys])
    return F.when(y.isNull(), F.lit(ys[len(ys) // 2])).otherwise(F.array_min(options)["year"])


def temporal_alignment(
    df: DataFrame, year: str = "label_year", available: Sequence[int] = (2017, 2025), decay: float | None = 8.0
) -> DataFrame:
    """Adds embedding_year, year_lag and w_time; rows of unknown year get the median lag."""
    d = df.withColumn("embedding_year", nearest_year(year, available))
    d = d.withColumn("_lag", F.abs(F.col(year) - F.col("embedding_year")).cast("double"))
    med = exact_quantiles(d, [], F.col("_lag"), {"_med": 0.5}).withColumn("_k", F.lit(0))
    d = d.withColumn("_k", F.lit(0)).join(F.broadcast(med), "_k", "left")  # a single row
    lag = F.coalesce(F.col("_lag"), F.col("_med"), F.lit(0.0))
    w = F.lit(1.0) if decay is None else F.exp(-lag / decay)
    return d.withColumn("year_lag", lag).withColumn("w_time", w).drop("_k", "_lag", "_med")


def training_weight(acc: Column, w_time: Column, area_km2: Column, nbr_dist: Column, buffer_m: float = 100.0) -> dict[str, Column]:
    """Soft factors, none of which can reach zero, and their product."""
    w_acc = F.coalesce(clip((acc - 0.40) / 0.50, 0.05, 1.0), F.lit(1.0))
    w_area = clip(0.5 + 0.5 * F.sqrt(F.greatest(area_km2, F.lit(0.0))), 0.5, 1.0)
    w_nbr = clip(0.5 + 0.5 * F.least(nbr_dist, F.lit(buffer_m)) / buffer_m, 0.5, 1.0)
    return {"w_acc": w_acc, "w_area": w_area, "w_nbr": w_nbr, "weight": w_acc * w_time * w_area * w_nbr}
