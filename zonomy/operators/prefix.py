"""Summed-area tables of pixel tables: exact sums of any rectangle by four lookups.

A tile holds the prefix sums of its own pixels. What lies left of a tile in its lines, above it in its columns, and above and left
of it are carries from tile edges and tile totals, so a prefix sum of the whole grid is four numbers of one tile's place, and no
line or column of pixels is ever in one task. Measures are whole numbers (scale others), sums are decimals: nothing
is lost by taking differences, at any size of grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.operators.spatial import TASK_ROWS
from zonomy.session import cut_lineage

TILE = 64
SUM = "decimal(38,0)"


def tile_sums(pixels: DataFrame, grid: Sequence[str], measures: dict[str, Column], tile: int = TILE) -> DataFrame:
    """(grid, _ty, _tx, one array per measure): prefix sums of every tile that has pixels, row by row.

    Absent pixels and null measures count as 0; a task holds one tile.
    """
    names = list(measures)
    d = pixels.select(*grid, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(n) for n, c in measures.items()])
    d = d.withColumns({"_ty": F.floor(F.col("row") / tile), "_tx": F.floor(F.col("col") / tile)})
    keys = [*grid, "_ty", "_tx"]
    types = dict(d.dtypes)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["row"] - key[-2] * tile).to_numpy(), (pdf["col"] - key[-1] * tile).to_numpy()
        out = dict(zip(keys, ([k] for k in key)))
        for n in names:
            plane = np.zeros((tile, tile), np.int64)
            np.add.at(plane, at, pdf[n].to_numpy())
            out[n] = [plane.cumsum(axis=0).cumsum(axis=1).ravel()]
        return pd.DataFrame(out)

    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"`{n}` array<long>" for n in names])
    return d.groupBy(*keys).applyInPandas(build, schema)


def _carried(points: DataFrame, tiles: DataFrame, grid: Sequence[str], names: list[str], along: str, across: str, place: str, edge, tile: int, tasks: int) -> DataFrame:
    """(_id, _sign, sums): for each point, what tiles before its own on the same line of tiles hold up to its place across."""
    sides = tiles.select(*grid, across, along, F.posexplode(F.sequence(F.lit(0), F.lit(tile - 1))).alias("_p", "_at"), *names).select(
        *grid, across, along, F.col("_p").cast("long").alias(place), *[edge(n).cast(SUM).alias(n) for n in names], F.lit(None).cast("long").alias("_id"), F.lit(None).cast("int").alias("_sign"))
    asked = points.select(*grid, across, along, place, *[F.lit(0).cast(SUM).alias(n) for n in names], "_id", "_sign")
    w = Window.partitionBy(*grid, across, place).orderBy(along).rangeBetween(Window.unboundedPreceding, -1)
    both = sides.unionByName(asked).repartition(tasks, *grid, across, place).withColumns({f"_{n}": F.coalesce(F.sum(n).over(w), F.lit(0).cast(SUM)) for n in names})
    return both.where(F.col("_id").isNotNull()).select("_id", "_sign", *[F.col(f"_{n}").cast(SUM).alias(n) for n in names])


def _corners(points: DataFrame, tiles: DataFrame, grid: Sequence[str], names: list[str], tile: int) -> DataFrame:
    """(_id, _sign, sums): totals of all tiles above and left of the point's tile, from a table of one row per tile."""
    last = F.lit(tile * tile)
    totals = tiles.select(*grid, "_ty", "_tx", *[F.element_at(n, last).cast(SUM).alias(n) for n in names])
    places = totals.select(*grid, "_ty", "_tx").unionByName(points.select(*grid, "_ty", "_tx")) if grid else totals.select("_ty", "_tx").unionByName(points.select("_ty", "_tx"))
    box = places.groupBy(*grid).agg(F.min("_ty").alias("y0"), F.max("_ty").alias("y1"), F.min("_tx").alias("x0"), F.max("_tx").alias("x1"))
    cells = box.where(F.col("y0").isNotNull()).withColumn("_ty", F.explode(F.sequence("y0", "y1"))).withColumn("_tx", F.explode(F.sequence("x0", "x1"))).select(*grid, "_ty", "_tx")
    keys = [*grid, "_ty", "_tx"]
    cells = cells.join(totals.hint("merge"), keys, "left").fillna(0, names)
    before = lambda part, order: Window.partitionBy(*grid, part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for part, order in (("_ty", "_tx"), ("_tx", "_ty")):
        cells = cells.select(*keys, *[F.coalesce(F.sum(n).over(before(part, order)), F.lit(0)).cast(SUM).alias(n) for n in names])
    return points.select(*keys, "_id", "_sign").join(cells.hint("merge"), keys).select("_id", "_sign", *names)


def window_sums(pixels: DataFrame, windows: DataFrame, grid: Sequence[str], key: str, measures: dict[str, Column], tile: int = TILE) -> DataFrame:
    """(key, one sum per measure) of the pixels of every window (grid, r0, r1, c0, c1, both ends inside; weight optional).

    Several windows of one key add up, each times its ``weight``. Windows without pixels, or with r1 < r0 or c1 < c0, give 0. Between the
    stages there are four rows per window and ``tile`` rows per tile. All joins sort: the size that Spark expects of a small file of
    windows does not know of their corners, so it would broadcast them.
    """
    names, grid = list(measures), list(grid)
    tiles = cut_lineage(tile_sums(pixels, grid, measures, tile))
    weight = F.col("weight") if "weight" in windows.columns else F.lit(1)
    ends = F.array(*[F.struct(F.col(r).cast("long").alias("row"), F.col(c).cast("long").alias("col"), (s * weight).cast("int").alias("sign")) for r, c, s in (("r1", "c1", 1), ("_r", "c1", -1), ("r1", "_c", -1), ("_r", "_c", 1))])
    filled = windows.where((F.col("r1") >= F.col("r0")) & (F.col("c1") >= F.col("c0"))).withColumns({"_r": F.col("r0") - 1, "_c": F.col("c0") - 1})
    named = cut_lineage(filled.select(*grid, key, F.explode(ends).alias("e")).select(*grid, key, "e.*").groupBy(*grid, key, "row", "col").agg(F.sum("sign").cast("int").alias("_sign"))
                        .where(F.col("_sign") != 0).withColumn("_id", F.monotonically_increasing_id()))
    tasks = max(1, math.ceil(named.count() / TASK_ROWS))
    points = named.select(*grid, "_id", "_sign", F.floor(F.col("row") / tile).alias("_ty"), F.floor(F.col("col") / tile).alias("_tx"), F.pmod("row", F.lit(tile)).alias("_y"), F.pmod("col", F.lit(tile)).alias("_x"))
    local = points.join(tiles.hint("merge"), [*grid, "_ty", "_tx"]).select("_id", "_sign", *[F.get(n, (F.col("_y") * tile + F.col("_x")).cast("int")).cast(SUM).alias(n) for n in names])
    left = _carried(points, tiles, grid, names, "_tx", "_ty", "_y", lambda n: F.get(n, F.col("_at") * tile + tile - 1), tile, tasks)
    above = _carried(points, tiles, grid, names, "_ty", "_tx", "_x", lambda n: F.get(n, F.col("_at") + tile * (tile - 1)), tile, tasks)
    parts = local.unionByName(left).unionByName(above).unionByName(_corners(points, tiles, grid, names, tile))
    sums = parts.repartition(4 * tasks, "_id").groupBy("_id").agg(*[F.sum(F.col(n) * F.col("_sign")).cast(SUM).alias(n) for n in names])
    found = named.select(F.col(key).alias("_key"), "_id").join(sums.hint("merge"), "_id").groupBy("_key").agg(*[F.sum(n).cast(SUM).alias(n) for n in names])
    keys = windows.select(F.col(key)).distinct()
    return keys.join(found.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left").select(key, *[F.coalesce(n, F.lit(0)).cast(SUM).alias(n) for n in names])


def clamped(windows: DataFrame, height: int, width: int) -> DataFrame:
    """Windows over a grid whose edge pixels repeat outside: rectangles inside the grid with how often each counts."""
    def parts(a: str, z: str, n: int) -> Column:
        piece = lambda lo, hi, w: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), w.cast("long").alias("w"))
        low, high, edge = F.col(a), F.col(z), F.lit(n - 1)
        before, after = F.least(high, F.lit(-1)) - low + 1, high - F.greatest(low, F.lit(n)) + 1
        all_ = F.array(piece(F.greatest(low, F.lit(0)), F.least(high, edge), F.lit(1)), piece(F.lit(0), F.lit(0), before), piece(edge, edge, after))
        return F.filter(all_, lambda p: (p["w"] > 0) & (p["lo"] <= p["hi"]))

    d = windows.withColumn("_rows", F.explode(parts("r0", "r1", height))).withColumn("_cols", F.explode(parts("c0", "c1", width)))
    d = d.withColumns({"r0": F.col("_rows.lo"), "r1": F.col("_rows.hi"), "c0": F.col("_cols.lo"), "c1": F.col("_cols.hi"), "weight": F.col("_rows.w") * F.col("_cols.w")})
    return d.drop("_rows", "_cols")


def window_moments(pixels: DataFrame, windows: DataFrame, grid: Sequence[str], key: str, value: str, threshold: float | None = None, tile: int = TILE) -> DataFrame:
    """Count, mean, deviation and share above a threshold of whole-numbered pixel values per window; null without pixels."""
    v = F.col(value).cast("long")
    measures = {"n": F.lit(1), "s": v, "q": v * v} | ({"h": (F.col(value) > threshold).cast("int")} if threshold is not None else {})
    d = window_sums(pixels.where(F.col(value).isNotNull()), windows, grid, key, measures, tile)
    n, s, q = (F.col(c).cast("double") for c in ("n", "s", "q"))
    some = lambda c: F.when(F.col("n") > 0, c)
    # n q - s s in decimals has no rounding
    spread = (F.col("n").cast("decimal(18,0)") * F.col("q").cast("decimal(20,0)") - F.col("s").cast("decimal(19,0)") * F.col("s").cast("decimal(19,0)")).cast("double")
    extra = [some(F.col("h").cast("double") / n).alias("share_above")] if threshold is not None else []
    return d.select(key, F.col("n").cast("long").alias("n_pixels"), some(s / n).alias("mean"), some(F.sqrt(F.greatest(spread, F.lit(0.0))) / n).alias("std"), *extra)


def class_windows(pixels: DataFrame, windows: DataFrame, grid: Sequence[str], key: str, classes: Sequence[int], height: int, width: int, value: str = "class",
                  prob: str = "confidence", prob_unit: float = 1e-9, tile: int = TILE) -> DataFrame:
    """Majority class (lowest on ties), its share and the mean probability in windows over a grid with repeated edges.

    Probabilities are taken in multiples of ``prob_unit``. Windows without pixels have no row.
    """
    measures = {f"c{k}": (F.col(value) == k).cast("int") for k in classes} | {"p": F.round(F.col(prob) / prob_unit)}
    d = window_sums(pixels, clamped(windows, height, width), grid, key, measures, tile)
    counts = F.array(*[F.col(f"c{k}") for k in classes])
    total = F.aggregate(counts, F.lit(0).cast(SUM), lambda a, x: (a + x).cast(SUM))
    d = d.select(key, "p", counts.alias("_c"), total.cast("long").alias("n_valid")).where(F.col("n_valid") > 0)
    most = F.array_max("_c")
    return d.select(key, "n_valid", F.element_at(F.array(*[F.lit(int(k)) for k in classes]), F.array_position("_c", most).cast("int")).alias(value),
                    (most.cast("double") / F.col("n_valid")).alias("purity"), (F.col("p").cast("double") * prob_unit / F.col("n_valid")).alias("mean_prob"))
