"""Burning polygons by scan lines: crossings of a pixel row with the edges, sorted, give runs of pixels; no pixel is tested.

A polygon is a column of rings; what an odd number of rings hold is inside. A pixel belongs to a polygon when its centre does,
a centre on a left or lower edge included, on a right or upper edge not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions import geometry as G


def _first(v: Column, res: float) -> Column:
    """Number of the first pixel whose centre is not before ``v``."""
    return F.ceil(v / res - 0.5)


def _span(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def edge_rows(shapes: DataFrame, keys: Sequence[str], res: float, rings: str = "rings") -> DataFrame:
    """(keys, row, x): where the centre line of a pixel row crosses an edge; one row per edge and pixel row."""
    points = F.filter(F.col("_ring"), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    d = shapes.select(*keys, F.explode(rings).alias("_ring")).where(F.size(points) > 2)
    d = d.select(*keys, F.explode(G._edges(points)).alias("_e")).where(F.col("_e.y0") != F.col("_e.y1"))
    up = F.col("_e.y0") < F.col("_e.y1")
    end = lambda a, b: F.when(up, F.col(f"_e.{a}")).otherwise(F.col(f"_e.{b}"))
    d = d.select(*keys, end("x0", "x1").alias("_ax"), end("y0", "y1").alias("_ay"), end("x1", "x0").alias("_bx"), end("y1", "y0").alias("_by"))
    d = d.withColumn("row", F.explode(_span(_first(F.col("_ay"), res), _first(F.col("_by"), res) - 1)))
    y = (F.col("row") + 0.5) * res
    return d.select(*keys, "row", (F.col("_ax") + (F.col("_bx") - F.col("_ax")) * (y - F.col("_ay")) / (F.col("_by") - F.col("_ay"))).alias("x"))


def ring_runs(shapes: DataFrame, keys: Sequence[str], res: float, rings: str = "rings") -> DataFrame:
    """(keys, row, c0, c1): the runs of pixels of every polygon and pixel row, both ends inside. ``keys`` tell polygons apart.

    A group is the crossings of one polygon with one pixel row. Null and empty polygons have no runs.
    """
    lines = edge_rows(shapes, keys, res, rings).groupBy(*keys, "row").agg(F.array_sort(F.collect_list("x")).alias("_x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda k: F.struct(
        _first(F.get("_x", 2 * k), res).alias("c0"), (_first(F.get("_x", 2 * k + 1), res) - 1).alias("c1")))
    d = lines.where(F.size("_x") > 1).select(*keys, "row", F.filter(pairs, lambda p: p["c1"] >= p["c0"]).alias("_p"))
    # runs that touch are one: a start or end counts where the neighbour leaves a gap
    starts = F.filter("_p", lambda p, i: (i == 0) | (p["c0"] > F.get("_p", i - 1)["c1"] + 1))
    ends = F.filter("_p", lambda p, i: (i == F.size("_p") - 1) | (F.get("_p", i + 1)["c0"] > p["c1"] + 1))
    joined = F.zip_with(starts, ends, lambda p, q: F.struct(p["c0"].alias("c0"), q["c1"].alias("c1")))
    return d.where(F.size("_p") > 0).select(*keys, "row", F.explode(joined).alias("_r")).select(*keys, "row", "_r.*")


def eroded_runs(runs: DataFrame, keys: Sequence[str], by: int) -> DataFrame:
    """Runs of the pixels whose whole square of ``by`` pixels around lies in the polygon, as (keys, row, c0, c1).

    A run keeps its middle; a pixel row keeps what the ``2 by + 1`` rows around it all hold, which their ends tell, sorted along the row.
    """
    if by <= 0:
        return runs
    near = runs.where(F.col("c1") - F.col("c0") >= 2 * by).select(*keys, F.explode(F.sequence(F.col("row") - by, F.col("row") + by)).alias("row"), (F.col("c0") + by).alias("c0"), (F.col("c1") - by).alias("c1"))
    ends = F.array_sort(F.flatten(F.collect_list(F.array(F.struct(F.col("c0").alias("c"), F.lit(1).alias("s")), F.struct((F.col("c1") + 1).alias("c"), F.lit(-1).alias("s"))))))
    d = near.groupBy(*keys, "row").agg(F.count(F.lit(1)).alias("_n"), ends.alias("_e")).where(F.col("_n") > 2 * by)
    start = F.struct(F.lit(0).alias("deep"), F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<c0:bigint,c1:bigint>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        full = (a["deep"] == 2 * by + 1) & (e["c"] > a["at"])
        out = F.when(full, F.concat(a["out"], F.array(F.struct(a["at"].alias("c0"), (e["c"] - 1).alias("c1"))))).otherwise(a["out"])
        return F.struct((a["deep"] + e["s"]).alias("deep"), e["c"].cast("bigint").alias("at"), out.alias("out"))

    kept = F.aggregate("_e", start, step)["out"]
    return d.select(*keys, "row", F.explode(kept).alias("_p")).select(*keys, "row", "_p.*")


def _pixels(shapes: DataFrame, grid: Sequence[str], key: str, keep: Sequence[str], res: float, rings: str, erode_px: int) -> DataFrame:
    runs = eroded_runs(ring_runs(shapes, [*grid, key], res, rings), [*grid, key], erode_px)
    named = shapes.select(*grid, key, *keep).withColumnRenamed(key, "_key")
    d = runs.join(named.withColumnsRenamed({g: f"_{g}" for g in grid}), [F.col(key) == F.col("_key"), *[F.col(g).eqNullSafe(F.col(f"_{g}")) for g in grid]])
    return d.select(*grid, "row", F.explode(F.sequence("c0", "c1")).alias("col"), *keep)


def burn_rings(shapes: DataFrame, grid: Sequence[str], res: float, key: str, value: str, priority: str, rings: str = "rings", erode_px: int = 0) -> DataFrame:
    """(grid, row, col, value): where polygons overlap the highest priority wins, then the highest key.

    ``key`` is a unique id; polygons without one are left out. With ``erode_px`` only pixels that far inside are burned.
    """
    d = shapes.withColumns({"_rank": F.struct(priority, key), "_value": F.col(value)})
    px = _pixels(d, grid, key, ["_rank", "_value"], res, rings, erode_px)
    return px.groupBy(*grid, "row", "col").agg(F.max_by("_value", "_rank").alias(value))


def burn_rings_uncontested(shapes: DataFrame, grid: Sequence[str], res: float, key: str, value: str, rings: str = "rings", erode_px: int = 0) -> DataFrame:
    """As ``burn_rings``, but a pixel that polygons of two values claim is nodata."""
    px = _pixels(shapes.withColumn("_value", F.col(value)), grid, key, ["_value"], res, rings, erode_px)
    d = px.groupBy(*grid, "row", "col").agg(F.min("_value").alias(value), F.max("_value").alias("_z"))
    return d.where(F.col(value) == F.col("_z")).drop("_z")
