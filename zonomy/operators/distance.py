"""Exact Euclidean distance from every absent pixel to its nearest donor, one axis at a time.

First along columns: a tile learns from the first and last donors of the tiles above and below which donor is nearest in each
column, so a column is never in one task. Then along rows: what a tile found goes to the tiles beside it within the
radius, and the least of square column distance plus square row distance is the answer. A task holds one tile
and its neighbours in the row; nothing grows with the square of the radius.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from zonomy.session import cut_lineage

#: Least and largest side of a tile.
SMALL, LARGE = 128, 1024
NONE = np.int32(-(1 << 30))


def _tile_side(radius: float) -> int:
    return int(min(LARGE, max(SMALL, 2 ** math.ceil(math.log2(max(radius, 1))))))


def nearest_on_rows(found: np.ndarray, rows: np.ndarray, start: int, tile: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(square distance, donor row, donor column) for columns start .. start + tile - 1 of ``found``: per pixel row and column the nearest donor's row in that column.

    Ties go to the lowest donor row, then column; square distances beyond the radius are -1.
    """
    far = int(radius)
    padded = np.pad(found, ((0, 0), (far, far)), constant_values=NONE)
    up = np.where(padded == NONE, np.int64(1) << 40, (padded.astype(np.int64) - rows[:, None]) ** 2)
    # one number orders by distance, then by donor row
    order = (up << 22) + np.where(padded == NONE, 0, padded - rows[:, None] + (1 << 21))
    best = order[:, start + far:start + far + tile].copy()
    column = np.zeros(best.shape, np.int32)
    for d in range(1, far + 1):
        for shift in (-d, d):
            one = order[:, start + far + shift:start + far + shift + tile] + (np.int64(d * d) << 22)
            better = (one < best) | ((one == best) & (shift < column))
            best = np.where(better, one, best)
            column = np.where(better, np.int32(shift), column)
    square = best >> 22
    donor = (best & ((1 << 22) - 1)) - (1 << 21) + rows[:, None]
    return np.where(square <= radius * radius, square, -1), donor, column + np.arange(tile)[None, :]


def nearest_donors(pixels: DataFrame, grid: Sequence[str], grid_types: str, radius: float, height: int, width: int, donors: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """(grid, row, col, d2, drow, dcol): the nearest donor of every absent pixel within the radius, lowest row, then column on ties.

    The grid has ``height`` x ``width`` pixels; ``donors`` are the present pixels unless given. ``tile`` moves no result.
    Row distances must stay below 2^20.
    """
    side, far = tile or _tile_side(radius), int(radius)
    grid, at = list(grid), [*grid, "_ty", "_tx"]
    reach = -(-far // side)
    key = lambda d: d.select(*grid, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).withColumns({
        "_ty": F.floor(F.col("row") / side), "_tx": F.floor(F.col("col") / side)})
    here = key(pixels).withColumn("_present", F.lit(True))
    given = key(donors).withColumn("_present", F.lit(False)) if donors is not None else None
    source = given if given is not None else here
    # tiles that a donor reaches
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = source.select(*at).distinct().withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    inside = F.col("_ty").between(0, (height - 1) // side) & F.col("_tx").between(0, (width - 1) // side)
    tiles = cut_lineage(around.select(*grid, (F.col("_ty") + F.col("_dy")).alias("_ty"), (F.col("_tx") + F.col("_dx")).alias("_tx")).where(inside).distinct())
    # per column of a tile the last donor above and the first below, from the ends of the donors of each tile
    ends = source.groupBy(*at, "col").agg(F.min("row").alias("_first"), F.max("row").alias("_last"))
    lines = tiles.withColumn("col", F.explode(F.sequence(F.col("_tx") * side, F.least((F.col("_tx") + 1) * side, F.lit(width)) - 1)))
    lines = lines.join(ends, [*at, "col"], "left")
    w = Window.partitionBy(*grid, "col").orderBy("_ty")
    lines = lines.withColumns({"_above": F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_below": F.min("_first").over(w.rowsBetween(1, Window.unboundedFollowing))})
    blank = {"row": F.lit(None).cast("long"), "_present": F.lit(None).cast("boolean")}
    carried = lines.where(F.col("_above").isNotNull() | F.col("_below").isNotNull()).select(*at, "col", "_above", "_below").withColumns(blank)
    no = {"_above": F.lit(None).cast("long"), "_below": F.lit(None).cast("long")}
    rows = here if given is None else here.unionByName(given)
    wanted = tiles.withColumns({"col": F.lit(None).cast("long"), **no, **blank})
    everything = rows.withColumns(no).unionByName(carried).unionByName(wanted)
    own_donors = given is not None

    def columns(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(k[-2]) * side, int(k[-1]) * side
        px = pdf[pdf["row"].notna()]
        r, c, present = (px["row"] - r0).to_numpy(int), (px["col"] - c0).to_numpy(int), px["_present"].to_numpy(bool)
        mask = np.zeros((side, side), bool)
        mask[r[present], c[present]] = True
        above, below = np.full((side, side), NONE, np.int64), np.full((side, side), -int(NONE), np.int64)
        mine = ~present if own_donors else present
        above[r[mine], c[mine]] = below[r[mine], c[mine]] = r[mine] + r0
        more = pdf[pdf["_above"].notna()]
        cc = (more["col"] - c0).to_numpy(int)
        above[0, cc] = np.maximum(above[0, cc], more["_above"].to_numpy(np.int64))
        more = pdf[pdf["_below"].notna()]
        cc = (more["col"] - c0).to_numpy(int)
        below[-1, cc] = np.minimum(below[-1, cc], more["_below"].to_numpy(np.int64))
        above, below = np.maximum.accumulate(above, axis=0), np.minimum.accumulate(below[::-1], axis=0)[::-1]
        at_row = np.arange(r0, r0 + side)[:, None]
        nearest = np.where(at_row - above <= below - at_row, above, below)
        nearest = np.where(np.abs(nearest - at_row) <= far, nearest, NONE)
        return pd.DataFrame({**{g: [v] for g, v in zip(at, k)}, "_plane": [nearest.astype(np.int32).tobytes()], "_mask": [np.packbits(mask).tobytes()]})

    types = ", ".join(x for x in (grid_types, "_ty long, _tx long") if x)
    planes = everything.groupBy(*at).applyInPandas(columns, f"{types}, _plane binary, _mask binary")
    spread = planes.withColumn("_dx", F.explode(steps)).select(*grid, "_ty", (F.col("_tx") + F.col("_dx")).alias("_tx"), (-F.col("_dx")).alias("_from"), "_plane", F.when(F.col("_dx") == 0, F.col("_mask")).alias("_mask"))

    def across(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(k[-2]) * side, int(k[-1]) * side
        wide = np.full((side, (2 * reach + 1) * side), NONE, np.int32)
        mask = None
        for source_, plane, own in zip(pdf["_from"], pdf["_plane"], pdf["_mask"]):
            a = (int(source_) + reach) * side
            wide[:, a:a + side] = np.frombuffer(plane, np.int32).reshape(side, side)
            if own is not None:
                mask = np.unpackbits(np.frombuffer(own, np.uint8))[:side * side].reshape(side, side).astype(bool)
        empty = pd.DataFrame({c: [] for c in (*grid, "row", "col", "d2", "drow", "dcol")})
        if mask is None:
            return empty
        d2, row, col = nearest_on_rows(wide, np.arange(r0, r0 + side), reach * side, side, radius)
        i, j = np.nonzero((d2 >= 0) & ~mask)
        ok = (i + r0 < height) & (j + c0 < width)
        i, j = i[ok], j[ok]
        out = pd.DataFrame({"row": i + r0, "col": j + c0, "d2": d2[i, j], "drow": row[i, j], "dcol": col[i, j] + c0})
        for name, value in zip(grid, k):
            out[name] = value
        return out[[*grid, "row", "col", "d2", "drow", "dcol"]]

    heads = ", ".join(x for x in (grid_types, "row long, col long, d2 long, drow long, dcol long") if x)
    return spread.groupBy(*at).applyInPandas(across, heads)


def fill_far(pixels: DataFrame, grid: Sequence[str], grid_types: str, radius: float, height: int, width: int, value: str = "class", donors: DataFrame | None = None, tile: int | None = None) -> DataFrame:
    """Absent pixels take the value of their nearest donor within the radius; as ``pixels.fill_gaps``, for radii of any size."""
    near = nearest_donors(pixels, grid, grid_types, radius, height, width, donors, tile)
    source = (donors if donors is not None else pixels).select(*grid, F.col("row").cast("long").alias("drow"), F.col("col").cast("long").alias("dcol"), value)
    filled = near.join(source, [*grid, "drow", "dcol"]).select(*grid, "row", "col", value)
    return pixels.select(*grid, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value).unionByName(filled)
