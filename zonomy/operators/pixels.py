"""Operators on pixel tables: one row per pixel (grid columns, row, col, value), nodata absent.

Neighbourhood sums use two window passes, one along rows and one along columns, so each
pixel is shuffled twice instead of once per offset. Kernels wider than a few pixels work
on square tiles with a halo: a tile is a bounded group, whatever the size of the grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions import geometry as G
from zonomy.functions.common import N_CLASSES, packed_mode
from zonomy.operators.graph import pixel_regions

Grid = Sequence[str]
TASK_PIXELS = 1_000_000  # pixels of shapes aimed at in a task that burns them




# ── burning shapes ───────────────────────────────────────────────────────────


def burn(shapes: DataFrame, grid: Grid, res: float, value: str, priority: Column, b: str = "box", erode_px: int = 0,
         ring: str | None = None) -> DataFrame:
    """Pixels whose centre lies in a shape; where shapes overlap the highest priority wins.

    The shape is first shrunk by ``erode_px`` pixels. With ``ring`` given, the centre must also
    lie in the ring. Overlaps collapse in a ``max_by``, before and after the shuffle.
    """
    px = _met(shapes, grid, res, b, erode_px, ring)
    return px.groupBy(*grid, "row", "col").agg(F.max_by(value, priority).alias(value))


def _spans(shapes: DataFrame, res: float, b: str, erode_px: int) -> DataFrame:
    """Shapes that the shrinking leaves some extent, with the first and last row and column whose centres their boxes hold."""
    d = shapes.withColumn("_e", G.expand(F.col(b), -erode_px * res)).where((G.width(F.col("_e")) > 0) & (G.height(F.col("_e")) > 0))
    first = lambda v: F.ceil(v / res - 0.5)  # noqa: E731  centre (i + 0.5) res >= v
    last = lambda v: F.ceil(v / res - 0.5) - 1  # noqa: E731  centre < v
    return d.withColumns({"_r0": first(F.col("_e.miny")), "_r1": last(F.col("_e.maxy")), "_c0": first(F.col("_e.minx")), "_c1": last(F.col("_e.maxx"))}).drop("_e")


def _met(shapes: DataFrame, grid: Grid, res: float, b: str, erode_px: int, ring: str | None) -> DataFrame:
    """``_covered`` pixels, with all shapes of a pixel in one task. Tasks grow in number with the pixels of all shapes, before
    shapes become pixels and after, so neither a small file of large shapes nor the number of shuffle partitions sets their size."""
    side = lambda a, z: F.greatest(F.col(z) - F.col(a) + 1, F.lit(0))
    rows = _spans(shapes, res, b, erode_px).agg(F.sum(side("_r0", "_r1") * side("_c0", "_c1"))).head()[0] or 0
    tasks = max(1, math.ceil(rows / TASK_PIXELS))
    dealt = shapes.repartition(tasks) if tasks > 1 else shapes
    return _covered(dealt, res, b, erode_px, ring).repartition(tasks, *grid, "row", "col")


def _covered(shapes: DataFrame, res: float, b: str, erode_px: int, ring: str | None) -> DataFrame:
    d = _spans(shapes, res, b, erode_px)
    span = lambda a, z: F.when(F.col(z) >= F.col(a), F.sequence(a, z)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("row", F.explode(span("_r0", "_r1"))).withColumn("col", F.explode(span("_c0", "_c1"))).drop("_r0", "_r1", "_c0", "_c1")
    if ring:
        d = d.where(G.in_ring(F.col(ring), (F.col("col") + 0.5) * res, (F.col("row") + 0.5) * res))
    return d


def burn_uncontested(shapes: DataFrame, grid: Grid, res: float, value: str, priority: Column, b: str = "box",
                     erode_px: int = 0) -> DataFrame:
    """As ``burn``, but a pixel claimed by two different values becomes nodata."""
    px = _met(shapes, grid, res, b, erode_px, None)
    return (
        px.groupBy(*grid, "row", "col")
        .agg(F.max_by(value, priority).alias(value), F.min(value).alias("_a"), F.max(value).alias("_z"))
        .where(F.col("_a") == F.col("_z")).drop("_a", "_z")
    )


def evidence_bands(shapes: DataFrame, grid: Grid, res: float, band: str = "band", b: str = "box", building_bands: Sequence[int] | None = None) -> DataFrame:
    """Set of bands burned on each pixel, as a sorted list; a row exists where any band does. With ``building_bands`` also
    what ``compose_bands`` tells of them, from the same pass."""
    px = _met(shapes.select(*grid, F.col(band).alias("band"), b), grid, res, b, 0, None).groupBy(*grid, "row", "col")
    return px.agg(F.array_sort(F.collect_set("band")).alias("bands"), *(_composed(building_bands) if building_bands is not None else []))


# ── merging layers ───────────────────────────────────────────────────────────


def merge_layers(layers: Sequence[DataFrame], grid: Grid, value: str = "value") -> DataFrame:
    """One value per pixel, the last layer that has one wins."""
    out = None
    for i, layer in enumerate(layers):
        d = layer.select(*grid, "row", "col", value, F.lit(i).alias("layer"))
        out = d if out is None else out.unionByName(d)
    return pick_ranked(out, grid, F.col("layer"), [value, "layer"])


def pick_ranked(pixels: DataFrame, grid: Grid, rank: Column, keep: Sequence[str]) -> DataFrame:
    """The row of highest rank per pixel."""
    return pixels.groupBy(*grid, "row", "col").agg(F.max_by(F.struct(*keep), rank).alias("_v")).select(
        *grid, "row", "col", "_v.*")


def overlay_authority(voted: DataFrame, truth: DataFrame, grid: Grid, truth_confidence: float = 1.0) -> DataFrame:
    """Authoritative classes replace the voted label sets; source is 1 voted, 2 authoritative."""
    t = truth.select(*grid, "row", "col", F.col("class").alias("_t"))
    j = voted.join(t, [*grid, "row", "col"], "full")
    has = F.col("_t").isNotNull()
    return j.select(
        *grid, "row", "col",
        F.when(has, F.pow(F.lit(2.0), F.col("_t") - 1).cast("long")).otherwise(F.col("bitmask")).alias("bitmask"),
        F.when(has, F.lit(truth_confidence)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(has, 2).otherwise(1).alias("source"),
        F.coalesce("n_eff", F.lit(0.0)).alias("n_eff"))


def fuse_teacher(teacher: DataFrame, truth: DataFrame, held_out: DataFrame, grid: Grid, min_conf: float) -> DataFrame:
    """Teacher pixels at or above a confidence, without the held-out pixels, overlaid with the truth."""
    at = [*grid, "row", "col"]
    t = teacher.where(F.col("confidence") >= min_conf).join(held_out.select(*at), at, "left_anti")
    g = truth.select(*at, F.col("class").alias("_g"))
    return t.select(*at, "class").join(g, at, "full").select(*at, F.coalesce("_g", "class").alias("class"))


def rank_by_size(pixels: DataFrame, grid: Grid, source: str) -> DataFrame:
    """Adds the pixel count of each source of a grid, for merges where the largest source comes first."""
    n = pixels.groupBy(*grid, source).agg(F.count(F.lit(1)).alias("source_px"))
    return pixels.join(n, [*grid, source])


def merge_sources(pixels: DataFrame, grid: Grid, source: str, value: str) -> DataFrame:
    """Hole-filling merge: the source with most pixels first, others only where it has none."""
    d = rank_by_size(pixels, grid, source)
    return pick_ranked(d, grid, F.struct(F.col("source_px"), F.col(source)), [value, source])


def mosaic_vectors(tiles: DataFrame, grid: Grid, rank: str, vector: str = "v") -> DataFrame:
    """Latest covering tile wins per pixel; an all-zero vector counts as uncovered."""
    live = tiles.where(F.exists(vector, lambda x: x != 0))
    return pick_ranked(live, grid, F.col(rank), [vector, rank])


def to_common_grid(tiles: DataFrame, res: float, origin: tuple[float, float], out_res: float | None = None) -> DataFrame:
    """Tile-local row and column to indices of a shared grid (tiles carry minx, maxy, row, col).

    ``origin`` is the upper-left corner of the shared grid; the pixel centre decides the cell.
    """
    x = F.col("minx") + (F.col("col") + 0.5) * res
    y = F.col("maxy") - (F.col("row") + 0.5) * res
    step = out_res or res
    return tiles.withColumns({
        "col": F.floor((x - origin[0]) / step), "row": F.floor((F.lit(origin[1]) - y) / step)}).drop("minx", "maxy")


def compose_bands(bands: DataFrame, grid: Grid, building_bands: Sequence[int]) -> DataFrame:
    """Index of the last band present per pixel, and whether any building band is."""
    return bands.groupBy(*grid, "row", "col").agg(*_composed(building_bands))


def _composed(building_bands: Sequence[int]) -> list[Column]:
    return [F.max("band").alias("band"), F.max(F.col("band").isin(*building_bands)).alias("building")]


# ── pooling ──────────────────────────────────────────────────────────────────


def block_key(factor: int) -> list[Column]:
    return [F.floor(F.col("row") / factor).alias("brow"), F.floor(F.col("col") / factor).alias("bcol")]


def _inside(factor: int, height: int | None, width: int | None) -> Column:
    ok = F.lit(True)
    if height is not None:
        ok = ok & (F.col("row") < height // factor * factor)
    if width is not None:
        ok = ok & (F.col("col") < width // factor * factor)
    return ok


def majority_pool(pixels: DataFrame, grid: Grid, factor: int, value: str = "class", height: int | None = None,
                  width: int | None = None) -> DataFrame:
    """Most frequent value per block, lowest on ties; ragged edge blocks are dropped when the size is known."""
    c = pixels.where(_inside(factor, height, width)).groupBy(*grid, *block_key(factor), value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*grid, "brow", "bcol").agg(packed_mode(value, "n").alias(value), F.sum("n").alias("n_valid"))


def mean_pool(pixels: DataFrame, grid: Grid, factor: int, value: str = "value", height: int | None = None,
              width: int | None = None) -> DataFrame:
    return pixels.where(_inside(factor, height, width)).groupBy(*grid, *block_key(factor)).agg(F.avg(value).alias(value))


def pool_class_volume(probs: DataFrame, grid: Grid, factor: int, how: str = "soft", min_coverage: float = 0.5) -> DataFrame:
    """Per-pixel class probabilities (array) pooled to cells: class, its mean mass, coverage.

    ``soft`` sums probabilities, ``majority`` counts the per-pixel winner.
    """
    arr = F.col("probs")
    if how == "majority":
        best = F.array_position(arr, F.array_max(arr))
        arr = F.transform(F.sequence(F.lit(1), F.lit(N_CLASSES)), lambda c: (c == best).cast("double"))
    p = probs.withColumn("_a", arr)
    sums = F.array(*[F.sum(F.get("_a", F.lit(i))) for i in range(N_CLASSES)])
    cell = p.groupBy(*grid, *block_key(factor)).agg(F.count(F.lit(1)).alias("n"), sums.alias("_s"))
    top = F.array_max("_s")
    return cell.select(
        *grid, "brow", "bcol", F.array_position("_s", top).cast("int").alias("class"), (top / F.col("n")).alias("confidence"),
        (F.col("n") / float(factor * factor)).alias("coverage")).where(F.col("coverage") >= min_coverage)


def window_vote(windows: DataFrame, grid: Grid, stride_cols: Sequence[str] = (), taper: bool = False) -> DataFrame:
    """Overlapping window predictions spread over their pixels, summed and renormalised.

    ``windows`` has row0, col0, size and probs. With ``taper`` each pixel counts by a raised
    cosine of its place in the window.
    """
    d = windows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    hann = lambda k: F.greatest(0.5 - 0.5 * F.cos(2 * math.pi * k / (F.col("size") - 1)), F.lit(1e-3))
    w = hann(F.col("_i")) * hann(F.col("_j")) if taper else F.lit(1.0)
    d = d.select(*grid, (F.col("row0") + F.col("_i")).alias("row"), (F.col("col0") + F.col("_j")).alias("col"), w.alias("_w"), "probs")
    s = F.array(*[F.sum(F.get("probs", F.lit(i)) * F.col("_w")) for i in range(N_CLASSES)])
    d = d.groupBy(*grid, "row", "col").agg(s.alias("_s"))
    total = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)
    return d.select(*grid, "row", "col", F.transform("_s", lambda x: x / total).alias("probs"))


# ── neighbourhoods ───────────────────────────────────────────────────────────


def _near(radius_lo: int, radius_hi: int, grid: Grid, along: str, across: str):
    return Window.partitionBy(*grid, across).orderBy(along).rangeBetween(-radius_lo, radius_hi)


def interior(pixels: DataFrame, grid: Grid, value: str, radius: int, height: int, width: int) -> DataFrame:
    """Adds ``interior``: every in-grid pixel within the Chebyshev radius is present with the same value."""
    across = _near(radius, radius, grid, "col", "row")
    down = _near(radius, radius, grid, "row", "col")
    d = pixels.withColumns({
        "_lo": F.min(value).over(across), "_hi": F.max(value).over(across), "_n": F.count(F.lit(1)).over(across)})
    d = d.withColumns({"_lo": F.min("_lo").over(down), "_hi": F.max("_hi").over(down), "_n": F.sum("_n").over(down)})
    size = lambda c, n: F.least(c + radius, F.lit(n - 1)) - F.greatest(c - radius, F.lit(0)) + 1
    want = size(F.col("row"), height) * size(F.col("col"), width)
    return d.withColumn("interior", (F.col("_lo") == F.col("_hi")) & (F.col("_n") == want)).drop("_lo", "_hi", "_n")


def erosion_valid(pixels: DataFrame, grid: Grid, height: int, width: int, radius: int = 1, min_conf: float = 0.0) -> DataFrame:
    """Labelled pixels inside their block and confident enough (block, bitmask, confidence)."""
    d = interior(pixels, grid, "block", radius, height, width)
    ok = F.col("interior") & (F.col("bitmask") != 0)
    if min_conf > 0:
        ok = ok & (F.col("confidence") >= min_conf)
    return d.where(ok).drop("interior")


def survival_share(pixels: DataFrame, grid: Grid, value: str, height: int, width: int) -> DataFrame:
    """Per value: share of its pixels whose whole 3 x 3 neighbourhood has the same value.

    Pixels on the rim of the grid never survive, as outside counts as background.
    """
    d = interior(pixels, grid, value, 1, height, width)
    rim = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    return d.groupBy(*grid, value).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("interior") & ~rim).cast("double")).alias("interior_share"))


def densify(pixels: DataFrame, grids: DataFrame, grid: Grid, value: str, height: int, width: int) -> DataFrame:
    """Every pixel of each grid, with 0 where the table has none."""
    line = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    full = grids.select(*grid).withColumn("row", line(height)).withColumn("col", line(width))
    j = full.join(pixels.select(*grid, "row", "col", value), [*grid, "row", "col"], "left")
    return j.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(0.0)))


def box_mean(dense: DataFrame, grid: Grid, value: str, window: int, height: int, width: int) -> DataFrame:
    """Moving window mean with the edge pixel repeated outside, as two one-dimensional passes."""
    lo, hi = window // 2, window - 1 - window // 2

    def one(d: DataFrame, along: str, across: str, n: int) -> DataFrame:
        near = _near(lo, hi, grid, along, across)
        whole = Window.partitionBy(*grid, across).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        left = F.greatest(F.lit(lo) - F.col(along), F.lit(0))
        right = F.greatest(F.col(along) + hi - (n - 1), F.lit(0))
        total = F.sum(value).over(near) + left * F.first(value).over(whole) + right * F.last(value).over(whole)
        return d.withColumn("_m", total / float(window)).drop(value).withColumnRenamed("_m", value)

    return one(one(dense, "col", "row", width), "row", "col", height)


def density_bins(dense: DataFrame, grid: Grid, value: str, window: int, height: int, width: int, t_open: float = 0.2,
                 t_compact: float = 0.4) -> DataFrame:
    """0 sparse, 1 open, 2 compact by the share of building pixels around each pixel."""
    m = box_mean(dense, grid, value, window, height, width)
    return m.withColumn("bin", F.when(F.col(value) >= t_compact, 2).when(F.col(value) >= t_open, 1).otherwise(0))


# ── filling ──────────────────────────────────────────────────────────────────


def _rim(pixels: DataFrame, grid: Grid) -> DataFrame:
    """Pixels with at least one absent neighbour among the eight (the grid edge counts as absent)."""
    d = pixels.withColumn("_n", F.count(F.lit(1)).over(_near(1, 1, grid, "col", "row")))
    d = d.withColumn("_n", F.sum("_n").over(_near(1, 1, grid, "row", "col")))
    return d.where(F.col("_n") < 9).drop("_n")


def _offsets(radius: float, eight: bool = False) -> Column:
    r = int(math.floor(radius))
    cells = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1)
             if (i, j) != (0, 0) and (eight or i * i + j * j <= radius * radius)]
    return F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc"), F.lit(i * i + j * j).alias("d2")) for i, j in cells])


def _gap_candidates(donors: DataFrame, present: DataFrame, grid: Grid, radius: float, height: int, width: int,
                    keep: Sequence[str], eight: bool = False) -> DataFrame:
    """Absent in-grid pixels within the radius of a donor, one row per (gap, donor). Only rim donors are spread."""
    at = [*grid, "row", "col"]
    d = _rim(donors, grid).withColumn("_o", F.explode(_offsets(radius, eight)))
    d = d.select(
        *grid, (F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"),
        F.struct(F.col("_o.d2").alias("d2"), F.col("row").alias("r"), F.col("col").alias("c")).alias("near"), *keep)
    d = d.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return d.join(present.select(*at), at, "left_anti")


def fill_gaps(pixels: DataFrame, grid: Grid, radius: float, height: int, width: int, value: str = "class",
              donors: DataFrame | None = None) -> DataFrame:
    """Absent pixels take the value of the nearest donor within the radius (lowest row, then column, on ties)."""
    d = _gap_candidates(donors if donors is not None else pixels, pixels, grid, radius, height, width, [value])
    filled = d.groupBy(*grid, "row", "col").agg(F.min_by(value, "near").alias(value))
    return pixels.select(*grid, "row", "col", value).unionByName(filled)


def seam_fill(pixels: DataFrame, grid: Grid, height: int, width: int, value: str = "class", min_neighbours: int = 6) -> DataFrame:
    """Absent pixels with enough of their eight neighbours present take the most frequent of them (lowest on ties)."""
    d = _gap_candidates(pixels, pixels, grid, 1, height, width, [value], eight=True)
    c = d.groupBy(*grid, "row", "col", value).agg(F.count(F.lit(1)).alias("n"))
    f = c.groupBy(*grid, "row", "col").agg(F.sum("n").alias("_t"), packed_mode(value, "n").alias(value)).where(F.col("_t") >= min_neighbours)
    return pixels.select(*grid, "row", "col", value).unionByName(f.drop("_t"))


def repair_seams(pixels: DataFrame, grid: Grid, height: int, width: int, value: str = "class", max_dist: int = 2) -> DataFrame:
    """Fill gaps that are narrow everywhere; wide gaps stay untouched, their rim included.

    A gap pixel within ``max_dist`` of a present one is a rim pixel. A connected set of rim
    pixels belongs to a wide gap exactly when it touches an absent pixel that is not rim, so
    the deep part of a wide gap is never generated.
    """
    at = [*grid, "row", "col"]
    cand = _gap_candidates(pixels, pixels, grid, max_dist, height, width, [value])
    rim = cand.groupBy(*at).agg(F.min_by(value, "near").alias(value))
    runs = pixel_regions(rim.withColumn("_v", F.lit(1)), grid, "_v")
    px = runs.withColumn("col", F.explode(F.sequence("c0", "c1"))).select(*at, "region")
    step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    around = px.withColumn("_s", F.explode(step)).select(
        *grid, (F.col("row") + F.col("_s.i")).alias("row"), (F.col("col") + F.col("_s.j")).alias("col"), "region")
    around = around.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    known = pixels.select(*at).unionByName(rim.select(*at))
    wide = around.join(known, at, "left_anti").select("region").distinct()
    narrow = px.join(wide, "region", "left_anti")
    return pixels.select(*at, value).unionByName(rim.join(narrow.select(*at), at))


# ── kernels on tiles with a halo ─────────────────────────────────────────────


def on_tiles(pixels: DataFrame, grid: Grid, tile: int, halo: int, fn: Callable[[pd.DataFrame, int, int], pd.DataFrame],
             schema: str) -> DataFrame:
    """Run ``fn(pixels of tile and halo, first row, first col)`` on every tile; bounded groups."""
    lo = lambda c: F.floor((F.col(c) - halo) / tile)
    hi = lambda c: F.floor((F.col(c) + halo) / tile)
    d = pixels.withColumn("_ty", F.explode(F.sequence(lo("row"), hi("row")))).withColumn(
        "_tx", F.explode(F.sequence(lo("col"), hi("col"))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf, int(key[-2]) * tile, int(key[-1]) * tile)
        for name, value in zip(grid, key):
            out[name] = value
        return out[[f.split()[0] for f in schema.split(", ")]]

    return d.groupBy(*grid, "_ty", "_tx").applyInPandas(run, schema)


def _kernel(sigma_px: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma_px + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma_px) ** 2)
    return w / w.sum()


def _smooth(plane: np.ndarray, k: np.ndarray) -> np.ndarray:
    r = len(k) // 2
    padded = np.pad(plane, r)
    rows = np.lib.stride_tricks.sliding_window_view(padded, len(k), axis=0) @ k
    return np.lib.stride_tricks.sliding_window_view(rows, len(k), axis=1) @ k


def gaussian_filter(pixels: DataFrame, grid: Grid, grid_types: str, sigma_px: dict[int, float], height: int, width: int,
                    value: str = "class", factor: int = 1, min_coverage: float = 0.5, tile: int = 256) -> DataFrame:
    """Per-class Gaussian smoothing of class masks and the strongest class per pixel or block.

    Kernels end at four deviations; outside the grid counts as empty. A cell with less than
    ``min_coverage`` present pixels stays nodata. ``tile`` must be a multiple of ``factor``.
    """
    if tile % factor:
        raise ValueError("tile must be a multiple of factor")
    kernels = {c: _kernel(s) for c, s in sigma_px.items()}
    halo = max(len(k) // 2 for k in kernels.values())

    def run(pdf: pd.DataFrame, r0: int, c0: int) -> pd.DataFrame:
        side = tile + 2 * halo
        rr, cc = pdf["row"].to_numpy() - r0 + halo, pdf["col"].to_numpy() - c0 + halo
        cls = pdf[value].to_numpy()
        core = slice(halo, halo + tile)
        valid = np.zeros((side, side))
        valid[rr, cc] = 1.0
        classes = sorted(set(cls.tolist()))
        best = np.full((tile // factor, tile // factor), -1.0)
        arg = np.zeros(best.shape, dtype=np.int32)
        pool = lambda a: a.reshape(tile // factor, factor, tile // factor, factor).mean(axis=(1, 3))
        for c in classes:
            plane = np.zeros((side, side))
            m = cls == c
            plane[rr[m], cc[m]] = 1.0
            score = pool(_smooth(plane, kernels[c])[core, core])
            better = score > best + 1e-12
            arg[better], best[better] = c, score[better]
        cover = pool(valid[core, core])
        n_rows, n_cols = height // factor, width // factor
        i, j = np.nonzero((cover >= min_coverage) & (arg > 0))
        row, colm = i + r0 // factor, j + c0 // factor
        ok = (row >= 0) & (colm >= 0) & (row < n_rows) & (colm < n_cols)
        return pd.DataFrame({"row": row[ok].astype("int64"), "col": colm[ok].astype("int64"), value: arg[i, j][ok]})

    return on_tiles(pixels, grid, tile, halo, run, f"{grid_types}, row long, col long, {value} int")


# ── crops and resampling ─────────────────────────────────────────────────────


def block_side(windows: DataFrame, h: Column, w: Column, least: int = 8, most: int = 256) -> int:
    """Side of the pixel blocks by which windows meet pixels: the power of two next to their mean side."""
    side = windows.agg(F.avg((h + w) / 2)).first()[0]
    return int(min(most, max(least, 2 ** math.ceil(math.log2(max(float(side or 1), 1.0))))))


def crop(pixels: DataFrame, shapes: DataFrame, grid: Grid, key: str, block: int | None = None) -> DataFrame:
    """Pixels of each window (r0, c0, h, w), with window-local row and column; blocks are about as large as a window."""
    block = block or block_side(shapes, F.col("h"), F.col("w"))
    s = shapes.select(*grid, key, "r0", "c0", "h", "w")
    for a, o, n in (("_br", "r0", "h"), ("_bc", "c0", "w")):
        s = s.withColumn(a, F.explode(F.sequence(F.floor(F.col(o) / block), F.floor((F.col(o) + F.col(n) - 1) / block))))
    p = pixels.withColumn("_br", F.floor(F.col("row") / block)).withColumn("_bc", F.floor(F.col("col") / block))
    inside = F.col("row").between(F.col("r0"), F.col("r0") + F.col("h") - 1) & F.col("col").between(F.col("c0"), F.col("c0") + F.col("w") - 1)
    d = p.join(s, [*grid, "_br", "_bc"]).where(inside)
    return d.withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")}).drop("_br", "_bc", "r0", "c0")


def crop_report(cropped: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """Pixels found per window, the extent they reach and whether the window is truncated."""
    c = cropped.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), (F.max("row") - F.min("row") + 1).alias("got_h"), (F.max("col") - F.min("col") + 1).alias("got_w"))
    d = shapes.select(key, "h", "w").join(c, key, "left").fillna(0, subset=["n", "got_h", "got_w"])
    return d.withColumn("truncated", (F.col("got_h") < F.col("h")) | (F.col("got_w") < F.col("w")))


def resample_nearest(cropped: DataFrame, key: str, out_h: int, out_w: int, value: str = "value") -> DataFrame:
    """Windows brought to a given shape by nearest index: output i reads source floor((i + 0.5) h / H).

    Every source pixel is told which output rows and columns read it, so no dense grid is joined.
    """
    def readers(c: str, n: str, out: int) -> Column:
        first = F.ceil(F.col(c) * out / F.col(n) - 0.5)
        last = F.ceil((F.col(c) + 1) * out / F.col(n) - 0.5) - 1
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    d = cropped.withColumn("_r", F.explode(readers("row", "h", out_h))).withColumn("_c", F.explode(readers("col", "w", out_w)))
    return d.select(key, F.col("_r").alias("row"), F.col("_c").alias("col"), value)


def tiles_with_enough(pixels: DataFrame, grid: Grid, tile: int, min_pixels: int) -> DataFrame:
    """Pixels labelled with their tile, tiles below the pixel floor dropped."""
    d = pixels.withColumns({"ty": F.floor(F.col("row") / tile), "tx": F.floor(F.col("col") / tile)})
    n = d.groupBy(*grid, "ty", "tx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pixels)
    return d.join(n, [*grid, "ty", "tx"])


def window_stats(pixels: DataFrame, candidates: DataFrame, grid: Grid, key: str, half_px: int, height: int, width: int,
                 value: str = "class", prob: str = "confidence") -> DataFrame:
    """Majority class (lowest on ties), its share of the valid pixels and their mean probability in
    the square window around each candidate; edge pixels stand in for those outside the grid."""
    s = candidates.select(*grid, key, (F.col("row") - half_px).alias("r0"), (F.col("col") - half_px).alias("c0"),
                          F.lit(2 * half_px + 1).alias("h"), F.lit(2 * half_px + 1).alias("w"))
    block = max(8, 2 ** math.ceil(math.log2(2 * half_px + 1)))
    c = crop(pixels.withColumns({"_row": F.col("row"), "_col": F.col("col")}), s, grid, key, block)

    def times(local: str, at: str, n: int) -> Column:
        # local index of an edge pixel = how many window lines fall before (or after) it
        low = F.when(F.col(at) == 0, F.col(local)).otherwise(0)
        high = F.when(F.col(at) == n - 1, F.lit(2 * half_px) - F.col(local)).otherwise(0)
        return 1 + low + high

    m = times("row", "_row", height) * times("col", "_col", width)
    per = c.withColumn("_m", m).groupBy(key, value).agg(F.sum("_m").alias("n"), F.sum(F.col(prob) * F.col("_m")).alias("_p"))
    return per.groupBy(key).agg(
        F.sum("n").alias("n_valid"), packed_mode(value, "n").alias(value), (F.max("n") / F.sum("n")).alias("purity"),
        (F.sum("_p") / F.sum("n")).alias("mean_prob"))


def combine_aux(layers: dict[str, tuple[DataFrame, float]], grid: Grid) -> DataFrame:
    """Aligned auxiliary layers as columns, each scaled by a fixed divisor; absent or non-finite becomes 0."""
    at, out = [*grid, "row", "col"], None
    for name, (d, divisor) in layers.items():
        one = d.select(*at, (F.col("value") / divisor).alias(name))
        out = one if out is None else out.join(one, at, "full")
    ok = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), 0.0).otherwise(F.col(c))
    return out.select(*at, *[ok(n).alias(n) for n in layers])


# ── threshold classifiers ────────────────────────────────────────────────────


def _positive(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (x > 0)


def presence_class(x: Column, threshold: float, cls: int) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= threshold), cls)


def height_tiers(x: Column, cuts: Sequence[tuple[float, int]]) -> Column:
    """Class of the highest cut that a positive finite value reaches."""
    out = F.lit(None).cast("int")
    for low, cls in sorted(cuts):
        out = F.when(_positive(x) & (x >= low), cls).otherwise(out)
    return out
