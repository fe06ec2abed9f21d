"""Lattices, patch placement and split cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions import geometry as G
from zonomy.functions.common import packed_mode, stable_fraction
from zonomy.operators.spatial import box_join


def lattice(boxes: DataFrame, side: float, b: str = "box") -> DataFrame:
    """Squares of ``side`` anchored at the lower-left corner of each box, with a row-major padded id."""
    w, h = G.width(F.col(b)), G.height(F.col(b))
    nx, ny = F.greatest(F.ceil(w / side), F.lit(1)), F.greatest(F.ceil(h / side), F.lit(1))
    d = boxes.withColumn("_nx", nx).withColumn("_iy", F.explode(F.sequence(F.lit(0).cast("long"), ny - 1)))
    d = d.withColumn("_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nx") - 1)))
    x, y = F.col(f"{b}.minx") + F.col("_ix") * side, F.col(f"{b}.miny") + F.col("_iy") * side
    pid = F.format_string("%07d", F.col("_iy") * F.col("_nx") + F.col("_ix"))
    return d.withColumn("patch_id", pid).withColumn("patch", G.box(x, y, x + side, y + side)).drop("_nx", "_ix", "_iy")


def snapped_cells(shapes: DataFrame, side: float, min_area: float = 0.0, b: str = "box") -> DataFrame:
    """Large shapes cut along a lattice snapped to multiples of ``side``; pieces keep positive area."""
    box_ = F.col(b)
    d = shapes.where(G.area(box_) > min_area)
    d = d.withColumn("_ix", F.explode(F.sequence(F.floor(box_["minx"] / side), F.ceil(box_["maxx"] / side) - 1)))
    d = d.withColumn("_iy", F.explode(F.sequence(F.floor(box_["miny"] / side), F.ceil(box_["maxy"] / side) - 1)))
    x, y = F.col("_ix") * side, F.col("_iy") * side
    piece = G.intersection(box_, G.box(x, y, x + side, y + side))
    return d.withColumn("piece", piece).where(G.area(F.col("piece")) > 0)


def snapped_grid(boxes: DataFrame, keys: Sequence[str], res: float, halo: float = 0.0, b: str = "box") -> DataFrame:
    """One grid per group: bounds with a halo snapped outward to the resolution, rows and columns."""
    box_ = F.col(b)
    g = boxes.groupBy(*keys).agg(
        (F.min(box_["minx"]) - halo).alias("_x0"), (F.min(box_["miny"]) - halo).alias("_y0"),
        (F.max(box_["maxx"]) + halo).alias("_x1"), (F.max(box_["maxy"]) + halo).alias("_y1"))
    r = F.lit(float(res))
    low, high = (lambda c: F.floor(F.col(c) / r)), (lambda c: F.ceil(F.col(c) / r))
    return g.select(*keys, r.alias("res"), (low("_x0") * r).alias("minx"), (high("_y1") * r).alias("maxy"),
                    (high("_x1") - low("_x0")).cast("long").alias("width"), (high("_y1") - low("_y0")).cast("long").alias("height"))


# Split of a cell by its place in the 3 x 3 macro block, top row first.
MACRO_PATTERN = (("train", "test", "train"), ("train", "train", "train"), ("train", "val", "train"))


def macro_split(ix: Column, iy: Column, pattern: Sequence[Sequence[str]] = MACRO_PATTERN) -> Column:
    """Split of lattice cell (ix, iy), both counted from the lower-left corner."""
    n = len(pattern)
    flat = [p for row in reversed(pattern) for p in row]
    return F.get(F.array(*map(F.lit, flat)), (F.pmod(iy, F.lit(n)) * n + F.pmod(ix, F.lit(n))).cast("int"))


def split_cells(points: DataFrame, origin: tuple[Column, Column], side: float, x: str = "x", y: str = "y") -> DataFrame:
    """Cell indices and macro split of every point: index arithmetic, no join with a grid."""
    ix, iy = F.floor((F.col(x) - origin[0]) / side), F.floor((F.col(y) - origin[1]) / side)
    return points.withColumns({"ix": ix, "iy": iy}).withColumn("split", macro_split(F.col("ix"), F.col("iy")))


def random_split(key: Column, shares: dict[str, float], salt: str = "split") -> Column:
    """Split by hash thresholds, so the same key always lands in the same split."""
    u, edge, out = stable_fraction(key, salt), 0.0, None
    for name, share in shares.items():
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(list(shares)[-1])


def valid_cell(coverage: Column, low: float = 0.02, high: float = 0.95) -> Column:
    return coverage.between(low, high)


def place_squares(shapes: DataFrame, side: float, key: str = "shape_id", cap: int | None = 4, b: str = "box") -> DataFrame:
    """Origin-aligned squares fully inside each shape, the ``cap`` nearest its centre.

    A shape wide enough for a square but missing every lattice square gets one around its
    centre. The candidates of a shape are filtered, ordered and cut inside one array, so
    nothing is shuffled.
    """
    box_ = F.col(b)
    cx, cy = G.centre(box_)
    lo = lambda v: F.ceil(v / side)
    hi = lambda v: F.floor(v / side) - 1
    span = lambda a, z: F.when(z >= a, F.sequence(a, z)).otherwise(F.array().cast("array<bigint>"))
    xs, ys = span(lo(box_["minx"]), hi(box_["maxx"])), span(lo(box_["miny"]), hi(box_["maxy"]))

    def square(i: Column, j: Column) -> Column:
        mx, my = (i + 0.5) * side, (j + 0.5) * side
        d = (mx - cx) * (mx - cx) + (my - cy) * (my - cy)
        return F.struct(d.alias("d"), mx.alias("x"), my.alias("y"))

    grid = F.array_sort(F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: square(i, j)))))
    if cap:
        grid = F.slice(grid, 1, cap)
    lone = F.array(F.struct(F.lit(0.0).alias("d"), cx.alias("x"), cy.alias("y")))
    picks = F.when(F.size(grid) > 0, grid).when(
        (G.width(box_) > side) & (G.height(box_) > side), lone).otherwise(F.slice(lone, 1, 0))
    h = side / 2
    d = shapes.withColumn("_q", F.explode(picks))
    return d.withColumn("square", G.box(F.col("_q.x") - h, F.col("_q.y") - h, F.col("_q.x") + h, F.col("_q.y") + h)).drop("_q")


def relaxed_squares(shapes: DataFrame, side: float, cell: float, key: str = "shape_id", min_own: float = 0.6,
                    max_other: float = 0.1, cap: int = 4, strip: float = 64.0) -> DataFrame:
    """Lattice squares mostly covered by one class, for shapes that hold no whole square.

    ``shapes`` needs key, class, weight, qc_pass and box. Own cover counts passing shapes of
    the class; other cover counts every shape, summed over the classes.
    """
    from zonomy.operators.spatial import covered_area

    small = shapes.where(F.col("qc_pass") & ~G.fits_square(F.col("box"), side))
    b = F.col("box")
    cand = small.select(
        key, "class", "weight", "box",
        F.explode(F.sequence(F.floor(b["minx"] / side), F.floor(b["maxx"] / side))).alias("ix"), )
    cand = cand.withColumn("iy", F.explode(F.sequence(F.floor(b["miny"] / side), F.floor(b["maxy"] / side))))
    sq = G.box(F.col("ix") * side, F.col("iy") * side, (F.col("ix") + 1) * side, (F.col("iy") + 1) * side)
    cand = cand.withColumn("lbox", sq).withColumn("mine", G.shared_area(F.col("lbox"), b) / side**2)
    squares = cand.select("ix", "iy", "lbox").distinct().withColumn("sq", F.concat_ws(":", "ix", "iy"))
    own_src = shapes.where("qc_pass").select(F.col("class").alias("_c"), F.col("box").alias("rbox"))
    own = covered_area(squares, own_src, cell, "sq", strip, keys=("_c",)).withColumnRenamed("covered", "own")
    all_src = shapes.select(F.col("class").alias("_c"), F.col("box").alias("rbox"))
    claims = covered_area(squares, all_src, cell, "sq", strip, keys=("_c",))
    total = claims.groupBy("sq").agg(F.sum("covered").alias("_all"))
    area = side * side
    d = cand.withColumn("sq", F.concat_ws(":", "ix", "iy")).withColumn("_c", F.col("class"))
    # sizes that Spark expects of candidates and covers do not know of the squares that a shape reaches, so none is broadcast
    d = d.join(own.hint("merge"), ["sq", "_c"]).join(claims.withColumnRenamed("covered", "_same").hint("merge"), ["sq", "_c"]).join(total.hint("merge"), "sq")
    d = d.withColumns({"dominant_frac": F.col("own") / area, "other_frac": (F.col("_all") - F.col("_same")) / area})
    d = d.where((F.col("dominant_frac") >= min_own) & (F.col("other_frac") <= max_other))
    w = Window.partitionBy(key).orderBy(F.desc("mine"), "ix", "iy")
    d = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap)
    # one square may be claimed by several shapes of the class: the lowest key keeps it
    keep = F.min(F.struct(F.col(key), "class", "weight", "dominant_frac", "other_frac")).alias("_k")
    return d.groupBy("ix", "iy").agg(keep).select(
        "ix", "iy", "_k.*").withColumn("weight", F.col("weight") * F.col("dominant_frac"))


def without_shared_ground(rows: DataFrame, strict: DataFrame, cell: float, key: str) -> DataFrame:
    """Rows whose lbox shares no area with any strict square (rbox)."""
    hit = box_join(rows.select(key, "lbox"), strict.select("rbox"), cell).select(key).distinct()
    return rows.join(hit, key, "left_anti")


def evenly_spaced(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Every row of groups with at most k rows, else the k rows at positions floor(i n / k)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    pos = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    d = df.withColumn("_n", n).withColumn("_p", pos)
    # position p is picked when some i has floor(i n / k) = p
    i = F.ceil(F.col("_p") * F.lit(k) / F.col("_n"))
    hit = (i < k) & (F.floor(i * F.col("_n") / F.lit(k)) == F.col("_p"))
    return d.where((F.col("_n") <= k) | hit).drop("_n", "_p")


def region_patches(pixels: DataFrame, side_px: int, min_dominant: float = 0.75, min_labelled: float = 0.5,
                   max_per_region: int = 4) -> DataFrame:
    """Lattice windows hit by each region, spread evenly, kept when well labelled and pure.

    ``pixels`` has aoi, row, col, region, class (0 when not a single class) and confidence.
    """
    gy, gx = F.floor(F.col("row") / side_px).alias("gy"), F.floor(F.col("col") / side_px).alias("gx")
    cells = pixels.where(F.col("region").isNotNull()).select("aoi", "region", gy, gx).distinct()
    picked = evenly_spaced(cells, ["aoi", "region"], ["gy", "gx"], max_per_region).select("aoi", "gy", "gx").distinct()
    win = pixels.where(F.col("class") > 0).groupBy("aoi", gy, gx, "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    stats = win.groupBy("aoi", "gy", "gx").agg(
        F.sum("n").alias("labelled"), F.max("n").alias("top"), packed_mode("class", "n").alias("class"),
        (F.sum("c") / F.sum("n")).alias("weight"))
    d = stats.join(picked, ["aoi", "gy", "gx"], "left_semi")
    d = d.withColumns({"labelled_frac": F.col("labelled") / float(side_px**2), "dominant_frac": F.col("top") / F.col("labelled")})
    return d.where((F.col("labelled_frac") >= min_labelled) & (F.col("dominant_frac") >= min_dominant)).drop("labelled", "top")


def window_starts(size: Column, window: int, stride: int) -> Column:
    """Start offsets of sliding windows, with a last one flush with the end."""
    last = F.greatest(size - window, F.lit(0))
    return F.array_union(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(stride).cast("long")), F.array(last.cast("long")))


def stride_points(tiles: DataFrame, stride_m: float) -> DataFrame:
    """Candidate lon/lat points on a metric stride inside each tile (lon0, lat0, lon1, lat1)."""
    mid = F.radians((F.col("lat0") + F.col("lat1")) / 2)
    dlat = F.lit(stride_m / 111320.0)
    d = tiles.withColumn("_dlon", dlat / F.cos(mid)).withColumn("_dlat", dlat)
    n = lambda a, z, s: F.greatest(F.floor((F.col(z) - F.col(a)) / F.col(s)), F.lit(0))
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n("lon0", "lon1", "_dlon"))))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), n("lat0", "lat1", "_dlat"))))
    lon, lat = F.col("lon0") + F.col("_i") * F.col("_dlon"), F.col("lat0") + F.col("_j") * F.col("_dlat")
    return d.withColumns({"lon": lon, "lat": lat}).drop("_i", "_j", "_dlon", "_dlat")


def touched_tiles(b: Column, deg: float) -> Column:
    """Lower-left corners of the lattice tiles that a lon/lat box touches."""
    xs = F.sequence(F.floor(b["minx"] / deg), F.floor(b["maxx"] / deg))
    ys = F.sequence(F.floor(b["miny"] / deg), F.floor(b["maxy"] / deg))
    return F.flatten(F.transform(xs, lambda i: F.transform(ys, lambda j: F.struct((i * deg).alias("lon"), (j * deg).alias("lat")))))
