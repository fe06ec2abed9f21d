"""Joins on boxes and points by grid cells.

Both sides are exploded to the cells they touch and joined on the cell; a pair that
shares several cells is kept only in the cell of the lower-left corner of its
intersection, so no distinct is needed. Cells with many rows are cut finer on both
sides first, which spreads a dense spot over many tasks; what stays skewed after that
is an equi-join key, which AQE splits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions import geometry as G
from zonomy.session import broadcast_if_small, cut_lineage

HOT_CELLS = 10_000  # dense cells up to which their list is broadcast; a longer one is joined
HOT_ROWS = 50_000
NEAREST_POINTS = 20_000  # points of a task that looks for their nearest sites
TASK_ROWS = 100_000  # rows of both sides, one for every cell that they touch, aimed at in a task of a join


def _span(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def with_cells(df: DataFrame, b: Column, cell: float) -> DataFrame:
    """One row per grid cell that a box touches (columns _cx, _cy)."""
    return df.withColumn("_cx", F.explode(_span(b["minx"], b["maxx"], cell))).withColumn(
        "_cy", F.explode(_span(b["miny"], b["maxy"], cell)))


def _cells_of(df: DataFrame, b: Column, cell: float) -> int:
    """Rows that ``with_cells`` makes of a table, without making them."""
    side = lambda lo, hi: F.floor(b[hi] / cell) - F.floor(b[lo] / cell) + 1
    return df.agg(F.sum(side("minx", "maxx") * side("miny", "maxy"))).first()[0] or 0


def by_cells(a: DataFrame, b: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Inner join on cells by sorting. Tasks grow in number with ``rows`` and not in size, and no side is broadcast: the size that
    Spark expects of a table does not know how many cells its rows touch."""
    n = max(1, math.ceil(rows / TASK_ROWS))
    return a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys)


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """A table that is to be exploded to ``rows`` rows, dealt out first, as a small file of large boxes is read by one task."""
    n = rows // (4 * TASK_ROWS)
    return df.repartition(n) if n > 1 else df


def hot_cells(cells: DataFrame, limit: int = HOT_ROWS) -> DataFrame | None:
    """The densest cells, how many parts per side to cut them into (a power of two), and over how
    many salts to spread what lies on one spot, both as the count asks. None when no cell is dense, so that
    the usual join pays only for the count."""
    over = F.col("_n") / limit
    cut = F.pow(F.lit(2.0), F.ceil(F.log2(F.sqrt(over)) + 0.5))
    found = (
        cells.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > limit)
        .select("_cx", "_cy", cut.cast("long").alias("_cut"), F.ceil(over).cast("int").alias("_salts")))
    return None if found.isEmpty() else broadcast_if_small(cut_lineage(found), HOT_CELLS)


def _cut_cells(df: DataFrame, b: Column, cell: float, hot: DataFrame, copies: bool) -> DataFrame:
    """Replace hot cells by finer ones. The left side is copied to every salt, the right side takes one."""
    d = df.join(hot, ["_cx", "_cy"], "left").withColumns({
        "_cut": F.coalesce("_cut", F.lit(1).cast("long")), "_salts": F.coalesce("_salts", F.lit(1))})
    fine = F.lit(float(cell)) / F.col("_cut")

    def part(low: Column, high: Column, c: Column) -> Column:
        first = F.greatest(F.floor(low / fine), c * F.col("_cut"))
        last = F.least(F.floor(high / fine), (c + 1) * F.col("_cut") - 1)
        return F.when(F.col("_cut") > 1, F.sequence(first, last)).otherwise(F.array(c))

    d = d.withColumn("_fx", F.explode(part(b["minx"], b["maxx"], F.col("_cx")))).withColumn(
        "_fy", F.explode(part(b["miny"], b["maxy"], F.col("_cy"))))
    every = F.sequence(F.lit(0), F.col("_salts") - 1)
    own = F.array(F.pmod(F.xxhash64(*df.columns), F.col("_salts")).cast("int"))
    return d.withColumn("_salt", F.explode(every if copies else own)).drop("_salts")


def box_join(
    left: DataFrame, right: DataFrame, cell: float, lbox: str = "lbox", rbox: str = "rbox",
    touching: bool = False, condition: Column | None = None, split_hot: bool = True, hot_rows: int = HOT_ROWS,
    margin: float = 0.0, rows: tuple[int, int] | None = None,
) -> DataFrame:
    """Pairs of boxes with positive shared area (or sharing at least a point when ``touching``).

    ``margin`` grows the left boxes, for distance joins; the columns of both sides must
    have distinct names. With ``split_hot`` the cells of the right side are counted first, and
    those with more than ``hot_rows`` rows are cut finer and salted. ``rows`` gives the cells that both sides touch, where they are known.
    """
    grown = G.expand(F.col(lbox), margin) if margin else F.col(lbox)
    rows_a, rows_b = rows or (_cells_of(left.select(grown.alias("_ga")), F.col("_ga"), cell), _cells_of(right.select(rbox), F.col(rbox), cell))
    a = with_cells(_spread(left, rows_a).withColumn("_ga", grown), F.col("_ga"), cell)
    b = with_cells(_spread(right, rows_b), F.col(rbox), cell)
    keys = ["_cx", "_cy"]
    x, y = F.greatest(F.col("_ga.minx"), F.col(f"{rbox}.minx")), F.greatest(F.col("_ga.miny"), F.col(f"{rbox}.miny"))
    home = (F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))
    hot = hot_cells(with_cells(right.select(rbox), F.col(rbox), cell), hot_rows) if split_hot else None
    if hot is not None:
        a = _cut_cells(a, F.col("_ga"), cell, hot, copies=True)
        b = _cut_cells(b, F.col(rbox), cell, hot, copies=False).drop("_cut")
        keys = ["_cx", "_cy", "_fx", "_fy", "_salt"]
        fine = F.lit(float(cell)) / F.col("_cut")
        home = home & (
            (F.col("_cut") == 1) | ((F.floor(x / fine) == F.col("_fx")) & (F.floor(y / fine) == F.col("_fy"))))
    j = by_cells(a, b, keys, rows_a + rows_b).where(home)
    test = G.intersects if touching or margin else G.overlaps
    j = j.where(test(F.col("_ga"), F.col(rbox)))
    if condition is not None:
        j = j.where(condition)
    return j.drop("_cx", "_cy", "_fx", "_fy", "_salt", "_cut", "_ga")


def point_join(
    points: DataFrame, boxes: DataFrame, cell: float, x: str = "x", y: str = "y", b: str = "rbox",
    how: str = "inner",
) -> DataFrame:
    """Points with every box that holds them. A point has one cell, so no pair repeats."""
    p = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    q = with_cells(boxes, F.col(b), cell)
    hits = p.join(q, ["_cx", "_cy"]).where(G.contains_point(F.col(b), F.col(x), F.col(y)))
    if how == "inner":
        return hits.drop("_cx", "_cy")
    raise ValueError("use pick_container for outer semantics")


def pick_container(
    points: DataFrame, boxes: DataFrame, cell: float, key: str, order: Column, keep: dict[str, Column], x: str = "x",
    y: str = "y", b: str = "rbox",
) -> DataFrame:
    """Each point with the containing box that comes first by ``order``; points in no box keep nulls.

    ``keep`` names the values taken from the chosen box. The choice is a ``min_by``
    aggregate, so overlapping boxes collapse on the map side.
    """
    hits = point_join(points.select(key, x, y), boxes, cell, x, y, b)
    best = hits.groupBy(key).agg(F.min_by(F.struct(*[c.alias(n) for n, c in keep.items()]), order).alias("_b"))
    out = points.join(best, key, "left")
    return out.select(*points.columns, *[F.col(f"_b.{n}").alias(n) for n in keep])


def covered_area(
    zones: DataFrame, shapes: DataFrame, cell: float, zone_id: str, strip: float = 64.0, zbox: str = "lbox",
    sbox: str = "rbox", keys: tuple[str, ...] = (), split_hot: bool = True,
) -> DataFrame:
    """Area of each zone under the union of the shapes, exact for any coordinates.

    Clipped shapes are cut at multiples of ``strip``, so no zone is held in one piece, and inside a
    strip at every lower or upper edge that occurs there. Between two edges the shapes are
    intervals, which running maxima merge. Equal clipped shapes collapse before they are cut; ``strip`` moves
    no result. The clipped shapes are dealt out once by zone and strip, over as many tasks as the join has; all that follows stays there.
    """
    rows = _cells_of(zones.select(zbox), F.col(zbox), cell), _cells_of(shapes.select(sbox), F.col(sbox), cell)
    pairs = box_join(zones.select(zone_id, zbox), shapes, cell, zbox, sbox, split_hot=split_hot, rows=rows)
    part = G.intersection(F.col(zbox), F.col(sbox))
    s = pairs.select(zone_id, *keys, part.alias("_p")).select(
        zone_id, *keys, F.col("_p.minx").alias("_x0"), F.col("_p.maxx").alias("_x1"), F.col("_p.miny").alias("_y0"), F.col("_p.maxy").alias("_y1"))
    s = s.withColumn("_s", F.explode(F.sequence(F.floor(F.col("_y0") / strip), F.ceil(F.col("_y1") / strip) - 1)))
    s = s.withColumns({"_y0": F.greatest(F.col("_y0"), F.col("_s") * strip), "_y1": F.least(F.col("_y1"), (F.col("_s") + 1) * strip)})
    group = [zone_id, *keys, "_s"]
    s = s.repartition(max(1, math.ceil(sum(rows) / TASK_ROWS)), *group).distinct()
    edges = s.select(*group, F.explode(F.array("_y0", "_y1")).alias("_y")).distinct()
    height = F.lead("_y").over(Window.partitionBy(*group).orderBy("_y")) - F.col("_y")
    slabs = edges.withColumn("_h", height).where(F.col("_h") > 0)
    cut = s.join(slabs.hint("merge"), group).where((F.col("_y0") <= F.col("_y")) & (F.col("_y") < F.col("_y1")))
    w = Window.partitionBy(*group, "_y").orderBy("_x0").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("_x1").over(w), F.col("_x0"))
    fresh = F.greatest(F.col("_x1") - F.greatest(F.col("_x0"), seen), F.lit(0.0))
    return cut.withColumn("_f", fresh * F.col("_h")).groupBy(zone_id, *keys).agg(F.sum("_f").alias("covered"))


def coverage_fraction(zones: DataFrame, shapes: DataFrame, cell: float, zone_id: str, strip: float = 64.0) -> DataFrame:
    """Share of every zone under the union of the shapes, 0 where nothing reaches it."""
    c = covered_area(zones, shapes, cell, zone_id, strip)
    share = F.least(F.coalesce(F.col("covered") / G.area(F.col("lbox")), F.lit(0.0)), F.lit(1.0))
    return zones.join(c, zone_id, "left").withColumn("fraction", share).drop("covered")


def hit_counts(zones: DataFrame, shapes: DataFrame, cell: float, zone_id: str, shape_id: str) -> DataFrame:
    """Shapes that touch each zone (closed test), zero included."""
    pairs = box_join(zones.select(zone_id, "lbox"), shapes.select(shape_id, "rbox"), cell, touching=True)
    n = pairs.groupBy(zone_id).agg(F.count(F.lit(1)).alias("n_hits"))
    return zones.join(n, zone_id, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long")))


def adjacency(blocks: DataFrame, cell: float, block_id: str = "block_id", b: str = "box") -> DataFrame:
    """Rook neighbours: each unordered pair once, with the length of the common side."""
    a = blocks.select(F.col(block_id).alias("block_a"), F.col(b).alias("lbox"))
    c = blocks.select(F.col(block_id).alias("block_b"), F.col(b).alias("rbox"))
    pairs = box_join(a, c, cell, touching=True, condition=F.col("block_a") < F.col("block_b"))
    return pairs.select("block_a", "block_b", G.shared_edge(F.col("lbox"), F.col("rbox")).alias("shared_len_m")).where(
        F.col("shared_len_m") > 0)


def ring_adjacency(blocks: DataFrame, block_id: str = "block_id", ring: str = "ring", digits: int = 6) -> DataFrame:
    """Rook neighbours of polygons: edges on the same supporting line whose spans overlap.

    Every ring edge is keyed by its line (normalised direction and offset) and by the stretches
    of the line that it reaches, so only edges near each other on one line meet, however many the line
    holds; overlap along the line gives the shared length. A stretch is twice the mean edge, so edges are
    cut into few pieces; a pair counts in the stretch where its overlap begins.
    """
    slim = blocks.select(F.col(block_id).alias("id"), F.col(ring).alias("_ring"))
    corners = slim.agg(F.sum(F.size("_ring"))).first()[0] or 0
    e = _spread(slim, corners).select("id", F.explode(G._edges(F.col("_ring"))).alias("e"))
    dx, dy = F.col("e.x1") - F.col("e.x0"), F.col("e.y1") - F.col("e.y0")
    n = F.hypot(dx, dy)
    flip = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    ux, uy = flip * dx / n, flip * dy / n
    e = e.where(n > 0).select(
        "id", F.round(ux, digits).alias("ux"), F.round(uy, digits).alias("uy"),
        F.round(F.col("e.x0") * uy - F.col("e.y0") * ux, 3).alias("off"),
        (F.col("e.x0") * ux + F.col("e.y0") * uy).alias("t0"), (F.col("e.x1") * ux + F.col("e.y1") * uy).alias("t1"),
    ).select("id", "ux", "uy", "off", F.least("t0", "t1").alias("a"), F.greatest("t0", "t1").alias("z"))
    mean, count = e.agg(F.avg(F.col("z") - F.col("a")), F.count(F.lit(1))).first()
    step = 2 * (mean or 1.0)
    e = e.withColumn("_s", F.explode(_span(F.col("a"), F.col("z"), step)))
    f = e.select(F.col("id").alias("id2"), "ux", "uy", "off", F.col("a").alias("a2"), F.col("z").alias("z2"), "_s")
    over = F.least("z", "z2") - F.greatest("a", "a2")
    return (
        by_cells(e, f, ["ux", "uy", "off", "_s"], 3 * count)
        .where((F.col("id") < F.col("id2")) & (over > 1e-9) & (F.floor(F.greatest("a", "a2") / step) == F.col("_s")))
        .groupBy(F.col("id").alias("block_a"), F.col("id2").alias("block_b"))
        .agg(F.sum(over).alias("shared_len_m"))
    )


# ── nearest ──────────────────────────────────────────────────────────────────


def nearest(
    points: DataFrame, sites: DataFrame, key: str, site_key: str, base: float, extent: float,
    k: Column | int = 1, site_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Exact k nearest sites of every point, without comparing every pair.

    ``points`` has (key, x, y), ``sites`` (site_key, sx, sy). Sites are indexed at cell sizes
    base, 2 base, 4 base, ... up to the width of the whole scene, which is taken from the data (``extent`` is
    its least value). For each
    occupied point cell the smallest size whose 3 x 3 block holds k sites bounds the k-th
    distance; the block two sizes up contains that disc, so it holds the answer.
    Ties break on the site key. Every point keeps its rows wherever it lies; an empty site table is an error.
    Points are dealt out by key before they meet sites, in tasks that grow in number with them: the size of a small table does not tell
    how many rows it meets. What a point meets stays in its task.
    """
    ends = lambda d, x, y: d.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count(F.lit(1))).head()
    of_sites, of_points = ends(sites, "sx", "sy"), ends(points, "x", "y")
    if of_sites[0] is None:
        raise ValueError("no sites")
    tasks = max(1, math.ceil(of_points[4] / NEAREST_POINTS))
    spans = [max(a, b) - min(c, d) for a, b, c, d in ((of_sites[i + 1], of_points[i + 1], of_sites[i], of_points[i]) for i in (0, 2)) if b is not None]
    extent = max([extent, *spans])
    top = max(3, math.ceil(math.log2(max(extent / base, 1.0))) + 3)
    size = lambda lv: F.lit(float(base)) * F.pow(F.lit(2.0), lv)
    lv = F.col("_lv")
    site = sites.select(site_key, "sx", "sy", *site_cols, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_lv")).select(
        "*", F.floor(F.col("sx") / size(lv)).alias("_cx"), F.floor(F.col("sy") / size(lv)).alias("_cy"))
    counts = site.groupBy("_lv", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    kcol = F.lit(k) if isinstance(k, int) else k
    p = points.withColumn("_k", kcol).withColumn("_px", F.floor(F.col("x") / base)).withColumn(
        "_py", F.floor(F.col("y") / base))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = p.groupBy("_px", "_py").agg(F.max("_k").alias("_k"))
    probes = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("_lv")).select(
        "*", F.explode(around).alias("_d")).select(
        "_px", "_py", "_k", "_lv",
        (F.floor(F.col("_px") / F.pow(F.lit(2.0), lv)) + F.col("_d.i")).alias("_cx"),
        (F.floor(F.col("_py") / F.pow(F.lit(2.0), lv)) + F.col("_d.j")).alias("_cy"))
    level = (
        probes.join(counts, ["_lv", "_cx", "_cy"])
        .groupBy("_px", "_py", "_lv").agg(F.sum("_n").alias("_n"), F.first("_k").alias("_k"))
        .where((F.col("_n") >= F.col("_k")) | (lv == top))
        .groupBy("_px", "_py").agg(F.least(F.min("_lv") + 2, F.lit(top)).alias("_lv"))
    )
    placed = [d.repartition(tasks, "_px", "_py") for d in (p, level)]
    q = placed[0].join(placed[1], ["_px", "_py"]).repartition(tasks, key).withColumn("_d", F.explode(around))
    q = q.withColumn("_cx", F.floor(F.col("x") / size(lv)) + F.col("_d.i")).withColumn(
        "_cy", F.floor(F.col("y") / size(lv)) + F.col("_d.j"))
    hits = q.join(site, ["_lv", "_cx", "_cy"]).withColumn(
        "dist", F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy")))
    work = ("_lv", "_cx", "_cy", "_px", "_py", "_d", "_n")
    hits = hits.drop(*work)
    if isinstance(k, int) and k == 1:
        best = hits.groupBy(key).agg(
            F.min_by(F.struct(site_key, "dist", *site_cols), F.struct("dist", site_key)).alias("_b"))
        return points.join(best, key, "left").select(*points.columns, "_b.*")
    w = Window.partitionBy(key).orderBy("dist", site_key)
    return hits.withColumn("nn", F.row_number().over(w)).where(F.col("nn") <= F.col("_k")).drop("_k")


def container_or_nearest(points: DataFrame, boxes: DataFrame, cell: float, key: str, site_key: str, base: float,
                         extent: float) -> DataFrame:
    """The containing box with the nearest centre, or for points in no box the nearest centre of all."""
    cx, cy = G.centre(F.col("rbox"))
    inside = point_join(points.select(key, "x", "y"), boxes, cell).groupBy(key).agg(
        F.min_by(site_key, F.struct(F.hypot(F.col("x") - cx, F.col("y") - cy).alias("d"), F.col(site_key))).alias(site_key))
    rest = points.join(inside, key, "left_anti")
    near = nearest(rest, boxes.select(site_key, cx.alias("sx"), cy.alias("sy")), key, site_key, base, extent)
    return inside.withColumn("inside", F.lit(True)).unionByName(near.select(key, site_key, F.lit(False).alias("inside")))


def near_lonlat(
    rows: DataFrame, others: DataFrame, key: str, radius_km: float, lon: str = "lon", lat: str = "lat",
) -> DataFrame:
    """Keys of ``rows`` closer than ``radius_km`` to any of ``others``.

    Latitude bands are at least the radius high; the longitude cell of a band is as wide as
    the radius one band nearer the pole, so a 3 x 3 neighbourhood is enough. Bands at the
    pole are a single cell.
    """
    band_deg = radius_km / 111.0
    band = lambda c: F.floor(c / band_deg)
    # one band further towards the pole, where a neighbour may sit
    edge = lambda b: (F.greatest(F.abs(b), F.abs(b + 1)) + 1) * band_deg
    wide = lambda b: F.lit(radius_km / 110.5) / F.cos(F.radians(edge(b)))
    turns = lambda b: F.when(edge(b) >= 88.0, F.lit(1)).otherwise(
        F.greatest(F.floor(F.lit(360.0) / wide(b)), F.lit(1)))
    column = lambda c, b: F.floor((c + 180.0) / (F.lit(360.0) / turns(b)))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    site = others.select(F.col(lon).alias("_olon"), F.col(lat).alias("_olat")).distinct()
    site = site.withColumn("_b", band(F.col("_olat"))).withColumn("_c", column(F.col("_olon"), F.col("_b")))
    q = rows.select(key, F.col(lon).alias("_lon"), F.col(lat).alias("_lat"))
    q = q.withColumn("_b", F.explode(F.transform(steps, lambda s: band(F.col("_lat")) + s)))
    q = q.withColumn("_c", F.explode(F.array_distinct(F.transform(
        steps, lambda s: F.pmod(column(F.col("_lon"), F.col("_b")) + s, turns(F.col("_b")))))))
    close = G.haversine_km(F.col("_lon"), F.col("_lat"), F.col("_olon"), F.col("_olat")) < radius_km
    return q.join(site, ["_b", "_c"]).where(close).select(key).distinct()


def drop_near(rows: DataFrame, held_out: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Rows at least ``radius_km`` from every held-out row."""
    return rows.join(near_lonlat(rows, held_out, key, radius_km), key, "left_anti")


def flag_overlap(rows: DataFrame, others: DataFrame, cell: float, key: str, margin: float = 0.0,
                 name: str = "hit") -> DataFrame:
    """Adds a flag: the row's box shares area with any other box (grown by ``margin``)."""
    b = others.select((G.expand(F.col("rbox"), margin) if margin else F.col("rbox")).alias("rbox"))
    hit = box_join(rows.select(key, "lbox"), b, cell).select(key).distinct().withColumn(name, F.lit(True))
    return rows.join(hit, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cover_status(shapes: DataFrame, tiles: DataFrame, cell: float, key: str, eps: float = 1e-6) -> DataFrame:
    """full / partial / none coverage of each shape by disjoint tiles, with the covered share."""
    j = box_join(shapes.select(key, "lbox"), tiles, cell)
    c = j.groupBy(key).agg(
        F.sum(G.shared_area(F.col("lbox"), F.col("rbox"))).alias("_a"), F.count(F.lit(1)).alias("n_tiles"),
        F.max(G.contains(F.col("rbox"), F.col("lbox"))).alias("in_one_tile"))
    full = F.col("_a") >= G.area(F.col("lbox")) - eps
    d = shapes.join(c, key, "left")
    return d.select(
        *shapes.columns,
        F.when(F.coalesce(full, F.lit(False)), "full").when(F.col("_a") > 0, "partial").otherwise("none").alias("status"),
        F.coalesce("n_tiles", F.lit(0).cast("long")).alias("n_tiles"),
        F.coalesce("in_one_tile", F.lit(False)).alias("in_one_tile"),
    )
