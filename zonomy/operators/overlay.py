"""Labels carried between shapes: patch overlay, conflicts, neighbours, homogeneity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from zonomy.functions import geometry as G
from zonomy.functions.common import N_CLASSES
from zonomy.operators.confusion import entropy_bits
from zonomy.operators.spatial import box_join, nearest, point_join


def patch_overlay(labels: DataFrame, patches: DataFrame, cell: float, patch_id: str = "patch_id",
                  boundary: float = 0.75) -> DataFrame:
    """Label shares of every patch.

    ``labels`` has lbl_set (array), confidence and rbox; a coarse set gives each member an
    equal part of its area, while the dominant category keeps the set whole. Patches without
    labels stay, fully unlabelled.
    """
    lab = labels.where(F.size("lbl_set") > 0).select(F.array_sort("lbl_set").alias("_set"), "confidence", "rbox")
    j = box_join(patches.select(patch_id, "lbox"), lab, cell)
    a = G.shared_area(F.col("lbox"), F.col("rbox"))
    # one row per (patch, category): the category area also yields every class share
    cat = j.groupBy(patch_id, F.array_join("_set", ",").alias("_key")).agg(
        F.sum(a).alias("_area"), F.sum(a * F.col("confidence")).alias("_ca"), F.first("_set").alias("_set"))
    n = F.size("_set")
    shares = [
        F.sum(F.when(F.array_contains("_set", c), F.col("_area") / n).otherwise(0.0)).alias(f"f_lcz_{c}")
        for c in range(1, N_CLASSES + 1)
    ]
    per = cat.groupBy(patch_id).agg(
        *shares,
        F.sum("_area").alias("_lab"), F.sum("_ca").alias("_conf"),
        F.sum(F.when(n > 1, F.col("_area")).otherwise(0.0)).alias("_coarse"),
        F.max(F.struct(F.col("_area"), (-n).alias("_n"), F.col("_key"), F.col("_set"))).alias("_top"),
    )
    d = patches.select(patch_id, "lbox").join(per, patch_id, "left")
    pa = G.area(F.col("lbox"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    dominant = zero(F.col("_top._area") / pa)
    return d.select(
        patch_id,
        *[zero(F.col(f"f_lcz_{c}") / pa).alias(f"f_lcz_{c}") for c in range(1, N_CLASSES + 1)],
        F.greatest(1 - zero(F.col("_lab") / pa), F.lit(0.0)).alias("unlabelled_frac"),
        zero(F.col("_coarse") / pa).alias("coarse_frac"),
        F.when(F.size("_top._set") == 1, F.col("_top._set")[0]).alias("dominant_lcz"),
        F.col("_top._key").alias("dominant_set"),
        dominant.alias("dominant_frac"),
        (F.col("_conf") / F.col("_lab")).alias("mean_confidence"),
        (dominant < boundary).alias("boundary_flag"),
    )


def patch_yield(overlay: DataFrame, min_dominant: float = 0.75, max_unlabelled: float = 0.25) -> DataFrame:
    """Patches with a hard dominant class, enough of it and little unlabelled ground."""
    return overlay.where(
        F.col("dominant_lcz").isNotNull() & (F.col("dominant_frac") >= min_dominant)
        & (F.col("unlabelled_frac") <= max_unlabelled)
    ).select("*", F.col("dominant_lcz").alias("class"), F.col("mean_confidence").alias("weight"))


def conflict_losers(shapes: DataFrame, cell: float, key: str = "shape_id") -> DataFrame:
    """Keys of shapes that a better ranked shape of another class touches.

    Rank: accuracy descending, then date ascending, then key. Shapes with the same box and
    class are collapsed to their best rank before the join, so copies do not multiply pairs.
    """
    rank = lambda p: F.struct(
        (-F.coalesce(F.col("acc"), F.lit(0.0))).alias("a"), F.coalesce(F.col("date").cast("double"), F.lit(1e18)).alias("d"),
        F.col(key).alias("k"))
    left = shapes.select(key, F.col("class").alias("lclass"), rank("l").alias("lrank"), F.col("box").alias("lbox"))
    best = shapes.groupBy(F.col("box").alias("rbox"), F.col("class").alias("rclass")).agg(F.min(rank("r")).alias("rrank"))
    beaten = (F.col("lclass") != F.col("rclass")) & (F.col("rrank") < F.col("lrank"))
    return box_join(left, best, cell, touching=True, condition=beaten).select(key).distinct()


def resolve_conflicts(shapes: DataFrame, cell: float, key: str = "shape_id") -> DataFrame:
    """Adds ``wins``: no better ranked shape of another class touches this one."""
    lost = conflict_losers(shapes, cell, key).withColumn("_lost", F.lit(True))
    return shapes.join(lost, key, "left").withColumn("wins", F.col("_lost").isNull()).drop("_lost")


def neighbour_relations(shapes: DataFrame, cell: float, key: str = "shape_id", cap: float = 2000.0,
                        buffer_m: float = 100.0) -> DataFrame:
    """Distance to the nearest shape of another class (infinite beyond ``cap``), whether it is
    closer than ``buffer_m``, and the area share that other classes overlap.

    Identical boxes of one class count once per copy in the overlap, through a multiplicity.
    """
    left = shapes.select(key, F.col("class").alias("lclass"), F.col("box").alias("lbox"))
    right = shapes.groupBy(F.col("box").alias("rbox"), F.col("class").alias("rclass")).agg(F.count(F.lit(1)).alias("_m"))
    dist = G.distance(F.col("lbox"), F.col("rbox"))
    pairs = box_join(left, right, cell, margin=cap, condition=F.col("lclass") != F.col("rclass")).where(dist <= cap)
    per = pairs.groupBy(key).agg(
        F.min(dist).alias("_d"), F.sum(F.col("_m") * G.shared_area(F.col("lbox"), F.col("rbox"))).alias("_o"))
    d = shapes.join(per, key, "left")
    nbr = F.coalesce(F.col("_d"), F.lit(float("inf")))
    share = F.least(F.coalesce(F.col("_o") / G.area(F.col("box")), F.lit(0.0)), F.lit(1.0))
    return d.withColumns({"nbr_dist_m": nbr, "nbr_conflict": nbr < buffer_m, "overlap_frac_diff_class": share}).drop("_d", "_o")


def qc_flags(shapes: DataFrame, cell: float, key: str = "shape_id", patch_side: float = 320.0,
             use_conflict: bool = True, drop_near: bool = False, cap: float = 2000.0) -> DataFrame:
    """All quality flags of a shape table and the verdict; nothing is dropped."""
    b = F.col("box")
    d = neighbour_relations(shapes, cell, key, cap)
    d = d.join(conflict_losers(shapes, cell, key).withColumn("_lost", F.lit(True)), key, "left")
    d = d.withColumns({
        "area_km2": G.area(b) / 1e6, "perimeter_m": G.perimeter(b), "shape": G.shape_index(G.area(b), G.perimeter(b)),
        "fits_patch": G.fits_square(b, patch_side), "wins": F.col("_lost").isNull(),
        "gate_oa": F.coalesce(F.col("acc") >= 0.5, F.lit(True)),
    }).drop("_lost")
    d = d.withColumn("qc1", (F.col("area_km2") >= 0.04) & (F.col("shape") < 3.0))
    verdict = F.col("qc1") & F.col("gate_oa")
    if use_conflict:
        verdict = verdict & F.col("wins")
    if drop_near:
        verdict = verdict & ~F.col("nbr_conflict")
    return d.withColumn("qc_pass", verdict)


def homogeneity(points: DataFrame, blocks: DataFrame, cell: float, base: float, extent: float,
                key: str = "point_id", block_id: str = "block_id") -> DataFrame:
    """Label entropy inside each block against that of the same number of points nearest its centre of points."""
    inside = point_join(points, blocks.select(block_id, "rbox"), cell)
    own = entropy_bits(inside, [block_id], "label").where(F.col("n") >= 2)
    centres = inside.groupBy(block_id).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("_m"))
    sites = points.select(key, F.col("x").alias("sx"), F.col("y").alias("sy"), "label")
    hood = nearest(centres.where(F.col("_m") >= 2), sites, block_id, key, base, extent, k=F.col("_m"), site_cols=("label",))
    around = entropy_bits(hood, [block_id], "label").select(block_id, F.col("entropy").alias("hood_entropy"))
    return own.join(around, block_id)


def overlap_trust(shapes: DataFrame, others: DataFrame, cell: float, group: str = "city", key: str = "shape_id") -> DataFrame:
    """Per group: pairs of overlapping shapes of the two sources, their class agreement, and shapes without overlap."""
    j = box_join(shapes.select(key, group, "class", "lbox"), others.select(F.col("class").alias("o_class"), "rbox"), cell)
    agg = j.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg((F.col("class") == F.col("o_class")).cast("double")).alias("agreement"))
    clean = shapes.join(j.select(key).distinct(), key, "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("n_clean"))
    n = shapes.groupBy(group).agg(F.count(F.lit(1)).alias("n_shapes"))
    return n.join(agg, group, "left").join(clean, group, "left").fillna(0, subset=["n_pairs", "n_clean"])


def tile_multiplicity(shapes: DataFrame, tiles: DataFrame, cell: float, key: str = "shape_id", zone: str = "zone") -> DataFrame:
    """Tiles whose box touches a shape, tiles that share area with it, and distinct zones of the latter."""
    j = box_join(shapes.select(key, "lbox"), tiles.select(zone, "rbox"), cell, touching=True)
    real = G.overlaps(F.col("lbox"), F.col("rbox"))
    m = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("bbox_hits"), F.count_if(real).alias("true_hits"),
        F.countDistinct(F.when(real, F.col(zone))).alias("n_zones"))
    return shapes.select(key).join(m, key, "left").fillna(0)

