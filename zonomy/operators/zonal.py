"""Zonal parameters: building, road, cover and raster statistics per zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions import geometry as G
from zonomy.operators.ordered import exact_quantiles
from zonomy.operators.pixels import block_side
from zonomy.operators.spatial import box_join, covered_area
from zonomy.session import cut_lineage

# Cover classes of each fraction.
COVER_GROUPS = {
    "f_water": ("water", "river", "lake", "reservoir", "pond", "basin", "lagoon", "wastewater", "oxbow"),
    "f_trees": ("wood", "forest", "tree", "tree_row", "trees"),
    "f_lowplants": ("grass", "grassland", "meadow", "farmland", "farmyard", "village_green", "greenfield", "garden",
                    "orchard", "cropland", "allotments", "vineyard", "managed", "fairway", "green", "rough", "pitch",
                    "recreation_ground"),
    "f_shrub": ("scrub", "heath", "shrub", "shrubbery"),
    "f_sand": ("sand", "beach", "dune"),
    "f_bare_rock": ("rock", "scree", "bare_rock", "bedrock", "stone"),
    "f_paved_infra": ("runway", "apron", "taxiway", "helipad", "parking"),
    "f_industrial_lu": ("industrial", "works", "brownfield"),
}
# Buildings of a zone up to which its median is a plain percentile; larger zones go by value ranges, with equal results.
PLAIN = 50_000
HEAVY_INDUSTRY = ("works", "chimney", "power_plant", "plant")


def building_stats(zones: DataFrame, buildings: DataFrame, cell: float, zone_id: str) -> DataFrame:
    """Fourteen aggregates of the buildings clipped to each zone.

    ``buildings`` needs rbox, height_m, height_tier, footprint_area_m2, is_large, is_tower,
    is_trusted, is_google. The median footprint is taken over the dominant open source when
    it holds at least half of the buildings.
    """
    # One clip of every building against every zone it overlaps, summed by (zone, footprint,
    # source). All figures, the median included, come from this table, which is written once.
    a, fp = F.col("_a"), F.col("footprint_area_m2")
    pairs = box_join(zones.select(zone_id, "lbox"), buildings, cell).withColumn(
        "_a", G.shared_area(F.col("lbox"), F.col("rbox"))).withColumn("_za", G.area(F.col("lbox")))
    has_h = F.col("height_m").isNotNull() & ~F.isnan("height_m")
    part = lambda flag: F.sum(F.when(flag, a).otherwise(0.0))
    base = cut_lineage(pairs.groupBy(zone_id, fp.alias("_fp"), "is_google").agg(
        F.first("_za").alias("_za"), F.count(F.lit(1)).alias("_n"), F.sum(a).alias("_a"),
        F.sum(F.when(has_h, a * F.col("height_m"))).alias("_ah"), F.sum(F.when(has_h, a)).alias("_aw"),
        F.max(F.when(has_h, F.col("height_m"))).alias("_hx"), part(F.col("height_tier").isin("explicit", "levels")).alias("_ev"),
        part(F.col("height_tier") == "none").alias("_no"), part(F.col("is_large")).alias("_la"),
        F.count_if("is_tower").alias("_tw"), part(~F.col("is_trusted")).alias("_ml")))
    n, area = F.sum("_n"), F.sum("_a")
    mean = F.sum(F.col("_fp") * F.col("_n")) / n
    spread = F.sqrt(F.greatest(F.sum(F.col("_fp") * F.col("_fp") * F.col("_n")) / n - mean * mean, F.lit(0.0)))
    stats = base.groupBy(zone_id).agg(
        (area / F.first("_za")).alias("bsf"), n.alias("n_buildings"),
        (F.sum(F.when(F.col("is_google"), F.col("_n")).otherwise(0)) / n).alias("f_google_source"),
        mean.alias("mean_footprint_area"), F.when(mean > 0, spread / mean).otherwise(0.0).alias("footprint_area_cv"),
        (n / (F.first("_za") / 1e6)).alias("building_count_density"), (F.sum("_ah") / F.sum("_aw")).alias("h_mean"),
        F.max("_hx").alias("h_max"), (F.sum("_ev") / area).alias("height_evidence_frac"),
        (F.sum("_no") / area).alias("height_none_frac"), (F.sum("_la") / area).alias("large_lowrise_frac"),
        F.sum("_tw").alias("n_tower"), (F.sum("_ml") / area).alias("built_area_ml_frac"))
    source = stats.select(zone_id, (F.col("f_google_source") >= 0.5).alias("_g"))
    used = base.select(zone_id, "_fp", "is_google", "_n").join(source, zone_id).where(~F.col("_g") | F.col("is_google"))
    small = stats.select(zone_id, (F.col("n_buildings") <= PLAIN).alias("_few"))
    used = used.join(small, zone_id)
    medians = used.where("_few").groupBy(zone_id).agg(F.expr("percentile(_fp, 0.5, _n)").alias("median_footprint_area"))
    if not base.groupBy(zone_id).agg(n.alias("_n")).where(F.col("_n") > PLAIN).isEmpty():
        medians = medians.unionByName(exact_quantiles(used.where(~F.col("_few")), [zone_id], F.col("_fp"), {"median_footprint_area": 0.5}, count=F.col("_n")))
    out = zones.select(zone_id).join(stats, zone_id, "left").join(medians, zone_id, "left")
    zero = [c for c in stats.columns if c not in (zone_id, "h_mean", "h_max", "footprint_area_cv")]
    return out.fillna(0, subset=zero)


def road_stats(
    zones: DataFrame, segments: DataFrame, n_buildings: DataFrame, cell: float, zone_id: str,
    motorised: Sequence[str] | None = None, sentinel: float = 1.0e4,
) -> DataFrame:
    """Road length per km2 and buildings per road-km.

    ``segments`` has x0, y0, x1, y1 and class. Buildings without any road get the sentinel.
    """
    s = segments.where(F.col("class").isin(*motorised)) if motorised else segments
    s = s.select("x0", "y0", "x1", "y1", G.box(
        F.least("x0", "x1"), F.least("y0", "y1"), F.greatest("x0", "x1"), F.greatest("y0", "y1")).alias("rbox"))
    length = G.clipped_length(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("lbox"))
    km = (
        box_join(zones.select(zone_id, "lbox"), s, cell, touching=True)
        .groupBy(zone_id).agg((F.sum(length) / 1000).alias("_km"))
    )
    d = zones.select(zone_id, "lbox").join(km, zone_id, "left").join(n_buildings, zone_id, "left")
    km_, n = F.coalesce(F.col("_km"), F.lit(0.0)), F.coalesce(F.col("n_buildings"), F.lit(0))
    return d.select(
        zone_id,
        (km_ / (G.area(F.col("lbox")) / 1e6)).alias("road_length_density"),
        F.when(km_ > 0, n / F.greatest(km_, F.lit(1e-9))).when(n > 0, F.lit(sentinel)).otherwise(0.0)
        .alias("buildings_per_road_km"),
    )


def cover_fractions(
    zones: DataFrame, cover: DataFrame, cell: float, zone_id: str, groups: dict[str, Sequence[str]] = COVER_GROUPS,
) -> DataFrame:
    """One union-area share per cover group, from a single join: the group is part of the key."""
    all_classes = [c for v in groups.values() for c in v]
    if len(all_classes) == len(set(all_classes)):
        tag = F.lit(None)
        for i, v in enumerate(groups.values()):
            tag = F.when(F.col("class").isin(*v), F.lit(i)).otherwise(tag)
        tagged = cover.select("rbox", tag.alias("_g")).where(F.col("_g").isNotNull())
    else:  # a class in several groups: one row per group
        tags = F.array(*[F.when(F.col("class").isin(*v), F.lit(i)) for i, v in enumerate(groups.values())])
        tagged = cover.select("rbox", F.explode(tags).alias("_g")).where(F.col("_g").isNotNull())
    c = covered_area(zones, tagged, cell, zone_id, keys=("_g",))
    wide = c.groupBy(zone_id).agg(*[F.max(F.when(F.col("_g") == i, F.col("covered"))).alias(g) for i, g in enumerate(groups)])
    d = zones.join(wide, zone_id, "left")
    return d.select(zone_id, *[
        F.least(F.coalesce(F.col(g) / G.area(F.col("lbox")), F.lit(0.0)), F.lit(1.0)).alias(g) for g in groups])


def landuse_overlay(
    zones: DataFrame, shapes: DataFrame, cell: float, zone_id: str, categories: Sequence[str],
    pairs: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Summed area share per category clipped at 1, optional pair sums clipped at 1, and the any-category share."""
    j = box_join(zones.select(zone_id, "lbox"), shapes, cell)
    a = G.shared_area(F.col("lbox"), F.col("rbox"))
    wide = j.groupBy(zone_id).agg(*[
        F.sum(F.when(F.col("category") == c, a).otherwise(0.0)).alias(f"_{c}") for c in categories])
    d = zones.join(wide, zone_id, "left")
    frac = {c: F.coalesce(F.col(f"_{c}") / G.area(F.col("lbox")), F.lit(0.0)) for c in categories}
    one = F.lit(1.0)
    total = sum(frac.values(), F.lit(0.0))
    return d.select(
        zone_id, *[F.least(v, one).alias(f"frac_{c}") for c, v in frac.items()],
        *[F.least(frac[a_] + frac[b_], one).alias(n) for n, (a_, b_) in (pairs or {}).items()],
        F.least(total, one).alias("frac_any"))


def geometric_descriptors(b: Column) -> dict[str, Column]:
    return {
        "area_m2": G.area(b), "perimeter_m": G.perimeter(b), "shape_index": G.shape_index(G.area(b), G.perimeter(b)),
        "compactness": G.compactness(G.area(b), G.perimeter(b)), "elongation": G.elongation(b),
    }


# ── raster zonal statistics on pixel tables ──────────────────────────────────


def tile_key(lon: Column, lat: Column, size: float = 0.5) -> tuple[Column, Column]:
    return F.round(F.floor(lon / size) * size, 4), F.round(F.floor(lat / size) * size, 4)


def zonal_pixels(
    zones: DataFrame, pixels: DataFrame, res: float, zone_id: str, block: int | None = None, b: str = "lbox",
) -> DataFrame:
    """Pixels of the row/column window of every zone box (outward rounding on both ends).

    Windows are joined to pixels by ``block`` x ``block`` pixel blocks, about as large as a zone unless given, so few
    pixels outside a window meet it.
    """
    block = block or block_side(zones, G.width(F.col(b)) / res, G.height(F.col(b)) / res)
    z = zones.select(
        zone_id, F.floor(F.col(f"{b}.minx") / res).alias("_c0"), (F.ceil(F.col(f"{b}.maxx") / res) - 1).alias("_c1"),
        F.floor(F.col(f"{b}.miny") / res).alias("_r0"), (F.ceil(F.col(f"{b}.maxy") / res) - 1).alias("_r1"))
    z = z.withColumn("_bc", F.explode(F.sequence(F.floor(F.col("_c0") / block), F.floor(F.col("_c1") / block))))
    z = z.withColumn("_br", F.explode(F.sequence(F.floor(F.col("_r0") / block), F.floor(F.col("_r1") / block))))
    p = pixels.withColumn("_bc", F.floor(F.col("col") / block)).withColumn("_br", F.floor(F.col("row") / block))
    inside = F.col("col").between(F.col("_c0"), F.col("_c1")) & F.col("row").between(F.col("_r0"), F.col("_r1"))
    return z.join(p, ["_bc", "_br"]).where(inside).drop("_bc", "_br", "_c0", "_c1", "_r0", "_r1")


def zonal_stats(
    zones: DataFrame, pixels: DataFrame, res: float, zone_id: str, value: str = "value", threshold: float | None = None,
) -> DataFrame:
    """Mean, deviation, exact p90, maximum and share above a threshold of the pixels per zone; null without pixels."""
    hit = zonal_pixels(zones, pixels.where(~F.isnan(F.col(value).cast("double"))), res, zone_id)
    # counted values serve the moments and the quantile alike
    base = hit.groupBy(zone_id, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    v, n = F.col("_v"), F.col("_n")
    mean = F.sum(v * n) / F.sum(n)
    aggs = [F.sum(n).alias("n_pixels"), mean.alias("mean"), F.max(v).alias("max"),
            F.sqrt(F.greatest(F.sum(v * v * n) / F.sum(n) - mean * mean, F.lit(0.0))).alias("std")]
    if threshold is not None:
        aggs.append((F.sum(F.when(v > threshold, n).otherwise(0)) / F.sum(n)).alias("share_above"))
    s = base.groupBy(zone_id).agg(*aggs)
    q = exact_quantiles(base, [zone_id], v, {"p90": 0.9}, count=n)
    return zones.select(zone_id).join(s, zone_id, "left").join(q, zone_id, "left")


def sample_points(points: DataFrame, pixels: DataFrame, res: float, x: str = "x", y: str = "y",
                  value: str = "value") -> DataFrame:
    """Value of the pixel under each point, null where there is none."""
    p = points.withColumn("col", F.floor(F.col(x) / res)).withColumn("row", F.floor(F.col(y) / res))
    return p.join(pixels.select("row", "col", value), ["row", "col"], "left").drop("row", "col")
