"""Class decision table over zonal parameters, label penalties and stability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions.common import clip, number_or


@dataclass(frozen=True)
class Thresholds:
    """Fixed cut-off values of the decision table, the compact-low router and the confidence rules."""

    natural_bsf_max: float = 0.05
    natural_built_max: float = 0.10
    water_min: float = 0.75
    trees_dense_min: float = 0.75
    trees_scatter_min: float = 0.35
    trees_scatter_veg_min: float = 0.75
    shrub_min: float = 0.60
    lowplants_min: float = 0.75
    rock_min: float = 0.60
    paved_min: float = 0.60
    sand_min: float = 0.60
    industry_min: float = 0.50
    industry_poi_min: int = 1
    large_bsf_min: float = 0.25
    large_h_max: float = 10.0
    large_footprint_min: float = 800.0
    large_type_min: float = 0.50
    high_min: float = 25.0
    mid_min: float = 10.0
    tower_min: int = 3
    compact_min: float = 0.40
    open_min: float = 0.20
    sparse_min: float = 0.05
    sparse_veg_min: float = 0.40
    informal_footprint_max: float = 60.0
    informal_count_min: float = 6000.0
    informal_cv_min: float = 0.7
    deficit_bpr_min: float = 250.0
    deficit_road_max: float = 5.0
    formal_footprint_min: float = 100.0
    formal_evidence_min: float = 0.3
    informal_layer_min: float = 0.5
    blob_google_max: float = 0.5
    blob_count_max: float = 2000.0
    blob_bsf_min: float = 0.4
    cap_informal: float = 0.60
    cap_informal_layer: float = 0.75
    evidence_full: float = 0.50
    raster_cap: float = 0.60
    none_max: float = 0.50
    trap_built_min: float = 0.15
    band: float = 0.03
    band_penalty: float = 0.70
    suspect_built_max: float = 0.02
    suspect_share: float = 0.99
    suspect_penalty: float = 0.50


ZERO_DEFAULT = (
    "bsf h_max n_tower height_evidence_frac height_none_frac mean_footprint_area median_footprint_area "
    "footprint_area_cv building_count_density f_google_source large_lowrise_frac built_area_ml_frac f_water "
    "f_trees f_lowplants f_shrub f_sand f_bare_rock f_paved_infra f_industrial_lu n_heavy_industry_poi "
    "road_length_density buildings_per_road_km"
).split()
NULL_DEFAULT = ("h_mean", "mn_informal_frac", "ghs_built_s")


def _x(name: str) -> Column:
    return F.col(f"_x_{name}")


def natural_rules(t: Thresholds) -> list[tuple[int, Column, Column]]:
    """(class, condition, evidence) in the order they are tried."""
    low, trees = _x("f_lowplants"), _x("f_trees")
    return [
        (17, _x("f_water") >= t.water_min, _x("f_water")),
        (11, trees >= t.trees_dense_min, trees),
        (12, (trees >= t.trees_scatter_min) & (low + trees >= t.trees_scatter_veg_min), low + trees),
        (13, _x("f_shrub") >= t.shrub_min, _x("f_shrub")),
        (14, low >= t.lowplants_min, low),
        (15, (_x("f_bare_rock") >= t.rock_min) | (_x("f_paved_infra") >= t.paved_min),
         F.greatest(_x("f_bare_rock"), _x("f_paved_infra"))),
        (16, _x("f_sand") >= t.sand_min, _x("f_sand")),
    ]


def _first(pairs: list[tuple[Column, object]]) -> Column:
    out = None
    for cond, value in pairs:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def height_class(t: Thresholds) -> Column:
    h = _x("h_mean")
    towers = (_x("h_max") >= t.high_min) & (_x("n_tower") >= t.tower_min)
    return _first([
        (towers | F.coalesce(h >= t.high_min, F.lit(False)), "high"), (h >= t.mid_min, "mid"), (h.isNotNull(), "low"),
    ])


def density_class(t: Thresholds) -> Column:
    bsf = _x("bsf")
    return _first([(bsf >= t.compact_min, "compact"), (bsf >= t.open_min, "open"), (bsf >= t.sparse_min, "sparse")])


def classify(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Adds lcz, lcz_set, label_type, confidence, reject_reason, height_class, density_class,
    boundary_flag and suspect_ml to a table of zonal parameters.

    Missing and NaN inputs count as zero, except mean height, built share and informal
    share, where they mean unknown. The table is worked through in four projections so that
    each generated method stays small: clean inputs, flags, the name of the rule that fires,
    and the label that the rule stands for.
    """
    # plain columns, not one struct: fields of a struct are inlined wherever they are used
    clean = {f"_x_{c}": number_or(c) for c in ZERO_DEFAULT} | {f"_x_{c}": number_or(c, None) for c in NULL_DEFAULT}
    bsf, built, h = _x("bsf"), _x("ghs_built_s"), _x("h_mean")
    near = F.lit(False)
    for cut in (t.compact_min, t.open_min, t.sparse_min):
        near = near | (F.abs(bsf - cut) <= t.band)
    no = lambda c: F.coalesce(c, F.lit(False))
    fp, count = _x("median_footprint_area"), _x("building_count_density")
    natural = natural_rules(t)
    d = df.withColumns(clean).withColumns({
        "_hc": height_class(t),
        "_dc": density_class(t),
        "_near": near,
        "_suspect": (bsf >= t.sparse_min) & no(built < t.suspect_built_max) & (_x("built_area_ml_frac") > t.suspect_share),
        "_nat": _first([(c, k) for k, c, _ in natural]),
        "_natev": _first([(c, e) for _, c, e in natural]),
        "_large": (bsf >= t.large_bsf_min) & F.coalesce(h < t.large_h_max, F.lit(True))
        & (_x("mean_footprint_area") >= t.large_footprint_min) & (_x("large_lowrise_frac") >= t.large_type_min),
        "_informal": (fp > 0) & (fp <= t.informal_footprint_max) & (count >= t.informal_count_min)
        & (_x("footprint_area_cv") >= t.informal_cv_min),
        "_deficit": (_x("buildings_per_road_km") >= t.deficit_bpr_min)
        | ((_x("road_length_density") < t.deficit_road_max) & (count >= t.informal_count_min)),
        "_layer": no(_x("mn_informal_frac") >= t.informal_layer_min),
        "_blob": (_x("f_google_source") < t.blob_google_max) & (count < t.blob_count_max) & (bsf >= t.blob_bsf_min),
        "_industry": _x("f_industrial_lu") >= t.industry_min,
    })
    hc, dc = F.col("_hc"), F.col("_dc")
    formal = (fp >= t.formal_footprint_min) & (_x("height_evidence_frac") >= t.formal_evidence_min) & ~F.col("_deficit")
    veg = _x("f_lowplants") + _x("f_trees")
    matrix = _first([
        ((hc == "high") & (dc == "compact"), 1), ((hc == "high") & (dc == "open"), 4),
        ((hc == "mid") & (dc == "compact"), 2), ((hc == "mid") & (dc == "open"), 5),
        ((hc == "low") & (dc == "open"), 6), ((hc == "low") & (dc == "sparse") & (veg >= t.sparse_veg_min), 9),
    ])
    floor = bsf < t.natural_bsf_max
    router = no((hc == "low") & (dc == "compact"))
    rule = _first([
        (floor & F.col("_nat").isNull(), "no_positive_evidence"),
        (floor & (built > t.trap_built_min), "completeness_trap"),
        (floor & (built >= t.natural_built_max), "built_signal_present"),
        (floor, "natural"),
        (F.col("_industry") & (_x("n_heavy_industry_poi") >= t.industry_poi_min), "heavy"),
        (F.col("_large") & F.col("_industry"), "large_or_heavy"),
        (F.col("_large"), "large"),
        (dc.isNull(), "below_built_floor"),
        (hc.isNull(), "no_height_class"),
        (router & F.col("_blob"), "low_or_light"),
        (router & ((F.col("_informal") & F.col("_deficit")) | F.col("_layer")), "light"),
        (router & formal, "low"),
        (router, "low_or_light"),
        (F.col("_matrix").isNull(), "matrix_unlabelled"),
        (_x("height_none_frac") > t.none_max, "insufficient_height_evidence"),
        (F.lit(True), "matrix"),
    ])
    d = d.withColumn("_matrix", matrix).withColumn("_rule", rule)
    r = F.col("_rule")
    penalty = F.when(F.col("_near"), t.band_penalty).otherwise(1.0) * F.when(F.col("_suspect"), t.suspect_penalty).otherwise(1.0)
    light_cap = F.when(F.col("_layer"), t.cap_informal_layer).otherwise(t.cap_informal)
    evidence_cap = F.when(_x("height_evidence_frac") < t.evidence_full, t.raster_cap).otherwise(1.0)
    coarse = r.isin("large_or_heavy", "low_or_light")
    hard = r.isin("natural", "heavy", "large", "light", "low", "matrix")
    graded = r.isin("no_height_class", "low_or_light", "light", "low", "matrix_unlabelled",
                    "insufficient_height_evidence", "matrix")
    lcz = _first([
        (r == "natural", F.col("_nat")), (r == "heavy", 10), (r == "large", 8), (r == "light", 7), (r == "low", 3),
        (r == "matrix", F.col("_matrix")),
    ])
    members = lambda *c: F.array(*map(F.lit, c)).cast("array<int>")
    out = d.withColumn("lcz", lcz.cast("int")).withColumns({
        "lcz_set": F.when(hard, F.array("lcz")).when(r == "large_or_heavy", members(8, 10))
        .when(coarse, members(3, 7)).otherwise(members()),
        "label_type": F.when(hard, "hard").when(coarse, "coarse").otherwise("unlabelled"),
        "confidence": F.when(r == "natural", clip(F.col("_natev"), 0, 1))
        .when(r == "matrix", evidence_cap * penalty).when(r == "light", F.least(penalty, light_cap))
        .when(hard | coarse, penalty).otherwise(0.0),
        "reject_reason": F.when(~(hard | coarse), r),
        "height_class": F.when(graded, hc),
        "density_class": F.when(graded, dc),
        "boundary_flag": (hard | coarse) & (r != "natural") & F.col("_near"),
        "suspect_ml": (hard | coarse) & (r != "natural") & F.col("_suspect"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def zone_penalty(confidence: Column, labelled: Column, zone_grade: Column, factor: float = 0.70) -> Column:
    """Labels outside a zone of sufficient size keep a reduced confidence."""
    return F.when(labelled & ~F.coalesce(zone_grade, F.lit(False)), confidence * factor).otherwise(confidence)


def change_height_class(h: Column, high: float = 25.0, mid: float = 10.0) -> Column:
    missing = h.isNull() | F.isnan(h)
    return (
        F.when(missing, "none").when(h >= high, "high").when(h >= mid, "mid").when(h > 0, "low").otherwise("nonbuilt")
    )


def stable(built0: Column, h0: Column, built1: Column, h1: Column, max_change: float = 0.10) -> Column:
    """Built share moved by less than the limit and height class is unchanged; unknown share counts as unstable."""
    ok = (F.abs(built1 - built0) < max_change) & ~F.isnan(built0) & ~F.isnan(built1)
    return F.coalesce(ok, F.lit(False)) & (change_height_class(h0) == change_height_class(h1))


def training_years(df: DataFrame, years, stable_col: str = "stable", own_year: str = "label_year") -> DataFrame:
    """One row per usable year: every year for stable rows, only the label's own year otherwise."""
    every = F.array(*[F.lit(int(y)) for y in years])
    own = F.array(F.col(own_year).cast("int"))
    return df.withColumn("year", F.explode(F.when(F.col(stable_col), every).otherwise(own)))
