"""Coverage manifests over several sources of the same keys, and their audits.

A scan table has one row per (family, dataset, patch_id): h, w, n_invalid, n_pixels,
invalid_frac, city, lcz.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.operators.ordered import exact_quantiles, quantiles_of
from zonomy.session import broadcast_if_small, cut_lineage

KEY = ("dataset", "patch_id")
FEW = 10_000  # rows of a table per family or split up to which it is broadcast; a longer one is joined
# Membership thresholds, truncation ratio and the histogram edges.
MAX_INVALID = 0.25
MIN_NATIVE = 0.5
SEVERE = 0.75
TRUNCATION = 0.85
HISTOGRAM = (
    ("exactly 0", 0.0, 1e-12), ("0-0.1%", 1e-12, 0.001), ("0.1-1%", 0.001, 0.01), ("1-5%", 0.01, 0.05),
    ("5-10%", 0.05, 0.10), ("10-25%", 0.10, 0.25), ("25-50%", 0.25, 0.50), ("50-75%", 0.50, 0.75),
    ("75-100%", 0.75, 1.0 + 1e-9),
)


def scan_patches(pixels: DataFrame, invalid: Column, keys: Sequence[str] = ("family", *KEY)) -> DataFrame:
    """Per patch: extent, pixels and invalid pixels of a pixel table."""
    return pixels.groupBy(*keys).agg(
        (F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"), F.count_if(invalid).alias("n_invalid"),
        F.count(F.lit(1)).alias("n_pixels")).withColumn("invalid_frac", F.col("n_invalid") / F.col("n_pixels"))


def _few(df: DataFrame) -> DataFrame:
    """A table of one row per family or split: written, counted and broadcast, so that the scan it joins is not shuffled."""
    return broadcast_if_small(cut_lineage(df), FEW)


def expected_area(scan: DataFrame, split: str = "training") -> DataFrame:
    """Exact median patch area per family on one split."""
    area = (F.col("h") * F.col("w")).cast("double")
    return exact_quantiles(scan.where(F.col("dataset") == split), ["family"], area, {"expected_area": 0.5})


def with_native(scan: DataFrame, split: str = "training", max_invalid: float = MAX_INVALID,
                min_native: float = MIN_NATIVE) -> DataFrame:
    """Adds native_frac (area over the family's expected area) and ok."""
    d = scan.join(_few(expected_area(scan, split)), "family", "left")
    d = d.withColumn("native_frac", F.col("h") * F.col("w") / F.col("expected_area"))
    ok = (F.col("invalid_frac") <= max_invalid) & (F.col("native_frac") >= min_native)
    return d.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("expected_area")


def build_manifest(scan: DataFrame, families: Sequence[str], **thresholds) -> DataFrame:
    """One row per key seen anywhere: fractions, presence and ok per family, and membership.

    Membership needs presence and ok in every family. Non-members stay as rows, so a key
    outside the universe can be told from an excluded one.
    """
    d = with_native(scan, **thresholds)
    of = lambda f, c: F.max(F.when(F.col("family") == f, F.col(c)))
    aggs = []
    for f in families:
        aggs += [of(f, "invalid_frac").alias(f"invalid_frac_{f}"), of(f, "native_frac").alias(f"native_frac_{f}"),
                 F.count_if(F.col("family") == f).alias(f"_n_{f}"), of(f, "ok").alias(f"_ok_{f}")]
    m = d.groupBy(*KEY).agg(F.min("city").alias("city"), F.min("lcz").alias("lcz"), *aggs)
    member = F.lit(True)
    cols = []
    for f in families:
        ok = F.coalesce(f"_ok_{f}", F.lit(False))
        cols += [f"invalid_frac_{f}", f"native_frac_{f}", (F.col(f"_n_{f}") > 0).alias(f"present_{f}"), ok.alias(f"ok_{f}")]
        member = member & ok
    return m.select(*KEY, "city", "lcz", *cols, member.alias("in_manifest"))


# ── filters with the keep-unknown rule ───────────────────────────────────────


def filter_invalid(items: DataFrame, scan: DataFrame, limit: float, families: Sequence[str] | None = None) -> DataFrame:
    """Items whose worst invalid share over the families is within the limit; unknown items stay.

    A limit of 1 or more returns the input itself.
    """
    if limit >= 1.0:
        return items
    s = scan.where(F.col("family").isin(*families)) if families else scan
    worst = s.groupBy(*KEY).agg(F.max("invalid_frac").alias("_f"))
    return items.join(worst, list(KEY), "left").where(F.col("_f").isNull() | (F.col("_f") <= limit)).drop("_f")


def filter_native(items: DataFrame, manifest: DataFrame, floor: float, families: Sequence[str]) -> DataFrame:
    """Items whose smallest native share over the families reaches the floor; unknown items stay."""
    if floor <= 0.0:
        return items
    cols = [f"native_frac_{f}" for f in families]
    missing = [c for c in cols if c not in manifest.columns]
    if missing or not cols:
        raise ValueError(f"manifest has no {missing or 'families'}")
    low = F.col(cols[0]) if len(cols) == 1 else F.least(*cols)
    m = manifest.select(*KEY, low.alias("_f"))
    return items.join(m, list(KEY), "left").where(F.col("_f").isNull() | (F.col("_f") >= floor)).drop("_f")


def filter_members(items: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Members and items outside the manifest's universe; excluded keys are dropped by an anti join."""
    if manifest is None:
        return items
    return items.join(manifest.where(~F.col("in_manifest")).select(*KEY), list(KEY), "left_anti")


def in_every_source(inventory: DataFrame, sources: Sequence[str], keys: Sequence[str] = KEY, source: str = "family") -> DataFrame:
    """Keys present in every source, by one count of distinct sources instead of a chain of joins."""
    return (
        inventory.where(F.col(source).isin(*sources)).groupBy(*keys)
        .agg(F.countDistinct(source).alias("_n")).where(F.col("_n") == len(set(sources))).drop("_n"))


# ── audits ───────────────────────────────────────────────────────────────────


def median_shape(scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact median height and width per group, in one pass."""
    q = quantiles_of(scan, keys, {"h": F.col("h"), "w": F.col("w")}, {"med": 0.5})
    return q.withColumnsRenamed({"h_med": "med_h", "w_med": "med_w"})


def coverage_summary(scan: DataFrame, reference: DataFrame) -> DataFrame:
    """Per family and split: missing keys, invalid share, exact quantiles, counts above thresholds, truncation."""
    keys = ["family", "dataset"]
    shape = median_shape(scan, keys)
    f = F.col("invalid_frac")
    cut = (F.col("h") < TRUNCATION * F.col("med_h")) | (F.col("w") < TRUNCATION * F.col("med_w"))
    head = scan.join(_few(shape), keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_on_disk"),
        (F.sum("n_invalid") / F.greatest(F.sum("n_pixels"), F.lit(1))).alias("total_invalid_px_frac"),
        F.avg((f > 0).cast("double")).alias("frac_any_invalid"),
        *[F.count_if(f > t).alias(f"n_above_{int(t * 100)}") for t in (0.0, 0.1, 0.25, 0.5, 0.75)],
        F.count_if(cut).alias("n_truncated"), F.max(f).alias("max"))
    q = exact_quantiles(scan, keys, f, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    ref = reference.groupBy("dataset").agg(F.countDistinct("patch_id").alias("n_reference"))
    return head.join(q, keys).join(ref, "dataset").withColumn("n_missing", F.col("n_reference") - F.col("n_on_disk"))


def bucket_label(x: Column, edges=HISTOGRAM) -> Column:
    out = None
    for name, low, high in edges:
        c = (x >= low) & (x < high)
        out = F.when(c, name) if out is None else out.when(c, name)
    return out


def invalid_histogram(scan: DataFrame, keys: Sequence[str] = ("family",)) -> DataFrame:
    return scan.groupBy(*keys, bucket_label(F.col("invalid_frac")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def native_area_report(scan: DataFrame, min_native: float = MIN_NATIVE) -> DataFrame:
    """Per family: area quantiles and the area rule beside the per-side truncation rule."""
    d = with_native(scan)
    train = scan.where(F.col("dataset") == "training")
    med = median_shape(train, ["family"])
    area = (F.col("h") * F.col("w")).cast("double")
    side = (F.col("h") < TRUNCATION * F.col("med_h")) | (F.col("w") < TRUNCATION * F.col("med_w"))
    nf = F.col("native_frac")
    agg = d.join(_few(med), "family").groupBy("family").agg(
        F.min(area).alias("area_min"), F.max(area).alias("area_max"),
        F.count_if(nf < 0.25).alias("below_25"), F.count_if((nf >= 0.25) & (nf < 0.5)).alias("below_50"),
        F.count_if((nf >= 0.5) & (nf < 0.75)).alias("below_75"), F.count_if((nf >= 0.75) & (nf < 0.95)).alias("below_95"),
        F.count_if(nf >= 0.95).alias("full"), F.count_if(nf < min_native).alias("below_area_rule"),
        F.count_if(side).alias("below_side_rule"))
    return agg.join(exact_quantiles(scan, ["family"], area, {"area_p1": 0.01, "area_p50": 0.5, "area_p99": 0.99}), "family")


def modal_shapes(scan: DataFrame, k: int = 5, split: str = "training") -> DataFrame:
    """The k most frequent shapes of each family; ranks work on the distinct shapes only."""
    from zonomy.operators.ordered import first_n

    c = scan.where(F.col("dataset") == split).groupBy("family", "h", "w").agg(F.count(F.lit(1)).alias("n"))
    return first_n(c, ["family"], -F.col("n"), k, [F.col("h"), F.col("w")])


def independence_audit(scan: DataFrame, base_family: str, others: Sequence[str]) -> DataFrame:
    """Of the severely invalid rows of one family: how many are also absent elsewhere, against the base rate."""
    seen = scan.where(F.col("family").isin(*others)).groupBy(*KEY).agg(
        *[F.max(F.col("family") == o).alias(f"_has_{o}") for o in others])
    b = scan.where(F.col("family") == base_family).join(seen, list(KEY), "left")
    severe = F.col("invalid_frac") > SEVERE
    cols = []
    for o in others:
        gone = ~F.coalesce(F.col(f"_has_{o}"), F.lit(False))
        cols += [F.count_if(severe & gone).alias(f"severe_absent_{o}"), F.avg(gone.cast("double")).alias(f"base_absence_{o}")]
    return b.groupBy("dataset").agg(
        F.count_if(severe).alias("n_severe"), F.count_if(F.col("invalid_frac") > MAX_INVALID).alias("n_above_max"), *cols)


def loss_tables(manifest: DataFrame) -> DataFrame:
    """Members and losses by city and by class in one pass over the manifest (grouping sets)."""
    cuts = F.explode(F.array(
        F.struct(F.lit("city").alias("cut"), F.col("city").cast("string").alias("level")),
        F.struct(F.lit("lcz").alias("cut"), F.col("lcz").cast("string").alias("level")))).alias("c")
    g = manifest.select("dataset", "in_manifest", cuts).groupBy("dataset", "c.cut", "c.level").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("in_manifest").alias("kept"))
    return g.withColumn("lost", F.col("n") - F.col("kept")).withColumn("loss_pct", 100 * F.col("lost") / F.col("n"))


def composition_shift(manifest: DataFrame) -> DataFrame:
    """Class shares before and after the manifest and their difference in points."""
    per = manifest.groupBy("dataset", "lcz").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_manifest").alias("k"))
    tot = per.groupBy("dataset").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    before, after = 100 * F.col("n") / F.col("_n"), F.coalesce(100 * F.col("k") / F.col("_k"), F.lit(0.0))
    return per.join(tot, "dataset").select("dataset", "lcz", before.alias("before_pct"), after.alias("after_pct"),
                                           (after - before).alias("delta_pp"))


def blame(manifest: DataFrame, families: Sequence[str]) -> DataFrame:
    """Excluded keys per family: absent there, or present but failing."""
    return manifest.where(~F.col("in_manifest")).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_lost"),
        *[F.count_if(~F.col(f"present_{f}")).alias(f"absent_{f}") for f in families],
        *[F.count_if(F.col(f"present_{f}") & ~F.col(f"ok_{f}")).alias(f"failed_{f}") for f in families])


def family_loss(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows a family could use alone against the common members."""
    own = with_native(scan).groupBy("family", "dataset").agg(F.count(F.lit(1)).alias("on_disk"), F.count_if("ok").alias("own_filtered"))
    mem = manifest.groupBy("dataset").agg(F.count_if("in_manifest").alias("members"))
    loss = F.when(F.col("own_filtered") > 0, (F.col("own_filtered") - F.col("members")) / F.col("own_filtered")).otherwise(0.0)
    return own.join(mem, "dataset").withColumn("loss_vs_own", loss)


def city_coverage(scan: DataFrame, reference: DataFrame, families: Sequence[str], held_out: Sequence[str] = ()) -> DataFrame:
    """One row per reference city: per family invalid share, missing and truncated counts, zero-filled."""
    med = median_shape(scan, ["family"])
    cut = (F.col("h") < TRUNCATION * F.col("med_h")) | (F.col("w") < TRUNCATION * F.col("med_w"))
    d = scan.join(_few(med), "family").withColumn("_cut", cut)
    cols = []
    for f in families:
        m = F.col("family") == f
        px = F.sum(F.when(m, F.col("n_pixels")))
        cols += [(F.sum(F.when(m, F.col("n_invalid"))) / px).alias(f"invalid_frac_{f}"),
                 F.count_if(m & (F.col("invalid_frac") > MAX_INVALID)).alias(f"n_above_{f}"),
                 F.count_if(m).alias(f"_n_{f}"), F.count_if(m & F.col("_cut")).alias(f"n_truncated_{f}")]
    per = d.groupBy("city").agg(*cols)
    ref = reference.groupBy("city").agg(F.count(F.lit(1)).alias("n_patches"))
    j = ref.join(per, "city", "left").na.fill(0)
    out = [F.col("city"), F.col("city").isin(*held_out).alias("held_out") if held_out else F.lit(False).alias("held_out"), F.col("n_patches")]
    for f in families:
        out += [F.col(f"invalid_frac_{f}"), F.col(f"n_above_{f}"), (F.col("n_patches") - F.col(f"_n_{f}")).alias(f"n_missing_{f}"),
                F.col(f"n_truncated_{f}")]
    return j.select(*out)


def recovery_counts(status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by coverage status: fully recoverable, partial, lost, and the recovered share."""
    s = F.col("status")
    return status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "full").alias("full"), F.count_if(s == "partial").alias("partial"),
        F.count_if(s == "none").alias("none")).withColumn("full_pct", 100 * F.col("full") / F.col("n"))


def truncation_by_zones(shapes: DataFrame, flag: str = "truncated", zones: str = "n_zones") -> DataFrame:
    """Truncation rate of shapes inside one zone and of shapes across several, and their ratio."""
    multi = F.col(zones) > 1
    t = F.col(flag).cast("double")
    d = shapes.groupBy().agg(
        F.count_if(multi).alias("n_multi"), F.count_if(~multi).alias("n_single"), F.avg(F.when(multi, t)).alias("rate_multi"),
        F.avg(F.when(~multi, t)).alias("rate_single"))
    return d.withColumn("ratio", F.when(F.col("rate_single") > 0, F.col("rate_multi") / F.col("rate_single")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties."""
    from zonomy.operators.ordered import with_average_rank

    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = with_average_rank(with_average_rank(d, [], F.col(x), "_rx"), [], F.col(y), "_ry")
    return d.groupBy().agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a table: row count and two folds of the row hashes."""
    cols = sorted(columns or df.columns)
    h = F.xxhash64(*cols)
    return df.select(h.alias("_h")).groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("_h").alias("xor"),
        F.sum(F.pmod(F.col("_h"), F.lit(1_000_000_007))).alias("sum"))
