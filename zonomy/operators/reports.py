"""Tabular reports: run histories, inventories, class mixes, weights, lookups and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions.common import CLASS_CODES, CLASS_NAMES, N_CLASSES
from zonomy.operators.ordered import exact_quantiles, with_rank

# ── runs ─────────────────────────────────────────────────────────────────────


def best_epochs(history: DataFrame, metrics: Sequence[str], monitor: str, keys: Sequence[str] = ("run",)) -> DataFrame:
    """All metrics of the epoch where the monitor peaks (earliest on ties), and the last epoch."""
    d = history.groupBy(*keys).agg(
        F.max_by(F.struct("epoch", *metrics), F.when(F.col(monitor).isNotNull(), F.struct(F.col(monitor), -F.col("epoch")))).alias("_b"),
        F.max("epoch").alias("stop_epoch"))
    return d.select(*keys, F.col("_b.epoch").alias("best_epoch"), "stop_epoch", *[F.col(f"_b.{m}").alias(m) for m in metrics])


def group_summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], peak: str = "best_epoch") -> DataFrame:
    """Mean, sample deviation (0 for one run) and range of each metric per group, and the sorted peaks.

    Works on the run table, one row per run.
    """
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_sd"),
                 F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.array_sort(F.collect_list(peak)).alias("peaks"), *aggs)


def widest_gap(runs: DataFrame, keys: Sequence[str], value: str = "best_epoch") -> DataFrame:
    """Largest distance between consecutive sorted values, where it starts (the latest of equals), and its
    share of the span."""
    w = Window.partitionBy(*keys).orderBy(value)
    d = runs.withColumn("_gap", F.lead(value).over(w) - F.col(value))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("_gap").alias("widest_gap"), (F.max(value) - F.min(value)).alias("span"),
        F.max_by(value, F.struct("_gap", F.col(value))).alias("gap_after"))
    share = F.when(F.col("span") > 0, F.col("widest_gap") / F.col("span")).otherwise(F.lit(0.0))
    return g.where(F.col("n") >= 3).withColumn("gap_fraction", share)


def class_deltas(scores: DataFrame, order: str, cls: str = "cls", metric: str = "f1", keys: Sequence[str] = ()) -> DataFrame:
    """Change of a per-class metric from one rung to the next."""
    w = Window.partitionBy(*keys, cls).orderBy(order)
    return scores.withColumn("delta", F.col(metric) - F.lag(metric).over(w)).where(F.col("delta").isNotNull())


def default_run(runs: DataFrame, metric: str, prefer: Column, name: str = "run") -> DataFrame:
    """Best run by the metric among the preferred ones, else among all with a metric, else the first by name."""
    return runs.groupBy().agg(F.coalesce(
        F.max_by(name, F.when(prefer & F.col(metric).isNotNull(), F.col(metric))),
        F.max_by(name, F.col(metric)), F.min(name)).alias(name))


def resolve_name(explicit: Column, legacy: Column, known: Sequence[str], legacy_map: dict[str, str]) -> tuple[Column, Column]:
    """(name, how): the explicit name when all its parts are known, else the mapped legacy label, else unresolved."""
    parts = F.split(explicit, r"\+")
    ok = explicit.isNotNull() & F.forall(parts, lambda p: p.isin(*known))
    table = F.create_map(*[F.lit(x) for kv in legacy_map.items() for x in kv])
    mapped = F.transform(F.split(legacy, r"\+"), lambda p: F.try_element_at(table, p))
    inferred = legacy.isNotNull() & F.forall(mapped, lambda p: p.isNotNull())
    name = F.when(ok, explicit).when(inferred, F.array_join(mapped, "+"))
    return name, F.when(ok, "explicit").when(inferred, "inferred").otherwise("unresolved")


def fused_provenance(parts: DataFrame, registry: DataFrame, key: str, fields: Sequence[str] = ("product", "version", "source", "status")) -> DataFrame:
    """Provenance of fused names: every field joined with ``+`` in part order. ``parts`` has key, pos, name."""
    j = parts.join(registry, "name", "left")
    cells = F.array_sort(F.collect_list(F.struct("pos", "name", *[F.coalesce(F.col(f), F.lit("none")).alias(f) for f in fields])))
    d = j.groupBy(key).agg(cells.alias("_c"))  # a handful of parts per name
    glue = lambda f: F.array_join(F.transform("_c", lambda x: x[f]), "+").alias(f)
    return d.select(key, glue("name"), *[glue(f) for f in fields])


def comparable(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Same product, version and source; missing equals missing."""
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & x.eqNullSafe(y)
    return out


def confusion_mismatches(confusion: DataFrame, runs: DataFrame, run: str = "run", total: str = "n_test") -> DataFrame:
    """Runs whose confusion total differs from the count in the run table."""
    s = confusion.groupBy(run).agg(F.sum("count").alias("n_confusion"))
    return runs.join(s, run, "left").where(~F.col("n_confusion").eqNullSafe(F.col(total))).select(run, total, "n_confusion")


# ── inventories and mixes ────────────────────────────────────────────────────


def city_inventory(items: DataFrame, splits: Sequence[str], city: str = "city", cls: str = "lcz", split: str = "dataset",
                   max_patches: int = 2000, max_classes: int = 8) -> DataFrame:
    """Patches, classes and split counts per city, and whether the city is too thin to supervise anything."""
    d = items.groupBy(city).agg(
        F.count(F.lit(1)).alias("n_patches"), F.countDistinct(cls).alias("n_classes"),
        *[F.count_if(F.col(split) == s).alias(s) for s in splits])
    return d.withColumn("sparse", (F.col("n_patches") < max_patches) | (F.col("n_classes") < max_classes))


def city_summary(items: DataFrame, city: str = "city", role: str = "role", split: str = "split") -> DataFrame:
    """Centre and split counts per city and role."""
    return items.groupBy(city, role).agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        *[F.count_if(F.col(split) == s).alias(f"n_{s}") for s in ("train", "val", "test")], F.count(F.lit(1)).alias("n_total"))


def map_split(df: DataFrame, raw: str, table: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a mapped split, and counts of the values that have no mapping."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    d = df.withColumn("split", F.try_element_at(m, F.col(raw)))
    lost = d.where(F.col("split").isNull()).groupBy(raw).agg(F.count(F.lit(1)).alias("n"))
    return d.where(F.col("split").isNotNull()), lost


def region_groups(row_groups: dict[str, Column]) -> Column:
    """Names of all (possibly overlapping) groups that a row belongs to."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in row_groups.items()]), lambda x: x.isNotNull())


def region_capacity(patches: DataFrame, groups: dict[str, Column], big: int = 50, wide: int = 8) -> DataFrame:
    """Capacity of each (overlapping) region: areas, countries, classes and areas with enough patches, mean weight.

    ``patches`` has aoi, iso, class, weight, split. Counts by (region, area, class) come first,
    so the second level works on a small table.
    """
    d = patches.withColumn("region", F.explode(region_groups(groups)))
    c = d.groupBy("region", "aoi", "iso", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), *[F.count_if(F.col("split") == s).alias(f"_{s}") for s in ("train", "val", "test")])
    per_aoi = c.groupBy("region", "aoi").agg(F.sum("n").alias("n"), F.countDistinct("class").alias("k"))
    per_cls = c.groupBy("region", "class").agg(F.sum("n").alias("n"))
    a = per_aoi.groupBy("region").agg(F.count_if(F.col("n") >= big).alias("aois_big"), F.count_if(F.col("k") >= wide).alias("aois_wide"))
    k = per_cls.groupBy("region").agg(F.count(F.lit(1)).alias("classes"), F.count_if(F.col("n") >= big).alias("classes_big"))
    h = c.groupBy("region").agg(
        F.countDistinct("aoi").alias("aois"), F.countDistinct("iso").alias("countries"), F.sum("n").alias("patches"),
        (F.sum("w") / F.sum("n")).alias("mean_weight"), *[F.sum(f"_{s}").alias(f"n_{s}") for s in ("train", "val", "test")])
    return h.join(a, "region").join(k, "region")


def labelled_area(pixels: DataFrame, keys: Sequence[str], pixel_m2: Column, cls: str = "class") -> DataFrame:
    """Labelled km2 and distinct classes per group of pixels."""
    return pixels.where(F.col(cls) > 0).groupBy(*keys).agg(
        (F.sum(pixel_m2) / 1e6).alias("labelled_km2"), F.countDistinct(cls).alias("n_classes"), F.count(F.lit(1)).alias("n_pixels"))


def cell_coverage(pixels: DataFrame, keys: Sequence[str], cell_px: int, low: float = 0.02, high: float = 0.95) -> DataFrame:
    """Labelled share of each square cell and whether it is a usable cell."""
    c = pixels.where(F.col("class") > 0).groupBy(*keys, F.floor(F.col("row") / cell_px).alias("cy"), F.floor(F.col("col") / cell_px).alias("cx")).agg(
        (F.count(F.lit(1)) / float(cell_px**2)).alias("coverage"))
    return c.withColumn("valid", F.col("coverage").between(low, high))


def class_mix(items: DataFrame, keys: Sequence[str], cls: str = "class", weight: Column | None = None) -> DataFrame:
    """Share of every class in percent, all 17 rows per group."""
    w = weight if weight is not None else F.lit(1.0)
    cols = [F.sum(F.when(F.col(cls) == c, w).otherwise(0.0)) for c in range(1, N_CLASSES + 1)]
    d = items.groupBy(*keys).agg(F.array(*cols).alias("_s"), F.sum(w).alias("_t"))
    d = d.select(*keys, "_t", F.posexplode("_s").alias("_i", "_n"))
    return d.select(*keys, (F.col("_i") + 1).alias("class"), (100 * F.col("_n") / F.col("_t")).alias("pct"))


def class_weights(areas: DataFrame, scheme: str = "inv_freq", cls: str = "class", area: str = "area") -> DataFrame:
    """Mean-normalised inverse (or root inverse) frequency weights; absent classes get the mean."""
    sums = areas.groupBy().agg(F.array(*[F.sum(F.when(F.col(cls) == c, F.col(area)).otherwise(0.0)) for c in range(1, N_CLASSES + 1)]).alias("_a"))
    inv = F.transform("_a", lambda a: F.when(a > 0, (1 / a) if scheme == "inv_freq" else F.sqrt(1 / a)))
    d = sums.withColumn("_w", inv)
    seen = F.filter("_w", lambda w: w.isNotNull())
    mean = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x) / F.size(arr)
    d = d.withColumn("_w", F.transform("_w", lambda w: F.coalesce(w, mean(seen))))
    d = d.withColumn("_m", mean(F.col("_w")))
    d = d.select("_m", F.posexplode("_w").alias("_i", "_x"))
    return d.select((F.col("_i") + 1).alias("class"), (F.col("_x") / F.col("_m")).alias("weight"))


def set_draw_weights(pixels: DataFrame, mask: str = "bitmask") -> DataFrame:
    """Inverse frequency over single-class rows; a set gets the mean over its members."""
    from zonomy.functions import labelsets as L

    classes = range(1, N_CLASSES + 1)
    hard = L.hard_class(mask)
    inv = pixels.groupBy().agg(F.array(*[
        F.when(F.count_if(hard == c) > 0, 1.0 / F.count_if(hard == c)).otherwise(0.0) for c in classes]).alias("_inv"))
    d = pixels.withColumn("_k", F.lit(1)).join(F.broadcast(inv.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row
    members = L.decode(mask)
    total = F.aggregate(F.transform(members, lambda c: F.element_at("_inv", c)), F.lit(0.0), lambda s, x: s + x)
    return d.withColumn("weight", F.when(F.col(mask) > 0, total / F.greatest(F.size(members), F.lit(1))).otherwise(0.0)).drop("_inv")


# ── projections ──────────────────────────────────────────────────────────────


def density_grid(points: DataFrame, facets: Sequence[str], bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """Counts on one grid shared by all facet values; the last edge belongs to the last bin."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ext = p.groupBy().agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    d = p.withColumn("_k", F.lit(1)).join(F.broadcast(ext.withColumn("_k", F.lit(1))), "_k")  # one row
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / ((F.col(b) - F.col(a)) / bins)), F.lit(bins - 1))
    f = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in facets])).alias("_f")
    d = d.select(cell(x, "_x0", "_x1").alias("ix"), cell(y, "_y0", "_y1").alias("iy"), "_x0", "_x1", "_y0", "_y1", f)
    c = d.groupBy(F.col("_f.facet").alias("facet"), F.col("_f.value").alias("facet_value"), "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.first("_x0").alias("_x0"), F.first("_x1").alias("_x1"), F.first("_y0").alias("_y0"), F.first("_y1").alias("_y1"))
    mid = lambda i, a, b: F.col(a) + (F.col(i) + 0.5) * (F.col(b) - F.col(a)) / bins
    return c.select("facet", "facet_value", mid("ix", "_x0", "_x1").alias("bin_x"), mid("iy", "_y0", "_y1").alias("bin_y"), "n")


def robust_limits(df: DataFrame, value: str, q: float = 0.98, pad: float = 0.04) -> DataFrame:
    """Axis limits between two quantiles, padded."""
    d = exact_quantiles(df, [], F.col(value), {"lo": 1 - q, "hi": q})
    span = F.col("hi") - F.col("lo")
    return d.select((F.col("lo") - pad * span).alias("lo"), (F.col("hi") + pad * span).alias("hi"))


def depth_order(df: DataFrame, z: str, key: str, descending: bool = False) -> DataFrame:
    """Adds the drawing order of points by depth."""
    v = -F.col(z) if descending else F.col(z)
    return with_rank(df, [], v, [F.col(key)], name="depth")


def top_levels(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """The n most frequent levels keep their name, the rest become one level."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), column).limit(n)
    j = df.join(F.broadcast(c.select(F.col(column).alias("_top"))), df[column] == F.col("_top"), "left")  # n rows
    return j.withColumn(f"{column}_top", F.coalesce("_top", F.lit(other))).drop("_top")


def class_labels(cls: Column) -> tuple[Column, Column]:
    """(code, ``LCZ n: name``) of a class number."""
    code = F.get(F.array(*map(F.lit, CLASS_CODES)), cls - 1)
    name = F.get(F.array(*map(F.lit, CLASS_NAMES)), cls - 1)
    return code, F.concat(F.lit("LCZ "), code, F.lit(": "), name)


# ── joins of reports ─────────────────────────────────────────────────────────


def common_rescore(a: DataFrame, b: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Two prediction sets on their common rows in long form, and the count of label disagreements."""
    j = a.select(*key, F.col("label").alias("truth"), F.col("pred").alias("pa")).join(
        b.select(*key, F.col("label").alias("_t2"), F.col("pred").alias("pb")), list(key))
    bad = j.groupBy().agg(F.count_if(F.col("truth") != F.col("_t2")).alias("n_mismatch"), F.count(F.lit(1)).alias("n_common"))
    long = j.select(*key, "truth", F.inline(F.array(
        F.struct(F.lit("a").alias("model"), F.col("pa").alias("pred")), F.struct(F.lit("b").alias("model"), F.col("pb").alias("pred")))))
    return long, bad


def many_to_one(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Left rows that find their single right row, and the count of those that do not. Raises on duplicate keys."""
    from zonomy.operators.splits import require_unique

    require_unique(right, [on])
    j = left.join(right.withColumn("_hit", F.lit(True)), on, "left")
    lost = j.groupBy().agg(F.count_if(F.col("_hit").isNull()).alias("n_unmatched"), F.count(F.lit(1)).alias("n"))
    return j.where(F.col("_hit").isNotNull()).drop("_hit"), lost


def incremental_fill(wanted: DataFrame, cache: DataFrame, key: str, compute) -> DataFrame:
    """Cached rows of the wanted keys plus freshly computed rows for the keys the cache lacks."""
    fresh = compute(wanted.join(cache.select(key), key, "left_anti"))
    return cache.join(wanted.select(key), key, "left_semi").unionByName(fresh, allowMissingColumns=True)


def column_blocks(runs: dict[str, DataFrame], key: str, shared: Sequence[str] = ()) -> DataFrame:
    """Runs side by side on their common keys; columns get the run's name as prefix, shared ones are taken once."""
    out = None
    for name, d in runs.items():
        own = [F.col(c).alias(f"{name}_{c}") for c in d.columns if c != key and c not in shared]
        part = d.select(key, *(list(shared) if out is None else []), *own)
        out = part if out is None else out.join(part, key)
    return out


def resolve_places(names: DataFrame, places: DataFrame, name: str = "name", place: str = "place", prefix: int = 5, overrides: DataFrame | None = None) -> DataFrame:
    """With ``overrides`` (name, place), names listed there take their place from it (``how`` is "override"); for all others:
    Each name's place by exact folded key, else by its first ``prefix`` letters or all of a shorter key;
    ambiguous matches take the first in order. Places are summed up per key and per head before they are
    joined, so a name meets one row of each."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.col(c), "_", " ")))
    p = places.select(place, fold(place).alias("_k"))
    n = names.select(name, fold(name).alias("_k")).distinct().withColumn("_p", F.substring("_k", 1, prefix))
    whole = p.groupBy("_k").agg(F.min(place).alias("_e"), F.count(F.lit(1)).alias("_ne"))
    lengths = F.sequence(F.lit(1), F.least(F.length("_k"), F.lit(prefix)))
    heads = p.where(F.length("_k") > 0).select(place, F.explode(F.transform(lengths, lambda i: F.substring("_k", F.lit(1), i))).alias("_p"))
    heads = heads.groupBy("_p").agg(F.min(place).alias("_f"), F.count(F.lit(1)).alias("_nf"))
    d = names.join(n.join(whole, "_k", "left").join(heads, "_p", "left").drop("_k", "_p"), name, "left")
    how = F.when(F.col("_ne") == 1, "exact").when(F.col("_ne") > 1, "exact, ambiguous").when(F.col("_nf") == 1, "prefix").when(
        F.col("_nf") > 1, "prefix, ambiguous").otherwise("none")
    found, how = F.coalesce("_e", "_f"), how
    if overrides is not None:  # the last in order where a name is listed twice
        o = overrides.groupBy(F.col(name).alias("_on")).agg(F.max(place).alias("_o"))
        d = d.join(o, F.col(name) == F.col("_on"), "left")
        found, how = F.coalesce("_o", found), F.when(F.col("_o").isNotNull(), "override").otherwise(how)
    return d.select(*names.columns, found.alias(place), how.alias("how"))


def first_real(*names: Column) -> Column:
    """First name that is neither empty nor ``N/A``; lists of aliases count by their first entry."""
    clean = [F.trim(F.split(n, ",")[0]) for n in names]
    return F.coalesce(*[F.when(c.isNotNull() & (c != "") & (c != "N/A"), c) for c in clean])


def place_context(points: DataFrame, countries: DataFrame, climate: DataFrame, settlements: DataFrame, key: str, cell: float,
                  res: float, base: float, extent: float) -> DataFrame:
    """Country (nearest one outside all), climate class of the grid cell, and the densest then largest settlement.

    ``countries`` country, rbox; ``climate`` row, col, climate; ``settlements`` place, level, size, rbox.
    """
    from zonomy.operators.spatial import container_or_nearest, point_join

    p = points.select(key, "x", "y")
    c = container_or_nearest(p, countries, cell, key, "country", base, extent)
    s = point_join(p, settlements, cell).groupBy(key).agg(
        F.max_by("place", F.struct("level", "size", "place")).alias("place"))
    k = p.select(key, F.floor(F.col("y") / res).alias("row"), F.floor(F.col("x") / res).alias("col")).join(climate, ["row", "col"], "left").select(key, "climate")
    return points.join(c, key, "left").join(k, key, "left").join(s, key, "left").withColumn("urban", F.col("place").isNotNull())


def lut_classes(df: DataFrame, fixed: dict[str, int], by_density: dict[str, Sequence[int]], feature: str = "feature", bin_: str = "bin") -> Column:
    """Class of a map feature; features whose class depends on density pick by bin (sparse, open, compact)."""
    one = F.create_map(*[x for k, v in sorted(fixed.items()) for x in (F.lit(k), F.lit(v))])
    many = F.create_map(*[x for k, v in sorted(by_density.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.get(F.try_element_at(many, F.col(feature)), F.col(bin_)), F.try_element_at(one, F.col(feature)))


def tag_rules(rows: Sequence[tuple[str, str, int, float | None]], order: Sequence[int]) -> tuple[Column, Column, Column]:
    """(class, buffer, priority) of a (key, value) tag from a rule list; a later place in ``order`` wins on the map."""
    table = F.create_map(*[x for k, v, c, b in rows for x in (F.lit(f"{k}={v}"), F.struct(F.lit(c).alias("c"), F.lit(b).cast("double").alias("b")))])
    hit = F.try_element_at(table, F.concat(F.col("key"), F.lit("="), F.col("value")))
    rank = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    return hit["c"], hit["b"], F.try_element_at(rank, hit["c"])


def ladder(scores: DataFrame, order: str, metrics: Sequence[str]) -> DataFrame:
    """One row per rung in order: its figures and their change against the rung before."""
    w = Window.orderBy(order)  # one row per rung
    return scores.select(order, *metrics, *[(F.col(m) - F.lag(m).over(w)).alias(f"d_{m}") for m in metrics])


def union_checked(parts: dict[str, DataFrame], key: str, tag: str = "part") -> DataFrame:
    """Frames of several areas or arms as one table; a key that occurs twice is an error."""
    from zonomy.operators.splits import require_unique

    out = None
    for name, d in parts.items():
        one = d.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return require_unique(out, [key])
