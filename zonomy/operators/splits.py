"""Leakage-safe splits, city roles and hash-ordered sampling.

Draws are ordered by a hash of the key, so they are stable when rows are added or the
cluster changes; no random generator is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions import geometry as G
from zonomy.functions.common import stable_fraction
from zonomy.operators.ordered import first_n, with_rank, with_running_sum
from zonomy.operators.spatial import box_join


def _quota(n: Column, share: float) -> Column:
    """Half-even rounding, at least one from three members on, else none."""
    return F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * share, 0).cast("int"))).otherwise(F.lit(0))


def region_splits(areas: DataFrame, key: str = "aoi", region: str = "region", val: float = 0.15, test: float = 0.15,
                  salt: str = "areas-v1", forced: str | None = None) -> DataFrame:
    """Area-disjoint split inside each region by hash order; forced test areas win last."""
    d = areas.withColumn("_f", stable_fraction(key, salt))
    d = with_rank(d, [region], F.col("_f"), [F.col(key)], name="_r", total="_n")
    n_test, n_val = _quota(F.col("_n"), test), _quota(F.col("_n"), val)
    split = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "val").otherwise("train")
    if forced:
        split = F.when(F.col(forced), "test").otherwise(split)
    return d.withColumn("split", split).drop("_f", "_r", "_n")


def train_val_splits(cities: DataFrame, key: str = "city", region: str = "region", held_out: str = "held_out",
                     train: float = 0.8, salt: str = "cities-v1") -> DataFrame:
    """Held-out cities are test; the rest go to train or val per region, both non-empty when possible."""
    free = cities.where(~F.col(held_out)).withColumn("_f", stable_fraction(key, salt))
    d = with_rank(free, [region], F.col("_f"), [F.col(key)], name="_r", total="_n")
    n = F.when(F.col("_n") < 2, F.col("_n")).otherwise(
        F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * train, 0).cast("long")), F.col("_n") - 1))
    d = d.withColumn("split", F.when(F.col("_r") <= n, "train").otherwise("val")).drop("_f", "_r", "_n")
    return d.unionByName(cities.where(F.col(held_out)).withColumn("split", F.lit("test")))


def city_roles(cities: DataFrame, n_val: int, key: str = "city", group: str = "continent", weight: str = "weight",
               held_out: str = "held_out") -> DataFrame:
    """culture / val_inner / train: round-robin over continents, most cities first, heaviest city first."""
    free = cities.where(~F.col(held_out))
    size = free.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    d = with_rank(free, [group], -F.col(weight).cast("double"), [F.col(key)], name="_round").join(size, group)
    top = d.orderBy("_round", F.desc("_size"), group, key).limit(n_val).select(key).withColumn("_v", F.lit(True))
    return cities.join(top, key, "left").withColumn(
        "role", F.when(F.col(held_out), "culture").when(F.col("_v"), "val_inner").otherwise("train")).drop("_v")


def lookup_group(df: DataFrame, table: dict[str, str], key: Column, default: str = "Unknown") -> Column:
    """Region or continent of a code from a small fixed table."""
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def cell_splits(cells: DataFrame, patches: DataFrame, cell: float, buffer_m: float, min_labelled: float = 0.01) -> DataFrame:
    """One split or one drop reason per grid cell.

    ``cells`` has city, city_role, grid_id, lbox; ``patches`` city, grid_id, role (train, val,
    test) and rbox. Order of reasons: no labels (or only training patches of a held-out city),
    mixed roles, too close to a patch of the other split, too few labelled metres.
    """
    p = patches.join(cells.select("city", "grid_id", "city_role", "lbox"), ["city", "grid_id"])
    culture = F.col("city_role") == "culture"
    usable = ~(culture & (F.col("role") == "train"))
    per = p.groupBy("city", "grid_id").agg(
        F.min(F.when(usable, F.col("role"))).alias("_lo"), F.max(F.when(usable, F.col("role"))).alias("_hi"),
        F.count_if(~usable).alias("_train"), F.sum(G.shared_area(F.col("lbox"), F.col("rbox"))).alias("_a"))
    d = cells.join(per, ["city", "grid_id"], "left")
    # only cells of held-out cities need the proximity test, against the other role of their city
    want = d.where(culture & (F.col("_lo") == F.col("_hi"))).select(
        "city", "grid_id", F.when(F.col("_lo") == "test", "val").otherwise("test").alias("_other"), "lbox")
    near = box_join(
        want, patches.where(F.col("role") != "train").select(F.col("city").alias("_pc"), F.col("role").alias("_pr"), "rbox"),
        cell, margin=buffer_m, condition=(F.col("_pc") == F.col("city")) & (F.col("_pr") == F.col("_other")),
    ).select("city", "grid_id").distinct().withColumn("_near", F.lit(True))
    d = d.join(near, ["city", "grid_id"], "left")
    reason = (
        F.when(F.col("_lo").isNull(), F.when(F.col("_train") > 0, "culture_train").otherwise("no_labels"))
        .when(F.col("_lo") != F.col("_hi"), "mixed_split")
        .when(F.coalesce("_near", F.lit(False)), "buffer")
        .when(F.col("_a") / G.area(F.col("lbox")) < min_labelled, "sparse"))
    role = F.col("city_role")
    split = F.when(role == "train", "train").when(role == "val_inner", "val").when(F.col("_lo") == "test", "test").otherwise("culture_val")
    return d.select("city", "grid_id", reason.alias("drop_reason"), F.when(reason.isNull(), split).alias("split"))


# ── guards ───────────────────────────────────────────────────────────────────


def require_empty(df: DataFrame, message: str, show: int = 5) -> None:
    """Raise when a guard query finds rows; only a few of them reach the driver."""
    bad = df.limit(show).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    require_empty(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), f"{list(keys)} is not unique")
    return df


def split_violations(rows: DataFrame, key: str, split: str = "split", held_out: DataFrame | None = None) -> DataFrame:
    """Keys in more than one split, or held-out keys outside test."""
    multi = rows.groupBy(key).agg(F.countDistinct(split).alias("_n")).where(F.col("_n") > 1).select(
        key, F.lit("several splits").alias("problem"))
    if held_out is None:
        return multi
    leaked = rows.where(F.col(split) != "test").join(held_out.select(key), key, "left_semi").select(
        key, F.lit("held out but not test").alias("problem")).distinct()
    return multi.unionByName(leaked)


def assert_splits(rows: DataFrame, key: str, needed: Sequence[str], split: str = "split", held_out: DataFrame | None = None) -> None:
    require_empty(split_violations(rows, key, split, held_out), "split leakage")
    have = rows.agg(*[F.count_if(F.col(split) == s).alias(f"n{k}") for k, s in enumerate(needed)]).head() if needed else ()
    missing = [s for s, n in zip(needed, have) if not n]
    if missing:
        raise ValueError(f"empty splits: {missing}")


# ── sampling ─────────────────────────────────────────────────────────────────


def stratified_sample(df: DataFrame, cap: int, key: str, cls: str = "label", floor: int = 25, salt: str = "s") -> DataFrame:
    """About ``cap`` rows, each class with its share of them but at least min(n, floor)."""
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy())
    share = F.least(F.col("_n"), F.greatest(F.floor(F.col("_n") * cap / total), F.least(F.col("_n"), F.lit(floor)))).alias("_share")
    n = n.select(cls, share)
    return first_n(df.join(n, cls), [cls], stable_fraction(key, salt), F.col("_share"), [F.col(key)]).drop("_share")


def first_per_group(df: DataFrame, keys: Sequence[str], n: int, key: str, salt: str = "s", apply_to: Column | None = None) -> DataFrame:
    """The first n rows per group in hash order; rows outside ``apply_to`` pass through."""
    if apply_to is None:
        return first_n(df, keys, stable_fraction(key, salt), n, [F.col(key)])
    hit = F.coalesce(apply_to, F.lit(False))
    kept = first_n(df.where(hit), keys, stable_fraction(key, salt), n, [F.col(key)])
    return kept.unionByName(df.where(~hit))


def fixed_size(df: DataFrame, n: int, key: str, salt: str = "s") -> DataFrame:
    """n rows in hash order (a distributed top-n)."""
    return df.orderBy(stable_fraction(key, salt), key).limit(n)


def capped_sample(df: DataFrame, key: str, per_tile: int, per_class: int, rare: Sequence[int] = (), tile: str = "tile",
                  cls: str = "class", salt: str = "s") -> DataFrame:
    """At most ``per_tile`` rows per (tile, class) and then ``per_class`` per class, rare classes exempt.

    The running caps of a sequential scan depend on file order; here the order is a hash.
    """
    free = F.col(cls).isin(*rare) if rare else F.lit(False)
    capped = first_n(df.where(~free), [tile, cls], stable_fraction(key, salt), per_tile, [F.col(key)])
    capped = first_n(capped, [cls], stable_fraction(key, salt), per_class, [F.col(key)])
    return capped.unionByName(df.where(free)) if rare else capped


def balanced_sample(df: DataFrame, total: int, key: str, keys: Sequence[str] = ("city", "class"), salt: str = "s") -> DataFrame:
    """An equal quota per group (ceil of total over groups); what small groups lack is drawn from
    the remaining rows in hash order."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n_groups = F.count(F.lit(1)).over(Window.partitionBy())  # over the group table, not the rows
    quota = groups.select(*keys, F.ceil(F.lit(float(total)) / n_groups).alias("_q"), n_groups.alias("_g"))
    d = df.join(quota, list(keys)).withColumn("_h", stable_fraction(key, salt))
    d = with_rank(d, keys, F.col("_h"), [F.col(key)], name="_r")
    order = F.when(F.col("_r") <= F.col("_q"), F.col("_h")).otherwise(1 + F.col("_h"))
    d = with_rank(d, [], order, [F.col(key)], name="_o")
    return d.where(F.col("_o") <= F.col("_q") * F.col("_g")).drop("_q", "_g", "_h", "_r", "_o")


def paired_ids(inventory: DataFrame, families: Sequence[str], n: int, key: str = "uid", source: str = "family", salt: str = "s") -> DataFrame:
    """n keys present in every family, in hash order."""
    ids = inventory.where(F.col(source).isin(*families)).groupBy(key).agg(F.countDistinct(source).alias("_n"))
    return fixed_size(ids.where(F.col("_n") == len(set(families))).select(key), n, key, salt)


def draw_weighted(df: DataFrame, n: int, weight: Column, key: str, salt: str = "draw") -> DataFrame:
    """n draws with replacement, each row with probability proportional to its weight.

    Draw i is the row whose cumulative interval holds i's hashed uniform. Both sides are
    keyed by slots of the weight axis, so the range join is an equi-join on slots; heavy
    rows cover many slots and are spread with them.
    """
    spark = df.sparkSession
    pos = df.withColumn("_wt", weight.cast("double")).where(F.col("_wt") > 0)
    whole = pos.agg(F.sum("_wt")).head()[0] or 1.0
    pos = pos.withColumn("_wt", F.greatest(F.round(F.col("_wt") / whole * 2.0**52), F.lit(1.0)).cast("long"))
    run = with_running_sum(pos, [], stable_fraction(key, salt), F.col("_wt"), [F.col(key)], name="_hi", total="_t")
    # weights are whole shares of 2^52, so an upper border is the next row's lower one
    run = run.withColumns({"_b": F.col("_hi") / F.col("_t"), "_a": (F.col("_hi") - F.col("_wt")) / F.col("_t")})
    slots = max(1, min(n, 1 << 20))
    run = run.withColumn("_slot", F.explode(F.sequence(
        F.floor(F.col("_a") * slots), F.least(F.floor(F.col("_b") * slots), F.lit(slots - 1)))))
    draws = spark.range(n).select(F.col("id").alias("draw"), stable_fraction("id", salt + "-u").alias("_u"))
    draws = draws.withColumn("_slot", F.floor(F.col("_u") * slots))
    hit = (F.col("_u") >= F.col("_a")) & (F.col("_u") < F.col("_b"))
    return draws.join(run, "_slot").where(hit).drop("_slot", "_u", "_a", "_b", "_hi", "_t", "_wt")


def class_draw_weights(df: DataFrame, cls: str = "class", scheme: str = "inverse") -> DataFrame:
    """Row weight 1/count or 1/sqrt(count) of its class."""
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    w = 1 / F.col("_n") if scheme == "inverse" else 1 / F.sqrt(F.col("_n"))
    return df.join(n, cls).withColumn("draw_weight", w).drop("_n")


def members_per_block(df: DataFrame, block: str, k: int, key: str, salt: str = "s") -> DataFrame:
    """Up to k rows per block in hash order as an array, and how many slots are filled."""
    d = first_n(df, [block], stable_fraction(key, salt), k, [F.col(key)])
    return d.groupBy(block).agg(F.array_sort(F.collect_list(key)).alias("members"), F.count(F.lit(1)).alias("n_members"))
