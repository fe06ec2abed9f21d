"""Exact ranks, quantiles and top-n inside groups of any size.

A plain window puts a whole group in one task. Here each group is first cut into value
ranges by an approximate quantile sketch (bounded, combined on the map side); rows are
then ranked inside (group, range) and shifted by the number of rows in the ranges before.
The result is exact whatever the sketch error, which only moves the range borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.session import cut_lineage

RANGES = 256
GROUP_LIMIT = 1000  # Spark's own bound for limiting groups before a shuffle
_KEY = "__o_all"


def _group_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(_KEY, F.lit(0)), [_KEY])


def with_ranges(df: DataFrame, keys: Sequence[str], value: Column, ranges: int = RANGES) -> DataFrame:
    """Add ``_r``: index of the value range of each row inside its group (equal values share a range)."""
    cuts = [i / ranges for i in range(1, ranges)]
    d = df.withColumn("__o_v", value.cast("double"))
    sketch = d.groupBy(*keys).agg(F.percentile_approx("__o_v", F.array(*map(F.lit, cuts)), F.lit(1000)).alias("__o_cuts"))
    j = d.join(F.broadcast(sketch) if list(keys) == [_KEY] else sketch, list(keys))
    below = F.size(F.filter("__o_cuts", lambda c: c < F.col("__o_v")))
    return j.withColumn("__o_r", F.when(F.col("__o_v").isNull(), F.lit(ranges)).otherwise(below)).drop("__o_cuts")


def with_offsets(df: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Add ``_before``: rows (or weight) in the earlier ranges of the group, and ``_total``."""
    w = weight if weight is not None else F.lit(1).cast("long")
    per = df.groupBy(*keys, "__o_r").agg(F.sum(w).alias("__o_n"))
    order = Window.partitionBy(*keys).orderBy("__o_r")
    per = per.select(
        *keys, "__o_r",
        (F.sum("__o_n").over(order) - F.col("__o_n")).alias("__o_before"),
        F.sum("__o_n").over(Window.partitionBy(*keys)).alias("__o_total"),
    )
    return df.join(F.broadcast(per) if list(keys) == [_KEY] else per, [*keys, "__o_r"])


def with_rank(
    df: DataFrame, keys: Sequence[str], first: Column, then: Sequence[Column] = (), name: str = "rank",
    total: str | None = None, ranges: int = RANGES,
) -> DataFrame:
    """Exact ``row_number`` (1-based) of each row in its group, ascending by ``first`` then ``then``.

    Rows of one ``first`` value share a range, so ``first`` should vary; draws use a hash of the key.
    """
    d, ks = _group_keys(df, keys)
    d = with_offsets(with_ranges(d, ks, first, ranges), ks)
    w = Window.partitionBy(*ks, "__o_r").orderBy(F.col("__o_v").asc_nulls_last(), *then)
    d = d.withColumn(name, F.col("__o_before") + F.row_number().over(w))
    if total:
        d = d.withColumn(total, F.col("__o_total"))
    return d.drop("__o_r", "__o_v", "__o_before", "__o_total", _KEY)


def with_running_sum(
    df: DataFrame, keys: Sequence[str], first: Column, weight: Column, then: Sequence[Column] = (),
    name: str = "running", total: str = "total",
) -> DataFrame:
    """Inclusive running sum of ``weight`` in group order, and the group total."""
    d, ks = _group_keys(df.withColumn("__o_w", weight), keys)
    d = with_offsets(with_ranges(d, ks, first), ks, F.col("__o_w"))
    w = Window.partitionBy(*ks, "__o_r").orderBy(F.col("__o_v").asc_nulls_last(), *then)
    frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn(name, F.col("__o_before") + F.sum("__o_w").over(frame)).withColumn(total, F.col("__o_total"))
    return d.drop("__o_r", "__o_v", "__o_w", "__o_before", "__o_total", _KEY)


def name_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Exact 1-based rank of each distinct ``key`` in its own order, whatever its type, by range partitions."""
    parts = cut_lineage(df.select(key).distinct().repartitionByRange(key).withColumn("__o_p", F.spark_partition_id()))
    per = parts.groupBy("__o_p").agg(F.count(F.lit(1)).alias("__o_n"))  # one row per partition
    before = F.sum("__o_n").over(Window.orderBy("__o_p")) - F.col("__o_n")
    own = F.row_number().over(Window.partitionBy("__o_p").orderBy(key))
    return parts.join(F.broadcast(per.select("__o_p", before.alias("__o_b"))), "__o_p").select(key, (F.col("__o_b") + own).alias(name))


def with_average_rank(df: DataFrame, keys: Sequence[str], value: Column, name: str = "avg_rank") -> DataFrame:
    """Rank with ties averaged, as used by rank correlation; null values get no rank."""
    d = df.withColumn("__o_x", value.cast("double"))
    counts = d.where(F.col("__o_x").isNotNull()).groupBy(*keys, "__o_x").agg(F.count(F.lit(1)).alias("__o_c"))
    run = with_running_sum(counts, keys, F.col("__o_x"), F.col("__o_c"), name="__o_run", total="__o_t")
    ranks = run.select(*keys, "__o_x", (F.col("__o_run") - (F.col("__o_c") - 1) / 2).alias(name))
    return d.join(ranks, [*keys, "__o_x"], "left").drop("__o_x")


def first_n(
    df: DataFrame, keys: Sequence[str], order: Column, n: Column | int, then: Sequence[Column] = ()
) -> DataFrame:
    """Rows with the n smallest ``order`` values per group; ``n`` may be a column of the row.

    For a constant n up to ``GROUP_LIMIT`` Spark cuts every task's part of a group to n rows before the
    shuffle, so a plain window is safe for groups of any size; a larger n goes through exact ranks.
    """
    if isinstance(n, int) and n <= GROUP_LIMIT:
        w = Window.partitionBy(*keys).orderBy(order.asc_nulls_last(), *then)
        return df.withColumn("__o_rank", F.row_number().over(w)).where(F.col("__o_rank") <= n).drop("__o_rank")
    return with_rank(df, keys, order, then, name="__o_rank").where(F.col("__o_rank") <= n).drop("__o_rank")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float], ranges: int = RANGES,
    count: Column | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group, one column per entry of ``probs``; nulls and NaN ignored.

    Values are counted first, so repeated values never travel; ``count`` says how often a row
    counts when the input is already counted. All three uses of the counted table keep the same
    columns, so Spark reuses one shuffle for them.
    """
    d, ks = _group_keys(df.withColumn("__o_x", value.cast("double")), keys)
    d = d.where(F.col("__o_x").isNotNull() & ~F.isnan("__o_x"))
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    counts = d.groupBy(*ks, "__o_x").agg(n.cast("long").alias("__o_c"))
    parts = with_offsets(with_ranges(counts, ks, F.when(F.col("__o_c") > 0, F.col("__o_x")), ranges), ks, F.col("__o_c"))
    w = Window.partitionBy(*ks, "__o_r").orderBy("__o_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.col("__o_before") + F.sum("__o_c").over(w)
    ranked = parts.withColumn("__o_hi", hi).withColumn("__o_lo", F.col("__o_hi") - F.col("__o_c"))
    aggs = []
    for name, p in probs.items():
        at = (F.col("__o_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        holds = lambda r: (F.col("__o_lo") <= r) & (r < F.col("__o_hi"))
        a = F.max(F.when(holds(low), F.col("__o_x")))
        b = F.max(F.when(holds(high), F.col("__o_x")))
        frac = F.max(at - low)
        aggs.append((a + (b - a) * frac).alias(name))
    return ranked.groupBy(*ks).agg(*aggs).drop(_KEY)


def quantiles_of(df: DataFrame, keys: Sequence[str], values: dict[str, Column], probs: dict[str, float]) -> DataFrame:
    """Quantiles of several columns in one pass: one row per group, columns named value_prob."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("__o_name"), c.cast("double").alias("__o_val")) for n, c in values.items()]))
    d = df.select(*keys, each.alias("__o_e")).select(*keys, "__o_e.*")
    q = exact_quantiles(d, [*keys, "__o_name"], F.col("__o_val"), probs)
    cells = [F.max(F.when(F.col("__o_name") == n, F.col(p))).alias(f"{n}_{p}") for n in values for p in probs]
    return q.groupBy(*keys).agg(*cells)
