"""Confusion tables and the accuracy figures derived from them.

Every figure starts from one grouped count over (keys, truth, predicted), which Spark
combines on the map side; all later steps work on at most 17 x 17 rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.functions.common import BUILT, N_CLASSES, packed_mode

EPS = 1e-12


def confusion_counts(
    df: DataFrame, truth: str = "truth", pred: str = "pred", keys: Sequence[str] = (), n_classes: int = N_CLASSES
) -> DataFrame:
    """Long confusion table (keys, truth, pred, n); rows without a valid truth or prediction are ignored."""
    valid = F.col(truth).between(1, n_classes) & F.col(pred).between(1, n_classes)
    return (
        df.where(valid)
        .groupBy(*keys, F.col(truth).cast("int").alias("truth"), F.col(pred).cast("int").alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dense_confusion(counts: DataFrame, keys: Sequence[str] = (), n_classes: int = N_CLASSES) -> DataFrame:
    """All truth x predicted cells of every key, zero where no row fell."""
    side = F.sequence(F.lit(1), F.lit(n_classes))
    base = counts.select(*keys).distinct() if keys else counts.groupBy().agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    grid = base.select(*keys, F.explode(side).alias("truth")).select("*", F.explode(side).alias("pred"))
    zeros = grid.withColumn("n", F.lit(0).cast("long"))
    return (
        zeros.unionByName(counts.select(*keys, "truth", "pred", F.col("n").cast("long").alias("n")))
        .groupBy(*keys, "truth", "pred")
        .agg(F.sum("n").alias("n"))
    )


def class_scores(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted count, true positives, precision, recall, F1 (zero when undefined)."""
    n = F.col("n")
    zero = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col("truth").alias("cls"), n.alias("t"), zero.alias("p"),
                 F.when(F.col("truth") == F.col("pred"), n).otherwise(zero).alias("tp")),
        F.struct(F.col("pred").alias("cls"), zero.alias("t"), n.alias("p"), zero.alias("tp")),
    )
    per = (
        counts.select(*keys, F.inline(roles))
        .groupBy(*keys, "cls")
        .agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))
    )
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    return per.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)),
    )


def summary_scores(
    counts: DataFrame, keys: Sequence[str] = (), macro: str = "present", n_classes: int = N_CLASSES
) -> DataFrame:
    """OA, kappa, macro recall and macro-F1 per key.

    ``macro`` picks the classes averaged: ``present`` in truth or prediction, present in
    ``truth`` only, or ``all`` classes with zero for absent ones. Micro-F1 of a single-label
    problem equals OA and is returned under its own name.
    """
    total = F.sum("support")
    kept = {"present": F.lit(True), "truth": F.col("support") > 0, "all": F.lit(True)}[macro]
    denom = F.lit(float(n_classes)) if macro == "all" else F.count_if(kept).cast("double")
    out = class_scores(counts, keys).groupBy(*keys).agg(
        total.alias("n"),
        (F.sum("tp") / total).alias("oa"),
        (F.sum(F.col("support").cast("double") * F.col("predicted")) / (total.cast("double") * total)).alias("_pe"),
        (F.sum(F.when(kept, F.col("f1"))) / denom).alias("f1_macro"),
        (F.sum("recall") / F.lit(float(n_classes))).alias("acc_macro"),
    )
    kappa = F.when(F.abs(1 - F.col("_pe")) > EPS, (F.col("oa") - F.col("_pe")) / (1 - F.col("_pe")))
    return out.withColumn("kappa", kappa).withColumn("f1_micro", F.col("oa")).drop("_pe")


def spread(scores: DataFrame, value: str = "kappa", keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, minimum and maximum of a figure over the groups of ``scores``."""
    return scores.groupBy(*keys).agg(
        F.count(value).alias("n_groups"),
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_pop(value).alias(f"{value}_std"),
        F.min(value).alias(f"{value}_min"),
        F.max(value).alias(f"{value}_max"),
    )


def weighted_scores(
    counts: DataFrame, weights: Sequence[Sequence[float]], keys: Sequence[str] = (), n_classes: int = N_CLASSES
) -> DataFrame:
    """Similarity-weighted OA and kappa, OA on built types only, OA of built against natural.

    The marginals are 17 numbers per key, so the expected agreement is one array expression.
    """
    classes = range(1, n_classes + 1)
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in weights])
    n = F.col("n").cast("double")
    built_t, built_p = F.col("truth").isin(*BUILT), F.col("pred").isin(*BUILT)
    wij = F.get(F.get(w, F.col("truth") - 1), F.col("pred") - 1)
    base = counts.groupBy(*keys).agg(
        F.sum(n).alias("_n"),
        F.sum(wij * n).alias("_wn"),
        F.sum(F.when(built_t & built_p, n).otherwise(0.0)).alias("_bn"),
        F.sum(F.when(built_t & (F.col("truth") == F.col("pred")), n).otherwise(0.0)).alias("_bc"),
        F.sum(F.when(built_t == built_p, n).otherwise(0.0)).alias("_same"),
        F.array(*[F.sum(F.when(F.col("truth") == c, n).otherwise(0.0)) for c in classes]).alias("_rows"),
        F.array(*[F.sum(F.when(F.col("pred") == c, n).otherwise(0.0)) for c in classes]).alias("_cols"),
    )

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    expected = F.aggregate(
        F.zip_with(F.col("_rows"), w, lambda r, wr: r * dot(wr, F.col("_cols"))), F.lit(0.0), lambda s, v: s + v
    )
    po = F.col("_wn") / F.col("_n")
    pe = expected / (F.col("_n") * F.col("_n"))
    return base.select(
        *keys,
        F.col("_n").cast("long").alias("n"),
        F.when(F.col("_bn") > 0, F.col("_bc") / F.col("_bn")).alias("oa_urban"),
        (F.col("_same") / F.col("_n")).alias("oa_built_natural"),
        po.alias("oa_weighted"),
        F.when(F.abs(1 - pe) > EPS, (po - pe) / (1 - pe)).alias("kappa_weighted"),
    )


def row_normalised(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each prediction within its truth row, with the row support."""
    support = counts.groupBy(*keys, "truth").agg(F.sum("n").alias("support"))
    return counts.join(support, [*keys, "truth"]).withColumn("share", F.col("n") / F.col("support"))


def labelled_pairs(df: DataFrame) -> DataFrame:
    """Rows with an emitted label and a truth, and whether the truth is in the label set."""
    return df.where(F.col("label_type").isin("hard", "coarse") & F.col("truth").isNotNull()).withColumn(
        "correct", F.array_contains("lcz_set", F.col("truth"))
    )


def set_aware_report(df: DataFrame, keys: Sequence[str] = (), high: float = 0.8) -> DataFrame:
    """Set-membership agreement: OA, OA and macro accuracy at high confidence, share of coarse labels."""
    m = labelled_pairs(df).withColumn("_hi", F.col("confidence") >= high)
    per_class = m.groupBy(*keys, "truth").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("ok"),
        F.count_if("_hi").alias("n_hi"),
        F.count_if(F.col("_hi") & F.col("correct")).alias("ok_hi"),
        F.count_if(F.col("label_type") == "coarse").alias("n_coarse"),
    )
    return per_class.groupBy(*keys).agg(
        F.sum("n").alias("n_matched"),
        (F.sum("ok") / F.sum("n")).alias("oa_all"),
        F.sum("n_hi").alias("n_high_conf"),
        F.when(F.sum("n_hi") > 0, F.sum("ok_hi") / F.sum("n_hi")).alias("oa_high"),
        F.avg(F.when(F.col("n_hi") > 0, F.col("ok_hi") / F.col("n_hi"))).alias("aa_high"),
        F.sum("n_coarse").alias("n_coarse"),
        (F.sum("n_coarse") / F.sum("n")).alias("coarse_frac"),
    )


def top_confusions(df: DataFrame, k: int = 5, high: float = 0.8) -> DataFrame:
    """The k most frequent wrong hard labels at high confidence."""
    m = labelled_pairs(df).where(
        (F.col("confidence") >= high) & (F.col("label_type") == "hard") & ~F.col("correct")
    )
    return (
        m.groupBy("truth", F.col("lcz").alias("pred"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "truth", "pred")
        .limit(k)
    )


def confidence_sweep(
    df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), correct: str = "correct", tol: float = 1e-9
) -> DataFrame:
    """Accuracy of the rows at or above each threshold, and whether the sequence never falls.

    Rows are counted once into the band they reach; the cumulative figures come from the
    band counts, so the cost does not grow with the number of thresholds.
    """
    ts = sorted(thresholds)
    band = F.lit(-1)
    for i, t in enumerate(ts):
        band = F.when(F.col("confidence") >= F.lit(float(t)), F.lit(i)).otherwise(band)
    bands = (
        df.withColumn("_b", band)
        .groupBy(*keys)
        .agg(*[F.count_if(F.col("_b") >= i).alias(f"_n{i}") for i in range(len(ts))],
             *[F.count_if((F.col("_b") >= i) & F.col(correct)).alias(f"_k{i}") for i in range(len(ts))])
    )
    acc = [F.when(F.col(f"_n{i}") > 0, F.col(f"_k{i}") / F.col(f"_n{i}")) for i in range(len(ts))]
    seq = F.filter(F.array(*acc), lambda x: x.isNotNull())
    steady = F.forall(
        F.zip_with(seq, F.slice(seq, 2, len(ts)), lambda a, b: F.coalesce(b >= a - tol, F.lit(True))), lambda x: x
    )
    cells = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_n{i}").alias("n"), acc[i].alias("accuracy"))
        for i, t in enumerate(ts)
    ])
    return bands.withColumn("monotone", steady).select(*keys, "monotone", F.inline(cells))


def single_class_audit(df: DataFrame, cls: int = 7, rival: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Where the rows of one truth class were routed, and how pure its hard label is."""
    m = labelled_pairs(df)
    hard = F.col("label_type") == "hard"
    gt = F.col("truth") == cls
    pred = hard & (F.col("lcz") == cls)
    pair = F.array_sort(F.array(F.lit(cls), F.lit(rival)))
    to_pair = gt & (F.array_sort(F.col("lcz_set").cast("array<int>")) == pair)
    s = m.groupBy(*keys).agg(
        F.count_if(gt).alias("n_truth"),
        F.count_if(pred).alias("n_pred_hard"),
        F.count_if(pred & gt).alias("_tp"),
        F.count_if(gt & hard & (F.col("lcz") == rival)).alias("_rival"),
        F.count_if(to_pair).alias("_pair"),
        F.count_if((F.col("truth") == rival) & pred).alias("rival_to_hard"),
    )
    n = F.col("n_truth")
    share = lambda c: F.when(n > 0, c / n)
    return s.select(
        *keys, "n_truth", "n_pred_hard", "rival_to_hard",
        F.when(F.col("n_pred_hard") > 0, F.col("_tp") / F.col("n_pred_hard")).alias("precision"),
        share(F.col("_tp")).alias("recall"),
        share(F.col("_pair")).alias("to_coarse_pair"),
        share(F.col("_rival")).alias("contamination"),
        share(n - F.col("_tp") - F.col("_rival") - F.col("_pair")).alias("to_other"),
    )


def block_scores(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Block-level figures: set-aware OA, coarse OA, and macro-F1 over the truth classes of hard rows."""
    scored = df.where(F.col("label_type").isin("hard", "coarse") & (F.col("pred") > 0)).withColumn(
        "correct", F.array_contains("lcz_set", F.col("pred"))
    )
    coarse = F.col("label_type") == "coarse"
    head = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("correct").cast("double")).alias("oa"),
        F.count_if(coarse).alias("n_coarse"),
        F.avg(coarse.cast("double")).alias("coarse_frac"),
        F.avg(F.when(coarse, F.col("correct").cast("double"))).alias("coarse_oa"),
    )
    counts = confusion_counts(scored.where(~coarse), "lcz", "pred", keys)
    tail = summary_scores(counts, keys, macro="truth").select(*keys, "f1_macro", F.col("oa").alias("hard_oa"))
    if keys:
        return head.join(tail, list(keys), "left")
    one = F.lit(1).alias("_one")
    return head.withColumn("_one", one).join(tail.withColumn("_one", one), "_one", "left").drop("_one")


def majority_vote(df: DataFrame, block: str = "block_id", pred: str = "pred") -> DataFrame:
    """Most frequent class per block, the lowest class on ties."""
    return (
        df.where(F.col(block).isNotNull())
        .groupBy(block, pred)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(block)
        .agg(packed_mode(pred, "n").alias(pred), F.sum("n").alias("votes"))
    )


def entropy_bits(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Shannon entropy of the label mix of each group."""
    share = F.col("n") / F.col("_t")
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return (
        counts.join(totals, list(keys))
        .groupBy(*keys)
        .agg(F.first("_t").alias("n"), F.greatest(F.sum(-share * F.log2(share)), F.lit(0.0)).alias("entropy"))
    )
