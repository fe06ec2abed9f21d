"""Multi-annotator votes per pixel and the consensus decision.

A vote table has one row per (aoi, pixel, annotator, submission): class, weight, date.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from zonomy.functions.common import N_CLASSES, clip, stable_fraction
from zonomy.operators.ordered import quantiles_of
from zonomy.session import broadcast_if_small, cut_lineage, stored

MAX_AREAS = 100_000
#: Votes at most whose pixels are scored in one go when authors are left out.
CHUNK = 1 << 25


@dataclass(frozen=True)
class ConsensusRules:
    """Fixed decision values; override per call."""

    tau_mass: float = 0.65
    max_set_size: int = 3
    min_p_top: float = 0.35
    prior_alpha: float = 1.0
    depth_base: float = 0.40
    depth_per_annotator: float = 0.15


def newest_votes(votes: DataFrame, keys: Sequence[str] = ("aoi", "pixel", "annotator")) -> DataFrame:
    """One vote per annotator and pixel: the newest (date, submission) wins, non-positive weights never vote.

    A ``max`` over a struct combines on the map side, so an annotator's repeated
    revisions collapse before the shuffle and no group is ever sorted.
    """
    top = F.max(F.struct("date", "submission", "class", "weight")).alias("_v")
    return (
        votes.where(F.col("weight") > 0)
        .groupBy(*keys)
        .agg(top)
        .select(*keys, F.col("_v.class").alias("class"), F.col("_v.weight").alias("weight"))
    )


def accumulate(votes: DataFrame, keys: Sequence[str] = ("aoi", "pixel")) -> DataFrame:
    """Per pixel: total weight, sum of squares and the 17 class weights as one array."""
    w = F.col("weight")
    return votes.groupBy(*keys).agg(
        F.sum(w).alias("w1"),
        F.sum(w * w).alias("w2"),
        F.array(*[F.sum(F.when(F.col("class") == c, w).otherwise(0.0)) for c in range(1, N_CLASSES + 1)]).alias("s"),
    )


def class_prior(acc: DataFrame, aoi: Sequence[str] = ("aoi",)) -> DataFrame:
    """Per area: class share of all weight and the mean weight of one effective annotator."""
    totals = [F.sum(F.get("s", F.lit(i))) for i in range(N_CLASSES)]
    n_eff = F.col("w1") * F.col("w1") / F.col("w2")
    return (
        acc.groupBy(*aoi)
        .agg(F.array(*totals).alias("_t"), F.sum("w1").alias("_w"), F.avg(F.col("w1") / n_eff).alias("mean_w"))
        .select(*aoi, F.transform("_t", lambda t: t / F.col("_w")).alias("prior"), "mean_w")
    )


def decide(acc: DataFrame, aoi: Sequence[str] = ("aoi",), rules: ConsensusRules = ConsensusRules(),
           keep_rejected: bool = False) -> DataFrame:
    """Smoothed posterior, smallest class set that reaches the mass, rejection and depth-scaled confidence.

    The ranking is over 17 numbers that already sit in one row, so it is an array
    expression and needs no window.
    """
    acc = cut_lineage(acc)  # read twice: for the area priors and for the pixels
    prior = broadcast_if_small(class_prior(acc, aoi), MAX_AREAS)
    return _decide(acc.join(prior, list(aoi)), rules, keep_rejected)


_WORK = ("w1", "w2", "s", "prior", "mean_w")


def _decide(p: DataFrame, rules: ConsensusRules, keep_rejected: bool = False) -> DataFrame:
    alpha = F.lit(rules.prior_alpha) * F.greatest(F.col("mean_w"), F.lit(1e-6))
    posterior = F.zip_with("s", "prior", lambda s, q: (s + alpha * q) / (F.col("w1") + alpha))
    cells = F.transform(posterior, lambda x, i: F.struct((-x).alias("neg"), (i + 1).cast("int").alias("cls")))
    top = F.slice(F.array_sort(cells), 1, rules.max_set_size + 1)
    zero = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("mask"))

    def grow(a: Column, x: Column) -> Column:
        grown = F.struct(
            (a["mass"] - x["neg"]).alias("mass"),
            (a["n"] + 1).alias("n"),
            a["mask"].bitwiseOR(F.pow(F.lit(2.0), x["cls"] - 1).cast("long")).alias("mask"),
        )
        return F.when(a["mass"] < rules.tau_mass, grown).otherwise(a)

    d = p.withColumn("_top", top).withColumn("_set", F.aggregate("_top", zero, grow))
    n_eff = F.col("w1") * F.col("w1") / F.col("w2")
    p_top = -F.col("_top")[0]["neg"]
    reject = (F.col("_set.n") > rules.max_set_size) | (p_top < rules.min_p_top)
    depth = clip(rules.depth_base + rules.depth_per_annotator * n_eff, 0.0, 1.0)
    out = d.select(
        *[c for c in p.columns if c not in _WORK],
        F.when(reject, F.lit(0).cast("long")).otherwise(F.col("_set.mask")).alias("bitmask"),
        F.when(reject, F.lit(0.0)).otherwise(clip(F.col("_set.mass") * depth, 0.0, 1.0)).alias("confidence"),
        F.when(reject, F.lit(0)).otherwise(F.col("_top")[0]["cls"]).alias("top_class"),
        p_top.alias("p_top"),
        F.col("_set.mass").alias("p_set"),
        n_eff.alias("n_eff"),
        F.col("_set.n").alias("set_size"),
    )
    return out if keep_rejected else out.where(F.col("bitmask") > 0)


def consensus(votes: DataFrame, rules: ConsensusRules = ConsensusRules(), **kw) -> DataFrame:
    """Votes to decided pixels."""
    return decide(accumulate(newest_votes(votes)), rules=rules, **kw)


def smallest_shape_wins(votes: DataFrame, keys: Sequence[str] = ("aoi", "pixel")) -> DataFrame:
    """Baseline without voting: the class of the smallest shape over the pixel (lowest id on equal areas)."""
    return votes.groupBy(*keys).agg(F.min_by("class", F.struct("area", "submission", "class")).alias("class"))


def _left_votes(votes: DataFrame, authors: DataFrame) -> DataFrame:
    """One row per vote of an author to hold out: class and weight, the peer's class there, and the pixel's sums over everyone.

    Votes meet their author first and then their pixel; there a vote asks under its peer's name, so that no second join is made.
    """
    fit = authors.select("aoi", F.col("held").alias("annotator"), "peer", F.lit(True).alias("_fit"))
    rows = votes.join(fit, ["aoi", "annotator"], "left").repartition("aoi", "pixel")
    name = lambda c, asks: F.struct(F.col(c).alias("_name"), F.lit(asks).alias("_asks"))
    rows = rows.withColumn("_n", F.explode(F.when(F.col("_fit"), F.array(name("annotator", False), name("peer", True))).otherwise(F.array(name("annotator", False)))))
    rows = rows.select("aoi", "pixel", F.col("annotator").alias("held"), "class", "weight", "_n._name", "_n._asks")
    pixel = Window.partitionBy("aoi", "pixel")
    w = F.when(~F.col("_asks"), F.col("weight"))
    rows = rows.withColumn("peer_class", F.max(F.when(~F.col("_asks"), F.col("class"))).over(Window.partitionBy("aoi", "pixel", "_name")))
    sums = {f"_s{c}": F.sum(F.when(F.col("class") == c, w).otherwise(0.0)).over(pixel) for c in range(1, N_CLASSES + 1)}
    rows = rows.withColumns({"w1": F.sum(w).over(pixel), "w2": F.sum(w * w).over(pixel), **sums}).where("_asks")
    return rows.select("aoi", "held", F.col("class").alias("truth"), "peer_class", F.col("weight").alias("hw"), "w1", "w2", F.array(*sums).alias("s"))


def _masks(rules: ConsensusRules):
    """The set that the others of a pixel decide on, 0 if rejected, by the rules of ``_decide``; many rows at once."""
    def columns(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_CLASSES)

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hw, w1, mean_w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("hw", "w1", "mean_w"))
            truth = pc.fill_null(batch.column("truth"), 0).to_numpy()
            s, own = columns(batch, "s").copy(), np.flatnonzero((truth >= 1) & (truth <= N_CLASSES))
            at = own, truth[own] - 1
            s[at] = np.maximum(s[at] - hw[own], 0.0)
            alpha = (rules.prior_alpha * np.fmax(mean_w, 1e-6))[:, None]
            posterior = (s + alpha * columns(batch, "prior")) / ((w1 - hw)[:, None] + alpha)
            top = np.argsort(-posterior, axis=1, kind="stable")[:, :rules.max_set_size + 1]
            p = np.take_along_axis(posterior, top, axis=1)
            mass, n, mask = np.zeros(len(p)), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for x, c in zip(p.T, top.T):
                grows = mass < rules.tau_mass
                mass, n, mask = np.where(grows, mass + x, mass), n + grows, np.where(grows, mask | (1 << c), mask)
            mask[(n > rules.max_set_size) | (p[:, 0] < rules.min_p_top)] = 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("aoi", "truth", "peer_class")), pa.array(mask)], names=["aoi", "truth", "peer_class", "bitmask"])

    return masks


def leave_one_out(
    votes: DataFrame, authors: DataFrame, rules: ConsensusRules = ConsensusRules(), min_others: int = 2, chunk: int = CHUNK
) -> DataFrame:
    """Agreement of each held-out annotator with the consensus of the others and with one peer.

    ``authors`` has (aoi, held, peer). Removing one annotator is a subtraction: the pixel
    sums of everyone are built and the held annotator's own vote is taken off, so no
    vote is copied once per fold. Pixels go in parts of about ``chunk`` votes, and what a part
    shuffles is dropped after it, so that the disk holds the votes and one part.
    """
    authors = stored(authors)  # read for every part
    v = stored(newest_votes(votes).where(F.col("aoi").isNotNull() & F.col("pixel").isNotNull()))
    parts = max(1, -(-v.count() // chunk))
    some = [v.where(F.pmod(F.xxhash64("pixel"), F.lit(parts)) == i) for i in range(parts)]
    together = lambda tables: reduce(DataFrame.unionByName, tables)
    # area-wide sums, and what a held annotator has of them
    pixel = Window.partitionBy("aoi", "pixel")
    hw, n_gone = F.col("weight"), lambda w1: ~(w1 - hw > 1e-9)
    w1, w2 = F.col("w1"), F.col("w2")
    rest = F.when(n_gone(w1), 0.0).otherwise(F.greatest(w2 - hw * hw, F.lit(0.0)) / (w1 - hw))
    own, area = [], []
    for x in some:
        x = x.repartition("aoi", "pixel")
        seen = x.withColumns({"w1": F.sum(hw).over(pixel), "w2": F.sum(hw * hw).over(pixel)})
        own.append(stored(seen.groupBy("aoi", F.col("annotator").alias("held"), "class").agg(
            F.sum(hw).alias("h"), F.sum(w2 / w1 - rest).alias("dm"), F.count_if(n_gone(w1)).alias("gone"))))
        sums = x.groupBy("aoi", "pixel").agg(F.sum(hw).alias("w1"), F.sum(hw * hw).alias("w2"))
        area.append(stored(sums.groupBy("aoi").agg(F.sum("w1").alias("_w"), F.sum(w2 / w1).alias("_m"), F.count(F.lit(1)).alias("_n"))))
    by_class = F.array(*[F.sum(F.when(F.col("class") == c, F.col("h")).otherwise(0.0)) for c in range(1, N_CLASSES + 1)])
    whole = together(area).groupBy("aoi").agg(*[F.sum(c).alias(c) for c in ("_w", "_m", "_n")])
    totals = together(own).groupBy("aoi", "class").agg(F.sum("h").alias("h")).groupBy("aoi").agg(by_class.alias("_t"))
    held = together(own).repartition("aoi", "held").groupBy("aoi", "held").agg(
        by_class.alias("_ht"), F.sum("h").alias("_hsum"), F.sum("dm").alias("_dm"), F.sum("gone").alias("_gone"))
    areas = broadcast_if_small(stored(whole.join(totals, "aoi")), MAX_AREAS)
    prior = stored(held.join(areas, "aoi").join(authors.select("aoi", "held"), ["aoi", "held"], "left_semi").select(
        "aoi", "held",
        F.zip_with("_t", "_ht", lambda a, b: (a - b) / (F.col("_w") - F.col("_hsum"))).alias("prior"),
        ((F.col("_m") - F.col("_dm")) / (F.col("_n") - F.col("_gone"))).alias("mean_w"),
    ))
    hit = F.call_function("shiftright", F.col("bitmask"), F.col("truth") - 1).bitwiseAND(F.lit(1).cast("long")) == 1
    same = F.col("peer_class") == F.col("truth")
    kind = dict(v.dtypes)
    schema = f"aoi {kind['aoi']}, truth {kind['class']}, peer_class {kind['class']}, bitmask long"
    scored = []
    for x in some:
        seen = _left_votes(x, authors).where(F.col("w1") - F.col("hw") > 1e-9).join(prior, ["aoi", "held"])
        decided = seen.select("aoi", "truth", "peer_class", "hw", "w1", "s", "prior", "mean_w").mapInArrow(_masks(rules), schema).where("bitmask > 0")
        scored.append(stored(decided.groupBy("aoi").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("ok"), F.count(hit).alias("n_ok"),
            F.count("peer_class").alias("n_peer"), F.count_if(same).alias("same"), F.count(same).alias("n_same"))))
    share = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))
    return together(scored).groupBy("aoi").agg(
        F.sum("n").alias("n_consensus"),
        share("ok", "n_ok").alias("loao_consensus"),
        F.sum("n_peer").alias("n_peer"),
        share("same", "n_same").alias("loao_peer"),
    )


def pick_authors(votes: DataFrame, min_shapes: int = 5, min_authors: int = 3) -> DataFrame:
    """All annotators to hold out per area, each with the next one in hash order as peer.

    Works on the annotator table (one row per area and annotator), never on votes.
    """
    a = votes.groupBy("aoi", "annotator").agg(F.countDistinct("submission").alias("shapes"))
    a = a.withColumn("_h", stable_fraction(F.concat_ws(":", "aoi", "annotator"), "author"))
    ring = Window.partitionBy("aoi").orderBy("_h", "annotator")
    everyone = Window.partitionBy("aoi").orderBy("_h", "annotator").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    a = a.withColumn("peer", F.coalesce(F.lead("annotator").over(ring), F.first("annotator").over(everyone)))
    fit = a.where(F.col("shapes") >= min_shapes)
    n = fit.groupBy("aoi").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_authors)
    return fit.join(n, "aoi", "left_semi").select("aoi", F.col("annotator").alias("held"), "peer")


def polygon_signal(df: DataFrame, signals: Sequence[str], ok: str = "n_ok", n: str = "n_px") -> DataFrame:
    """Correct share by tercile of each metadata signal, to see whether it ranks correctness.

    Tercile borders are exact quantiles of the signal over the scored shapes.
    """
    cut = quantiles_of(df, [], {c: F.col(c) for c in signals}, {"a": 1 / 3, "b": 2 / 3}).withColumn("_k", F.lit(1))
    d = df.withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k")  # one row
    tier = lambda c: F.when(F.col(c) <= F.col(f"{c}_a"), 0).when(F.col(c) <= F.col(f"{c}_b"), 1).otherwise(2)
    each = F.array(*[F.struct(F.lit(c).alias("signal"), F.when(F.col(c).isNotNull(), tier(c)).alias("tier")) for c in signals])
    d = d.select(F.col(ok).alias("_ok"), F.col(n).alias("_n"), F.inline(each)).where(F.col("tier").isNotNull())
    return d.groupBy("signal", "tier").agg(F.count(F.lit(1)).alias("shapes"), (F.sum("_ok") / F.sum("_n")).alias("share_ok"))


def area_audit(votes: DataFrame, truth: DataFrame, rules: ConsensusRules = ConsensusRules()) -> DataFrame:
    """One row per area: volume, consensus depth, and agreement with a truth of consensus and baseline."""
    head = votes.groupBy("aoi").agg(
        F.count(F.lit(1)).alias("n_votes"),
        F.countDistinct("submission").alias("n_submissions"),
        F.countDistinct("annotator").alias("n_annotators"),
    )
    d = consensus(votes, rules).join(truth, ["aoi", "pixel"], "left")
    ok = F.call_function("shiftright", F.col("bitmask"), F.col("truth") - 1).bitwiseAND(F.lit(1).cast("long"))
    hard = F.col("set_size") == 1
    cons = d.groupBy("aoi").agg(
        F.count(F.lit(1)).alias("px_consensus"),
        F.count("truth").alias("px_compared"),
        F.avg(hard.cast("double")).alias("hard_frac"),
        F.avg("confidence").alias("mean_conf"),
        F.avg("n_eff").alias("mean_n_eff"),
        F.avg(ok.cast("double")).alias("oa_consensus"),
        F.avg(F.when(hard, (F.col("top_class") == F.col("truth")).cast("double"))).alias("oa_hard_only"),
    )
    naive = (
        smallest_shape_wins(votes)
        .join(truth, ["aoi", "pixel"])
        .groupBy("aoi")
        .agg(F.avg((F.col("class") == F.col("truth")).cast("double")).alias("oa_naive"))
    )
    return head.join(cons, "aoi", "left").join(naive, "aoi", "left")
