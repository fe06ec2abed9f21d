"""Connected components and what is built on them: zones, dissolving, merging, pixel regions.

Rounds are driver-controlled joins; every round cuts its lineage with a reliable
checkpoint, so a lost executor never replays earlier rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from zonomy.operators.spatial import TASK_ROWS
from zonomy.session import cut_lineage


def local_roots(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the smallest node that these edges tie each to."""
    ids, at = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b, root = at[:len(lo)], at[len(lo):], np.arange(len(ids))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return ids, ids[root]


def _tied_in_tasks(live: DataFrame, tasks: int) -> DataFrame:
    """(node, root) of every node that a task meets, edges near each other in one task."""
    kind = dict(live.dtypes)["lo"]

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(found) if (found := list(batches)) else None
        if own is not None and len(own):
            ends = (own.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("lo", "hi"))
            types = own.schema.field("lo").type
            yield pa.RecordBatch.from_arrays([pa.array(x, types) for x in local_roots(*ends)], names=["node", "root"])

    dealt = live.repartitionByRange(tasks, "lo", "hi") if tasks > 1 else live.coalesce(1)
    return dealt.mapInArrow(tie, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, a: str = "block_a", b: str = "block_b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Each round every remaining node hooks to its smallest smaller neighbour, hook chains are
    shortened by doubling, and edges are rewritten to the new roots and deduplicated. The
    graph shrinks geometrically in practice, hubs included, because a hub's edges collapse
    under the per-node ``min`` and ``distinct``. Node ids must be orderable.

    Before the rounds, tasks of at most about ``TASK_ROWS`` edges tie what their own edges tie, where ids are whole numbers or strings;
    the rounds only see the roots of tasks that share a node, so long chains take few rounds.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    live = cut_lineage(edges.where(F.col(a) != F.col(b)).select(lo, hi).distinct())
    first, label = None, None  # node -> smallest root of a task, node -> current root
    if dict(live.dtypes)["lo"] in ("tinyint", "smallint", "int", "bigint", "string") and (count := live.count()):
        near = cut_lineage(_tied_in_tasks(live, math.ceil(count / TASK_ROWS)))
        first = cut_lineage(near.groupBy("node").agg(F.min("root").alias("_first")))
        live = cut_lineage(near.join(first, "node").where(F.col("root") != F.col("_first")).select(F.col("_first").alias("lo"), F.col("root").alias("hi")).distinct())
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        hooks = live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        hooks = _flatten(cut_lineage(hooks))
        roots = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        if label is None:
            nodes = live.select(F.col("lo").alias("node")).union(live.select("hi")).distinct()
            label = nodes.join(roots, nodes["node"] == roots["_n"], "left").select("node", F.coalesce("_r", "node").alias("root"))
        else:
            label = label.join(roots, label["root"] == roots["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
        label = cut_lineage(label)
        moved = live.join(roots, live["lo"] == roots["_n"], "left").select(F.coalesce("_r", "lo").alias("lo"), "hi")
        moved = moved.join(roots, moved["hi"] == roots["_n"], "left").select("lo", F.coalesce("_r", "hi").alias("hi"))
        live = cut_lineage(moved.where(F.col("lo") != F.col("hi")).select(
            F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if label is None and first is not None:
        return first.select("node", F.col("_first").alias("component"))
    if label is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).distinct()
    if first is not None:
        to = label.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        return first.join(to, first["_first"] == to["_n"], "left").select("node", F.coalesce("_r", "_first").alias("component"))
    return label.select("node", F.col("root").alias("component"))


def _flatten(hooks: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Follow hook chains to their ends by pointer doubling."""
    for _ in range(max_rounds):
        up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        nxt = hooks.join(up, hooks["root"] == up["_n"], "left").select(
            "node", F.coalesce("_r", "root").alias("root"), F.col("_n").isNotNull().alias("_moved"))
        nxt = cut_lineage(nxt)
        if nxt.where("_moved").isEmpty():
            return nxt.drop("_moved")
        hooks = nxt.drop("_moved")
    raise RuntimeError("hook chains did not settle")


def with_component(nodes: DataFrame, edges: DataFrame, key: str, a: str = "block_a", b: str = "block_b") -> DataFrame:
    """Adds ``component``; a node without edges is its own component."""
    c = connected_components(edges, a, b).withColumnRenamed("node", key)
    return nodes.join(c, key, "left").withColumn("component", F.coalesce("component", F.col(key)))


def same_key_edges(nodes: DataFrame, edges: DataFrame, key: str, label: str, a: str = "block_a", b: str = "block_b") -> DataFrame:
    """Edges whose two ends carry the same non-null label."""
    left = nodes.select(F.col(key).alias(a), F.col(label).alias("_la"))
    right = nodes.select(F.col(key).alias(b), F.col(label).alias("_lb"))
    return edges.join(left, a).join(right, b).where(F.col("_la") == F.col("_lb")).select(a, b)


def form_zones(blocks: DataFrame, edges: DataFrame, key: str = "block_id", label: str = "label_key",
               min_area_ha: float = 15.0) -> DataFrame:
    """Adjacent blocks of one label form a zone; a zone of enough area is zone-grade.

    Adds zone_id (smallest member), zone_area_ha and zone_grade; unlabelled blocks get nulls
    and false.
    """
    labelled = blocks.where(F.col(label).isNotNull())
    comp = with_component(labelled.select(key, "area_m2"), same_key_edges(labelled, edges, key, label), key)
    area = comp.groupBy("component").agg((F.sum("area_m2") / 1e4).alias("zone_area_ha"))
    z = comp.join(area, "component").select(key, F.col("component").alias("zone_id"), "zone_area_ha")
    grade = F.coalesce(F.col("zone_area_ha") >= min_area_ha, F.lit(False))
    return blocks.join(z, key, "left").withColumn("zone_grade", grade)


def dissolve_small_zones(blocks: DataFrame, edges: DataFrame, key: str = "block_id", pred: str = "pred",
                         min_area_ha: float = 15.0) -> DataFrame:
    """Blocks of small predicted zones take the most frequent prediction of their neighbours in
    zones of sufficient size (lowest class on ties); blocks without such neighbours keep theirs."""
    b = blocks.withColumn("_p", F.when(F.col(pred) > 0, F.col(pred)))
    z = form_zones(b, edges, key, "_p", min_area_ha).withColumn("_small", F.col("_p").isNotNull() & ~F.col("zone_grade"))
    both = edges.select("block_a", "block_b").union(edges.select("block_b", "block_a")).toDF("me", "other")
    me = z.where("_small").select(F.col(key).alias("me"))
    other = z.where(F.col("_p").isNotNull() & ~F.col("_small")).select(F.col(key).alias("other"), "_p")
    votes = both.join(me, "me").join(other, "other").groupBy("me", "_p").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy("me").agg(F.max_by("_p", F.struct("_n", -F.col("_p"))).alias("_new"))
    out = z.join(best, z[key] == best["me"], "left")
    return out.select(*blocks.columns, F.coalesce("_new", F.col(pred)).alias("dissolved"))


def both_directions(edges: DataFrame, positions: DataFrame, key: str = "block_id", pos: str = "pos") -> DataFrame:
    """Edges as dense positions, once per direction; edges with an end outside the set are dropped."""
    a = positions.select(F.col(key).alias("block_a"), F.col(pos).alias("src"))
    b = positions.select(F.col(key).alias("block_b"), F.col(pos).alias("dst"))
    e = edges.join(a, "block_a").join(b, "block_b").select("src", "dst", "shared_len_m")
    return e.union(e.select("dst", "src", "shared_len_m"))


def merge_small_blocks(blocks: DataFrame, edges: DataFrame, min_area: float, corridor: float, passes: int = 3) -> DataFrame:
    """Small or thin blocks join the viable neighbour with the longest common side.

    ``blocks`` has block_id, area_m2 and thin_m (its inner width); ``edges`` the rook
    adjacency. A merged block keeps the id of its absorber; areas and shared sides are summed.
    Returns (block_id, target): null target means dropped after the last pass. The merged
    width is the larger of the two, as the absorber is viable.
    """
    state = cut_lineage(blocks.select("block_id", "area_m2", F.col("thin_m").cast("double").alias("thin_m")))
    links = cut_lineage(edges.select("block_a", "block_b", "shared_len_m"))
    member = cut_lineage(blocks.select("block_id", F.col("block_id").alias("target")))
    bad = (F.col("area_m2") < min_area) | (F.col("thin_m") <= corridor)
    for _ in range(passes):
        flagged = state.where(bad).select(F.col("block_id").alias("small"))
        if flagged.isEmpty() or state.where(~bad).isEmpty():
            break
        both = links.union(links.select("block_b", "block_a", "shared_len_m")).toDF("small", "host", "len")
        good = state.where(~bad).select(F.col("block_id").alias("host"))
        pick = both.join(flagged, "small").join(good, "host").groupBy("small").agg(
            F.max_by("host", F.struct("len", F.col("host"))).alias("host"))
        pick = cut_lineage(pick)
        if pick.isEmpty():
            break
        to = pick.select(F.col("small").alias("_s"), F.col("host").alias("_h"))
        member = cut_lineage(member.join(to, member["target"] == to["_s"], "left").select(
            "block_id", F.coalesce("_h", "target").alias("target")))
        state = state.join(to, state["block_id"] == to["_s"], "left").select(
            F.coalesce("_h", "block_id").alias("block_id"), "area_m2", "thin_m")
        state = cut_lineage(state.groupBy("block_id").agg(F.sum("area_m2").alias("area_m2"), F.max("thin_m").alias("thin_m")))
        moved = links.join(to, links["block_a"] == to["_s"], "left").select(
            F.coalesce("_h", "block_a").alias("block_a"), "block_b", "shared_len_m")
        moved = moved.join(to, moved["block_b"] == to["_s"], "left").select(
            "block_a", F.coalesce("_h", "block_b").alias("block_b"), "shared_len_m")
        links = cut_lineage(
            moved.where(F.col("block_a") != F.col("block_b"))
            .groupBy(F.least("block_a", "block_b").alias("block_a"), F.greatest("block_a", "block_b").alias("block_b"))
            .agg(F.sum("shared_len_m").alias("shared_len_m")))
    all_bad = state.where(~bad).isEmpty()
    keep = state if all_bad else state.where(~bad)
    alive = keep.select(F.col("block_id").alias("_t"))
    return member.join(alive, member["target"] == alive["_t"], "left").select("block_id", F.col("_t").alias("target"))


# ── pixel regions ────────────────────────────────────────────────────────────


def pixel_runs(pixels: DataFrame, grid: Sequence[str], value: str, strip: int = 4096) -> DataFrame:
    """Horizontal runs of equal value: (grid, row, c0, c1, value, n).

    Rows are cut into strips of ``strip`` columns first, so a very wide row is many groups.
    """
    d = pixels.withColumn("_s", F.floor(F.col("col") / strip))
    w = Window.partitionBy(*grid, "row", "_s", value).orderBy("col")
    d = d.withColumn("_i", F.col("col") - F.row_number().over(w))
    return d.groupBy(*grid, "row", "_s", value, "_i").agg(
        F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("n")).drop("_s", "_i")


def pixel_regions(pixels: DataFrame, grid: Sequence[str], value: str, strip: int = 4096) -> DataFrame:
    """Runs with the id of their 4-connected region of equal value.

    Only runs enter the graph, not pixels. Runs meet by (row, block of columns), then by
    overlap; runs that continue over a strip border meet by their ends.
    """
    runs = pixel_runs(pixels, grid, value, strip)
    rid = F.concat_ws(":", *[F.col(g).cast("string") for g in grid], F.lpad(F.col("row").cast("string"), 9, "0"),
                      F.lpad(F.col("c0").cast("string"), 9, "0"))
    runs = cut_lineage(runs.withColumn("run", rid))
    blk = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("c0") / 256), F.floor(F.col("c1") / 256))))
    up = blk.select(*grid, (F.col("row") + 1).alias("row"), "_b", F.col(value).alias("_v2"), F.col("run").alias("run2"),
                    F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    vert = blk.join(up, [*grid, "row", "_b"]).where(
        (F.col(value) == F.col("_v2")) & (F.col("c0") <= F.col("d1")) & (F.col("d0") <= F.col("c1"))).select(
        F.col("run").alias("block_a"), F.col("run2").alias("block_b"))
    ends = runs.select(*grid, "row", F.col("c1").alias("_e"), F.col(value).alias("_v2"), F.col("run").alias("run2"))
    starts = runs.withColumn("_e", F.col("c0") - 1)
    side = starts.join(ends, [*grid, "row", "_e"]).where(F.col(value) == F.col("_v2")).select(
        F.col("run").alias("block_a"), F.col("run2").alias("block_b"))
    return with_component(runs, vert.union(side).distinct(), "run").withColumnRenamed("component", "region")


def consensus_regions(pixels: DataFrame, grid: Sequence[str], res: float, min_area: float, deep: float = 3.0) -> DataFrame:
    """Regions of equal (bitmask, source) with at least ``min_area``: size, mean confidence and
    annotator depth, label type and kind.

    ``pixels`` has row, col, bitmask, source (1 voted, 2 authoritative), confidence, n_eff.
    """
    d = pixels.where(F.col("bitmask") > 0).withColumn("_key", F.col("bitmask") * 4 + F.col("source"))
    runs = pixel_regions(d, grid, "_key")
    size = runs.groupBy("region").agg(F.sum("n").alias("n_pixels")).where(F.col("n_pixels") * res * res >= min_area)
    kept = runs.join(size, "region")
    px = kept.withColumn("col", F.explode(F.sequence("c0", "c1"))).select(*grid, "row", "col", "region", "n_pixels")
    per = d.join(px, [*grid, "row", "col"]).groupBy(*grid, "region", "_key").agg(
        F.first("n_pixels").alias("n_pixels"), F.avg("confidence").alias("confidence"), F.avg("n_eff").alias("n_eff"))
    mask = F.floor(F.col("_key") / 4).cast("long")
    return per.select(
        *grid, "region", "n_pixels", mask.alias("bitmask"), (F.col("_key") % 4).cast("int").alias("source"),
        "confidence", "n_eff",
        F.when(F.bit_count(mask) == 1, "hard").otherwise("coarse").alias("label_type"),
        F.when(F.col("_key") % 4 == 2, "authoritative").when(F.col("n_eff") >= deep, "consensus_deep")
        .otherwise("consensus_shallow").alias("block_kind"))
