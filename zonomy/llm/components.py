"""Connected components of link tables whose classes are mostly stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from zonomy.session import cut_lineage


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node on a link (a, b); the component is its smallest node.

    In a round every node takes the smallest label among its neighbours and its own, and then the label of
    that label, so stars settle in two rounds and the length of chains halves. A round is one
    plan that ends in a reliable checkpoint; hubs are pre-aggregated by ``min`` and their joins may be split.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = cut_lineage(both)
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component"), F.lit(True).alias("moved")))
    for _ in range(max_rounds):
        if label.where("moved").isEmpty():
            return label.select("node", "component")
        named = label.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
        near = both.join(named, "b").groupBy(F.col("a").alias("_n")).agg(F.min("of_b").alias("m"))
        best = label.join(near, F.col("node") == F.col("_n")).select("node", "component", F.least("component", "m").alias("m"))
        jump = label.select(F.col("node").alias("_j"), F.col("component").alias("of_m"))
        best = best.join(jump, F.col("m") == F.col("_j"), "left").select("node", "component", F.least("m", F.coalesce("of_m", "m")).alias("m"))
        label = cut_lineage(best.select("node", F.col("m").alias("component"), (F.col("m") < F.col("component")).alias("moved")))
    raise RuntimeError("components did not settle")
