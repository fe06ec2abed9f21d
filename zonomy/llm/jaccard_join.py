"""Near-duplicate texts: an exact Jaccard join of shingle sets and the classes that its links form.

Jaccard distance is a metric. Sets are dealt to regions, a region compares its members with a pivot
first, and only what the pivot leaves open is compared further. Two sets of similarity s share an element
among the first ``n - ceil(s n) + 1`` of each in any fixed order (rare ones first here), so these elements,
as one-element sets the nearest pivots of all in the metric, are the regions, and a set stands in
every region that a partner within the radius may have as its own. Inside, members within the radius
of the region's pivot join its class at once; a region whose members are of one class is finished; pairs
between classes are compared if the elements they share in all regions do not exclude the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.components import components
from zonomy.llm.tables import at_most_partitions
from zonomy.llm.twice import again_filter, log_bits_for, suspects
from zonomy.session import cut_lineage

#: Counters of the frequency sketch (16 MB); it orders elements, so its size changes speed alone.
SKETCH_BITS = 22
#: Rows of a table up to which it is broadcast; a larger one is joined by a shuffle.
TASK_ROWS = 2_000  # texts of a task at least, so that a small table is not dealt over many tasks in every round
BROADCAST_ROWS = 300_000
#: Pairs left open by the pivots, per row of the regions, up to which they are listed; beyond it
#: further pivots are taken first.
OPEN_PAIRS = 8
#: Further pivots that a region takes at a time.
PIVOTS = 16
_SEGMENT = 1 << 16


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words the whole is one run."""
    if not len(hashes):
        return hashes
    if len(hashes) < width:
        return tx.window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(tx.window_hashes(hashes, width))


def kept_elements(n: int, percent: int) -> int:
    """How many first elements of a set of ``n`` must be looked at."""
    return n - -(-percent * n // 100) + 1


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    hashes, size = tx.word_hashes(texts)
    return [shingle_set(own, width) for own in np.split(hashes, np.cumsum(size)[:-1])] if texts else []


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Occurrences of shingles over all texts, in ``2^SKETCH_BITS`` shared counters."""

    def count(batches):
        counters = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in tx.slices(batches):
            for s in _sets(tx.raw(batch.column(0)), width):
                np.add.at(counters, s & np.uint64(len(counters) - 1), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k in range(0, len(counters), _SEGMENT):
            if counters[k:k + _SEGMENT].any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack(counters[k:k + _SEGMENT].tobytes())])], names=["k", "c"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(unpack(c), np.uint32).astype(np.uint64)
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, c in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([pack(np.minimum(c, 2**20).astype(np.uint32).tobytes())])], names=["k", "c"])

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for row in docs.mapInArrow(count, "k int, c binary").repartition(16, "k").mapInArrow(add, "k int, c binary").coalesce(16).toLocalIterator():
        out[row["k"]:row["k"] + _SEGMENT] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["c"])), np.uint32)
    return out


def first_elements(s: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The first elements of a set in the order of (frequency, hash); what ties with the last is in."""
    k = kept_elements(len(s), percent)
    key = sketch[s & np.uint64(len(sketch) - 1)].astype(np.uint64) << np.uint64(43) | s >> np.uint64(21)
    return s[key <= np.partition(key, k - 1)[k - 1]]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (``id_col``, long ``n_shingles``, ``component_id``) for each row of ``docs``.

    Words are white-space separated, A-Z lower-cased; a set holds the distinct runs of ``width`` words, or the whole
    sequence if it is shorter. Two rows link when ``100 |a and b| >= percent |a or b|``; ``component_id`` is
    the smallest id reachable. Null or empty texts have no shingles and no links. Rows of one id are one node
    with the links of all its texts. Rows without id belong to the class of their text, or to none (null).
    Shingles are compared by 64-bit, whole sets by 128-bit hashes. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = max(spark.sparkContext.defaultParallelism, -(-slim.count() // TASK_ROWS))
    slim = slim.coalesce(parts)  # fewer if the table has fewer
    with at_most_partitions(spark, parts):
        rows, classes, label = _linked(slim, width, percent)
    member = rows.select("id", "n", "f1", "f2").join(classes.select("f1", "f2", F.col("node").alias("_node")), ["f1", "f2"], "left")
    member = member.join(label.withColumnRenamed("node", "_label"), F.col("_node") == F.col("_label"), "left")
    return member.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "_node", "id").alias("component_id"))


def _linked(slim: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their fingerprints, classes of equal sets, (node, component) of every class that has a link), all of them written."""
    spark, id_type = slim.sparkSession, slim.schema["id"].dataType
    sketch = spark.sparkContext.broadcast(frequency_sketch(slim.select("text"), width))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()),
                           T.StructField("f2", T.LongType()), T.StructField("first", T.ArrayType(T.LongType()))])

    def describe(batches):
        for batch in tx.slices(batches):
            sets = _sets(tx.raw(batch.column("text")), width)
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            first = [first_elements(s, sketch.value, percent) if len(s) else s for s in sets]
            ends = np.cumsum([0] + [len(x) for x in first], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tx.to_long(np.concatenate(first)))
            yield pa.record_batch([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], names=schema.names)

    rows = cut_lineage(slim.mapInArrow(describe, schema))
    sketch.unpersist()
    classes = rows.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("first").alias("first"))
    classes = cut_lineage(classes.where("node is not null"))
    regions = _regions(classes, id_type)
    return rows, classes, cut_lineage(_labels(regions, slim, width, percent))


def _regions(classes: DataFrame, id_type: T.DataType) -> DataFrame:
    """(h, node, n): the classes at their first elements, without elements that are sure to be of one class only."""
    spark = classes.sparkSession
    n = classes.agg(F.sum(F.size("first"))).head()[0] or 0
    log_bits = log_bits_for(n)

    def halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        return h, tx.mix(h)

    bits = spark.sparkContext.broadcast(again_filter(classes.select("first"), lambda batch: halves(batch.column(0)), log_bits))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("node", id_type), T.StructField("n", T.LongType())])

    def deal(batches):
        for batch in batches:
            lo, hi = halves(batch.column("first"))
            hit = suspects(bits.value, log_bits, lo, hi) if len(lo) else np.zeros(0, bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("first").offsets.to_numpy()))[hit]
            yield pa.record_batch([tx.to_long(lo[hit]), batch.column("node").take(pa.array(row)), batch.column("n").take(pa.array(row))], names=schema.names)

    regions = cut_lineage(classes.select("first", "node", "n").mapInArrow(deal, schema))
    bits.unpersist()
    return regions


def _labels(regions: DataFrame, slim: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of every class that has a link."""
    size = regions.count()
    pivots = regions.groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("pivot")).where("m > 1")
    met = regions.join(pivots, "h").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    # a pair that meets its pivot in few regions is left to the later comparison, which is exact
    likely = met.where(F.col("shared") * 1000 >= F.col("n") * (100 - percent)).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    label = components(_verified(cut_lineage(likely), slim, width, percent))
    while True:
        named = label.withColumnRenamed("node", "_node")
        known = regions.join(named, F.col("node") == F.col("_node"), "left").select("h", "node", "n", F.coalesce("component", "node").alias("c"))
        mixed = known.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
        open_ = cut_lineage(known.join(mixed.select("h", "m"), "h"))
        if (open_.agg(F.sum(F.col("m") - 1)).head()[0] or 0) <= 2 * OPEN_PAIRS * size:
            break
        # further pivots, the smallest of each of PIVOTS parts of a region; what they have met they leave settled
        part = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
        chosen = open_.groupBy("h", part.alias("part")).agg(F.min("node").alias("node")).select("h", "node")
        chosen = cut_lineage(chosen.join(open_, ["h", "node"]).select("h", F.col("node").alias("pivot"), F.col("c").alias("cp")))
        pairs = open_.join(chosen, "h").where("c <> cp").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        label = _joined(label, _verified(cut_lineage(pairs), slim, width, percent))
        regions = cut_lineage(open_.join(chosen.select("h", F.col("pivot").alias("node")), ["h", "node"], "left_anti").select("h", "node", "n"))
    possible = cut_lineage(_possible(open_, percent))
    return label if possible.isEmpty() else _joined(label, _verified(possible, slim, width, percent))


def _possible(open_: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different classes that the elements of their regions do not exclude.

    Two sets within the radius share at least ``least`` of their first elements. In an order of all elements (those of small regions first) the
    first one that they share has ``least`` elements or more from there on in either set, so pairs are listed where this holds, and not once for
    every element that they share.
    """
    behind = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("m"), F.desc("h")))  # a set has few elements
    placed = cut_lineage(open_.select("h", "node", "n", "c", behind.alias("k")))
    other = placed.select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("k").alias("kb"))
    need = F.ceil(percent * (F.col("n") + F.col("nb")) / (100 + percent))
    rest = lambda n: F.ceil(percent * F.col(n) / 100) - 1  # noqa: E731  elements behind the first ones
    least = need - F.greatest(rest("n"), rest("nb"))
    near = F.expr("node < b and c <> cb and 100 * least(n, nb) >= {0} * greatest(n, nb)".format(percent))
    pairs = placed.join(other, "h").where(near & (F.least("k", "kb") >= least))
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links: components are linked among themselves, then every node renamed."""
    links = cut_lineage(links)
    if links.isEmpty():
        return label
    name = lambda c: label.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"c{c}"))
    over = links.join(name("a"), F.col("a") == F.col("_a"), "left").join(name("b"), F.col("b") == F.col("_b"), "left")
    over = cut_lineage(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    nodes = label.union(over.select("a", F.col("a")).union(over.select("b", F.col("b")))).groupBy("node").agg(F.min("component").alias("component"))
    new = components(over.where("a <> b")).select(F.col("node").alias("_old"), F.col("component").alias("new"))
    return cut_lineage(nodes.join(new, F.col("component") == F.col("_old"), "left").select("node", F.coalesce("new", "component").alias("component")))


def _verified(pairs: DataFrame, slim: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are within the radius. The set of ``a`` travels to ``b``, made anew from the text."""
    tags = pairs.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("to")).withColumn("own", F.lit(False))
    tags = tags.unionByName(pairs.select(F.col("b").alias("id")).distinct().withColumns({"to": F.array().cast(tags.schema["to"].dataType), "own": F.lit(True)}))
    tags = cut_lineage(tags.groupBy("id").agg(F.flatten(F.collect_list("to")).alias("to"), F.max("own").alias("own")))
    if (tags.agg(F.sum(1 + F.size("to"))).head()[0] or 0) <= BROADCAST_ROWS:
        tags = F.broadcast(tags)
    tagged = slim.join(tags, "id")
    schema = T.StructType([slim.schema["id"], T.StructField("to", tagged.schema["to"].dataType), T.StructField("own", T.BooleanType()), T.StructField("s", T.BinaryType())])

    def hashed(batches):
        for batch in tx.slices(batches):
            sets = _sets(tx.raw(batch.column("text")), width)
            yield pa.record_batch([batch.column(c) for c in ("id", "to", "own")] + [pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)

    sets = tagged.select("id", "text", "to", "own").mapInArrow(hashed, schema)
    left = sets.select(F.col("id").alias("a"), F.explode("to").alias("b"), F.col("s").alias("sa"))
    right = sets.where("own").select(F.col("id").alias("b"), F.col("s").alias("sb"))

    @F.arrow_udf(T.BooleanType())
    def near(sa: pa.Array, sb: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(sa, sb):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) else 0
            out.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return left.join(right, "b").where(near("sa", "sb")).select("a", "b").distinct()
