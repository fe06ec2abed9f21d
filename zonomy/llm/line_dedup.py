"""Lines that many documents share lose all their places but one.

Two Bloom filters tell the line hashes that may repeat; only those are shuffled, counted exactly
and given the document that keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.twice import again_filter, log_bits_for, suspects
from zonomy.session import cut_lineage

#: Confirmed keys that are broadcast (16 + 8 bytes each); more of them are joined.
BROADCAST_KEYS = 200_000


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its 16-byte key hash, or None if the key is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(tx.SPACE).lower() if len(line) >= min_chars else b""
        if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.uint64)
    return both[0::2], both[1::2]


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text",
               broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with shared lines taken out of ``text_col``, and long ``n_lines``, ``n_dropped``.

    A key is a line without outer white space, A-Z lower-cased. Keys of at least ``min_chars`` code points
    in at least ``min_docs`` documents stay only in the largest ``id_col`` that holds them, there with all
    their lines. Other lines stay as they are. Null or empty text: one empty line. Rows of one id are one
    document for the counts; rows without id are one further document that ranks below every id.
    Columns of ``docs`` named ``n_lines`` or ``n_dropped`` are replaced. All texts are read whole. Keys
    are compared by 128-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    chars = docs.agg(F.sum(F.length(text_col))).head()[0] or 0
    log_bits = log_bits_for(chars / min_chars)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def per_document(batch) -> list[list[bytes]]:
        return [list(dict.fromkeys(k for k in line_keys(t, min_chars) if k)) for t in tx.raw(batch.column("text"))]

    def hashes(batch):
        return _halves([k for keys in per_document(batch) for k in keys])

    bits = spark.sparkContext.broadcast(again_filter(slim.select("text"), hashes, log_bits))
    id_type = slim.schema["id"].dataType
    seen_schema = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("id", id_type)])

    def suspected(batches):
        for batch in tx.slices(batches, 2048):
            keys = per_document(batch)
            lo, hi = _halves([k for own in keys for k in own])
            if not len(lo):
                continue
            hit = suspects(bits.value, log_bits, lo, hi)
            row = np.repeat(np.arange(batch.num_rows), [len(k) for k in keys])[hit]
            yield pa.record_batch([tx.to_long(lo[hit]), tx.to_long(hi[hit]), batch.column("id").take(pa.array(row))], names=["lo", "hi", "id"])

    seen = slim.mapInArrow(suspected, seen_schema)
    n_docs = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))

    def shared(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lo", "hi").agg(n_docs.alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")

    found = cut_lineage(shared(seen))
    out_schema = T.StructType(docs.schema.fields + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at_text, at_id = docs.columns.index(text_col), docs.columns.index(id_col)

    def strip(batch, drops) -> pa.RecordBatch:
        """``drops`` tells for a row number and a key whether its lines go."""
        kept, lines, gone = [], [], []
        for row, text in enumerate(tx.raw(batch.column(at_text))):
            split = text.split(b"\n")
            stay = [not (key and drops(row, key)) for key in line_keys(text, min_chars)]
            kept.append(text if all(stay) else b"\n".join(x for x, ok in zip(split, stay) if ok))
            lines.append(len(split))
            gone.append(len(split) - sum(stay))
        columns = [batch.column(i) for i in range(len(out_schema) - 2)]
        columns[at_text] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.record_batch(columns + [pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=out_schema.names)

    if found.limit(broadcast_keys + 1).count() <= broadcast_keys:
        rows = found.collect()
        both = np.array([(r["lo"], r["hi"]) for r in rows], np.int64).reshape(-1, 2)
        keepers = spark.sparkContext.broadcast({k.tobytes(): r["keeper"] for k, r in zip(both, rows)})

        def by_broadcast(batches):
            keeper = keepers.value
            for batch in tx.slices(batches):
                ids = batch.column(at_id).to_pylist()
                yield strip(batch, lambda row, key: key in keeper and keeper[key] != ids[row])

        return docs.mapInArrow(by_broadcast, out_schema)

    lost = seen.join(found, ["lo", "hi"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy(F.col("id").alias("_lost_id")).agg(F.collect_set(F.struct("lo", "hi")).alias("_lost"))
    joined = docs.join(lost, docs[id_col].eqNullSafe(lost["_lost_id"]), "left").drop("_lost_id")

    def by_column(batches):
        for batch in tx.slices(batches):
            sets = [{np.array([x["lo"], x["hi"]], np.int64).tobytes() for x in own or ()} for own in batch.column("_lost").to_pylist()]
            yield strip(batch, lambda row, key: key in sets[row])

    return joined.mapInArrow(by_column, out_schema)
