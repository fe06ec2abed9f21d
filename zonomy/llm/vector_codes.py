"""Product codes of vectors: a codebook per part, fitted by rounds of exact assignment and integer means.

Vectors become integers, are filled up with zeros to a common length that the number of parts divides, and are cut into
equal parts. The nearest codebook entries are found by a tree over the entries (``gnat``). A round shuffles one row
of sums per task and entry. Codebooks are the only thing on the driver: parts times entries vectors.

Rows without a vector, or with null or non-finite components, take no part; rows without id or label do. Repeated rows
count as often as they occur. Components saturate at 2^24 and, like squared distances, are 64-bit integers. An empty
table gives no codes and empty codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from zonomy.llm import gnat
from zonomy.llm.text import slices
from zonomy.llm.vectors import finite, int_matrix
from zonomy.session import cut_lineage

#: Rows that go down the tree together.
TOGETHER = 4096
#: A label with more than this share of the rows is joined by broadcast: there are fewer of them than its inverse.
HOT_SHARE = 1 / 1000


class Codebooks:
    """``books[p]`` holds the entries of part p as integer rows."""

    def __init__(self, books: np.ndarray, scale: int):
        self.books, self.scale = books, scale

    @property
    def dims(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        """Digest of the decimal components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def assigned(self, column: pa.ListArray, trees: list[gnat.Node]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, the rows' parts, nearest entries, squared distances) of every part of a batch."""
        v = int_matrix(column, self.scale, self.dims).reshape(len(column), *self.books.shape[::2])
        for p, (book, tree) in enumerate(zip(self.books, trees)):
            yield p, v[:, p], *gnat.nearest(tree, book, v[:, p])


def _moved(rows: DataFrame, codes: Codebooks) -> np.ndarray:
    """The codebooks after one round: floors of the means of what is assigned, unused entries as they are."""
    parts, entries, width = codes.books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [gnat.build(b) for b in codes.books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in slices(batches, TOGETHER):
            for p, own, index, _ in codes.assigned(batch.column("v"), trees):
                for k in range(width):  # sums of 4,096 components of 2^24 fit a double
                    total[p, :, k] += np.rint(np.bincount(index, own[:, k], entries)).astype(np.int64)
                count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(total[p, e, k]) for k in range(width))],
                                         names=["p", "e", "n", *(f"s{k}" for k in range(width))])

    names = ["n", *(f"s{k}" for k in range(width))]
    found = rows.mapInArrow(sums, "p long, e long, " + ", ".join(f"{c} long" for c in names))
    got = found.groupBy("p", "e").agg(*(F.sum(c).alias(c) for c in names)).toArrow().to_pydict()  # a row per entry
    books = codes.books.copy()
    if got["p"]:
        books[got["p"], got["e"]] = np.stack([np.array(got[c]) for c in names[1:]], axis=1) // np.array(got["n"])[:, None]
    return books


def fit_codebooks(df: DataFrame, scale: int, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> Codebooks:
    """Codebooks that start as the parts of the ``entries`` rows of smallest id (nulls last, ties by vector)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(finite("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-dims // parts))
    start = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    first = int_matrix(start, scale, parts * width)
    codes = Codebooks(np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2)), scale)
    for _ in range(rounds if len(first) else 0):
        codes = Codebooks(_moved(rows, codes), scale)
    return codes


def encode(df: DataFrame, codes: Codebooks, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(id, label, code, error): the nearest entries' numbers in part order, two hex digits or more each, and the summed squared distance."""
    parts, entries, _ = codes.books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    rows = df.select(F.col(id_col), F.col(label_col), F.col(vec_col).alias("v")).where(finite("v"))
    keep = rows.drop("v").schema

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [gnat.build(b) for b in codes.books]
        for batch in slices(batches, TOGETHER):
            text, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for _, _, index, distance in codes.assigned(batch.column("v"), trees):
                text, error = text + np.array([f"{i:0{digits}x}" for i in index.tolist()], object), error + distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=[id_col, label_col, "code", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return rows.mapInArrow(code, f"{schema}, code string, error long")


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """Add ``label_error``, the error summed over equal labels, nulls together.

    Sums of labels with more than a thousandth of the rows are broadcast, all others joined, so no label is in one task.
    """
    coded = cut_lineage(coded)
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    sums = cut_lineage(sums)
    least = HOT_SHARE * coded.count()
    hot, rare = (sums.where(c).drop("_n") for c in (F.col("_n") > least, F.col("_n") <= least))
    near = coded.join(F.broadcast(hot), F.col(label_col).eqNullSafe(F.col("_label")), "left").drop("_label")
    if rare.isEmpty():
        return near
    rest = near.where(F.col("label_error").isNull()).drop("label_error").join(rare, F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
    return near.where(F.col("label_error").isNotNull()).unionByName(rest)
