"""Vector columns as integer matrices inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Integer components saturate here, so that sums of products of up to 16,384 components stay below 2^63.
LARGEST = 1 << 24


def finite(vec: str) -> Column:
    """A vector that is there and holds neither nulls nor non-finite components."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def int_matrix(column: pa.ListArray, scale: int, dims: int) -> np.ndarray:
    """``floor(scale * x)`` of every component as a row of int64; shorter vectors are filled up with zeros."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(column), dims), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.clip(np.floor(scale * flat), -LARGEST, LARGEST).astype(np.int64)
    return out
