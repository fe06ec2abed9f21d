"""Two Bloom filters over a whole column of hashes: what was seen once, and what was seen again.

Every task fills its own pair, the pairs meet segment by segment in a shuffle of compressed bits,
and ``again = again_a | again_b | (once_a & once_b)``. A repeated hash is never missed; a single one may
be taken for repeated, which costs its reader an exact look.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SEGMENT_BITS = 1 << 19


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Pair:
    """The two filters of one task; both halves of a 128-bit hash give a position."""

    def __init__(self, log_bits: int) -> None:
        self.mask = np.uint64((1 << log_bits) - 1)
        self.once = np.zeros(1 << (log_bits - 3), np.uint8)
        self.again = np.zeros_like(self.once)

    def add(self, lo: np.ndarray, hi: np.ndarray) -> None:
        _, first, count = np.unique(lo, return_index=True, return_counts=True)
        a, b = lo[first] & self.mask, hi[first] & self.mask
        repeated = (count > 1) | (_has(self.once, a) & _has(self.once, b))
        for at in (a, b):
            _set(self.again, at[repeated])
            _set(self.once, at)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        step = min(SEGMENT_BITS >> 3, len(self.once))
        pack = zstandard.ZstdCompressor(level=1).compress
        for k, start in enumerate(range(0, len(self.once), step)):
            if self.once[start:start + step].any():
                yield k, pack(self.once[start:start + step].tobytes()), pack(self.again[start:start + step].tobytes())


def suspects(bits: np.ndarray, log_bits: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which hashes the second filter holds."""
    mask = np.uint64((1 << log_bits) - 1)
    return _has(bits, lo & mask) & _has(bits, hi & mask)


def log_bits_for(keys: float, lowest: int = 20, highest: int = 28) -> int:
    """Sixteen bits a key as a power of two; at ``highest`` the filter takes 32 MB and lets more
    single keys through, which costs shuffle but no rows."""
    return int(min(highest, max(lowest, np.ceil(np.log2(16 * max(keys, 1))))))


def again_filter(df: DataFrame, hashes: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], log_bits: int) -> np.ndarray:
    """The second filter over the whole of ``df`` (at most 32 MB, see ``log_bits_for``);
    ``hashes`` gives the 128-bit hashes of a batch as two halves."""
    names = pa.schema([("seg", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])

    def build(batches):
        pair = Pair(log_bits)
        for batch in batches:
            lo, hi = hashes(batch)
            if len(lo):
                pair.add(lo, hi)
        for k, once, again in pair.segments():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([once]), pa.array([again])], schema=names)

    def merge(batches):
        got: dict[int, list[np.ndarray]] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                k, once, again = (batch.column(i)[row].as_py() for i in range(3))
                once, again = np.frombuffer(unpack(once), np.uint8), np.frombuffer(unpack(again), np.uint8)
                if k in got:
                    mine = got[k]
                    mine[1] |= again | (mine[0] & once)
                    mine[0] |= once
                else:
                    got[k] = [once.copy(), again.copy()]
        for k, (_, again) in got.items():
            packed = zstandard.ZstdCompressor(level=1).compress(again.tobytes())
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([packed])], names=["seg", "again"])

    parts = df.mapInArrow(build, "seg int, once binary, again binary").repartition(16, "seg").mapInArrow(merge, "seg int, again binary").coalesce(16)  # a job each below
    bits = np.zeros(1 << (log_bits - 3), np.uint8)
    step = min(SEGMENT_BITS >> 3, len(bits))
    for row in parts.toLocalIterator():
        bits[row["seg"] * step:(row["seg"] + 1) * step] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["again"])), np.uint8)
    return bits
