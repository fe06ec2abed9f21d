"""Text helpers that run inside Arrow tasks: words, lines, hashes and small batches.

White space is ``[\\x20\\x09-\\x0D]`` and lower case touches A-Z only, which is what ``bytes.split``
and ``bytes.lower`` do; texts therefore stay UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\v\f\r"
#: Words that a memo of a task holds; it starts anew beyond it.
MEMO_WORDS = 400_000
#: Bytes that are hashed at once, unless a single word is longer.
BLOCK_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SPACE = np.isin(np.arange(256), list(SPACE))
_powers: list[np.ndarray] = []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives empty bytes."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """White-space separated words in lower case."""
    return text.lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64) for base in (_ODD, _INVERSE)]
    return _powers


def _block_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of lower-case bytes: a polynomial of the word's bytes, from prefix sums."""
    space = np.concatenate([[True], _IS_SPACE[data], [True]])
    start, stop = np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64) * _INVERSE), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words of each text); words as in ``words``."""
    joined = b" ".join(texts).lower()
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(joined):
        to = at + BLOCK_BYTES
        if to < len(joined):  # on to the end of the word
            rest = joined[to:to + 4096].split(None, 1) if joined[to] not in SPACE else None
            if rest is not None:
                to = to + len(rest[0]) if len(rest[0]) < 4096 else next((k for k in range(to, len(joined)) if joined[k] in SPACE), len(joined))
        h, s = _block_hashes(np.frombuffer(joined[at:to], np.uint8))
        hashes.append(h)
        starts.append(s + at)
        at = to
    h, s = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((hashes, np.uint64), (starts, np.int64)))
    return h, np.bincount(np.searchsorted(ends, s, side="right"), minlength=len(texts)).astype(np.int64)


def word_hash(word: bytes) -> np.uint64:
    """The hash that a word, or any other mark without white space at its ends, has."""
    data = np.frombuffer(word, np.uint8)
    power, _ = _power_tables(len(data) + 1)
    return mix(((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)]).sum(keepdims=True) + np.array([len(data)], np.uint64) * _INVERSE)[0]


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _ODD + h[k:k + n]
    return mix(total)


def to_long(h: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(h, np.uint64).view(np.int64), pa.int64())
