"""Array expressions over embedding vectors: decoding, nodata, norms, scaling, small linear maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from zonomy.functions.common import col

CODEBOOK = (8, 8, 8, 5, 5, 5)  # fixed value: levels per code dimension


def doubles(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, eps: float = 0.0) -> Column:
    n = norm(v) + eps
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def signed_square(v: Column) -> Column:
    return F.transform(v, lambda x: F.pow(x / 127.5, F.lit(2.0)) * F.signum(x))


def linear(v: Column) -> Column:
    return F.transform(v, lambda x: x / 127.5)


def linear_unit(v: Column) -> Column:
    return unit(linear(v))


def scaled(v: Column, scale: Column) -> Column:
    return F.transform(v, lambda x: x * scale)


def mixed_radix(v: Column, levels: Sequence[int] = CODEBOOK, bands: int = 12) -> Column:
    """Codebook indices of the first ``bands`` entries to ``len(levels)`` values in [-1, 1] each."""
    steps, base = [], 1
    for lv in levels:
        steps.append((base, lv))
        base *= lv

    def codes(x: Column) -> Column:
        return F.array(*[
            (F.floor(x / b) % n - n // 2) / float(n // 2) for b, n in steps])

    return F.flatten(F.transform(F.slice(v, 1, bands), codes))


def quantise(v: Column) -> tuple[Column, Column]:
    """(integer codes, scale): the largest component uses the full signed byte range."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    return F.transform(v, lambda x: F.least(F.greatest(F.rint(x / scale), F.lit(-127.0)), F.lit(127.0)).cast("int")), scale


def is_nodata(v: Column, sentinel: float | None) -> Column:
    """Every channel equals the sentinel, or any channel is NaN."""
    bad = F.exists(v, lambda x: F.isnan(x))
    return bad if sentinel is None else bad | F.forall(v, lambda x: x == sentinel)


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def log_clip(v: Column, floor: float = 1e-12) -> Column:
    return F.transform(v, lambda p: F.log(F.greatest(p, F.lit(floor))))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def argmax(v: Column) -> Column:
    """1-based position of the largest entry, the first on ties."""
    return F.array_position(v, F.array_max(v)).cast("int")


def project(v: Column, rows: Sequence[Sequence[float]], mean: Sequence[float]) -> list[Column]:
    """(v - mean) times each row of a small matrix."""
    m = F.array(*map(F.lit, map(float, mean)))
    centred = F.zip_with(v, m, lambda x, c: x - c)
    return [dot(centred, F.array(*map(F.lit, map(float, r)))) for r in rows]


DECODERS = {"signed_square": signed_square, "linear": linear, "linear_unit": linear_unit, "mixed_radix": mixed_radix}
