"""Small column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# 17 classes, the first ten are built types, the other seven natural ones.
N_CLASSES = 17
BUILT = tuple(range(1, 11))
NATURAL = tuple(range(11, 18))
CLASS_CODES = ("1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "A", "B", "C", "D", "E", "F", "G")
CLASS_NAMES = (
    "Compact high-rise", "Compact mid-rise", "Compact low-rise", "Open high-rise", "Open mid-rise",
    "Open low-rise", "Lightweight low-rise", "Large low-rise", "Sparsely built", "Heavy industry",
    "Dense trees", "Scattered trees", "Bush or scrub", "Low plants", "Bare rock or paved",
    "Bare soil or sand", "Water",
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or(c: Column | str, default: float | None = 0.0) -> Column:
    """Value as double where null, NaN and unparsable text all become ``default``.

    With a number as default the result is non-nullable for Spark, which keeps the code
    generated downstream free of null checks.
    """
    x = col(c).try_cast("double")
    if default is None:
        return F.when(~F.isnan(x), x)
    d = F.lit(float(default))
    return F.nanvl(F.coalesce(x, d), d)


def known(c: Column | str) -> Column:
    """True where a number is present: neither null nor NaN."""
    return col(c).isNotNull() & ~F.isnan(col(c).cast("double"))


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def all_of(flags: Iterable[Column]) -> Column:
    out = F.lit(True)
    for f in flags:
        out = out & f
    return out


def any_of(flags: Iterable[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def isin_safe(c: Column | str, values: Iterable) -> Column:
    """Membership that is false, never null, for a null value."""
    return F.coalesce(col(c).isin(*values), F.lit(False))


def stable_fraction(key: Column | str, salt: str = "") -> Column:
    """Uniform number in [0, 1) from sha256 of ``salt:key``; 52 bits, exact in a double."""
    text = F.concat(F.lit(f"{salt}:"), col(key).cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def crc_keep(key: Column | str, per_mille: int) -> Column:
    """Joinable subsample: keep a row when crc32 of its key modulo 1000 is below ``per_mille``."""
    return F.crc32(col(key).cast("string")) % 1000 < per_mille


def packed_mode(cls: Column | str, n: Column | str) -> Column:
    """Aggregate: the class with the largest count, lowest class on ties.

    Count and class share one long, so the aggregate keeps a primitive buffer and stays a hash
    aggregate; classes must lie in 0..255.
    """
    top = F.max(col(n).cast("long") * 256 + (255 - col(cls).cast("long")))
    return (255 - F.pmod(top, F.lit(256))).cast("int")
