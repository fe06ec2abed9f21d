"""Class sets as arrays and as bit masks (class ``c`` is bit ``c - 1``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from zonomy.functions.common import N_CLASSES, col


def encode(classes: Column | str) -> Column:
    """Array of classes to mask; null or empty gives 0."""
    mask = F.aggregate(
        col(classes),
        F.lit(0).cast("long"),
        lambda m, c: m.bitwiseOR(F.expr("1L").alias("one") * F.pow(F.lit(2.0), c - 1).cast("long")),
    )
    return F.coalesce(mask, F.lit(0).cast("long"))


def decode(mask: Column | str) -> Column:
    """Mask to ascending array of classes."""
    return F.filter(
        F.sequence(F.lit(1), F.lit(N_CLASSES)),
        lambda c: contains(col(mask), c),
    )


def contains(mask: Column | str, cls: Column | str) -> Column:
    return F.call_function("shiftright", col(mask), (col(cls) - 1).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def size(mask: Column | str) -> Column:
    return F.bit_count(col(mask))


def hard_class(mask: Column | str) -> Column:
    """The class of a single-class mask, else 0."""
    m = col(mask)
    return F.when(F.bit_count(m) == 1, F.round(F.log2(m.cast("double"))).cast("int") + 1).otherwise(F.lit(0))


def dissolve_key(label_type: Column | str, cls: Column | str, classes: Column | str) -> Column:
    """``h7`` for a hard class, ``c3,7`` for a coarse set, null when unlabelled."""
    ordered = F.array_join(F.array_sort(F.transform(col(classes), lambda c: c.cast("int"))).cast("array<string>"), ",")
    return F.when(col(label_type) == "hard", F.concat(F.lit("h"), col(cls).cast("int").cast("string"))).when(
        col(label_type) == "coarse", F.concat(F.lit("c"), ordered)
    )
