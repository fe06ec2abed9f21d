"""Cleaning rules for submitted polygons and dirty tag tables, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from zonomy.functions.common import BUILT, N_CLASSES, any_of, col

# Accepted spellings of a flag.
TRUE_TOKENS = ("true", "t", "1", "yes", "y")
FALSE_TOKENS = ("false", "f", "0", "no", "n")
RURAL = "_rural"


def class_or_null(raw: Column | str, n: int = N_CLASSES) -> Column:
    """Class number when the value parses and lies in 1..n, else null."""
    x = col(raw).try_cast("double")
    return F.when(x.between(1, n), x.cast("int"))


def class_gate(df: DataFrame, raw: str = "class_raw", n: int = N_CLASSES) -> tuple[DataFrame, DataFrame]:
    """Rows inside the class domain, and counts of the values that were dropped."""
    good = class_or_null(raw, n)
    kept = df.withColumn("class", good).where(F.col("class").isNotNull())
    dropped = df.where(good.isNull()).groupBy(F.col(raw).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return kept, dropped


def tri_state(raw: Column | str) -> Column:
    """True, false, or null for any unknown token."""
    token = F.lower(F.trim(col(raw).cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


@F.pandas_udf(StringType())
def _compatible_form(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def slug(text: Column | str, compatible: bool = True) -> Column:
    """Join-safe token that keeps letters of any script; ``unnamed`` when nothing is left.

    Compatibility characters (full-width forms, ligatures) are folded first, unless ``compatible`` is false; only texts beyond ASCII
    go to an Arrow function for that, the rest stays in the JVM.
    """
    s = col(text).cast("string")
    if compatible:
        s = F.coalesce(_compatible_form(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)
    s = F.regexp_replace(F.trim(s), r"[\s\p{Z}/\\]+", "_")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_.-]", "")
    s = F.regexp_replace(s, r"^[_.]+|[_.]+$", "")
    return F.regexp_replace(s, "^$", "unnamed")  # a pattern, so that the chain is evaluated once


def aoi_key(name: Column | str, code: Column | str, compatible: bool = True) -> Column:
    return F.concat(slug(name, compatible), F.lit("__"), col(code).cast("string"))


def folded_name(text: Column | str) -> Column:
    """Name key without case, accents or separators."""
    accents = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
    plain = "aaaaaaceeeeiiiinooooouuuuyy"
    return F.regexp_replace(F.translate(F.lower(col(text)), accents, plain), r"[^\p{L}\p{N}]", "")


# Latin letters that no decomposition takes apart.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "ng"}


@F.pandas_udf(StringType())
def _plain_latin(text: pd.Series) -> pd.Series:
    table = str.maketrans(LETTERS)

    def plain(s: str | None) -> str | None:
        if s is None:
            return None
        parts = unicodedata.normalize("NFKD", s.lower()).translate(table)
        return "".join(c for c in parts if not unicodedata.combining(c))

    return text.map(plain)


def place_key(text: Column | str) -> Column:
    """Name key of a place: lower case, accents and Latin letters beyond ASCII written out, everything else that is no letter a-z or digit
    folded to one space, none at the ends. Names in other scripts give an empty key."""
    s = F.lower(col(text).cast("string"))
    s = F.coalesce(_plain_latin(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def sane_year(date_text: Column | str, low: int = 1990, high: int = 2025) -> Column:
    """Year of a date text; unparsable or out-of-range years are null, never clamped."""
    y = F.year(F.try_to_timestamp(col(date_text).cast("string")))
    return F.when(y.between(low, high), y)


def label_year(representative: Column | str, submitted: Column | str, low: int = 1990, high: int = 2025) -> Column:
    return F.coalesce(sane_year(representative, low, high), sane_year(submitted, low, high))


def annotator(
    last: Column | str, first: Column | str, study: Column | str, cite: Column | str, submission: Column | str
) -> tuple[Column, Column]:
    """(annotator id, its source): author name, else study text, else ``blank:submission``."""
    clean = lambda c: F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit(""))))
    named = (clean(last) != "") | (clean(first) != "")
    text = F.trim(F.coalesce(col(study), col(cite), F.lit("")))
    has_study = text != ""
    key = (
        F.when(named, F.concat(F.lit("name:"), slug(clean(last)), F.lit("|"), slug(clean(first))))
        .when(has_study, F.concat(F.lit("study:"), slug(text)))
        .otherwise(F.concat(F.lit("blank:"), col(submission).cast("string")))
    )
    source = F.when(named, "name").when(has_study, "study").otherwise("blank")
    return key, source


def resolve_blank(annotator_id: Column | str, source: Column | str, aoi: Column | str,
                  policy: str = "collapse_per_aoi") -> Column:
    """Nameless rows of one area become one annotator, or stay one per submission."""
    if policy == "per_submission":
        return col(annotator_id)
    if policy != "collapse_per_aoi":
        raise ValueError(f"unknown policy {policy}")
    return F.when(col(source) == "blank", F.concat(F.lit("blank:"), col(aoi))).otherwise(col(annotator_id))


def tag_number(raw: Column | str) -> Column:
    """Number in a tag cell such as ``12 m`` or ``3;4`` (first entry counts); other units give null."""
    head = F.split(col(raw).cast("string"), ";")[0]
    return F.trim(F.regexp_replace(F.trim(head), "m+$", "")).try_cast("double")


def tag_height(height: Column | str, levels: Column | str, per_level: float = 3.0) -> Column:
    return F.coalesce(tag_number(height), tag_number(levels) * per_level)


def in_bucket(x: Column | str, low: float | None, high: float | None) -> Column:
    """Half-open (low, high] test, false for null."""
    c = col(x)
    ok = c.isNotNull()
    if low is not None:
        ok = ok & (c > low)
    if high is not None:
        ok = ok & (c <= high)
    return F.coalesce(ok, F.lit(False))


def building_height(
    explicit: Column, trusted: Column, floors: Column, roof: Column, raster: Column, per_floor: float = 3.2,
    low: float = 2.0, high: float = 1000.0,
) -> tuple[Column, Column]:
    """(height, tier): trusted explicit height, else trusted floors plus roof, else raster sample, else none."""
    ok = trusted & explicit.between(low, high)
    levels = trusted & (floors > 0)
    by_floor = floors * per_floor + F.coalesce(roof, F.lit(0.0))
    height = F.when(ok, explicit).when(levels, by_floor).when(raster > 0, raster)
    tier = F.when(ok, "explicit").when(levels, "levels").when(raster > 0, "raster").otherwise("none")
    return height, tier


def class_accuracy(cls: Column | str, oa: Column | str, oau: Column | str) -> Column:
    """Accuracy that speaks for the class: urban accuracy for built classes, else the overall one."""
    return F.when(col(cls).isin(*BUILT), F.coalesce(col(oau), col(oa))).otherwise(col(oa))


def class_value(values: Column | str, cls: Column | str) -> Column:
    """Entry of a class-keyed map."""
    return F.try_element_at(col(values), col(cls))


def quality_gates(
    *, require: dict[str, bool] | None = None, min_oa: float = 0.0, min_oau: float = 0.0, min_f1: float = 0.0,
    min_area: float = 0.0012, max_area: float = 100.0, min_vertices: int | None = 4,
) -> dict[str, Column]:
    """Drop flag per enabled gate. Here a missing value fails an enabled gate."""
    fails = lambda ok: ~F.coalesce(ok, F.lit(False))
    gates: dict[str, Column] = {}
    for step, needed in (require or {"qc_step1": True}).items():
        if needed:
            gates[step] = fails(F.col(step))
    if min_oa > 0:
        gates["min_oa"] = fails(F.col("oa") >= min_oa)
    if min_oau > 0:
        gates["min_oau"] = F.col("class").isin(*BUILT) & fails(F.col("oau") >= min_oau)
    if min_f1 > 0:
        gates["min_f1"] = fails(F.col("class_f1") >= min_f1)
    gates["min_area"] = fails(F.col("area_km2") >= min_area)
    gates["max_area"] = fails(F.col("area_km2") <= max_area)
    if min_vertices is not None:
        gates["min_vertices"] = fails(F.col("vertices") >= min_vertices)
    return gates


def apply_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    return df.where(~any_of(gates.values()))


def gate_counts(df: DataFrame, gates: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows in, rows kept and rows each gate drops, in one pass."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_in"),
        F.count_if(~any_of(gates.values())).alias("n_kept"),
        *[F.count_if(g).alias(f"drop_{name}") for name, g in gates.items()],
    )


def passes(value: Column, low: float) -> Column:
    """Accuracy gate of the published regime: a missing value passes."""
    return F.coalesce(value >= low, F.lit(True))
