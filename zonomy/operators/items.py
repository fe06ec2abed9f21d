"""Labelled items for training: patches that have a file, with their split by one of three modes, and weighted weak items.

The dataset of a patch names the folder of its file, and patch ids repeat between folders, so files are found by
(dataset, patch_id) in every mode, also where the split comes from elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from zonomy.operators.spatial import drop_near
from zonomy.operators.splits import assert_splits

# Spellings of the splits, and what a test cell of the grid becomes where the test set is the original one.
SPLITS = {"train": "train", "training": "train", "val": "val", "validation": "val", "test": "test", "testing": "test"}
GRID_FOLD = {"train": "train", "val": "val", "test": "train"}
KEY = ("dataset", "patch_id")


def _lookup(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def with_files(patches: DataFrame, files: DataFrame) -> DataFrame:
    """Patches whose file is in the inventory."""
    return patches.join(files.select(*KEY).distinct(), list(KEY), "left_semi")


def split_items(patches: DataFrame, files: DataFrame, mode: str = "dataset", split_col: str = "split", label_col: str = "lcz",
                required: Sequence[str] = ("train", "val", "test")) -> tuple[DataFrame, DataFrame]:
    """(dataset, patch_id, label from 0, split) of the patches with a file, and counts of split values that mean nothing.

    ``mode`` is ``dataset`` (the folder is the split), ``column`` (``split_col`` is, and every required split must then have rows) or
    ``hybrid`` (the original test set stays, other patches take ``split_col``, its test cells as training). Rows of
    unknown split values are dropped. A missing column is an error.
    """
    if mode not in ("dataset", "column", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    if mode != "dataset" and split_col not in patches.columns:
        raise ValueError(f"no column {split_col} among {sorted(patches.columns)}")
    raw = F.col("dataset") if mode == "dataset" else F.col(split_col)
    known = _lookup(raw.cast("string"), SPLITS)
    if mode == "hybrid":
        known = F.when(F.col("dataset") == "testing", "test").otherwise(_lookup(known, GRID_FOLD))
    d = with_files(patches, files).withColumns({"_raw": raw.cast("string"), "_split": known})
    unknown = d.where(F.col("_split").isNull()).groupBy(F.col("_raw").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    items = d.where(F.col("_split").isNotNull()).select(*KEY, (F.col(label_col) - 1).cast("int").alias("label"), F.col("_split").alias("split"))
    if mode == "column":
        assert_splits(items.withColumn("_key", F.struct(*KEY)), "_key", required)
    return items, unknown


def weak_items(weak: DataFrame, files: DataFrame, held_out: DataFrame | None = None, radius_km: float = 0.0, scale: float = 1.0, label_col: str = "lcz",
               weight_col: str = "weight") -> DataFrame:
    """(dataset, patch_id, label from 0, split, weight): weak labels as training rows of scaled weight.

    Rows nearer than ``radius_km`` to a held-out row (lon, lat) are dropped, rows without a file too. A null dataset means the
    unlabelled folder.
    """
    d = weak.withColumn("dataset", F.coalesce("dataset", F.lit("unlabeled")))
    if held_out is not None and radius_km > 0:
        d = drop_near(d.withColumn("_key", F.struct(*KEY)), held_out, "_key", radius_km).drop("_key")
    return with_files(d, files).select(*KEY, (F.col(label_col) - 1).cast("int").alias("label"), F.lit("train").alias("split"), (F.col(weight_col) * scale).alias("weight"))
