"""Array payload files (npy) as pixel rows or shapes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from zonomy.sources.scans import patch_key


def _files(spark: SparkSession, root: str) -> DataFrame:
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "patch_*.npy").load(root)
    dataset, pid = patch_key(F.col("path"))
    return d.select(dataset.alias("dataset"), pid.alias("patch_id"), "content")


def read_pixels(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, patch_id, row, col, v) of channel-first arrays; one file at a time in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dataset, pid, blob in zip(pdf["dataset"], pdf["patch_id"], pdf["content"]):
                a = np.load(io.BytesIO(blob)).astype("float64")
                c, h, w = a.shape
                yield pd.DataFrame({
                    "dataset": dataset, "patch_id": pid, "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h),
                    "v": list(a.reshape(c, -1).T)})

    return _files(spark, root).mapInPandas(run, "dataset string, patch_id string, row int, col int, v array<double>")


def read_shapes(spark: SparkSession, root: str) -> DataFrame:
    """(dataset, patch_id, h, w) from the array headers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = []
            for blob in pdf["content"]:
                f = io.BytesIO(blob)
                version = np.lib.format.read_magic(f)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shapes.append(read(f)[0])
            yield pd.DataFrame({"dataset": pdf["dataset"], "patch_id": pdf["patch_id"], "h": [s[-2] for s in shapes], "w": [s[-1] for s in shapes]})

    return _files(spark, root).mapInPandas(run, "dataset string, patch_id string, h int, w int")
