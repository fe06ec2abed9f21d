"""Files laid out along a Hilbert curve, with a table of their bounds: a scan for a box opens only the files that reach into it.

Rows are ordered by the cell of their box centre on the curve, cut into ranges of about equal bytes and written one file per range;
the bounds table has one row per file. Both sides of a scan are exact: a file whose bounds miss the box holds no row that meets it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from zonomy.functions import geometry as G

#: Levels of the curve: cells a side are two to this power.
LEVELS = 16


def hilbert_key(x: Column, y: Column, levels: int = LEVELS) -> Column:
    """Place of the cell (x, y), both whole numbers from 0 below 2^levels, along a Hilbert curve."""
    def level(state: Column, k: Column) -> Column:
        s = F.shiftleft(F.lit(1).cast("long"), k) if not isinstance(k, Column) else F.pow(F.lit(2.0), k).cast("long")
        rx = F.when(state["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(0).cast("long")
        ry = F.when(state["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(0).cast("long")
        key = state["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        low_x, low_y = state["x"].bitwiseAND(s - 1), state["y"].bitwiseAND(s - 1)
        turned = ry == 0
        flip = turned & (rx == 1)
        fx, fy = F.when(flip, s - 1 - low_x).otherwise(low_x), F.when(flip, s - 1 - low_y).otherwise(low_y)
        return F.struct(F.when(turned, fy).otherwise(fx).alias("x"), F.when(turned, fx).otherwise(fy).alias("y"), key.alias("d"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(levels - 1), F.lit(0), F.lit(-1)), start, level, lambda s: s["d"])


@dataclass(frozen=True)
class Layout:
    path: str

    @property
    def data(self) -> str:
        return f"{self.path}/data"

    @property
    def bounds(self) -> str:
        return f"{self.path}/bounds"


def write_layout(df: DataFrame, path: str, box: str, file_bytes: int = 128 << 20, row_bytes: Column | None = None) -> Layout:
    """Write ``df`` along the curve in files of about ``file_bytes``, by the given or estimated bytes of a row, and the files' bounds.

    Rows without a box come last, in files whose bounds are null and which only a full read opens.
    """
    cx, cy = G.centre(F.col(box))
    size = row_bytes if row_bytes is not None else F.length(F.to_json(F.struct(*df.columns)))
    ends = df.agg(F.min(cx), F.min(cy), F.max(cx), F.max(cy), F.sum(size)).first()
    files = max(1, math.ceil((ends[4] or 0) / file_bytes))
    side = (1 << LEVELS) - 1
    cell = lambda v, lo, hi: F.least(F.greatest(F.floor((v - lo) / ((hi - lo) or 1.0) * side), F.lit(0)), F.lit(side))
    key = hilbert_key(cell(cx, ends[0] or 0.0, ends[2] or 0.0), cell(cy, ends[1] or 0.0, ends[3] or 0.0))
    laid = Layout(path)
    dealt = df.withColumn("_key", key).repartitionByRange(files, F.col("_key").asc_nulls_last(), F.xxhash64(F.col(box), *[c for c in df.columns if c != box]))
    dealt.drop("_key").write.mode("overwrite").parquet(laid.data)
    spark = df.sparkSession
    written = spark.read.parquet(laid.data).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col(box).alias("_b"))
    written.groupBy("file").agg(F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("_b.minx").alias("minx"), F.min("_b.miny").alias("miny"),
                                F.max("_b.maxx").alias("maxx"), F.max("_b.maxy").alias("maxy")).write.mode("overwrite").parquet(laid.bounds)
    return laid


def files_for(spark: SparkSession, laid: Layout, minx: float, miny: float, maxx: float, maxy: float) -> list[str]:
    """The files whose bounds a box touches."""
    b = spark.read.parquet(laid.bounds)
    meet = (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
    return [r["file"] for r in b.where(meet).select("file").collect()]  # as many as the scan opens


def read_box(spark: SparkSession, laid: Layout, box: str, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Rows whose box touches the given one, from the files that can hold them; the box test goes to the scan as well."""
    files = files_for(spark, laid, minx, miny, maxx, maxy)
    whole = spark.read.parquet(laid.data)
    d = spark.read.schema(whole.schema).parquet(*files) if files else whole.limit(0)
    return d.where((F.col(f"{box}.minx") <= maxx) & (F.col(f"{box}.maxx") >= minx) & (F.col(f"{box}.miny") <= maxy) & (F.col(f"{box}.maxy") >= miny))
