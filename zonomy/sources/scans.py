"""Scans of partitioned map themes and small reference files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from zonomy.functions import geometry as G
from zonomy.functions.common import isin_safe
from zonomy.functions.similarity import validate
from zonomy.operators.ordered import exact_quantiles
from zonomy.operators.splits import require_unique


def bbox_meets(minx: float, miny: float, maxx: float, maxy: float, b: str = "bbox") -> Column:
    """Intersects test on a bounds struct; four comparisons that reach the parquet statistics."""
    return (F.col(f"{b}.xmin") <= maxx) & (F.col(f"{b}.xmax") >= minx) & (F.col(f"{b}.ymin") <= maxy) & (F.col(f"{b}.ymax") >= miny)


def read_theme(spark: SparkSession, root: str, theme: str, kind: str, bbox: tuple[float, float, float, float] | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """One theme and type of a tree partitioned by ``theme=/type=``, optionally within a box."""
    d = spark.read.parquet(root).where((F.col("theme") == theme) & (F.col("type") == kind))
    if bbox:
        d = d.where(bbox_meets(*bbox))
    return d.select(*columns) if columns else d


def source_flags(sources: str, trusted: Sequence[str], other: str) -> dict[str, Column]:
    """Any source trusted, any source equal to ``other``, and the first source's name."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return {
        "is_trusted": no(F.exists(sources, lambda s: s["dataset"].isin(*trusted))),
        "is_other": no(F.exists(sources, lambda s: s["dataset"] == other)),
        "primary_source": F.get(sources, F.lit(0))["dataset"],
    }


def tagged_union(parts: dict[str, DataFrame], tag: str = "base_type") -> DataFrame:
    """Several themes as one table with a tag; columns that a theme lacks are null."""
    out = None
    for name, d in parts.items():
        one = d.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def split_by(df: DataFrame, column: str, names: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Disjoint parts of one scan by a subtype."""
    return {n: df.where(isin_safe(column, v)) for n, v in names.items()}


def informal_flag(df: DataFrame) -> DataFrame | None:
    """Adds ``informal`` from the first column present: informal, is_informal, k_complexity >= 1, or
    access at or below its median. None when the layer has no such column."""
    have = set(df.columns)
    for name in ("informal", "is_informal"):
        if name in have:
            return df.withColumn("informal", F.coalesce(F.col(name).cast("boolean"), F.lit(False)))
    if "k_complexity" in have:
        return df.withColumn("informal", F.coalesce(F.col("k_complexity") >= 1, F.lit(False)))
    if "access" in have:
        m = exact_quantiles(df, [], F.col("access"), {"_m": 0.5}).withColumn("_k", F.lit(1))
        d = df.withColumn("_k", F.lit(1)).join(F.broadcast(m), "_k")  # one row
        return d.withColumn("informal", F.coalesce(F.col("access") <= F.col("_m"), F.lit(False))).drop("_k", "_m")
    return None


def read_bounds(spark: SparkSession, path: str, key: str = "SMOD_ID") -> DataFrame:
    """City bounds as boxes; the key must be unique."""
    schema = f"{key} string, JRC_NAME_MAIN string, minx double, miny double, maxx double, maxy double"
    d = require_unique(spark.read.csv(path, header=True, schema=schema), [key])
    return d.withColumn("rbox", G.box("minx", "miny", "maxx", "maxy"))


def read_similarity(path: str) -> list[list[float]]:
    """A class similarity matrix from a small CSV with comment lines, checked before use."""
    with open(path, encoding="utf-8") as f:
        rows = [line.strip().split(",") for line in f if line.strip() and not line.startswith("#")]
    return validate([[float(v) for v in r[1:]] for r in rows[1:]])


# ── inventories ──────────────────────────────────────────────────────────────


def patch_key(path: Column) -> tuple[Column, Column]:
    """(dataset, patch_id) of ``.../<dataset>/.../patch_<id>.npy``."""
    return (F.regexp_extract(path, r"/(training|validation|testing|unlabeled)/", 1), F.regexp_extract(path, r"patch_([^/]+)\.npy$", 1))


def patch_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Patch files of a tree by path and size; file contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "patch_*.npy").load(root)
    dataset, pid = patch_key(F.col("path"))
    return d.select("path", "length", dataset.alias("dataset"), pid.alias("patch_id")).where(F.col("dataset") != "")


def tile_cells(names: DataFrame, name: str = "name", size: float = 0.1, anchor: str = "centre") -> DataFrame:
    """Lon/lat box of a tile from the two numbers of its name, anchored at the centre or the lower-left corner.

    A trailing file extension is not part of the second number.
    """
    pattern = r"(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)(?:\.(?:tif|tiff|npy))?$"
    d = names.withColumns({"lon": F.regexp_extract(name, pattern, 1).try_cast("double"), "lat": F.regexp_extract(name, pattern, 2).try_cast("double")})
    h = size / 2 if anchor == "centre" else 0.0
    x, y = F.col("lon") - h, F.col("lat") - h
    return d.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("rbox", G.box(x, y, x + size, y + size))


def tiles_meeting(tiles: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    roi = G.box(F.lit(minx), F.lit(miny), F.lit(maxx), F.lit(maxy))
    return tiles.where(G.overlaps(F.col("rbox"), roi))


def utm_footprints(tiles: DataFrame, res: float = 10.0) -> DataFrame:
    """Grid of a named tile in the UTM zone of its centre and its lon/lat corners.

    The cell is projected, snapped outward to the resolution, and its four corners go back to
    lon/lat as a quadrilateral.
    """
    d = tiles.withColumn("epsg", G.utm_epsg("lon", "lat")).withColumn("_m", G.utm_meridian(G.utm_zone("lon")).cast("double"))
    south = F.col("lat") < 0
    xs, ys = [], []
    for x in ("minx", "maxx"):
        for y in ("miny", "maxy"):
            e, n = G.utm_xy(F.col(f"rbox.{x}"), F.col(f"rbox.{y}"), F.col("_m"), south)
            xs.append(e), ys.append(n)
    d = d.withColumns({
        "x0": F.floor(F.least(*xs) / res) * res, "x1": F.ceil(F.greatest(*xs) / res) * res,
        "y0": F.floor(F.least(*ys) / res) * res, "y1": F.ceil(F.greatest(*ys) / res) * res})
    corners = []
    for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")):
        lon, lat = G.utm_lonlat(F.col(x), F.col(y), F.col("_m"), south)
        corners.append(F.struct(lon.alias("x"), lat.alias("y")))
    size = lambda a, b: ((F.col(b) - F.col(a)) / res).cast("long")
    return d.withColumns({"width": size("x0", "x1"), "height": size("y0", "y1"), "ring": F.array(*corners)}).drop("_m")


def local_tiles(index: DataFrame, files: DataFrame, year: int, prefix: str) -> DataFrame:
    """Index rows of a year with the derived local path and whether the file is present."""
    d = index.where(F.col("year") == year).withColumn("local", F.regexp_replace("url", r"^.*/", prefix))
    return d.join(files.select(F.col("path").alias("local"), F.lit(True).alias("_p")), "local", "left").withColumn(
        "present", F.coalesce("_p", F.lit(False))).drop("_p")


def missing_tasks(wanted: DataFrame, done: DataFrame, keys: Sequence[str], valid: Column, complete: Column) -> DataFrame:
    """Work still to do: valid and fully covered requests without an existing result."""
    return wanted.where(valid & complete).join(done.select(*keys), list(keys), "left_anti")


def read_facets(df: DataFrame, method: str, filters: dict[str, Sequence] | None = None) -> DataFrame:
    """Rows with coordinates of a layout method that pass the facet filters."""
    d = df.where(F.col(f"{method}_x").isNotNull() & F.col(f"{method}_y").isNotNull())
    for c, values in (filters or {}).items():
        if c in df.columns:
            d = d.where(F.col(c).isin(*values))
    return d


def layout_methods(columns: Sequence[str]) -> list[str]:
    """Layout methods that have both coordinate columns."""
    return sorted({c[:-2] for c in columns if c.endswith("_x") and f"{c[:-2]}_y" in columns})


def stack_runs(runs: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Runs below each other with their name; a wanted column that a run lacks is null."""
    out = None
    for name, d in runs.items():
        cols = [c for c in (columns or d.columns) if c in d.columns]
        one = d.select(F.lit(name).alias("run"), *cols)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def discover_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of all run files that match a glob, with the run name from the folder."""
    d = spark.read.option("mergeSchema", "true").parquet(pattern)
    return d.withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))


