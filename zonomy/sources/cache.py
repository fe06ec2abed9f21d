"""Writes: shared scratch tables, stage caches, products, compaction and append."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from zonomy.operators.manifest import content_hash
from zonomy.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A new folder below the checkpoint folder that all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name or 'table'}-{uuid.uuid4().hex[:12]}"


def config_hash(config: dict, only: Sequence[str] | None = None) -> str:
    """12 hex digits of the canonical JSON of a configuration, or of the named entries.

    A costly scan is keyed on the entries that shape it, so changing a threshold never
    repeats the scan.
    """
    part = {k: config[k] for k in only} if only else config
    return hashlib.sha256(json.dumps(part, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def cached_stage(spark: SparkSession, root: str, stage: str, config: dict, build: Callable[[], DataFrame],
                 only: Sequence[str] | None = None, force: bool = False) -> DataFrame:
    """Read a stage's table if its configuration was built before, else build and write it.

    A table counts as built when its success marker exists, so a lost job is simply redone.
    """
    path = f"{root}/{stage}/cfg={config_hash(config, only)}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_product(df: DataFrame, path: str, lead: Sequence[str], partition: str, provenance: dict[str, str]) -> None:
    """Leading and provenance columns first, one folder per partition value."""
    d = df.withColumns({k: F.lit(v) for k, v in provenance.items()})
    first = [*lead, *provenance]
    d.select(*first, *[c for c in d.columns if c not in first]).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_both(first: DataFrame, first_path: str, derive: Callable[[DataFrame], DataFrame], second_path: str) -> None:
    """Two outputs of one job: the second is derived from the table just written."""
    first.write.mode("overwrite").parquet(first_path)
    derive(first.sparkSession.read.parquet(first_path)).write.mode("overwrite").parquet(second_path)


def write_manifest(df: DataFrame, path: str) -> dict:
    """Compressed table and its order-free fingerprint."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return content_hash(df.sparkSession.read.parquet(path)).first().asDict()


def pack(df: DataFrame, path: str, partition: str, rows_per_file: int) -> None:
    """Few files of bounded size per partition value; a large partition is spread over many tasks."""
    share = F.pmod(F.xxhash64(*df.columns), F.lit(8))
    df.repartition(partition, share).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(partition).parquet(path)


def append_rows(df: DataFrame, path: str) -> DataFrame:
    """Append to a table whose columns may have changed; older rows read as null."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.option("mergeSchema", "true").parquet(path)
