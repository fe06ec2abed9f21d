"""Session construction and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(master: str | None = None, app: str = "zonomy", **conf: str) -> SparkSession:
    """A session with the settings the plans rely on; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


# Settings that the plans gain from and that a session may leave open. Methods above 8000 bytes of
# code are not compiled by the JVM, so a larger fused stage is better split; skewed joins are
# worth an extra shuffle.
PREFERRED = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship_package(sc: SparkContext) -> None:
    """Give the executors this package, once per application, so that Python functions of a plan
    can be loaded wherever the driver was started."""
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and apply the preferred settings that the session has not set itself."""
    ship_package(spark.sparkContext)
    for key, value in PREFERRED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a scratch folder in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return
    if not (sc.master or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so later failures do not replay its plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the checkpoint folder and drop the shuffle files that this took, for tables
    that are too large to lie there as plain rows beside them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a table for broadcast when its row count, which is taken first, is within ``max_rows``;
    a larger one is returned for an ordinary join. The count reads only the grouping keys, so
    ``df`` should come from a materialised table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
