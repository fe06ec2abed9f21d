"""Reading the driver's tables, and the held-out split."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


@contextmanager
def at_most_partitions(spark: SparkSession, parts: int) -> Iterator[None]:
    """Plans that run inside shuffle over ``parts`` partitions at most. For iterations over small tables, whose many short plans would
    otherwise leave the driver with more tasks than rows; a session that asks for fewer keeps its number."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    if int(old) > parts:
        spark.conf.set(key, str(parts))
    try:
        yield
    finally:
        spark.conf.set(key, old)
