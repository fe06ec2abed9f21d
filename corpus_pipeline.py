"""A corpus pipeline of five stages over ``documents``: quality, shared lines, near-duplicates, benchmark passages, tokens.

Each stage takes the columns of ``documents`` and, but for the last, returns them. ``run`` stores the result of a
stage as Parquet in the shared checkpoint folder and reads it again as the input of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from zonomy.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_gbt
from zonomy.llm.queries import tokenizer_path
from zonomy.llm.tables import crc_remainder, table
from zonomy.session import ensure_checkpoint_dir, prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score from which a document passes the quality classifier.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier learnt from the labels of this input does not reject. A null text counts as empty; rows without
    id are judged but teach nothing, repeated rows are judged alike."""
    forest = quality_gbt.fit_quality(docs, table(prepare(spark), sf_dir, "labels"), crc_remainder("doc_id", 4) != 2)
    return quality_gbt.quality_score(docs, forest, score_col="_quality").where(F.col("_quality") >= LEAST_QUALITY).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share; ``n_chars`` follows the text. A null text becomes empty, rows
    without id lose shared lines and keep none for others."""
    prepare(spark)
    kept = line_dedup.line_dedup(docs.select(*COLUMNS))
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class, repeated rows once. A row without id has one made from its text, behind all others, so
    it stays only where no row with an id is in its class. Documents without words are no copies of others."""
    prepare(spark)
    made = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    docs = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), made).alias("_row"))
    found = jaccard_join.near_duplicates(docs, id_col="_row")
    kept = found.where(F.col("component_id") == F.col("_row")).select("_row").distinct()
    return docs.join(kept, "_row", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are not a twentieth or more; these stay whole, rows without text or id too."""
    found = decontaminate.find_contamination(docs, table(prepare(spark), sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digest and the digest of the text that they decode to; none for a null text."""
    prepare(spark)
    encoded = bpe.encode_checked(docs.select("doc_id", "text"), tokenizer_path())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]
#: A trained classifier stands in the way of SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
