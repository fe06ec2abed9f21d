"""The registered queries of the operators: contract columns from their real outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from zonomy.llm import (
    bpe, chat_format, decontaminate, hard_negatives, jaccard_join, line_dedup, oracles, pitman_yor, quality_gbt, quality_rules, secrets, toxicity, url_filters,
    vector_codes,
)
from zonomy.llm.tables import crc_remainder, table

TOKENIZER = "byte_bpe_50k.json"
#: The rules of the url query: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = url_filters.url_filter(table(spark, folder, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema))
    path = tokenizer_path()
    read = chat_format.read_chats(chat_format.format_chats(turns, path), path)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op4_quality_gbt(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents").select("doc_id", "text"), crc_remainder("doc_id", 4) == 2
    forest = quality_gbt.fit_quality(docs, table(spark, folder, "labels"), ~held_out)
    scored = quality_gbt.quality_score(docs, forest)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pitman_yor.score_texts(docs, crc_remainder("doc_id", 7) != 2)


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode_checked(table(spark, folder, "documents").select("doc_id", "text"), path)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held_out = table(spark, folder, "documents").select("doc_id", "text"), crc_remainder("doc_id", 5) == 0
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), ~held_out)
    scored = toxicity.toxicity_score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).drop("text")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, scale=256)


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    codes = vector_codes.fit_codebooks(vectors, scale=1024)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, codes))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan_secrets(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    counts = [secrets.count_kind("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed("spans", base_only=True), 256).alias("base_sha256"),
                        secrets.listed("spans").alias("spans"), "n_live", "n_copied")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_url_filters, op2_line_dedup, op3_chat_format, op4_quality_gbt, op5_pitman_yor,
    op6_bpe, op7_toxicity, op8_decontamination, op9_jaccard_join, op10_quality_rules,
    op11_hard_negatives, op12_vector_codes, op13_secrets,
)}
SQL: dict[str, str] = {
    "op1_url_filters": oracles.URL_FILTERS, "op2_line_dedup": oracles.LINE_DEDUP, "op3_chat_format": oracles.CHAT_FORMAT,
    "op8_decontamination": oracles.DECONTAMINATION, "op9_jaccard_join": oracles.JACCARD_JOIN, "op10_quality_rules": oracles.QUALITY_RULES,
    "op11_hard_negatives": oracles.HARD_NEGATIVES, "op12_vector_codes": oracles.VECTOR_CODES, "op13_secrets": oracles.SECRETS,
}
