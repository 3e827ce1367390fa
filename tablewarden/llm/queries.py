"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.llm import chat, collocations, conversation_repair, decontaminate, fingerprints, language_id, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, sharding


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_quality(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return quality.classified(docs).select("row.doc_id", "posterior", "score", "kept")


def op2_chat_formatting(spark: SparkSession, directory: str) -> DataFrame:
    """All conversations, and conversation -1 of another layout whose texts hold control strings."""
    records = chat.from_rows(_table(spark, directory, "conversations"))
    hostile = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(hostile).alias("prompt"), F.lit(hostile).alias("completion"))
    return chat.digests(records.unionByName(extra, allowMissingColumns=True))


def op3_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, directory, "documents"), shingle=4, percent=80)


def op4_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.report(_table(spark, directory, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def op5_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents").select("doc_id", "text")
    return line_dedup.deduplicated(docs).select("row.doc_id", F.col("clean").alias("text"), "n_removed", "removed", "partners")


def op6_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = decontaminate.report(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"), n=10)
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def op7_language_id(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    prototypes = language_id.learn(docs.where(~language_id.held_out("doc_id")).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), prototypes).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    docs = _table(spark, directory, "documents")
    held_out = language_id.held_out("doc_id", fold=1)
    model = lm_scoring.train(docs.where(~held_out).select("text"))
    found = lm_scoring.scored(docs.select("doc_id", "text"), model).select("row.doc_id", "n_tokens", "n_known", "base_score", "score")
    return found.select("*", held_out.alias("held_out"), F.lit(model.tokens).cast("long").alias("train_tokens"))


def op9_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprints.compared_with_edits(_table(spark, directory, "documents"))


def op10_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return sharding.report(_table(spark, directory, "documents"), shards=24)


def op11_packing(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, directory, "documents")
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end=1)


def op12_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(_table(spark, directory, "conversations")))


def op13_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations.collocations(_table(spark, directory, "documents"), least=100, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_fingerprints": op9_fingerprints,
    "op10_sharding": op10_sharding,
    "op11_packing": op11_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_collocations": op13_collocations,
}
