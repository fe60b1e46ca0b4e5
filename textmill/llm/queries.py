"""The opN_ queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm import sql
from textmill.llm.runtime import documents, shared_dir
from textmill.llm.secrets import PACKS


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.sharding import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from textmill.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.decontamination import leaks

    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.hmm import score_documents
    from textmill.llm.language import held_out

    return score_documents(documents(spark, sf_dir), held_out(7, 2))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.substrings import removal_digest, repeated_spans

    docs = documents(spark, sf_dir)
    return removal_digest(docs, repeated_spans(docs))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.licences import scan

    return scan(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.language import predict_languages

    return predict_languages(documents(spark, sf_dir))


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    import public_tokenizers

    from textmill.llm.rollups import document_totals

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return document_totals(documents(spark, sf_dir), labels, f"{shared_dir(spark)}/rollup-{uuid4().hex}", public_tokenizers.path("word_bpe_49k.json"))


def op8_word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from textmill.llm.rollups import word_totals

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return word_totals(documents(spark, sf_dir), labels, f"{shared_dir(spark)}/rollup-{uuid4().hex}")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(documents(spark, sf_dir), shingle_words=4)
    return found.select("doc_id", hex_fingerprint(found["fp"]).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.quality import judge

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return judge(documents(spark, sf_dir), labels).select(*columns)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from uuid import uuid4

    from textmill.llm.secrets import document_secrets

    return document_secrets(documents(spark, sf_dir), f"{shared_dir(spark)}/secrets-{uuid4().hex}")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.merkle import document_manifest

    return document_manifest(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textmill.llm.conversations import damaged, digests, repair

    return digests(repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_hmm_scores": op4_hmm_scores,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_licence_scan": op6_licence_scan,
    "op7_language_id": op7_language_id,
    "op8_token_rollup": op8_token_rollup,
    "op8_word_rollup": op8_word_rollup,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
    "op11_secret_scan": op11_secret_scan,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": sql.SHARDING,
    "op5_substring_dedup": sql.SUBSTRING_DEDUP,
    "op8_word_rollup": sql.TOKEN_ROLLUP,
    "op11_secret_scan": sql.secrets(PACKS),
    "op12_merkle_manifest": sql.manifest(),
    "op13_conversation_repair": sql.repairs(),
}
