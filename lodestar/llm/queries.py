"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import chat, licenses, lines, prefixes, rules
from lodestar.llm.media import media_digest
from lodestar.llm.mixing import mix_table
from lodestar.llm.neardup import near_dup_table
from lodestar.llm.packing import pack_documents
from lodestar.llm.quality import quality_table
from lodestar.llm.suffixes import repeat_table
from lodestar.llm.syncmers import fingerprint_table
from lodestar.llm.whitening import whitening_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_table(table(spark, sf_dir, "documents"), width=2)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_table(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_table(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_table(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_table(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_table(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_table(table(spark, sf_dir, "embeddings"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_table(table(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_media_columns": op2_media_columns,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_license_scans": op9_license_scans,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op5_quality_rules": rules.ORACLE_SQL,
    "op6_line_dedup": lines.ORACLE_SQL,
    "op9_license_scans": licenses.oracle_sql(),
    "op13_conversation_prefix_trie": prefixes.ORACLE_SQL,
}
