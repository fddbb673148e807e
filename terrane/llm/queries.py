"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import cut, table
from . import chat, codes, decontam, html, langid, licenses, neardup, pii, quality, secrets, sentencepiece, sharding, variants


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is kept as a table of numbers; the policy's verdict and its ablation are read from it."""
    rows = quality.apply_policy(quality.with_ablation(cut(quality.ledger(table(spark, sf_dir, "documents")), "ledger")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "only_rule", "only_rule_n")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).drop("rh")


#: Two turns that consist of control strings, as conversation -1.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    return chat.read_back(chat.format_turns(turns.union(probe)))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_license_scans": op9_license_scans,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_language_id": op13_language_id,
}
ORACLES: dict[str, str] = {
    "op10_quality_rules": oracles.OP10,
    "op5_chat_formatting": oracles.OP5,
    "op6_benchmark_decontamination": oracles.OP6,
    "op9_license_scans": oracles.OP9,
}
