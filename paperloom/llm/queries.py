"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontamination, html_extraction, language_id, merkle, packing, prefix_trie, quality, secrets, sharding, simhash, substring_dedup, training_order, url_filters
from paperloom.llm.oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    return url_filters.judge(_read(spark, sf_dir, "pages"), rules)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), width=3, radius=3)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.materialise(_read(spark, sf_dir, "documents"), key=20_240_607, window=2048)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(_read(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_read(spark, sf_dir, "documents"), window=35, with_text=False).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = rows.failure_bits.bitwiseAND(quality.bits(quality.BASE)) != 0
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *measures, base_failed.alias("base_failed"), quality.verdict(quality.POLICIES[0]).alias("kept"), "failure_bits")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_id.train(docs.filter(~held_out).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), window=2048, end_id=1, with_ids=False).drop("ids")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), shards=8)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13, with_places=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return html_extraction.extract(pages, html_extraction.fit(pages))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_read(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_simhash, op3_training_order, op4_secrets, op5_substring_dedup, op6_quality, op7_language_id, op8_packing, op9_sharding, op10_decontamination, op11_html_extraction, op12_prefix_trie, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
