"""A pipeline over documents: quality rules, near-dedup, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontamination, packing, quality, secrets, simhash
from paperloom.llm.common import columns, scratch, spent, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the first policy keeps.

    Null, empty and short texts go; rows that repeat are judged alike; an empty table stays empty. Columns stay as they
    are, whatever their names.
    """
    judged = quality.ledger(docs.select(F.col("text"), F.struct(*columns(docs)).alias("_row")))
    return judged.filter(quality.verdict(quality.POLICIES[0])).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 or more.

    Equal texts are a group, and so are all texts without a word. The row of the smallest doc_id stays, a null one
    last; of rows that repeat, one. An empty table stays empty.
    """
    return simhash.without_near_duplicates(docs, width=5, similarity=0.8)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which hit words are fewer than a twentieth.

    Null, empty and wordless texts stay; rows that repeat are judged alike; an empty table or benchmark removes nothing.
    """
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; n_chars, where there is one, follows the text.

    A null text stays null, and its n_chars with it; rows that repeat stay; an empty table stays empty.
    """
    found = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return found
    follows = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return found.select(*(follows if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids; columns other than doc_id are dropped.

    A null or empty text is one end token; rows that repeat are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, window=2048, end_id=1, with_ids=True)


STAGES = [
    ("quality", quality_rules),
    ("simhash", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: SQL cannot express the SimHash and packing stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet in the shared folder and read again.

    What a stage stored besides its result, and the result before, are deleted once the result is written. An empty
    documents table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
            keep.append(docs)
        if last is not None:
            spent(last)
        last = docs
    return docs
