"""Sorts, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.operators.joins import area_priority


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """one page of the rows in order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def sort_cases(cases: DataFrame, sort: str = "desc") -> DataFrame:
    """F02."""
    return cases.orderBy(F.desc("data_creazione") if sort == "desc" else F.asc("data_creazione"), "id")


def reading_order(files: DataFrame) -> DataFrame:
    """files by category in reading order, then by name whatever its case."""
    return files.withColumn("category_no", reading_rank("path")).orderBy("category_no", F.lower("path"), "path")


def reading_rank(path: str) -> Column:
    """the place of a file's category in reading order."""
    rank = {c: i for i, c in enumerate([*C.CATEGORIES_CLI, "other"])}
    return F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))[X.categorize(path, "cli")]


def area_order(paragraphs: DataFrame, name: str = "categoria", then: str = "sottotitolo") -> DataFrame:
    """paragraphs by area of reports, then by title."""
    return area_priority(paragraphs, name=name).orderBy("priority", then)


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """the k commonest values, of equals the first by value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col).limit(k)


def recent_activity(df: DataFrame, limit: int = 50, user=None) -> DataFrame:
    """the latest rows of events, of one user if asked for."""
    own = df if user is None else df.filter(F.col("user_id") == user)
    return own.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def page_info(df: DataFrame, size: int = 10) -> DataFrame:
    """rows and pages of a list."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("pages"))


def ordered_results(df: DataFrame) -> DataFrame:
    """results in the order of their batches."""
    return df.orderBy("case_id", "batch_id")


def union_buckets(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables, by name; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_batches(standard: DataFrame, compact: DataFrame) -> DataFrame:
    """Standard and compact batches, told apart."""
    return standard.withColumn("mode", F.lit("standard")).unionByName(compact.withColumn("mode", F.lit("compact")))


def catalogue_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of two catalogues by where they are: both, a or b."""
    both = a.intersect(b).withColumn("side", F.lit("both"))
    return both.unionByName(a.exceptAll(b).distinct().withColumn("side", F.lit("a"))).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("b")))


def distinct_lines(df: DataFrame, keys: list[str], text: str = "text", n: int = 50) -> DataFrame:
    """Of rows with the same keys and first n characters one, the smallest text."""
    return df.groupBy(*keys, F.substring(text, 1, n).alias("head")).agg(F.min(text).alias(text)).drop("head")


def recovery_set(wanted: DataFrame, missing: DataFrame) -> DataFrame:
    """Keys that were asked for and are missing."""
    return wanted.intersect(missing)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Values for a list of filters."""
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


def area_count(df: DataFrame, col: str = "categoria") -> DataFrame:
    """Distinct areas that rows touch; rows without one touch the last."""
    return df.agg(F.count_distinct(F.coalesce(F.col(col), F.lit(C.AREAS[-1]))).alias("areas"))
