"""Relevance safety net: no file is skipped as noise unless four rules agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import text as X
from paperloom.operators.shared import checked, numbered, stored


def whitelist(df: DataFrame, match: Column | None = None) -> DataFrame:
    """First layer: files whose name says so are CORE; matched tells by which words."""
    matched = X.whitelist_match("filename") if match is None else match
    forced = matched.isNotNull() & (F.col("role") != "CORE")
    return df.withColumn("matched", F.when(forced, matched)).withColumn("role", F.when(forced, "CORE").otherwise(F.col("role"))).withColumn("role_conf", F.when(forced, 1.0).otherwise(F.col("role_conf")))


def dedup_content(df: DataFrame, least: int = 200) -> DataFrame:
    """Of files of one case with the same stripped text of enough characters the first by name keeps its role, the others are NOISE.

    df(case_id, path, filename, text, role, role_conf) gains duplicate_of, the path of the first. Short texts are never
    duplicates. Only the hash is shuffled by, so that a case of any size spreads over all tasks.
    """
    stripped = X.py_strip("text")
    # A short or null text gets a key of its own, which also keeps such rows from meeting in one task.
    key = F.when(F.length(stripped) >= least, F.sha2(stripped, 256)).otherwise(F.concat_ws("/", F.lit("short"), "path"))
    w = Window.partitionBy("case_id", "_hash").orderBy("filename", "path")
    out = df.withColumn("_hash", key).withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("path").over(w))
    twin = (F.col("_n") > 1) & ~F.col("_hash").startswith("short/")
    out = out.withColumn("duplicate_of", F.when(twin, F.col("_first")))
    return out.withColumn("role", F.when(twin, "NOISE").otherwise(F.col("role"))).withColumn("role_conf", F.when(twin, 1.0).otherwise(F.col("role_conf"))).drop("_hash", "_n", "_first")


def confidence_threshold(df: DataFrame, least: float = 0.9) -> DataFrame:
    """Third layer: NOISE of lower or no confidence is SUPPORT."""
    low = (F.col("role") == "NOISE") & (F.coalesce(F.round("role_conf", 6), F.lit(0.0)) < least)
    return df.withColumn("low_confidence", low).withColumn("role", F.when(low, "SUPPORT").otherwise(F.col("role")))


def volume_cap(df: DataFrame, frac: float = 0.15, min_files: int = 10) -> DataFrame:
    """At most that share of a case's files is NOISE, those of highest confidence, then by name; the others are SUPPORT.

    Cases of few files are left as they are. Only keys of the noise are ranked, over ranges of them, and only the last
    one within each case's share joins back, so that no task holds a case. (case_id, path) tells files apart.
    """
    sizes = df.groupBy("case_id").agg(F.count(F.lit(1)).alias("_files")).filter(F.col("_files") >= min_files)
    sizes = sizes.select(F.col("case_id").alias("_case"), F.floor(F.col("_files") * frac).alias("_most"))
    key = F.struct((-F.coalesce(F.round("role_conf", 6), F.lit(0.0))).alias("c"), F.col("filename").alias("f"), F.col("path").alias("p"))
    noise = F.col("role") == "NOISE"
    ranked = numbered(df.filter(noise).select("case_id", key.alias("_key")), ["case_id"], ["_key"], "_rank")
    last = ranked.join(sizes, F.col("case_id").eqNullSafe(F.col("_case")) & (F.col("_rank") == F.col("_most"))).select(F.col("case_id").alias("_of"), F.col("_key").alias("_last"))
    cuts = sizes.join(last, F.col("_case").eqNullSafe(F.col("_of")), "left").filter("_last is not null or _most = 0").select("_case", "_last", F.lit(True).alias("_cut"))
    out = df.join(checked(stored(cuts, "cuts")), F.col("case_id").eqNullSafe(F.col("_case")), "left")
    over = F.coalesce(noise & F.col("_cut") & (F.col("_last").isNull() | (key > F.col("_last"))), F.lit(False))
    return out.withColumn("over_cap", over).withColumn("role", F.when(over, "SUPPORT").otherwise(F.col("role"))).drop("_case", "_last", "_cut")


def safety_net(classified: DataFrame, match: Column | None = None) -> DataFrame:
    """classified(case_id, path, filename, text, role, role_conf) after all four layers, with what each did.

    A null role is SUPPORT. skipped tells the files that end as NOISE, reason why: duplicate or
    model_marked_noise_high_confidence.
    """
    df = classified.withColumn("role", F.coalesce("role", F.lit("SUPPORT")))
    df = volume_cap(confidence_threshold(dedup_content(whitelist(df, match))))
    skipped = F.col("role") == "NOISE"
    reason = F.when(skipped, F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("model_marked_noise_high_confidence"))
    return df.withColumn("skipped", skipped).withColumn("reason", reason)


def safety_stats(done: DataFrame) -> DataFrame:
    """Counts of each layer of safety_net by case."""
    count = lambda c, name: F.count_if(c).alias(name)
    return done.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("files"),
        count(F.col("matched").isNotNull(), "whitelisted"),
        count(F.col("duplicate_of").isNotNull(), "duplicates"),
        count(F.col("low_confidence"), "low_confidence"),
        count(F.col("over_cap"), "over_cap"),
        count(F.col("skipped"), "skipped"),
        count(F.col("role") == "CORE", "core"),
    )


def skip_ledger(done: DataFrame) -> DataFrame:
    """Why each skipped file was skipped."""
    return done.filter("skipped").select("case_id", "path", F.lit("NOISE").alias("role"), "role_conf", "reason", "duplicate_of")
