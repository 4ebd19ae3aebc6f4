"""Operators on files, classifications and their routing: filters and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.operators.shared import checked


def drop_artifacts(files: DataFrame) -> DataFrame:
    """Files without leftovers of operating systems and categories to skip."""
    return files.filter(~X.is_artifact("path") & (X.categorize("path") != "skip"))


def text_verdict(text, cap: int = 200_000) -> Column:
    """Empty, short, garbage, partial or ok."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    stripped = F.length(X.py_strip(text))
    return (
        F.when(stripped == 0, "needs_ocr_empty")
        .when(stripped < 200, "needs_ocr_too_short")
        .when(X.printable_ratio(text) < 0.7, "native_garbage")
        .when(F.length(text) >= 0.95 * cap, "native_partial")
        .otherwise("native_ok")
    )


def triage(files: DataFrame, cap: int = 200_000) -> DataFrame:
    """files(path, text) with method and bucket: native_text, needs_ocr, unrecoverable or non_pdf."""
    method = F.when(X.categorize("path") != "pdf", "non_pdf_passthrough").when(F.col("text").isNull(), "missing_path").otherwise(text_verdict("text", cap))
    bucket = F.when(F.col("method") == "non_pdf_passthrough", "non_pdf").when(F.col("method") == "missing_path", "unrecoverable").when(F.col("method").startswith("needs_ocr"), "needs_ocr").otherwise("native_text")
    return files.withColumn("method", method).withColumn("bucket", bucket)


def split_by_method(triaged: DataFrame) -> DataFrame:
    """Native files with part: clean, partial or garbage."""
    part = F.when(F.col("method") == "native_ok", "clean").when(F.col("method") == "native_partial", "partial").when(F.col("method") == "native_garbage", "garbage")
    return triaged.filter("bucket = 'native_text'").withColumn("part", part).filter("part is not null")


def has_text(c, n: int = 10) -> Column:
    """Whether n characters are left after stripping."""
    return F.coalesce(F.length(X.py_strip(c)) >= n, F.lit(False))


def bypass_low_signal(files: DataFrame, least: int = 50) -> DataFrame:
    """files(filename, text) with classe and confidence set where name and text have too few characters to ask a model."""
    low = F.length(X.snippet("text", 500)) + F.length(X.snippet("filename")) < least
    return files.withColumn("bypassed", low).withColumn("classe", F.when(low, "ALTRO")).withColumn("confidence", F.when(low, F.lit(0.3)))


def coerce_classification(df: DataFrame) -> DataFrame:
    """Unknown classes become ALTRO, unknown roles null, confidences lie in 0 to 1 and are 0 where they are no number."""
    classe, role = F.upper(F.trim("classe")), F.upper(F.trim("role"))
    number = F.coalesce(F.col("confidence").cast("string").try_cast("double"), F.lit(0.0))
    return (
        df.withColumn("classe", F.when(classe.isin([c for c, *_ in C.CLASSES]), classe).otherwise("ALTRO"))
        .withColumn("role", F.when(role.isin(C.ROLES), role))
        .withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    )


def classes(df: DataFrame) -> DataFrame:
    """The table of classes: classe, area, cap, default_role."""
    return df.sparkSession.createDataFrame(C.CLASSES, "classe string, area string, cap int, default_role string")


def enrich(df: DataFrame) -> DataFrame:
    """P10: df(classe, role) with area, cap and role from the 13 classes where they are missing."""
    table = F.broadcast(classes(df))
    out = df.join(table, "classe", "left")
    return out.withColumn("role", F.coalesce("role", "default_role", F.lit("SUPPORT"))).drop("default_role")


def list_cases(cases: DataFrame, user=None, tipo=None, search=None, start=None, end=None, norm=None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """The newest cases that fit the filters; a search ignores case. Filters come before the limit."""
    out = ui_filter(cases, tipo, norm, search)
    if user is not None:
        out = out.filter(F.col("user_id") == user)
    if start is not None:
        out = out.filter(F.to_date("data_creazione") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.to_date("data_creazione") <= F.lit(end).cast("date"))
    out = out.orderBy(F.desc("data_creazione"), "id").offset(offset)
    return out if limit is None else out.limit(limit)


def ui_filter(cases: DataFrame, tipo=None, norm=None, search=None) -> DataFrame:
    """Cases by type, norm and part of the company's name, whatever its case."""
    out = cases
    if tipo is not None:
        out = out.filter(F.col("tipo") == tipo)
    if norm is not None:
        out = out.filter(F.col("norma") == norm)
    if search is not None:
        out = out.filter(F.lower("azienda").contains(search.lower()))
    return out


def list_errors(errors: DataFrame, as_of: str, days_back: int = 30, user=None, error_type=None, include_resolved: bool = False, limit: int = 50) -> DataFrame:
    """The newest errors of the last days."""
    out = errors.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days_back} days"))
    if not include_resolved:
        out = out.filter(~F.col("resolved"))
    if user is not None:
        out = out.filter(F.col("user_id") == user)
    if error_type is not None:
        out = out.filter(F.col("error_type") == error_type)
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def visible_to(df: DataFrame, user, role: str) -> DataFrame:
    """All rows for an admin, else the user's own."""
    return df if role == "admin" else df.filter(F.col("user_id") == user)


def visible_count(df: DataFrame, user, role: str) -> DataFrame:
    """What others than admins learn of a list: how long it is."""
    return visible_to(df, user, role).agg(F.count(F.lit(1)).alias("n"))


def case_view(cases: DataFrame) -> DataFrame:
    """Cases as clients see them."""
    return cases.select(F.col("id").cast("string").alias("case_id"), F.col("user_id").alias("owner"), F.col("tipo").alias("type"), F.col("azienda").alias("company"), F.col("norma").alias("norm"), F.to_date("data_creazione").alias("created"))


def error_view(errors: DataFrame) -> DataFrame:
    """Errors as clients see them."""
    return errors.select("id", "error_type", F.coalesce("error_subtype", F.lit("")).alias("subtype"), F.col("resolved").cast("boolean").alias("resolved"), F.col("auto_recovered").cast("boolean").alias("recovered"))


def route_compact(docs: DataFrame, flag: str = "auto", threshold: int = 50) -> DataFrame:
    """docs(case_id, role) with compact: collective files go the compact way if it is on, or automatic and the case has many."""
    collective = F.coalesce(F.col("role") == "AGGREGABLE", F.lit(False))
    if flag != "auto":
        return docs.withColumn("compact", collective & F.lit(flag == "on"))
    many = docs.filter("role = 'AGGREGABLE'").groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= threshold)
    many = checked(many.select("case_id", F.lit(True).alias("_many")))
    return docs.join(many, "case_id", "left").withColumn("compact", collective & F.col("_many").isNotNull()).drop("_many")


def analysable(files: DataFrame) -> DataFrame:
    """Members with a suffix that has text."""
    return files.filter(F.lower("path").rlike(r"\.(pdf|docx?|xlsx?|txt|csv|rtf|eml|msg|html?|xml|odt|ods|pptx?|p7m)$"))


def shallow_warnings(evidence: DataFrame, lists: list[str]) -> DataFrame:
    """Fields of evidence(case_id, path, clusters map<string, map<string, string>>) that should hold a list but only say yes or present."""
    each = evidence.select("case_id", "path", F.explode("clusters").alias("cluster", "fields")).select("case_id", "path", "cluster", F.explode("fields").alias("field", "value"))
    shallow = F.lower(F.trim("value")).isin("si", "sì", "yes", "presente", "present", "presenti", "ok")
    return each.filter(F.col("field").isin(lists) & shallow)
