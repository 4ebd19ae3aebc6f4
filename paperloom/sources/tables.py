"""Registers, logs and reports as tables: reading, appending, changing, keeping and exporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators.shared import numbered

EVENT_FIELDS = "type string, ts timestamp, session_id string, phase string, pct double, detail string, duration_seconds double, filename string, size_bytes long, kind string, msg string, chars long, method string, success boolean, batch int, chunk string, event_id long, _corrupt string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines; malformed and blank lines are left out."""
    rows = spark.read.schema(EVENT_FIELDS).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null and type is not null").drop("_corrupt")


def read_checklists(spark: SparkSession, path: str) -> DataFrame:
    """clauses(case_id, norm, clause_key, text) of checklist files in either form: a map of clauses, or a list of answers."""
    fields = "norma string, azienda string, clausole map<string, string>, contenuto array<struct<requisito: string, evidenza: string>>"
    return parse_checklists(spark.read.schema(fields).option("multiLine", "true").json(path))


def parse_checklists(rows: DataFrame) -> DataFrame:
    """The same of rows(azienda, norma, clausole, contenuto)."""
    head = [F.col("azienda").alias("case_id"), F.col("norma").alias("norm")]
    maps = rows.select(*head, F.explode("clausole").alias("clause_key", "text"))
    lists = rows.select(*head, F.explode("contenuto").alias("x")).select("case_id", "norm", F.col("x.requisito").alias("clause_key"), F.col("x.evidenza").alias("text"))
    return maps.unionByName(lists)


REPORT_FIELDS = "type string, case_id string, title string, categoria string, numero int, contenuto string, _corrupt string"


def report_rows(paragraphs: DataFrame) -> DataFrame:
    """Header, category and paragraph rows of a report, of paragraphs(case_id, categoria, numero, contenuto)."""
    head = paragraphs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit("header").alias("type"), "case_id", F.concat(F.lit("Report "), F.col("case_id").cast("string")).alias("title"))
    parts = paragraphs.select(F.lit("category").alias("type"), "case_id", "categoria").distinct()
    body = paragraphs.select(F.lit("paragraph").alias("type"), "case_id", "categoria", "numero", "contenuto")
    return head.unionByName(parts, allowMissingColumns=True).unionByName(body, allowMissingColumns=True)


def write_report_jsonl(paragraphs: DataFrame, path: str) -> None:
    """S14."""
    report_rows(paragraphs).write.mode("append").json(path)


def read_report_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Rows of report files; corrupt holds lines that are no JSON."""
    return spark.read.schema(REPORT_FIELDS).option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumnRenamed("_corrupt", "corrupt")


def append_rows(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append rows to a table of files, in folders by some columns if asked for."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def resolve_errors(errors: DataFrame, ids: DataFrame, by: str, at: str) -> DataFrame:
    """Errors with those of ids(id) marked as resolved; earlier marks stay. versions.resolve_errors_in writes it as a new version."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    out = errors.join(hit, "id", "left")
    now = F.col("_hit").isNotNull() & ~F.col("resolved")
    marks = {"resolved_by": by, "resolved_at": at}
    old = lambda c: F.col(c) if c in errors.columns else F.lit(None)
    rest = [c for c in errors.columns if c not in ("resolved", *marks)]
    return out.select(*(F.col(f"`{c}`") for c in rest), (F.col("resolved") | F.col("_hit").isNotNull()).alias("resolved"), *(F.when(now, F.lit(v)).otherwise(old(c)).alias(c) for c, v in marks.items()))


def delete_cases(cases: DataFrame, ids: DataFrame, owner=None) -> DataFrame:
    """Cases without those of ids(id), with an owner given only without that owner's."""
    if owner is None:
        return cases.join(ids.select("id"), "id", "left_anti")
    gone = ids.select("id").withColumn("user_id", F.lit(owner).cast(cases.schema["user_id"].dataType))
    return cases.join(gone, ["id", "user_id"], "left_anti")


def write_snapshot(df: DataFrame, path: str) -> None:
    """A snapshot of each case as JSON, replaced as a whole."""
    df.write.mode("overwrite").partitionBy("case_id").json(path)


def write_sections(evidence: DataFrame, path: str) -> None:
    """Evidence in a folder for each case and section."""
    evidence.write.mode("overwrite").partitionBy("case_id", "section_id").parquet(path)


def list_sections(evidence: DataFrame) -> DataFrame:
    """The sections that a written table has; a read of their folders only."""
    return evidence.groupBy("case_id", "section_id").agg(F.count(F.lit(1)).alias("documents"))


def export_cases(cases: DataFrame) -> DataFrame:
    """The list of cases for a spreadsheet, newest first and numbered by user."""
    return numbered(cases, ["user_id"], [F.desc("data_creazione"), "id"], "n").select("user_id", "n", "id", "tipo", "azienda", "norma", F.date_format("data_creazione", "dd/MM/yyyy").alias("data"), F.round("processing_time_seconds", 1).alias("secondi"))


def retention_plan(df: DataFrame, as_of: str, live: int = 7, archive: int = 30, ts: str = "ts") -> DataFrame:
    """Rows with action by age: live, archive or delete, and the month of archived ones."""
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date(ts))
    action = F.when(age < live, "live").when(age < archive, "archive").otherwise("delete")
    return df.withColumn("action", action).withColumn("yyyy_mm", F.when(F.col("action") == "archive", F.date_format(ts, "yyyy-MM")))


def retention_summary(plan: DataFrame, size: Column) -> DataFrame:
    """Rows and bytes of each action."""
    return plan.groupBy("action", "yyyy_mm").agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"))


def archive_by_month(plan: DataFrame, path: str, as_of: str) -> None:
    """The rows of a retention plan to archive as gzip JSON, in a folder for each run and month; a run done again replaces its own.

    Rows to archive are written whole before `live_rows` is published, so that a failure between the two loses none.
    """
    rows = plan.filter(F.col("action") == "archive").drop("action")
    rows.write.mode("overwrite").partitionBy("yyyy_mm").option("compression", "gzip").json(f"{path}/run={as_of}")


def live_rows(plan: DataFrame) -> DataFrame:
    """The rows of a retention plan that stay, with their own columns."""
    return plan.filter(F.col("action") == "live").drop("action", "yyyy_mm")


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content no row of manifest(hash) has."""
    return files.withColumn("hash", X.content_hash("text")).join(manifest.select("hash").distinct(), "hash", "left_anti")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """A table whose files gained columns over time; older rows have nulls there."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def narrative_to_evidence(df: DataFrame) -> DataFrame:
    """paragraphs(case_id, numero, categoria, contenuto) as evidence, in the section that the category's number names, else 18."""
    return df.select("case_id", F.coalesce(X.area_code("categoria"), F.lit("18")).alias("section_id"), F.col("numero").alias("pos"), F.lit("Paragrafo").alias("tipo"), F.col("contenuto").alias("text"))
