"""Every file that goes in comes out as kept, skipped or unprocessed; counted in the pass that writes the ledger.

The counts are metrics of the job that writes (`DataFrame.observe`), taken in its last stage, so that a task that runs
again after a lost executor counts once. A difference raises, in batch and in every micro-batch of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

KEY = ["case_id", "path"]
STATUSES = ("kept", "skipped", "unprocessed")


class Unaccounted(RuntimeError):
    """Files went in that came out in no way, in two ways, or without having gone in."""


def outcomes(inputs: DataFrame, kept: DataFrame, skipped: DataFrame, failures: DataFrame) -> DataFrame:
    """A row for each file of inputs, kept or skipped with its status; phase and reason of unprocessed ones.

    All take case_id and path, failures(case_id, path, phase, reason) too; rows of one file count as one, of several
    failures the first by phase and reason tells. A file that was kept or skipped but never went in is stray, one both
    kept and skipped is doubled. A null case or path is a value like any other. One shuffle does for all four tables.
    """
    why = F.struct("phase", "reason")
    none = F.lit(None).cast("struct<phase: string, reason: string>")
    part = lambda df, name: df.select(*(F.col(k).cast("string").alias(k) for k in KEY), F.lit(name).alias("_from"), (why.cast("struct<phase: string, reason: string>") if name == "failed" else none).alias("_why"))
    rows = part(inputs, "in").unionByName(part(kept, "kept")).unionByName(part(skipped, "skipped")).unionByName(part(failures, "failed"))
    seen = {n: F.bool_or(F.col("_from") == n).alias(f"_{n}") for n in ("in", "kept", "skipped")}
    files = rows.groupBy(*KEY).agg(*seen.values(), F.min("_why").alias("_why")).filter("_in OR _kept OR _skipped")
    status = F.when(~F.col("_in"), "stray").when(F.col("_kept") & F.col("_skipped"), "doubled").when(F.col("_kept"), "kept").when(F.col("_skipped"), "skipped").otherwise("unprocessed")
    lost = status == "unprocessed"
    told = lambda c: F.when(lost, F.coalesce(f"_why.{c}", F.lit("unknown"))).alias(c)
    return files.select(*KEY, status.alias("status"), told("phase"), told("reason"))


def _metrics(status: Column) -> list[Column]:
    """Rows of each status, and those of any other or none."""
    known = [F.count_if(status == s).alias(s) for s in STATUSES]
    return [F.count(F.lit(1)).alias("files"), *known]


def _check(found: dict, where: str) -> dict:
    rest = found["files"] - sum(found[s] for s in STATUSES)
    if rest:
        raise Unaccounted(f"{where}: {rest} of {found['files']} files are neither {', '.join(STATUSES)}")
    return found


def write_accounted(files: DataFrame, path: str, status: str = "status") -> dict:
    """Write files with a status to a new folder and count them on the way; the counts. Raises if a status is none of STATUSES.

    The table stays where it raises, so that the rows at fault can be looked at. An empty table has counts of zero.
    """
    seen = Observation()
    files.observe(seen, *_metrics(F.col(status))).write.parquet(path)
    return _check(seen.get, path)


def ledger(inputs: DataFrame, kept: DataFrame, skipped: DataFrame, failures: DataFrame, path: str) -> DataFrame:
    """The outcome of every file, written to path in one pass that checks that none is lost, doubled or stray."""
    write_accounted(outcomes(inputs, kept, skipped, failures), path)
    return inputs.sparkSession.read.parquet(path)


def ingest_outcomes(members: DataFrame, ingested: DataFrame) -> DataFrame:
    """The outcome of each member(case_id, path, problem, artefact) of archives, given the rows of `ingest`.

    Kept are members with enough text, of an envelope in any document in it; skipped are artefacts, members that are not
    read by their kind, and those with a problem; the rest is unprocessed, with the method that ingest tells as reason.
    """
    skipped = members.filter("problem is not null or artefact")
    # A document in an envelope has the envelope's path before its own.
    read = members.filter("problem is null and not artefact")
    up = F.expr("transform(sequence(1, size(split(path, '/'))), i -> array_join(slice(split(path, '/'), 1, i), '/'))")
    rows = ingested.select("case_id", F.col("path").alias("_path"), "enough", "method", F.explode(up).alias("path"))
    found = rows.join(read.select(*KEY).distinct(), KEY, "left_semi")
    kept = found.filter("enough")
    failed = found.filter("not enough").select(*KEY, F.lit("text").alias("phase"), F.col("method").alias("reason"))
    return outcomes(members, kept, skipped, failed)


def accounted_stream(stream: DataFrame, status: Column, path: str, checkpoint: str):
    """A writer that appends a stream of files with their status, and fails at the first micro-batch with a file that has none.

    A batch that runs again after a failure replaces its own folder, so that no file is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation()
        rows = batch.withColumn("status", status).observe(seen, *_metrics(F.col("status")))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        _check(seen.get, f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
