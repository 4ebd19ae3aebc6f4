"""Tables in the folder that driver and executors share, and numbering that no task does for a whole key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes up to which a side counts as small enough for a broadcast.
BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset and all runs on one machine, a folder in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it again: what made it runs once, however often it is used."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of df, a stored or cheap table, if its rows take no more than that many bytes; else Spark picks the join.

    A string counts as its bytes and eight more, a number as 16, a struct or list as 256, a row as 16 more.
    """
    nested = sum(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema)
    strings = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    fixed = 16 + 16 * (len(df.columns) - len(strings)) + 8 * len(strings) + 240 * nested
    each = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in strings), F.lit(fixed)).cast("long")
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= most else df


#: Bytes of one batch of rows that a Python worker gets.
BATCH_BYTES = 4_000_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session that gives Python batches of BATCH_BYTES at most, unless it has a bound of its own.

    Rows that hold files or whole texts have any size, so that Spark's 10,000 rows or 64 MB are much for a worker that makes
    several copies, of which a task may have three at once.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


def placed(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df dealt to ranges of (by, order) and stored, with _part, its range, and _at, which rises in that order.

    A key of any size is spread over as many ranges as it needs, so that what follows is a sum over ranges.
    """
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return stored(ranged, "placed").withColumn("_part", F.shiftright("_at", 33))


def carried(rows: DataFrame, by: list[str], inside: Column, over_parts) -> DataFrame:
    """One row for each key and range of placed rows: _of_part, over_parts of the aggregates inside of the ranges before."""
    runs = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), inside.alias("_x"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(runs.withColumn("_of_part", over_parts("_x", before)).drop("_x"), "runs")


def with_runs(rows: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their key and range in runs; keys may be null."""
    runs = checked(runs.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_run"), "_first", "_of_part"))
    same = F.col("_part") == F.col("_run")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return rows.join(runs, same).drop("_run", *(f"_by{i}" for i in range(len(by))))


def numbered(df: DataFrame, by: list[str], order: list, out: str, first: int = 1) -> DataFrame:
    """df with out: the rows of each key numbered in order from first, as row_number would."""
    rows = placed(df, by, order)
    runs = carried(rows, by, F.count(F.lit(1)), lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)))
    number = (F.col("_at") - F.col("_first") + F.col("_of_part") + first).cast("int")
    return with_runs(rows, runs, by).withColumn(out, number).drop("_at", "_part", "_first", "_of_part")
