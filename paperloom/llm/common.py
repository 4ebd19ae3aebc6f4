"""What several operators share: tables in the shared folder, checked broadcasts, gapless numbering."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words are runs of anything but ASCII white space; bytes.split() of Python cuts at the same six bytes.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes up to which a table counts as small enough for a broadcast.
BROADCAST_BYTES = 64_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset and all runs on one machine, a folder in the warehouse; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables that stored() wrote, by what it returned, and in order.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_WRITTEN: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and fixes every row."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    _WRITTEN.append(path)
    return found


def spent(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, as all that was made of them is stored too."""
    for t in tables:
        _delete(t.sparkSession, _PATHS.pop(t))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete what stored() writes inside, at the end, but for the tables that are put into the list; all of it after a failure."""
    first, keep = len(_WRITTEN), []
    try:
        yield keep
    except BaseException:
        keep.clear()
        raise
    finally:
        kept = [_PATHS[t] for t in keep]
        for path in _WRITTEN[first:]:
            if path not in kept:
                _delete(spark, path)
        _WRITTEN[first:] = kept


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterations."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one batch of rows that a Python worker gets.
BATCH_BYTES = 8_000_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session that gives Python batches of BATCH_BYTES at most, unless it has a bound of its own.

    Texts have any size, so that Spark's 10,000 rows or 64 MB are much for a worker that makes several copies.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


def small(df: DataFrame, each: Column | None = None) -> DataFrame:
    """Hint a broadcast if df, a stored table, has no more than BROADCAST_BYTES; else leave the join to Spark.

    Bytes are rows times the width of their columns: a number 8, a digest or short string 40, and 16 for the row. Where
    each tells what a row counts, as for an array or a long value, its sum times 16 is added.
    """
    width = 16 + sum(40 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 for f in df.schema)
    found = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if each is None else each), F.lit(0))).first()
    return F.broadcast(df) if found[0] * width + found[1] * 16 <= BROADCAST_BYTES else df


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, also those whose names hold dots."""
    return [F.col(f"`{c}`") for c in df.columns]


def unused(name: str, df: DataFrame) -> str:
    """A column name made of name that df does not have; names differ in more than case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of words; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, with no task that holds a whole key.

    Every partition is sorted by key and stored with its row numbers; only the counts of each (key, partition) are
    summed up over the partitions, and each row adds its place to its partition's offset. Keys must not be null.
    """
    placed = stored(df.sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    runs = stored(runs.select(*keys, "_part", (F.col("_before") - F.col("_first")).alias("_shift")), f"{name}-runs")
    return placed.join(small(runs), [*keys, "_part"]).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
