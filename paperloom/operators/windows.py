"""Window operators: numbering, running sums, filling, gaps and caps within a case or session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.operators.shared import carried, numbered, placed, stored, with_runs

_BEFORE = (Window.unboundedPreceding, -1)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each case and provider; of runs that end together the highest number."""
    return runs.groupBy("case_id", "provider").agg(F.max(F.struct("finished_at", "run_id")).alias("last")).select("case_id", "provider", "last.finished_at", "last.run_id")


def renumber(df: DataFrame, order: list, by: list[str] = ["case_id"], out: str = "numero") -> DataFrame:  # noqa: B006
    """Rows of a case numbered 1 to N in the order given, with no task that holds a whole case."""
    return numbered(df, by, order, out)


def running_offset(df: DataFrame, size: str, order: list, by: list[str], start: int = 1, out: str = "offset") -> DataFrame:
    """Start plus the sum of size over the rows before: of a range of rows, and of all ranges before."""
    rows = placed(df, by, order)
    runs = carried(rows, by, F.sum(size), lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)))
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(*_BEFORE)
    found = with_runs(rows, runs, by).withColumn(out, start + F.col("_of_part") + F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return found.drop("_at", "_part", "_first", "_of_part")


def homogeneous_groups(evidence: DataFrame, n: int = 3) -> DataFrame:
    """Types of which a section has n documents or more, numbered as they first appear."""
    groups = evidence.groupBy("case_id", "section_id", "tipo").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).filter(F.col("n") >= n)
    return renumber(groups, ["first_pos"], ["case_id", "section_id"], "group_no")


def fill_section(df: DataFrame, default: str = "18") -> DataFrame:
    """df(case_id, pos, own, header) with section: its own, else that of the nearest header above, else the default."""
    rows = placed(df, ["case_id"], ["pos"])
    last = F.max_by("header", F.when(F.col("header").isNotNull(), F.col("_at")))
    runs = carried(rows, ["case_id"], last, lambda x, w: F.last(x, ignorenulls=True).over(w))
    inside = Window.partitionBy("_part", "case_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce("own", F.last("header", ignorenulls=True).over(inside), "_of_part", F.lit(default))
    return with_runs(rows, runs, ["case_id"]).withColumn("section", section).drop("_at", "_part", "_first", "_of_part")


def merge_first(df: DataFrame, fields: list[str], order: str) -> DataFrame:
    """Of each field of a case the first value in order that is not null or empty."""
    filled = lambda c: F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.col(order))
    return df.groupBy("case_id").agg(*(F.min_by(F.col(c), filled(c)).alias(c) for c in fields))


def round_robin(df: DataFrame, order: list, by: list[str], n: int = 6, out: str = "group_no") -> DataFrame:
    """Rows dealt to n groups in turn."""
    return numbered(df, by, order, out, 0).withColumn(out, F.col(out) % n)


def chunk(df: DataFrame, order: list, by: list[str], n: int = 100, out: str = "chunk_no") -> DataFrame:
    """Rows in chunks of n."""
    return numbered(df, by, order, out, 0).withColumn(out, F.floor(F.col(out) / n).cast("int"))


def rotate(df: DataFrame, i: str, labels: list[str], out: str = "label") -> DataFrame:
    """The labels in turn by a row's number."""
    return df.withColumn(out, F.element_at(F.array(*map(F.lit, labels)), (F.pmod(F.col(i), F.lit(len(labels))) + 1).cast("int")))


def progress_pct(events: DataFrame) -> DataFrame:
    """events(session_id, ts, event_id, type, pct) with shown: the highest percentage so far, at most 99 before done, 100 from then on.

    A session may span any number of ranges; each takes over the highest percentage and the end of those before.
    """
    by = ["session_id"]
    rows = placed(events, by, ["ts", "event_id"])
    pct, done = F.coalesce("pct", F.lit(0.0)), (F.col("type") == "done").cast("int")
    so_far = lambda x, w: F.struct(F.coalesce(F.max(f"{x}.high").over(w), F.lit(0.0)).alias("high"), F.coalesce(F.max(f"{x}.done").over(w), F.lit(0)).alias("done"))
    runs = carried(rows, by, F.struct(F.max(pct).alias("high"), F.max(done).alias("done")), so_far)
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    high, ended = F.greatest(F.max(pct).over(inside), "_of_part.high"), F.greatest(F.max(done).over(inside), "_of_part.done")
    shown = F.when(ended == 1, 100.0).otherwise(F.least(F.lit(99.0), high))
    return with_runs(rows, runs, by).withColumn("shown", shown).drop("_at", "_part", "_first", "_of_part")


def with_silence(events: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """events of sessions placed in ranges, with _silence: microseconds since the session's event before, null for its first."""
    by = ["session_id"]
    rows = placed(events, by, [ts, order])
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    runs = carried(rows, by, F.max(micros), lambda x, w: F.max(x).over(w))
    inside = Window.partitionBy("_part", *by).orderBy("_at")
    before = F.coalesce(F.lag(micros).over(inside), "_of_part")
    return with_runs(rows, runs, by).withColumn("_silence", micros - before).drop("_first", "_of_part")


def gaps(events: DataFrame, seconds: int, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events that come more than seconds after the one before, with the silence in seconds."""
    found = with_silence(events, ts, order).withColumn("silence", F.round(F.col("_silence") / 1e6, 3))
    return found.filter(F.col("silence") > seconds).drop("_at", "_part", "_silence")


def stretches(events: DataFrame, micros: int, ts: str = "ts", order: str = "event_id", out: str = "stretch") -> DataFrame:
    """events with the number of their stretch in the session, from 1: a silence of more than micros begins a new one."""
    by = ["session_id"]
    rows = stored(with_silence(events, ts, order).withColumn("_new", (F.coalesce("_silence", F.lit(micros + 1)) > micros).cast("long")), "silences")
    runs = carried(rows, by, F.sum("_new"), lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)))
    inside = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return with_runs(rows, runs, by).withColumn(out, F.col("_of_part") + F.sum("_new").over(inside)).drop("_at", "_part", "_first", "_of_part", "_silence", "_new")


def cap_stream(chunks: DataFrame, cap: int = 400_000) -> DataFrame:
    """chunks(session_id, seq, text) up to cap characters of a session; the last is cut and flagged."""
    rows = chunks.withColumn("_length", F.coalesce(F.length("text"), F.lit(0)))
    out = running_offset(rows, "_length", ["seq"], ["session_id"], 0, "_before").filter(F.col("_before") < cap)
    left = F.lit(cap) - F.col("_before")
    return out.withColumn("truncated", F.length("text") > left).withColumn("text", F.substring(F.col("text"), F.lit(1), left.cast("int"))).drop("_before", "_length")


def first_match(files: DataFrame, word: str) -> DataFrame:
    """Of each case the first file by path whose name has the word."""
    hit = files.filter(F.lower("path").contains(word))
    return hit.groupBy("case_id").agg(F.min("path").alias("path"))
