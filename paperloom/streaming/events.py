"""Progress events as streams, each operator with the batch twin that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.functions import catalog as C
from paperloom.operators.windows import cap_stream, stretches
from paperloom.sources.tables import EVENT_FIELDS


def event_stream(spark: SparkSession, path: str, watermark: str = "10 minutes", per_batch: int = 100) -> DataFrame:
    """Events of JSON lines as they come; malformed lines are left out."""
    rows = spark.readStream.schema(EVENT_FIELDS).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", per_batch).json(path)
    return rows.filter("_corrupt is null and type is not null").drop("_corrupt").withWatermark("ts", watermark)


def unique_events(stream: DataFrame) -> DataFrame:
    """Events once each; of a stream, late ones beyond the watermark are dropped, of a table none is late."""
    key = ["session_id", "ts", "type"]
    return stream.dropDuplicatesWithinWatermark(key) if stream.isStreaming else stream.dropDuplicates(key)


def _micros(ts: pd.Series) -> list[int]:
    return (pd.to_datetime(ts).astype("datetime64[us]").astype("int64")).tolist()


def _limited(types: list[str], times: list[int], recent: list[int], n: int, window: int) -> tuple[list[bool], list[int]]:
    """Which events pass: protected ones always, others while fewer than n passed within the window; all that pass count."""
    passed = []
    for kind, t in zip(types, times, strict=True):
        recent = [x for x in recent if x >= t - window]
        ok = kind in C.PROTECTED_EVENTS or len(recent) < n
        if ok:
            recent.append(t)
        passed.append(ok)
    return passed, recent


_LIMITED = "session_id string, event_id long, ts timestamp, type string, passed boolean"


def rate_limit_batch(events: DataFrame, n: int = 5, seconds: float = 1.0) -> DataFrame:
    """events(session_id, event_id, ts, type) with passed, in the order of time within each session.

    After a silence longer than the window nothing that passed counts any more, so that a session is cut there and its
    stretches are dealt to tasks on their own. A task reads its stretches in order and keeps the times of one that
    passed lately, n and those of protected events; only a stretch without such a silence stays in one task.
    """
    window = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, recent = None, []
        for b in batches:
            passed = []
            for k, part in b.groupby(["session_id", "stretch"], sort=False, dropna=False):
                found, recent = _limited(part["type"].tolist(), _micros(part["ts"]), recent if k == key else [], n, window)
                key = k
                passed += found
            yield b[["session_id", "event_id", "ts", "type"]].assign(passed=passed)

    slim = events.select(F.col("session_id").cast("string").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "type")
    return stretches(slim, window).repartition("session_id", "stretch").sortWithinPartitions("session_id", "stretch", "ts", "event_id").mapInPandas(run, _LIMITED)


def rate_limit(stream: DataFrame, n: int = 5, seconds: float = 1.0) -> DataFrame:
    """T02 over a stream: the times of a session that passed lately are its state; those of an hour before the watermark lose theirs."""
    window = int(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        recent = list(state.get[0]) if state.exists else []
        passed, recent = _limited(rows["type"].tolist(), _micros(rows["ts"]), recent, n, window)
        state.update((recent,))
        state.setTimeoutTimestamp(max(recent, default=0) // 1000 + 3_600_000)
        yield rows.assign(passed=passed)[["session_id", "event_id", "ts", "type", "passed"]]

    slim = stream.select(F.col("session_id").cast("string").alias("session_id"), "event_id", "ts", "type")
    return slim.groupBy("session_id").applyInPandasWithState(step, _LIMITED, "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drop_stats(limited: DataFrame) -> DataFrame:
    """Events that passed and those dropped, by type."""
    return limited.groupBy("type").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("dropped"))


def session_status(events: DataFrame) -> DataFrame:
    """Events of each session and the type of the last; on a stream in update mode."""
    return events.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.length("type")).alias("chars"), F.max(F.struct("ts", "event_id", "type")).alias("last")).select("session_id", "events", "chars", "last.ts", "last.type")


def replay(events: DataFrame, session) -> DataFrame:
    """The events of a session in order, and an end marker with their number."""
    own = events.filter(F.col("session_id") == session).select("session_id", "ts", "event_id", "type")
    end = own.groupBy("session_id").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("event_id")).select("session_id", "ts", "event_id", F.lit("replay.end").alias("type"))
    return own.withColumn("last", F.lit(0)).unionByName(end.withColumn("last", F.lit(1))).orderBy("last", "ts", "event_id")


def sessions_by_gap(events: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Stretches of a session without a silence of the gap; each ends where the session went stale."""
    w = F.session_window("ts", gap)
    return events.groupBy("session_id", w.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("session_id", F.col("w.start").alias("started"), F.col("w.end").alias("stale_from"), "events")


def events_per_window(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Events and errors of each stretch of time and type."""
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 6).alias("total")).select(F.col("w.start").alias("started"), "type", "events", "total")


_PROGRESS = "session_id string, event_id long, shown double"


class _ByKey(StatefulProcessor):
    """A value for each key, which a step maps with the key's new rows to the next value (None: no more) and rows out.

    The value goes when the step says so, or idle after the key's last event: by a timer of event time where the rows
    have ts, by its time to live where they have not.
    """

    def __init__(self, step: Callable, fields: str, idle_ms: int, order: list[str]) -> None:
        self._step, self._fields, self._idle, self._order = step, fields, idle_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._timed = handle, self._order[0] == "ts"
        self._value = handle.getValueState("value", self._fields, **({} if self._timed else {"ttlDurationMs": self._idle}))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(self._order)
        value, out = self._step(key, new, self._value.get() if self._value.exists() else None)
        if self._timed:
            for t in list(self._handle.listTimers()):
                self._handle.deleteTimer(t)
        if value is None:
            self._value.clear()
        else:
            self._value.update(value)
            if self._timed:
                last = max(_micros(new["ts"])) // 1000
                self._handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self._idle)
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._value.clear()
        yield from ()

    def close(self) -> None:
        pass


def _rocksdb(df: DataFrame) -> None:
    """The state of these operators needs Spark's RocksDB store, which spills to disk; queries start with what is set then."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def progress_stream(stream: DataFrame, idle: float = 3600.0) -> DataFrame:
    """events(session_id, event_id, ts, type, pct) with the percentage to show: never less than before, at most 99 before done.

    The stream needs a watermark; a session's state goes idle seconds of event time after its last event.
    """

    def step(key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[tuple, pd.DataFrame]:
        high, done = value or (0.0, False)
        shown = []
        for kind, pct in zip(rows["type"], rows["pct"], strict=True):
            done = done or kind == "done"
            high = max(high, pct if pct == pct else 0.0)
            shown.append(100.0 if done else min(99.0, high))
        return (float(high), bool(done)), rows.assign(shown=shown)[["session_id", "event_id", "shown"]]

    _rocksdb(stream)
    slim = stream.select(F.col("session_id").cast("string").alias("session_id"), "event_id", "ts", "type", "pct")
    return slim.groupBy("session_id").transformWithStateInPandas(_ByKey(step, "high double, done boolean", int(idle * 1000), ["ts", "event_id"]), _PROGRESS, "Append", "EventTime")


_LIVENESS = "session_id string, status string, events long, last_ts timestamp"


class _Watch(StatefulProcessor):
    """Counts a session's events, and says that it is stale when none has come for a while of the clock."""

    def __init__(self, silence_ms: int) -> None:
        self._silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "events long, last_ts timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values("ts")
        events, last = self._seen.get() if self._seen.exists() else (0, None)
        back = events > 0 and not list(self._handle.listTimers())
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        newest = new["ts"].iloc[-1].to_pydatetime()
        last = newest if last is None else max(last.replace(tzinfo=newest.tzinfo), newest)
        events += len(new)
        if (new["type"] == "done").any():
            self._seen.clear()
            yield pd.DataFrame([(key[0], "done", events, last)], columns=["session_id", "status", "events", "last_ts"])
            return
        self._seen.update((events, last))
        self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._silence)
        if events == len(new) or back:
            yield pd.DataFrame([(key[0], "alive", events, last)], columns=["session_id", "status", "events", "last_ts"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events, last = self._seen.get()
        self._seen.clear()
        yield pd.DataFrame([(key[0], "stale", events, last)], columns=["session_id", "status", "events", "last_ts"])

    def close(self) -> None:
        pass


def liveness(stream: DataFrame, silence: float = 60.0) -> DataFrame:
    """T06 by the clock: events(session_id, ts, type) → alive with a session's first event, stale when none came for silence seconds, done at its end.

    Unlike sessions_by_gap it speaks while no event comes at all, since a timer of processing time wakes it. A session
    that is stale or done has no state; it counts anew, and is alive again, with its next event.
    """
    _rocksdb(stream)
    slim = stream.select(F.col("session_id").cast("string").alias("session_id"), "ts", "type")
    return slim.groupBy("session_id").transformWithStateInPandas(_Watch(int(silence * 1000)), _LIVENESS, "Append", "ProcessingTime")


_PARTS = "session_id string, text string, chars long, truncated boolean, status string"


def reassemble_batch(chunks: DataFrame, cap: int = 400_000) -> DataFrame:
    """chunks(session_id, seq, text, status) as one text for each session, up to cap characters; status is the last one."""
    # Empty chunks add nothing, so that a session's chunks are no more than its characters.
    cut = cap_stream(chunks, cap).filter("text <> ''")
    parts = F.sort_array(F.collect_list(F.struct("seq", "text")))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), "")
    whole = cut.groupBy("session_id").agg(text.alias("text"))
    last = chunks.groupBy("session_id").agg(F.max_by("status", "seq").alias("status"), F.sum(F.length("text")).alias("total"))
    return last.join(whole, "session_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).select(F.col("session_id").cast("string").alias("session_id"), "text", F.length("text").cast("long").alias("chars"), (F.coalesce("total", F.lit(0)) > cap).alias("truncated"), "status")


def reassemble(stream: DataFrame, cap: int = 400_000, idle: float = 3600.0) -> DataFrame:
    """T09 over a stream: a session's text comes out when a chunk of status end or abort arrives, and its state goes; idle seconds without one end it too."""

    def step(key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[tuple | None, pd.DataFrame]:
        text, total = value or ("", 0)
        out = []
        for part, status in zip(rows["text"].fillna(""), rows["status"], strict=True):
            total += len(part)
            text += part[: cap - len(text)]
            if status in ("end", "abort"):
                out.append((key[0], text, len(text), total > cap, status))
                text, total = "", 0
        return (text, total) if total else None, pd.DataFrame(out, columns=["session_id", "text", "chars", "truncated", "status"])

    _rocksdb(stream)
    slim = stream.select(F.col("session_id").cast("string").alias("session_id"), "seq", "text", "status")
    return slim.groupBy("session_id").transformWithStateInPandas(_ByKey(step, "text string, total long", int(idle * 1000), ["seq"]), _PARTS, "Append", "ProcessingTime")


_MARKERS = "session_id string, kind string, value string, at long"
#: Characters at the end of what has come that wait for more, so that a cut line is not taken for a marker.
HELD_BACK = 256


def find_markers(text: str, start: int, end: int) -> list[tuple[str, str, int]]:
    """Markers whose line starts in text[start:end], by place."""
    found = []
    for kind, p in C.MARKERS:
        for m in re.finditer(p, text):
            if start <= m.start() < end:
                found.append((kind, (m[1] if m.re.groups else m[0]).strip(), m.start()))
    return sorted(found, key=lambda x: (x[2], x[0]))


def markers_batch(texts: DataFrame) -> DataFrame:
    """The markers of texts(session_id, text) with their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *x) for k, t in zip(b["session_id"], b["text"].fillna(""), strict=True) for x in find_markers(t, 0, len(t))]
            yield pd.DataFrame(rows, columns=["session_id", "kind", "value", "at"])

    return texts.select(F.col("session_id").cast("string").alias("session_id"), "text").mapInPandas(run, _MARKERS)


def markers(stream: DataFrame, idle: float = 3600.0) -> DataFrame:
    """T10 over a stream of chunks(session_id, seq, text, status): each marker once, as soon as its line is complete.

    What has come is looked at up to the last whole line before the characters held back; the rest is the state, which
    goes with the end of the session, or idle seconds after its last chunk.
    """

    def step(key: tuple, rows: pd.DataFrame, value: tuple | None) -> tuple[tuple | None, pd.DataFrame]:
        tail, offset = value or ("", 0)
        out, last = [], False
        for part, status in zip(rows["text"].fillna(""), rows["status"], strict=True):
            tail += part
            last = status in ("end", "abort")
            end = len(tail) if last else tail.rfind("\n", 0, max(0, len(tail) - HELD_BACK)) + 1
            out += [(key[0], kind, found, offset + at) for kind, found, at in find_markers(tail[:end], 0, end)]
            tail, offset = ("", 0) if last else (tail[end:], offset + end)
        return None if last else (tail, offset), pd.DataFrame(out, columns=["session_id", "kind", "value", "at"])

    _rocksdb(stream)
    slim = stream.select(F.col("session_id").cast("string").alias("session_id"), "seq", "text", "status")
    return slim.groupBy("session_id").transformWithStateInPandas(_ByKey(step, "tail string, skipped long", int(idle * 1000), ["seq"]), _MARKERS, "Append", "ProcessingTime")


def completion(done: DataFrame, totals: DataFrame) -> DataFrame:
    """Batches done of each case and their share of totals(case_id, total)."""
    n = done.groupBy("case_id").agg(F.count(F.lit(1)).alias("done"))
    return n.join(totals, "case_id").withColumn("pct", F.round(100.0 * F.col("done") / F.col("total"), 1))
