"""Streams give the rows of their batch twins."""

import json
import os
import time

from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.operators.windows import progress_pct
from paperloom.streaming import events as S


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    done = q.awaitTermination(60)
    q.stop()
    assert done
    return stream.sparkSession.table(name)


def _run_by_clock(stream, name):
    """For state with a time to live or timers of the clock, where a query that runs what is available never ends."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for _ in range(240):
            time.sleep(0.5)
            p = q.lastProgress
            if q.exception() or p and p["numInputRows"] == 0 and p["batchId"] > 2:
                break
        assert not q.exception()
        return stream.sparkSession.table(name), q.lastProgress
    finally:
        q.stop()


def _write(tmp_path, rows, files=3):
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        (tmp_path / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in part) + ("{bad\n" if i == 1 else ""))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))


def _events(n=60):
    return [{"session_id": f"s{i % 3}", "event_id": i, "ts": f"2024-01-01T00:00:{i // 4:02d}.{i % 4 * 200:03d}Z", "type": "done" if i > 56 else ["phase.tick", "file.done", "error", "llm.token"][i % 4], "pct": float((i * 37) % 100)} for i in range(n)]


def _same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def _batch(spark, tmp_path):
    from paperloom.sources.tables import read_events

    return read_events(spark, str(tmp_path))


def test_limiter_and_drop_counts(spark, tmp_path):
    _write(tmp_path, _events())
    streamed = _run(S.rate_limit(S.event_stream(spark, str(tmp_path), per_batch=1), 1), "limited")
    batch = S.rate_limit_batch(_batch(spark, tmp_path), 1)
    assert _same(streamed, batch) and batch.filter("not passed").count() > 0
    assert _same(S.drop_stats(streamed), S.drop_stats(batch))


def test_limiter_golden(spark):
    rows = [("s", i, f"2024-01-01 00:00:00.{i:03d}", "phase.tick") for i in range(10)] + [("s", 10, "2024-01-01 00:00:00.500", "error")]
    df = spark.createDataFrame(rows, "session_id string, event_id long, ts string, type string").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.rate_limit_batch(df, 3)
    assert out.filter("passed and type = 'phase.tick'").count() == 3 and out.filter("passed and type = 'error'").count() == 1


def test_progress_status_windows(spark, tmp_path):
    _write(tmp_path, _events())
    streamed = _run(S.progress_stream(S.event_stream(spark, str(tmp_path), per_batch=1)), "progress")
    assert _same(streamed, progress_pct(_batch(spark, tmp_path)).select("session_id", "event_id", "shown"))
    status = _run(S.session_status(S.event_stream(spark, str(tmp_path), per_batch=1)), "status", "complete")
    assert _same(status, S.session_status(_batch(spark, tmp_path)))
    per = S.events_per_window(S.event_stream(spark, str(tmp_path)).withColumn("value", F.col("pct")), "10 seconds")
    assert _same(_run(per, "windows", "complete"), S.events_per_window(_batch(spark, tmp_path).withColumn("value", F.col("pct")), "10 seconds"))
    stale = S.sessions_by_gap(S.event_stream(spark, str(tmp_path)), "5 seconds")
    assert _same(_run(stale, "stale", "complete"), S.sessions_by_gap(_batch(spark, tmp_path), "5 seconds"))


def test_unique_events(spark, tmp_path):
    _write(tmp_path, _events() + _events())
    assert _run(S.unique_events(S.event_stream(spark, str(tmp_path))), "unique").count() == 60


def test_reassembly_and_markers(spark, tmp_path):
    text = "meta:\n  azienda:\n  indice:\n## 08 · LEGALE\n### Scheda doc 3\n  titolo: 'Uno'\n" + "riga lunga di testo\n" * 40 + "  tipo: Visura\nfine"
    rows = [{"session_id": s, "seq": i, "text": text[i * 50 : i * 50 + 50], "status": "end" if (i + 1) * 50 >= len(text) else "more"} for s in ("a", "b") for i in range(-(-len(text) // 50))]
    _write(tmp_path, rows)
    fields = "session_id string, seq int, text string, status string"
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).json(str(tmp_path)).filter("seq is not null")
    batch = spark.read.schema(fields).json(str(tmp_path)).filter("seq is not null")
    whole = S.reassemble_batch(batch, 700)
    streamed, progress = _run_by_clock(S.reassemble(stream, 700), "whole")
    assert _same(streamed, whole) and whole.filter("truncated").count() == 2
    assert progress["stateOperators"][0]["numRowsTotal"] == 0
    found = S.markers_batch(S.reassemble_batch(batch))
    streamed, progress = _run_by_clock(S.markers(stream), "markers")
    assert _same(streamed, found)
    assert progress["stateOperators"][0]["numRowsTotal"] == 0
    assert {r.kind for r in found.collect()} == {"meta_azienda", "meta_indice", "category", "document", "doc_titolo", "doc_tipo"}


def test_replay_and_completion(spark):
    df = spark.createDataFrame([("s", "2024-01-01 00:00:01", 2, "done"), ("s", "2024-01-01 00:00:00", 1, "error")], "session_id string, ts string, event_id long, type string")
    assert [r.type for r in S.replay(df, "s").collect()] == ["error", "done", "replay.end"]
    totals = spark.createDataFrame([("c", 4)], "case_id string, total int")
    assert S.completion(spark.createDataFrame([("c",)], "case_id string"), totals).first().pct == 25.0


def test_limiter_of_a_hot_session(spark):
    """A session of 100,000 events, and small ones, pass as the limiter event by event says; its stretches are many tasks'."""
    import random

    r = random.Random(9)
    rows, t = [], 0
    for i in range(100_000):
        t += r.choice([0, 1, 200_000, 400_000, 1_000_000, 1_000_001, 3_000_000])
        rows.append(("hot" if i % 100 else f"s{i % 7}", i, t, r.choice(["phase.tick", "file.done", "error", "done"])))
    df = spark.createDataFrame(rows, "session_id string, event_id long, t long, type string").select("session_id", "event_id", F.timestamp_micros("t").alias("ts"), "type")
    found = {x.event_id: x.passed for x in S.rate_limit_batch(df, 2, 1.0).collect()}
    recent, want = {}, {}
    for s, i, t, kind in sorted(rows, key=lambda x: (x[2], x[1])):
        recent[s] = [x for x in recent.get(s, []) if x >= t - 1_000_000]
        want[i] = kind in C.PROTECTED_EVENTS or len(recent[s]) < 2
        if want[i]:
            recent[s].append(t)
    assert found == want


def test_progress_state_ends(spark, tmp_path):
    """A session's state is gone once the watermark has passed its idle time."""
    rows = [{"session_id": f"s{i % 3}", "event_id": i, "ts": f"2024-01-01T00:00:{i:02d}.000Z", "type": "phase.tick", "pct": 50.0} for i in range(30)]
    rows += [{"session_id": "late", "event_id": 100 + i, "ts": f"2024-01-01T0{3 + i}:00:00.000Z", "type": "phase.tick", "pct": 10.0} for i in range(3)]
    _write(tmp_path, rows, files=11)
    stream = S.progress_stream(S.event_stream(spark, str(tmp_path), per_batch=1), idle=60)
    q = stream.writeStream.format("memory").queryName("ending").outputMode("append").trigger(availableNow=True).start()
    done = q.awaitTermination(120)
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    assert done and max(state) >= 3 and state[-1] < max(state) and state[-1] <= 2
    assert spark.table("ending").count() == 33


def test_liveness_by_the_clock(spark, tmp_path):
    """A session that falls silent is stale although no event of any session comes; one that ended says so and no more."""
    rows = [{"session_id": s, "event_id": i, "ts": f"2024-01-01T00:00:0{i}.000Z", "type": "done" if s == "b" and i == 3 else "phase.tick"} for i in range(4) for s in ("a", "b")]
    _write(tmp_path, rows, files=2)
    q = S.liveness(S.event_stream(spark, str(tmp_path)), silence=4).writeStream.format("memory").queryName("alive").outputMode("append").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            found = {(r.session_id, r.status): r.events for r in spark.table("alive").collect()}
            if q.exception() or ("a", "stale") in found:
                break
        assert not q.exception()
    finally:
        q.stop()
    assert found == {("a", "alive"): 4, ("a", "stale"): 4, ("b", "done"): 4}
