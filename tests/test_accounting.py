"""No file disappears: the ledger's counts, and what raises."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import accounting, joins
from paperloom.sources import archives
from tests_zip import archive


def _files(spark, names, case="c"):
    return spark.createDataFrame([(case, n) for n in names], "case_id string, path string")


def _failures(spark, rows):
    return spark.createDataFrame(rows, "case_id string, path string, phase string, reason string")


def test_ledger(spark, tmp_path):
    inputs = _files(spark, [f"f{i}" for i in range(9)] + ["f0", None])
    why = _failures(spark, [("c", "f8", "ocr", "r"), ("c", "f8", "analyze", "q"), ("c", "elsewhere", "ocr", "r"), ("c", "f0", "ocr", "kept all the same")])
    args = inputs, _files(spark, ["f0", "f1", "f2", "f2"]), _files(spark, ["f3"]), why
    found = accounting.ledger(*args, str(tmp_path / "l"))
    rows = {r.path: (r.status, r.phase, r.reason) for r in found.collect()}
    assert len(rows) == found.count() == 10
    assert rows["f0"] == ("kept", None, None) and rows["f3"] == ("skipped", None, None)
    assert rows["f8"] == ("unprocessed", "analyze", "q") and rows[None] == ("unprocessed", "unknown", "unknown")
    old = {r.path for r in joins.unprocessed(*args).filter("path is not null").collect()}
    assert old == {p for p, r in rows.items() if r[0] == "unprocessed" and p}


@pytest.mark.parametrize(("kept", "skipped"), [(["a", "b"], ["b"]), (["a"], ["nowhere"])])
def test_doubled_and_stray_raise(spark, tmp_path, kept, skipped):
    with pytest.raises(accounting.Unaccounted, match="1 of"):
        accounting.ledger(_files(spark, ["a", "b"]), _files(spark, kept), _files(spark, skipped), _failures(spark, []), str(tmp_path / "l"))


def test_empty(spark, tmp_path):
    none = _files(spark, [])
    assert accounting.write_accounted(accounting.outcomes(none, none, none, _failures(spark, [])), str(tmp_path / "l")) == {"files": 0, "kept": 0, "skipped": 0, "unprocessed": 0}


def test_ingest(spark, tmp_path):
    content = archive({"a.txt": b"a text that is long enough", "short.txt": b"x", "__MACOSX/x": b"x", "../evil.txt": b"x", "b.xyz": b"?" * 50, "c.zip": archive({"in.txt": b"another long enough text"})})
    found = spark.createDataFrame([("c", bytearray(content))], "case_id string, content binary")
    members = archives.expand_archives(found).select("case_id", "path", "problem", (X.is_artifact("path") | (X.categorize("path") == "skip")).alias("artefact"))
    counts = accounting.write_accounted(accounting.ingest_outcomes(members, archives.ingest(found)), str(tmp_path / "l"))
    assert counts["files"] == members.count()
    status = {r.path: r.status for r in spark.read.parquet(str(tmp_path / "l")).collect()}
    assert status["a.txt"] == "kept" and status["short.txt"] == "unprocessed"
    assert sum(s == "kept" for s in status.values()) == 2
    assert any(s == "skipped" for s in status.values())


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    _files(spark, ["a.txt", "b.tmp"]).write.json(str(source), mode="append")
    status = F.when(F.col("path").endswith(".txt"), "kept").when(F.col("path").endswith(".tmp"), "skipped")

    def run():
        stream = spark.readStream.schema("case_id string, path string").json(str(source))
        accounting.accounted_stream(stream, status, str(out), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run()
    assert spark.read.parquet(str(out)).count() == 2
    _files(spark, ["c.txt", "what"]).write.json(str(source), mode="append")
    with pytest.raises(StreamingQueryException, match="1 of 2 files"):
        run()
