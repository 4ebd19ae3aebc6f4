"""Names of cases from texts, records of pipe tables, the archive by month."""

import gzip
import json

from paperloom.functions import text as X
from paperloom.operators import joins
from paperloom.sources import tables


def test_records(spark):
    text = "x\n| a | b | a |\n|---|:-:|---|\n| 1 | 2 | 3 |\n| 4 |\nbetween\n| only |\n\n| k | v |\n| 5 | 6 | 7 |\n|  |  |"  # a row of blanks reads as a rule
    df = spark.createDataFrame([(text,), (None,), ("",), ("no table",), ("|\n||\n",)], "t string").select(X.md_records("t").alias("r"))
    found = [r.r for r in df.collect()]
    assert found[0] == [{"b": "2", "a": "3"}, {"b": "", "a": ""}, {"k": "5", "v": "6"}]
    assert found[1:] == [[], [], [], []]


def test_long_table(spark):
    text = "| a | b |\n" + "| 1 | 2 |\n" * 20_000
    df = spark.createDataFrame([(text,)], "t string").select(X.md_records("t").alias("r"))
    assert df.selectExpr("size(r) AS n").first().n == 20_000


def test_names_of_cases(spark):
    cases = [
        (1, "consorzio_alfa.zip", "Denominazione: Alfa Beta SRL\n", "Voted SRL"),
        (2, "gamma_delta.zip", "Denominazione: Alfa Beta SRL\n", "Voted SRL"),
        (3, "allegati.zip", "Denominazione: Alfa Beta SRL\n", None),
        (4, "gamma_delta.zip", None, "Voted SRL"),
        (5, "allegati.zip", None, "Voted SRL"),
        (6, "allegati.zip", None, None),
        (7, "allegati.zip", None, " "),
        (8, None, None, None),
        (9, "abcd.zip", "Denominazione: Xyzw Beta SRL\n", None),
    ]
    paragraphs = [
        (6, 1, "Visura", "VISURA ORDINARIA relativa a Zeta Opere S.R.L. di Roma"),
        (6, 2, None, "denominata anche Omega SPA, e altro"),
        (6, 3, "", "denominata anche Omega  SPA; fine"),
        (7, 5, "a", "Consorzio Uno, e"),
        (7, 4, "b", "denominata anche Omega SPA;"),
        (8, 1, None, None),
        (8, 2, "x" * 900, "denominata anche Omega SPA"),
        (8, 3, "", "x" * 900 + " denominata anche Omega SPA"),
    ]
    df = spark.createDataFrame(cases, "case_id int, archive string, registry_text string, voted string")
    texts = spark.createDataFrame(paragraphs, "case_id int, numero int, sottotitolo string, contenuto string")
    found = {r.case_id: (r.name, r.how) for r in joins.resolve_case_name(df, texts).collect()}
    assert found == {
        1: ("ALFA BETA SRL", "registry_and_archive"),
        2: ("GAMMA DELTA", "archive"),
        3: ("ALFA BETA SRL", "registry"),
        4: ("GAMMA DELTA", "archive"),
        5: ("Voted SRL", "vote"),
        6: ("OMEGA SPA", "text"),
        7: ("OMEGA SPA", "text"),
        8: ("OMEGA SPA", "text"),
        9: ("XYZW BETA SRL", "registry"),
    }
    assert joins.resolve_case_name(df).filter("how = 'none'").count() == 3


def test_archive_by_month(spark, tmp_path):
    rows = [(1, "2024-03-09 10:00:00"), (2, "2024-03-01 10:00:00"), (3, "2024-02-20 10:00:00"), (4, "2023-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id int, ts string").selectExpr("id", "CAST(ts AS TIMESTAMP) AS ts")
    plan = tables.retention_plan(df, "2024-03-10")
    for _ in range(2):
        tables.archive_by_month(plan, str(tmp_path), "2024-03-10")
    found = {}
    for f in tmp_path.rglob("*.json.gz"):
        found[f.parent.name] = [json.loads(x)["id"] for x in gzip.open(f, "rt")]
    assert found == {"yyyy_mm=2024-03": [2], "yyyy_mm=2024-02": [3]}
    assert [r.id for r in tables.live_rows(plan).collect()] == [1]
