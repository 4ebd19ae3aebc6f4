"""Many words at once equal a look at each word."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.operators import joins
from paperloom.operators.dictionary import Dictionary, matches

TEXT = st.text("abB é", max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=8), TEXT)
def test_dictionary(words, text):
    d = Dictionary(words, around=True)
    assert d.inside(text) == {w for w in words if w in text}
    assert d.around(text) == {w for w in words if text in w}


@pytest.mark.parametrize("most", [0, 1_000_000])
@pytest.mark.parametrize("around", [False, True])
def test_matches(spark, most, around):
    texts = [None, "", "ab", "xabx", "a", "ab", "q" * 5000 + "ab"]
    words = ["ab", "b", "", None, "xabxy", "ab"]
    t, w = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in words], "w string")
    want = {(a, b) for a in texts for b in words if a is not None and b is not None and (b in a or (around and a in b))}
    found = [tuple(r) for r in matches(t, "t", w, "w", around, most).collect()]
    assert len(found) == len(want) and set(found) == want


def test_empty_dictionary(spark):
    assert matches(spark.createDataFrame([("a",)], "t string"), "t", spark.createDataFrame([], "w string"), "w").count() == 0


def test_areas_and_priority(spark):
    table = spark.createDataFrame([("01 · ALFA", "01", 1), ("02 · ALFA BETA", "02", 2), ("03 · GAMMA", "03", 3)], "area string, code string, area_no int")
    names = ["2 x", "alfa", "beta", "see 03 · gamma here", "", None, "none", "· alfa"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, categoria string")
    found = {r.i: r.area for r in joins.route_area(rows, table).collect()}
    assert found == {0: "02 · ALFA BETA", 1: "01 · ALFA", 2: "02 · ALFA BETA", 3: "03 · GAMMA", 4: "01 · ALFA", 5: None, 6: None, 7: "01 · ALFA"}
    clash = rows.withColumn("_x", F.lit(1))
    found = {r.i: r.priority for r in joins.area_priority(clash, ["BETA", "ALFA", "ALTRO", "SEE"]).collect()}
    assert found == {0: 999, 1: 1, 2: 0, 3: 3, 4: 999, 5: 2, 6: 999, 7: 1}


def test_standards(spark):
    keys = spark.createDataFrame([("ISO 9001",), ("ISO 9001:2015",), ("ESG",), ("iso",)], "key string")
    rows = spark.createDataFrame([(1, "iso 9001"), (2, "UNI ISO 9001:2015 x"), (3, "Bilancio esg 9"), (4, None), (5, "x"), (6, "ISO 22000"), (7, "iso 9001")], "id int, norma string")
    found = {r.id: r.standard for r in joins.detect_standard(rows, keys).collect()}
    assert found == {1: "ISO 9001", 2: "ISO 9001:2015", 3: "ESG", 4: None, 5: None, 6: "iso", 7: "ISO 9001"}
