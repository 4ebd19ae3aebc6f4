"""Golden cases and invariants of operators that SQL does not cover."""

import io
import time
import zipfile

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import batching, evidence, files, joins, safety_net
from paperloom.sources import archives, tables


def _classified(spark, rows):
    return spark.createDataFrame(rows, "case_id string, path string, filename string, text string, role string, role_conf double")


def test_volume_cap_keeps_the_surest(spark):
    rows = [("c", f"f{i}", f"f{i}", "", "NOISE" if i < 5 else "CORE", 0.99 if i == 0 else 0.91) for i in range(10)]
    out = {r.path: r.role for r in safety_net.volume_cap(_classified(spark, rows)).collect()}
    assert [p for p, r in out.items() if r == "NOISE"] == ["f0"] and sum(r == "SUPPORT" for r in out.values()) == 4
    rows = [("c", f"f{i}", f"f{i}", "", "NOISE" if i < 2 else "CORE", 0.95) for i in range(22)]
    assert safety_net.volume_cap(_classified(spark, rows)).filter("role = 'NOISE'").count() == 2
    rows = [("c", f"f{i}", f"f{i}", "", "NOISE", 0.95) for i in range(5)]
    assert safety_net.volume_cap(_classified(spark, rows)).filter("role = 'NOISE'").count() == 5


def test_safety_net_layers(spark):
    long = "x" * 300
    rows = [
        ("c", "a/DVR_2024.pdf", "DVR_2024.pdf", "one", "NOISE", 0.99),
        ("c", "b/copy1.pdf", "copy1.pdf", long, "CORE", 0.9),
        ("c", "b/copy2.pdf", "copy2.pdf", f"  {long}\n", "CORE", 0.9),
        ("c", "s1.pdf", "s1.pdf", "short", "CORE", 0.9),
        ("c", "s2.pdf", "s2.pdf", "short", "CORE", 0.9),
        ("c", "n.pdf", "n.pdf", "n", "NOISE", None),
        ("c", "m.pdf", "m.pdf", None, None, None),
    ]
    out = {r.path: r for r in safety_net.safety_net(_classified(spark, rows)).collect()}
    assert out["a/DVR_2024.pdf"].role == "CORE" and out["a/DVR_2024.pdf"].matched.strip("_") == "DVR"
    assert out["b/copy2.pdf"].duplicate_of == "b/copy1.pdf" and out["b/copy2.pdf"].skipped
    assert not out["s2.pdf"].skipped and out["n.pdf"].role == "SUPPORT" and out["m.pdf"].role == "SUPPORT"
    assert safety_net.safety_net(_classified(spark, rows).limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["CORE", "NOISE", "SUPPORT", None]), st.sampled_from([None, 0.5, 0.9, 0.95]), st.sampled_from(["a" * 250, "b" * 250, "c"])), min_size=1, max_size=40))
def test_safety_net_never_skips_core(spark, rows):
    """No file that is CORE and no duplicate is skipped, and at most the share of a case."""
    df = _classified(spark, [("c", f"f{i:03}", f"f{i:03}", t, r, c) for i, (r, c, t) in enumerate(rows)])
    out = safety_net.safety_net(df).collect()
    roles = {f"f{i:03}": r for i, (r, _, _) in enumerate(rows)}
    assert len(out) == len(rows)
    assert not [r for r in out if r.skipped and roles[r.path] == "CORE" and r.duplicate_of is None]
    if len(rows) >= 10:
        assert sum(r.skipped for r in out) <= int(len(rows) * 0.15)


def test_ffd_batches(spark):
    docs = spark.createDataFrame([("c", f"f{i}", n) for i, n in enumerate([30000, 15000, 15000, 5000, 5000])], "case_id string, path string, n_chars int")
    out = {r.path: r.batch_id for r in batching.ffd_batches(docs, 4, 50000).collect()}
    assert out == {"f0": 0, "f1": 0, "f2": 1, "f3": 0, "f4": 1}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 60000), min_size=1, max_size=60))
def test_ffd_bounds(spark, sizes):
    docs = spark.createDataFrame([("c", f"f{i:03}", n) for i, n in enumerate(sizes)], "case_id string, path string, n_chars int")
    out = batching.ffd_batches(docs).toPandas()
    assert len(out) == len(sizes)
    for _, b in out.groupby("batch_id"):
        assert len(b) <= 4 and (b["n_chars"].sum() <= 50000 or len(b) == 1)


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark):
    inner = _zip({"deep.txt": "deep"})
    content = _zip({"a.txt": "one", "__MACOSX/._a": "x", ".hidden": "x", "../up.txt": "x", "/abs.txt": "x", "in.zip": inner, "bad.zip": b"nothing"})
    df = spark.createDataFrame([("c1", bytearray(content)), ("c2", bytearray(b"no archive"))], "case_id string, content binary")
    out = {(r.case_id, r.path): r for r in archives.expand_archives(df).collect()}
    assert bytes(out["c1", "a.txt"].content) == b"one" and bytes(out["c1", "in.zip/deep.txt"].content) == b"deep"
    assert out["c1", "../up.txt"].problem == "unsafe_path" and out["c1", "/abs.txt"].problem == "unsafe_path"
    assert out["c1", "bad.zip"].problem == "bad_archive" and out["c2", "c2"].problem == "bad_archive"
    assert not [p for _, p in out if "MACOSX" in p or "hidden" in p]
    limited = archives.expand_archives(df.filter("case_id = 'c1'"), max_files=1).collect()
    assert [r.path for r in limited if r.problem == "limit"] == ["in.zip"]
    flat = archives.expand_archives(df.filter("case_id = 'c1'"), max_depth=1).collect()
    assert [r for r in flat if r.problem == "too_deep"]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "case1").mkdir()
    (tmp_path / "case1" / "x.zip").write_bytes(_zip({"a.txt": "one"}))
    (tmp_path / "case1" / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    assert [(r.case_id, r.path) for r in archives.read_archives(spark, f"{tmp_path}/case1/*.zip").collect()] == [("x", "a.txt")]
    found = archives.read_folder(spark, str(tmp_path), "*.txt").withColumn("text", archives.decode_text("content")).collect()
    assert [(r.case_id, r.path, r.text) for r in found] == [("case1", "case1/b.txt", "café")]
    archives.archive_table_function(spark)
    row = spark.sql(f"SELECT t.* FROM (SELECT unhex('{_zip({'a.txt': 'one'}).hex()}') AS c) s, LATERAL expand_archive(s.c) t").first()
    assert (row.path, row.size) == ("a.txt", 3)


def test_extract_text(spark):
    docx = _zip({"word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>Hello</w:t></w:p><w:p><w:t>World</w:t></w:p></w:d>'})
    xlsx = _zip({"xl/sharedStrings.xml": '<s xmlns="x"><si><t>name</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="x"><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>'})
    mail = b"From: a@example.com\nSubject: Hi\n\nbody text\n"
    rows = [("c", "a.docx", docx), ("c", "b.xlsx", xlsx), ("c", "c.eml", mail), ("c", "d.html", b"<p>x</p><script>y</script>"), ("c", "e.docx", b"broken"), ("c", "f.bin", b"x"), ("c", "g.txt", None), ("c", "h.rtf", rb"{\rtf1 Hello\par World}")]
    df = spark.createDataFrame([(a, b, bytearray(c) if c is not None else None) for a, b, c in rows], "case_id string, path string, content binary")
    out = {r.path: r for r in archives.extract_text(df).collect()}
    assert out["a.docx"].text == "Hello\nWorld" and out["b.xlsx"].text == "name | 5"
    assert "Subject: Hi" in out["c.eml"].text and "body text" in out["c.eml"].text and out["d.html"].text == "x"
    assert out["e.docx"].method.startswith("failed") and out["f.bin"].method == "no_handler" and out["g.txt"].method == "missing"
    assert out["h.rtf"].text.split() == ["Hello", "World"]


def test_embedded_and_strings(spark):
    df = spark.createDataFrame([("c", "x.p7m", bytearray(b"\x01\x02%PDF-1.4 abc%%EOF\x00"))], "case_id string, path string, content binary")
    assert bytes(archives.carve_embedded(df).first().content) == b"%PDF-1.4 abc%%EOF"
    found = spark.createDataFrame([(bytearray(b"\x00\x01Hello\x00\x02" + "Ciao mondo".encode("utf-16-le")),)], "c binary").select(archives.binary_strings("c").alias("s")).first().s
    assert "Hello" in found and "Ciao mondo" in found


def test_event_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"type": "done", "session_id": "s"}\n{garbage not json\n\n{"type": "error", "session_id": "s"}\n')
    assert tables.read_events(spark, str(tmp_path)).count() == 2


def test_tables_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("c", 1, "A", "text"), ("c", 2, "A", "more")], "case_id string, numero int, categoria string, contenuto string")
    tables.write_report_jsonl(p, f"{tmp_path}/r")
    rows = tables.read_report_jsonl(spark, f"{tmp_path}/r")
    assert {r.type: r["count"] for r in rows.groupBy("type").count().collect()} == {"header": 1, "category": 1, "paragraph": 2}
    tables.append_rows(p, f"{tmp_path}/t")
    tables.append_rows(p.withColumn("extra", F.lit(1)), f"{tmp_path}/t")
    assert tables.read_merged(spark, f"{tmp_path}/t").filter("extra is null").count() == 2
    e = p.withColumn("section_id", F.lit("08"))
    tables.write_sections(e, f"{tmp_path}/s")
    assert tables.list_sections(spark.read.parquet(f"{tmp_path}/s")).first().documents == 2
    tables.write_snapshot(p, f"{tmp_path}/snap")
    assert spark.read.json(f"{tmp_path}/snap").count() == 2
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.json").write_text('{"norma": "ISO 9001", "azienda": "x", "clausole": {"a": "1", "b": "2"}}')
    (tmp_path / "k" / "b.json").write_text('{"norma": "ESG", "azienda": "x", "contenuto": [{"requisito": "q", "evidenza": "z"}]}')
    assert {(r.norm, r.clause_key) for r in tables.read_checklists(spark, f"{tmp_path}/k").collect()} == {("ISO 9001", "a"), ("ISO 9001", "b"), ("ESG", "q")}


def test_evidence_never_loses_a_chunk(spark):
    raw = "```yaml\nmeta:\n  azienda:\n    nome: 'ALFA SRL'\nsezioni:\n- nome: '08 · LEGALE'\n  documenti:\n  - tipo: Visura\n    titolo: T1\n  - tipo: DVR\n    titolo: T2\n```\n---\n{{garbage\n---\ntipo: Fattura\ncategoria: '10 · SSL'\n"
    df = spark.createDataFrame([("c", 1, raw), ("c", 2, None), ("c", 3, "")], "case_id string, batch_id int, text string")
    cards, meta, failures = evidence.assemble(df)
    assert [(r.section, r.card["tipo"]) for r in cards.orderBy("pos").collect()] == [("08 · LEGALE", "Visura"), ("08 · LEGALE", "DVR"), ("10 · SSL", "Fattura")]
    assert meta.first().company == "ALFA SRL" and failures.count() == 1


def test_narrative_tiers(spark):
    rows = [("c", 1, '[{"numero": 1, "categoria": "A"}]'), ("c", 2, 'noise {"numero": 2, "categoria": "B",} {"x"'), ("c", 3, "nothing"), ("c", 4, None)]
    out = evidence.parse_narrative(spark.createDataFrame(rows, "case_id string, batch_id int, text string")).collect()
    assert sorted((r.batch_id, r.tier, r.categoria) for r in out) == [(1, 1, "A"), (2, 2, "B")]


def test_recovery_loses_nothing(spark):
    docs = spark.createDataFrame([("c", i // 3, f"f{i}") for i in range(12)], "case_id string, batch_id long, path string")

    def scorer(batches):
        for b in batches:
            b = b[(b["batch_id"] != 1) & ~b["path"].isin(["f4"]) | (b["batch_id"] > 10) & (b["path"] != "f4")]
            yield b.assign(output="x")[["case_id", "batch_id", "path", "output"]]

    done, failed = batching.recover(docs, scorer, "case_id string, batch_id long, path string, output string")
    assert done.select("path").distinct().count() == 11 and [r.path for r in failed.collect()] == ["f4"]


def test_ledger_accounts_for_every_file(spark):
    df = spark.createDataFrame([("c", f"f{i}") for i in range(9)], "case_id string, path string")
    part = lambda k: df.filter(F.substring("path", 2, 1).cast("int") % 3 == k)
    why = part(2).limit(1).withColumn("phase", F.lit("ocr")).withColumn("reason", F.lit("r"))
    out = joins.unprocessed(df, part(0), part(1), why)
    assert out.count() == 3 and out.filter("phase = 'ocr'").count() == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("CONSORZIO STABILE ALFA SOCIETA' CONSORTILE PER AZIONI",), ("CONSORZIO STABILE ALFA S.C.P.A.",), ("CONSORZIO STABILE ALFA SOC CONS RL",)], "n string")
    assert {r.k for r in df.select(X.company_key("n").alias("k")).collect()} == {"consorzio stabile alfa"}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.area_code(F.lit("8 LEGALE"))) == "08" and one(X.area_code(F.lit("19 X"))) is None
    assert one(X.clean_company(F.lit("Alfa S.r.l."))) == "Alfa" and one(X.it_date(F.lit("31/02/2024"))) is None
    assert one(X.py_strip(F.lit("  x  "))) == "x" and one(X.printable_ratio(F.lit("ab\x01\x02"))) == 0.5
    assert one(X.md_tables(F.lit("| a | b |\n|---|---|\n| 1 | 2 |"))) == [["a", "b"], ["1", "2"]]
    assert one(files.has_text(F.lit(None).cast("string"))) is False


def test_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "case_id string, path string, text string")
    assert files.triage(empty).count() == 0
    one = spark.createDataFrame([(None, None, None)], "case_id string, path string, text string")
    assert files.triage(one).first().bucket == "non_pdf"
    docs = spark.createDataFrame([], "case_id string, path string, n_chars int")
    assert batching.ffd_batches(docs).count() == 0


def test_keyword_cascade(spark):
    df = spark.createDataFrame([("c", "a", "visura.pdf", "x" * 80), ("c", "b", "b.pdf", ""), ("c", "d", "boh.pdf", "y" * 80)], "case_id string, path string, filename string, text string")
    strong = lambda it: (b[["case_id", "path"]].assign(classe="DVR", confidence=0.95) for b in it)
    out = {r.path: r for r in batching.cascade(df, strong=strong).collect()}
    assert out["a"].classe == "VISURA" and out["b"].confidence == 0.3 and out["d"].classe == "DVR" and out["d"].rescored


def test_sql_functions(spark):
    from paperloom.functions.register import register

    assert "pl_word_count" in register(spark)
    row = spark.sql("SELECT pl_word_count(' a  b ') AS n, pl_it_date('31/12/2024') AS d, pl_it_date('2024') AS e, pl_pct(1, 0) AS p, pl_file_name('a/b.c') AS f").first()
    assert (row.n, str(row.d), row.e, row.p, row.f) == (2, "2024-12-31", None, 0.0, "b.c")


def test_sql_functions_equal_columns(spark):
    """A function in SQL gives what the column function of its name gives."""
    from paperloom.functions.register import register

    register(spark)
    texts = [None, "", " \t", "07 Qualità  & così", "a\r\nb\x07\x7fc\n\n\n\nd", "```yaml\nx: 1\n```", "CF RSSMRA80A01H501U nata il 1/2/1980, qui", "a/b\\\\..\\\\Visura SOA_12.PDF", "/x/.doc", "C:/y.xlsx", "caso-1_A", "l'anno\u200b \uffff 'x'"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    pairs = {
        "pl_sanitize(x, 5)": X.sanitize("x", 5), "pl_cap_lines(x, 3)": X.cap_lines("x", 3), "pl_xml_safe(x)": X.xml_safe("x"), "pl_printable_ratio(x)": X.printable_ratio("x"),
        "pl_compress_text(x)": X.compress_text("x"), "pl_area_code(x)": X.area_code("x"), "pl_slug(x, 9)": X.slug("x", 9), "pl_safe_name(x, 9)": X.safe_name("x", 9), "pl_redact(x)": X.redact("x"),
        "pl_strip_fences(x)": X.strip_fences("x"), "pl_snippet(x, 9)": X.snippet("x", 9), "pl_extension(x)": X.extension("x"), "pl_category(x)": X.categorize("x"), "pl_safe_path(x)": X.safe_path("x"),
        "pl_valid_case_id(x)": X.valid_case_id("x"), "pl_whitelist_match(x)": X.whitelist_match("x"), "pl_strip(x)": X.py_strip("x"), "pl_name_key(x)": X.name_key("x"),
    }
    row = df.select("x", *(F.expr(s).alias(f"a{i}") for i, s in enumerate(pairs)), *(c.alias(f"b{i}") for i, c in enumerate(pairs.values()))).collect()
    for i, name in enumerate(pairs):
        assert [r[f"a{i}"] for r in row] == [r[f"b{i}"] for r in row], name


def test_sql_functions_of_names_maps_and_tables(spark):
    """The same for functions on names of companies, maps, lists, tables and calls."""
    from paperloom.functions import values as V
    from paperloom.functions.register import register

    register(spark)
    cards = [None, {}, {"tipo": "DVR", "nota": "CF RSSMRA80A01H501U", "Password": "x"}, {"titolo": " ", "sezioni": "a"}, {"titolo": "T", "meta": None}]
    texts = [None, "", "ROSSI S.R.L.", "Società Édile s.p.a.", "la rossi s.r.l. e Rossi S.r.l.; [Rossi]", " [nome] ", "visura camerale, statuto; dvr", "p/Audit_ROSSI_20240101.zip", "up\\\\upload_1.zip",
        "Denominazione: EDIL ROSSI S.R.L. via", "VISURA CAMERALE di ALFA SPA denominata anche BETA S.R.L.", "a\n| k | v | k |\n|---|---|---|\n| 1 | 2 |\n|3|4|5|6|\nx\n|---|\n| only |\n"]
    rows = [(t, f"Bilancio_{i}" if i % 2 else None, cards[i % 5], None if i == 0 else ["a", "a", None, "b"][: i % 5], i % 4 - 1, float(i % 3)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "x string, name string, m map<string, string>, l array<string>, n long, d double").withColumn("ts", F.to_timestamp(F.lit("2024-02-28 10:00:00")))
    mapping = [("ROSSI", "ALFA"), ("ALFA", "BETA")]
    pairs = {
        "pl_one_line(x)": X.optimize_text("x"), "pl_clean_company(x)": X.clean_company("x"), "pl_clean_in_text(x, 'Rossi S.r.l.')": X.clean_in_text("x", F.lit("Rossi S.r.l.")), "pl_clean_in_text(x, name)": X.clean_in_text("x", "name"),
        "pl_company_key(x)": X.company_key("x"), "pl_valid_company(x)": X.valid_company("x"), "pl_source_score(x)": X.source_score("x"), "pl_char_cap(name, x, 1.5D)": X.char_cap("name", "x", 1.5),
        "pl_anonymise(x, array(struct('ROSSI' AS old, 'ALFA' AS new), struct('ALFA' AS old, 'BETA' AS new)))": X.anonymise("x", mapping), "pl_name_from_archive(x)": X.name_from_archive("x"),
        "pl_name_from_registry(x)": X.name_from_registry("x"), "pl_names_in_text(name, x)": X.names_in_text("name", "x"), "pl_value_to_text(m, 9)": V.value_to_text(F.col("m"), 9), "pl_list_to_text(l, 4)": V.list_to_text(F.col("l"), 4),
        "pl_age_days(ts, DATE '2024-03-02')": V.age_days("ts", "2024-03-02"), "pl_yyyy_mm(ts)": V.yyyy_mm("ts"), "pl_pct_delta(d, n)": V.pct_delta(F.col("d"), F.col("n").cast("double")), "pl_backoff(CAST(n AS INT), 2D, 3D)": V.backoff(F.col("n").cast("int"), 2.0, 3.0),
        "pl_md_tables(x)": X.md_tables("x"), "pl_md_records(x)": X.md_records("x"), "pl_scrub(m, array('password'))": V.scrub(F.col("m"), ["password"]), "pl_card_head(m)": V.split_card(F.col("m"))[0], "pl_card_clusters(m)": V.split_card(F.col("m"))[1],
        "pl_flat_doc(m)": V.flat_doc(F.col("m")), "pl_dedup_runs(l)": X.dedup_runs(F.col("l")), "pl_is_artifact(x)": X.is_artifact("x"),
    }
    row = df.select(*(F.expr(s).alias(f"a{i}") for i, s in enumerate(pairs)), *(c.alias(f"b{i}") for i, c in enumerate(pairs.values()))).collect()
    for i, name in enumerate(pairs):
        assert [r[f"a{i}"] for r in row] == [r[f"b{i}"] for r in row], name
    assert row[-1]["a19"] == [{"k": "", "v": "2"}, {"k": "5", "v": "4"}]


def test_sql_functions_of_calls_and_batches(spark):
    from paperloom.functions import values as V
    from paperloom.functions.register import register

    register(spark)
    calls = spark.createDataFrame([("m/x", "ocr", 10, 20, -1, -2.0, None, "e" * 300, 2.0, 3.0, 0.5), ("y", "zip", None, 5, 7, 1.23456, 2, "", 1.0, None, None)], "model string, kind string, input_tokens long, cached_tokens long, output_tokens long, duration_seconds double, retry_count long, error string, input double, output double, cached_input double")
    said = calls.selectExpr("pl_model_name(model) AS model", "pl_call_kind(kind) AS kind", "pl_call_count(input_tokens) AS input_tokens", "pl_cached_tokens(cached_tokens, input_tokens) AS cached_tokens", "pl_call_count(output_tokens) AS output_tokens", "pl_call_seconds(duration_seconds) AS duration_seconds", "pl_call_count(retry_count) AS retry_count", "pl_call_error(error) AS error", "input", "output", "cached_input")
    assert said.collect() == V.clean_call(calls).select(*said.columns).collect()
    costs = said.select(F.expr("pl_call_cost(input_tokens, cached_tokens, output_tokens, input, cached_input, output)").alias("a"), V.call_cost().alias("b")).collect()
    assert [r.a for r in costs] == [r.b for r in costs]
    docs = spark.createDataFrame([("c", 1, 2, "b", "xyz"), ("c", 1, 1, "a", "uvw")], "case_id string, batch_id int, pos long, filename string, text string")
    payload = docs.groupBy("case_id", "batch_id").agg(F.expr("pl_payload(collect_list(struct(pos, filename, text)), 2)").alias("payload"))
    assert payload.first().payload == V.batch_payload(docs, F.lit(2)).first().payload == "### FILE: a\nuv\n\n### FILE: b\nxy"
    assert spark.sql("SELECT pl_group_schema(array('k1', 'k2'))").first()[0] == '{"k1":"string","k2":"string"}'


def test_scrub_of_nested_json(spark):
    from paperloom.functions import values as V

    text = '{"tipo": "DVR", "Password": "x", "voci": [{"nota": "CF RSSMRA80A01H501U", "password": 1, "n": 2.5}, null, "ok"]}'
    df = spark.createDataFrame([(text,), ("{broken",), (None,)], "x string")
    out = [r[0] for r in df.select(V.scrub_json(F.col("x"), ["password"])).collect()]
    assert out == ['{"tipo": "DVR", "voci": [{"nota": "CF [dato privacy rimosso]", "n": 2.5}, null, "ok"]}', None, None]


def _first_fit(lengths, max_files=4, max_chars=50_000):
    """Batch of each length in turn: the first with room, found in a tree over the most room of its batches."""
    size = 1 << max(1, len(lengths)).bit_length()
    room, files, out = [max_chars] * (2 * size), [0] * size, []
    for n in lengths:
        i = 1
        if n > max_chars:
            i = size + next(k for k in range(len(out) + 1) if files[k] == 0)
        else:
            while i < size:
                i = 2 * i if room[2 * i] >= n else 2 * i + 1
        k = i - size
        files[k] += 1
        room[i] = -1 if files[k] == max_files or n > max_chars else room[i] - n
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        out.append(k)
    return out


def test_ffd_of_a_long_case(spark):
    """A case of 100,000 documents, and others, get the batches that first fit gives document by document."""
    import random

    r = random.Random(4)
    rows = [("hot", f"f{i:06}", r.choice([0, 1, 100, r.randint(0, 50_000), r.randint(0, 3000), 12_500, 25_000, None]) if i > 20 else 50_000 + i % 3) for i in range(100_000)]
    rows += [(None, f"n{i:03}", r.randint(0, 60_000)) for i in range(300)] + [("twice", "same", 20_000)] * 7 + [("long", f"l{i}", 60_000) for i in range(5)]
    docs = spark.createDataFrame(rows, "case_id string, path string, n_chars int")
    found = batching.ffd_batches(docs).toPandas()
    assert len(found) == len(rows)
    for case, own in found.groupby("case_id", dropna=False):
        want = sorted(((x[2] or 0, x[1]) for x in rows if x[0] == (None if case != case else case)), key=lambda x: (-x[0], x[1]))
        own = own.sort_values(["n_chars", "path", "batch_id"], ascending=[False, True, True])
        assert own["batch_id"].tolist() == _first_fit([n for n, _ in want])


def test_scans_of_a_hot_session(spark):
    """A session of nine tenths of the rows: percentages, silences and caps as windows over all of it give, in no hot task."""
    from pyspark.sql.window import Window

    from paperloom.operators import windows

    e = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("session_id"), F.timestamp_micros(F.abs(F.xxhash64("id")) % 10_000_000_000).alias("ts"), F.col("id").alias("event_id"), F.when(F.xxhash64("id") % 4000 == 0, "done").otherwise("x").alias("type"), F.when(F.col("id") % 3 > 0, (F.abs(F.xxhash64("id", "id")) % 10000) / 100).alias("pct"))
    whole = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    shown = e.withColumn("shown", F.when(F.max((F.col("type") == "done").cast("int")).over(whole) == 1, 100.0).otherwise(F.least(F.lit(99.0), F.max(F.coalesce("pct", F.lit(0.0))).over(whole))))
    found = windows.progress_pct(e)
    assert sorted(map(tuple, found.select("event_id", "shown").collect())) == sorted(map(tuple, shown.select("event_id", "shown").collect()))
    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    micros = F.unix_micros("ts")
    silent = e.withColumn("silence", F.round((micros - F.lag(micros).over(w)) / 1e6, 3)).filter("silence > 1")
    assert sorted(map(tuple, windows.gaps(e, 1).select("event_id", "silence").collect())) == sorted(map(tuple, silent.select("event_id", "silence").collect()))
    new = F.coalesce((micros - F.lag(micros).over(w) > 500_000).cast("int"), F.lit(1))
    cut = e.withColumn("_n", new).withColumn("stretch", F.sum("_n").over(whole))
    assert sorted(map(tuple, windows.stretches(e, 500_000).select("event_id", "stretch").collect())) == sorted(map(tuple, cut.select("event_id", "stretch").collect()))
    chunks = e.select("session_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 > 0, F.repeat(F.lit("é"), (F.col("event_id") % 7).cast("int"))).alias("text"))
    kept = {(r.session_id, r.seq): (r.text, r.truncated) for r in windows.cap_stream(chunks, 1001).collect()}
    by = {}
    for r in chunks.orderBy("seq").collect():
        before = by.get(r.session_id, 0)
        if before < 1001:
            assert kept.pop((r.session_id, r.seq)) == (r.text[: 1001 - before] if r.text is not None else None, len(r.text) > 1001 - before if r.text is not None else None)
        by[r.session_id] = before + len(r.text or "")
    assert not kept


def test_numbering_of_a_hot_case(spark):
    """A case of nine tenths of the rows is numbered, summed and filled as a window over all of it would."""
    from pyspark.sql.window import Window

    from paperloom.operators import windows

    df = spark.range(5000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.when(F.col("id") % 20 > 0, "b")).alias("case_id"), F.col("id").alias("pos"), F.lit(None).cast("string").alias("own"), F.when(F.col("id") % 700 == 3, F.concat(F.lit("h"), "id")).alias("header"))
    df = df.repartition(7)
    w = Window.partitionBy("case_id").orderBy("pos")
    want = df.select("pos", F.row_number().over(w).alias("n"), F.coalesce(F.sum("pos").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s"), F.coalesce(F.last("header", True).over(w), F.lit("18")).alias("h"))
    key = lambda rows: sorted(map(tuple, rows))
    assert key(windows.renumber(df, ["pos"], out="n").select("pos", "n").collect()) == key(want.select("pos", "n").collect())
    assert key(windows.running_offset(df, "pos", ["pos"], ["case_id"], 0, "s").select("pos", "s").collect()) == key(want.select("pos", "s").collect())
    assert key(windows.fill_section(df).select("pos", "section").collect()) == key(want.select("pos", "h").collect())
    assert windows.renumber(df.limit(0), ["pos"]).count() == 0
    # Most ranges hold rows of the hot case: no task has it whole.
    from paperloom.operators.shared import placed

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert placed(df, ["case_id"], ["pos"]).filter("case_id = 'hot'").select("_part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scorers_see_each_row_once_a_round(spark):
    seen = spark.sparkContext.accumulator(0)

    def scorer(batches):
        for b in batches:
            seen.add(len(b))
            b = b[(b["batch_id"] != 1) | (b["batch_id"] > 10)]
            yield b.assign(output="x")[["case_id", "batch_id", "path", "output"]]

    docs = spark.createDataFrame([("c", i // 3, f"f{i}") for i in range(12)], "case_id string, batch_id long, path string")
    done, failed = batching.recover(docs, scorer, "case_id string, batch_id long, path string, output string")
    assert (done.count(), failed.count(), done.count()) == (12, 0, 12)
    assert seen.value == 12 + 3 + 3
    seen.value = 0

    def cheap(batches):
        for b in batches:
            seen.add(len(b))
            yield b[["case_id", "path"]].assign(classe="DVR", confidence=0.5)

    df = spark.createDataFrame([("c", str(i), "visura.pdf", "x" * 80) for i in range(5)], "case_id string, path string, filename string, text string")
    out = batching.cascade(df, cheap, cheap)
    assert (out.count(), out.filter("rescored").count(), seen.value) == (5, 5, 10)


def test_corrupt_members_and_long_texts(spark):
    data = bytearray(_zip({"a.txt": "one"}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b.txt", "some text " * 500)
    broken = bytearray(out.getvalue())
    broken[40:60] = bytes(20)
    df = spark.createDataFrame([("c1", data), ("c2", broken)], "case_id string, content binary")
    assert {(r.path, r.problem) for r in archives.expand_archives(df).collect()} == {("a.txt", None), ("b.txt", "unreadable_member")}
    long = "é" * 250_000
    files_ = spark.createDataFrame([("c", "a.txt", bytearray(long.encode()))], "case_id string, path string, content binary")
    whole, cut = archives.extract_text(files_).first(), archives.extract_text(files_, cap=200_000).first()
    assert (whole.text, whole.method) == (long, "ok") and (len(cut.text), cut.method) == (200_000, "truncated")
    df = spark.createDataFrame([("c1", bytearray(_zip({"a.txt": long.encode()})))], "case_id string, content binary")
    assert archives.ingest(df).first().text == long
    cut = archives.ingest(df, cap=200_000).first()
    assert cut.text == long[:200_000] + "\n[TESTO TRONCATO V2]" and cut.method == "truncated"


def test_sanitize(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.sanitize(F.lit("a\r\nb\rc\x00\x7f\td"))) == "a\nb\nc\x7f\td" and one(X.sanitize(F.lit(None).cast("string"))) == ""


def test_checklist_asks_again_and_loses_no_report(spark):
    """A report comes to the scorer once a round; what it leaves out is asked for alone, and a report that it passes over too."""
    from paperloom.operators.evidence import build_checklist

    seen = spark.sparkContext.accumulator(0)

    def scorer(batches):
        for b in batches:
            seen.add(len(b))
            rows = []
            for case, norm, groups, report in zip(b["case_id"], b["norm"], b["groups"], b["report"], strict=True):
                single = all(len(g) == 1 for g in groups)
                for g in groups:
                    rows += [(case, norm, k, report) for k in g if single or (case != "shy" and k != "k1")]
            yield pd.DataFrame(rows, columns=["case_id", "norm", "clause_key", "text"])

    long, short = "word " * 200, "word " * 60
    report = spark.createDataFrame([("a", "N", long), ("shy", "N", long), ("b", "N", short), ("c", "M", long), ("d", "none", long)], "case_id string, norm string, text string")
    clauses = spark.createDataFrame([(n, f"k{i}", i) for n in "NM" for i in range(3)], "norm string, clause_key string, pos int")
    got = sorted(map(tuple, build_checklist(report, clauses, scorer, groups=2).collect()))
    want = [(c, n, f"k{i}", w, s) for c, n, w, s in (("a", "N", 200, "complete"), ("b", "N", 60, "short"), ("c", "M", 200, "complete"), ("shy", "N", 200, "complete")) for i in range(3)]
    # Keys of clauses repeat over norms; each report is sent once, and once more if something is missing or short.
    assert got == want and seen.value == 4 + 4
    assert build_checklist(report.limit(0), clauses, scorer).count() == 0


def test_answers_of_a_checklist_are_not_stored(spark):
    """the tables of a checklist's answers hold counts, not the answers, which are many times the reports."""
    from paperloom.operators import evidence

    seen, stored = [], evidence.stored

    def scorer(batches):
        for b in batches:
            yield pd.DataFrame([(c, n, k, None if k == "k1" else "a\x1cb c\u00a0d " * 30) for c, n, g in zip(b["case_id"], b["norm"], b["groups"], strict=True) for keys in g for k in keys], columns=["case_id", "norm", "clause_key", "text"])

    def watched(df, name):
        seen.append((name, df.columns))
        return stored(df, name)

    report = spark.createDataFrame([("a", "N", "x"), ("b", "N", None)], "case_id string, norm string, text string")
    clauses = spark.createDataFrame([("N", f"k{i}", i) for i in range(3)], "norm string, clause_key string, pos int")
    evidence.stored = watched
    try:
        out = sorted(map(tuple, evidence.build_checklist(report, clauses, scorer).collect()))
    finally:
        evidence.stored = stored
    assert [c for n, c in seen if n == "answers"] == [["case_id", "norm", "clause_key", "words"]] * 2
    assert [(c, k, w) for c, _, k, w, _ in out] == [(c, k, 0 if k == "k1" else 90) for c in "ab" for k in ("k0", "k1", "k2")]
    assert {s for _, _, k, _, s in out if k == "k1"} == {"missing"}


def test_long_runs_take_no_square_of_their_length(spark):
    """words are computed once for a row, and each is held against the one before."""
    from paperloom.functions.text import dedup_runs

    rows = [(["a", "a", "b", None, None, "b", "b", "a"],), ([],), (None,), ([None],)]
    df = spark.createDataFrame(rows, "w array<string>")
    assert [r.x for r in df.select(dedup_runs(F.col("w")).alias("x")).collect()] == [["a", "b", None, None, "b", "a"], [], None, [None]]
    words, long = 60_000, spark.range(1).select(F.expr("repeat('a b b ', 20000)").alias("t"))
    start = time.time()
    assert len(long.select(dedup_runs(F.split("t", " ")).alias("x")).first().x) == words * 2 // 3 + 1
    assert time.time() - start < 20


def test_counts_and_categories_in_python_are_those_of_columns(spark):
    from paperloom.functions import text as X

    texts = ["", " ", "a\x1cb", "a\u00a0b\u2003c\u0085d", "a\u200bb", " x\ty\n\x0bz ", "\x1f", "\u180e a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(X.word_count("t").alias("n")).collect()] == [X.count_words(t) for t in texts]
    paths = ["a/b.PDF", "x.docx.p7m/x.docx", ".txt", "a.txt/b", "a.b.zip", "b.exe", "c.", "d.txt\n", "e/.f.txt", "noend", "a.\u212aml"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.c for r in df.select(X.categorize("p").alias("c")).collect()] == [X.category_of(p) for p in paths]


def test_braces_are_those_of_a_scan_by_characters():
    """outermost objects found by jumps from brace to brace are those of a scan."""
    import random

    from paperloom.operators.evidence import _braces

    def scan(text):
        out, depth, start, quoted, escaped = [], 0, 0, False, False
        for i, c in enumerate(text):
            if quoted:
                escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
            elif c == '"' and depth:
                quoted = True
            elif c == "{":
                depth, start = depth + 1, start if depth else i
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    out.append(text[start : i + 1])
        return out

    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice('{}"\\a\n') for _ in range(rng.randrange(30)))
        assert _braces(text) == scan(text)
    assert _braces('{"' + "a" * 200_000) == []


def test_small_archives_share_frames(spark):
    """the members of many small archives come in one frame, a batch to Spark, not one for each archive."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x")
    df = spark.createDataFrame([(str(i), out.getvalue()) for i in range(50)], "case_id string, content binary").coalesce(1)
    frames = lambda it: iter([pd.DataFrame({"n": [sum(1 for _ in it)]})])
    found = archives.expand_archives(df)
    assert found.count() == 50 and found.select("path").mapInPandas(frames, "n long").first().n == 1
    rows = lambda: (row for i in range(50) for row in archives.expand(str(i), out.getvalue()))
    assert len(list(archives._in_parts(rows()))) == 1 and len(list(archives._in_parts(rows(), 1000))) == 10
