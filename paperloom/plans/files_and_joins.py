"""Registered queries: files, classification, the safety net, joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.functions import values as V
from paperloom.operators import accounting, batching, files, joins, ordering, safety_net, summaries, windows
from paperloom.operators.shared import shared_dir
from paperloom.plans.views import query

AS_OF_ERRORS, AS_OF_CASES = "2024-01-31", "2001-08-02"

def words(c: str) -> str:
    return f"CASE WHEN regexp_replace({c}, '\\s+', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+')) END"


_EXT = "lower(regexp_extract(path, '[^/.][^/]*\\.([^./]*)$', 1))"


def category(known: dict, skip: bool = True) -> str:
    rows = " ".join(f"WHEN {_EXT} IN ({', '.join(repr(e) for e in ext)}) THEN '{name}'" for name, ext in known.items())
    first = f"WHEN {_EXT} IN ({', '.join(repr(e) for e in C.SKIPPED_EXTENSIONS)}) THEN 'skip' " if skip else ""
    return f"CASE {first}{rows} ELSE 'other' END"


CATEGORY = category(C.CATEGORIES)
ARTIFACT = "(starts_with(path, '__MACOSX/') OR contains(path, '/__MACOSX/') OR starts_with(regexp_replace(path, '^.*/', ''), '.') OR starts_with(regexp_replace(path, '^.*/', ''), '__'))"


@query("p01_categorize", "v_files", sql=f"SELECT doc_id, path, {CATEGORY} AS v2, {category({**C.CATEGORIES, **C.CATEGORIES_V1})} AS v1, {category(C.CATEGORIES_CLI, False)} AS cli FROM v_files")
def _(f):
    return f.select("doc_id", "path", *(X.categorize("path", p).alias(p) for p in ("v2", "v1", "cli")))


@query("p02_drop_artifacts", "v_files", sql=f"SELECT doc_id, path FROM v_files WHERE NOT {ARTIFACT} AND {CATEGORY} <> 'skip'")
def _(f):
    return files.drop_artifacts(f).select("doc_id", "path")


@query("p03_safe_path", "pages", sql="SELECT page_id, NOT starts_with(url, '/') AND NOT regexp_matches(url, '^[A-Za-z]:') AND NOT list_contains(string_split(url, '/'), '..') AS safe, regexp_full_match(url, '[A-Za-z0-9_-]{1,200}') AS valid_id FROM pages")
def _(p):
    return p.select("page_id", X.safe_path("url").alias("safe"), X.valid_case_id("url").alias("valid_id"))


_STRIPPED = "length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"
_METHOD = f"CASE WHEN {CATEGORY} <> 'pdf' THEN 'non_pdf_passthrough' WHEN text IS NULL THEN 'missing_path' WHEN {_STRIPPED} = 0 THEN 'needs_ocr_empty' WHEN {_STRIPPED} < 200 THEN 'needs_ocr_too_short' WHEN length(text) >= 0.95 * 20000 THEN 'native_partial' ELSE 'native_ok' END"
_TRIAGED = f"SELECT doc_id, case_id, path, method, CASE WHEN method = 'non_pdf_passthrough' THEN 'non_pdf' WHEN method = 'missing_path' THEN 'unrecoverable' WHEN starts_with(method, 'needs_ocr') THEN 'needs_ocr' ELSE 'native_text' END AS bucket FROM (SELECT *, {_METHOD} AS method FROM v_files)"


@query("p04_triage", "v_files", sql=_TRIAGED)
def _(f):
    return files.triage(f, 20_000).select("doc_id", "case_id", "path", "method", "bucket")


@query("p05_text_verdict", "documents", sql=f"SELECT doc_id, CASE WHEN {_STRIPPED} = 0 THEN 'needs_ocr_empty' WHEN {_STRIPPED} < 200 THEN 'needs_ocr_too_short' WHEN length(text) >= 0.95 * 20000 THEN 'native_partial' ELSE 'native_ok' END AS verdict FROM documents")
def _(d):
    return d.select("doc_id", files.text_verdict("text", 20_000).alias("verdict"))


@query("p06_split_by_method", "v_files", sql=f"SELECT doc_id, CASE method WHEN 'native_ok' THEN 'clean' ELSE 'partial' END AS part FROM ({_TRIAGED}) WHERE bucket = 'native_text'")
def _(f):
    return files.split_by_method(files.triage(f, 20_000)).select("doc_id", "part")


@query("p07_has_text", "documents", sql=f"SELECT doc_id FROM documents WHERE {_STRIPPED} >= 10")
def _(d):
    return d.filter(files.has_text("text", 10)).select("doc_id")


@query("p08_bypass_low_signal", "v_files", sql="WITH s AS (SELECT doc_id, length(regexp_replace(substr(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), 1, 500), '^\\s+|\\s+$', '', 'g')) + length(substr(regexp_replace(path, '^.*/', ''), 1, 200)) AS n FROM v_files) SELECT doc_id, n < 50 AS bypassed, CASE WHEN n < 50 THEN 'ALTRO' END AS classe, CASE WHEN n < 50 THEN 0.3::DOUBLE END AS confidence FROM s")
def _(f):
    return files.bypass_low_signal(f.withColumn("filename", X.file_name("path"))).select("doc_id", "bypassed", "classe", "confidence")


_CLASS_OF = "CASE doc_id % 7 WHEN 0 THEN ' visura ' WHEN 1 THEN 'DVR' WHEN 2 THEN 'sconosciuta' WHEN 3 THEN 'Attestato' WHEN 4 THEN 'FATTURA' WHEN 5 THEN 'statuto' ELSE 'IDENTITA' END"
_COERCED = f"SELECT doc_id, CASE WHEN upper(trim({_CLASS_OF})) IN ({', '.join(repr(c) for c, *_ in C.CLASSES)}) THEN upper(trim({_CLASS_OF})) ELSE 'ALTRO' END AS classe, role, greatest(0.0, least(1.0, confidence::DOUBLE * 2 - 0.5)) AS confidence FROM v_classified"


def _classed(c):
    return c.withColumn("classe", F.expr(_CLASS_OF)).withColumn("confidence", F.col("confidence").cast("double") * 2 - 0.5)


@query("p09_coerce_classification", "v_classified", sql=_COERCED)
def _(c):
    return files.coerce_classification(_classed(c)).select("doc_id", "classe", "role", "confidence")


_CLASS_ROWS = ", ".join(f"('{c}', '{a}', {cap}, '{r}')" for c, a, cap, r in C.CLASSES)


@query("p10_enrich", "v_classified", sql=f"SELECT d.doc_id, d.classe, coalesce(d.role, t.r) AS role, t.a AS area, t.cap AS cap FROM ({_COERCED}) d JOIN (VALUES {_CLASS_ROWS}) t(c, a, cap, r) ON d.classe = t.c")
def _(c):
    return files.enrich(files.coerce_classification(_classed(c))).select("doc_id", "classe", "role", "area", "cap")


_MATCHES = ", ".join("nullif(regexp_extract(filename, '" + p.replace("'", "''") + "', 0), '')" for p in C.WHITELIST)


@query("p11_whitelist_match", "v_classified", sql=f"SELECT doc_id, filename, coalesce({_MATCHES}) AS matched FROM v_classified")
def _(c):
    return c.select("doc_id", "filename", X.whitelist_match("filename").alias("matched"))


@query("p12_list_cases", "v_cases", sql="SELECT id, tipo, azienda, norma FROM v_cases WHERE tipo = 'report' AND lower(azienda) LIKE '%azienda 1%' AND CAST(data_creazione AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1999-12-31' ORDER BY data_creazione DESC, id LIMIT 50 OFFSET 10")
def _(c):
    return files.list_cases(c, tipo="report", search="AZIENDA 1", start="1995-01-01", end="1999-12-31", limit=50, offset=10).select("id", "tipo", "azienda", "norma")


@query("p13_list_errors", "v_errors", sql=f"SELECT id, user_id, error_type FROM v_errors WHERE created_at >= TIMESTAMP '{AS_OF_ERRORS}' - INTERVAL 20 DAY AND NOT resolved ORDER BY created_at DESC, id LIMIT 50")
def _(e):
    return files.list_errors(e, AS_OF_ERRORS, 20).select("id", "user_id", "error_type")


@query("p14_visible_to", "v_cases", sql="SELECT 'admin' AS role, count(*) AS n FROM v_cases UNION ALL SELECT 'auditor', count(*) FROM v_cases WHERE user_id = 7")
def _(c):
    return files.visible_count(c, 7, "admin").select(F.lit("admin").alias("role"), "n").union(files.visible_count(c, 7, "auditor").select(F.lit("auditor"), "n"))


@query("p15_case_view", "v_cases", sql="SELECT CAST(id AS VARCHAR) AS case_id, user_id AS owner, tipo AS type, azienda AS company, norma AS norm, CAST(data_creazione AS DATE) AS created FROM v_cases")
def _(c):
    return files.case_view(c)


@query("p15_error_view", "v_errors", sql="SELECT id, error_type, coalesce(error_subtype, '') AS subtype, resolved, auto_recovered AS recovered FROM v_errors")
def _(e):
    return files.error_view(e)


@query("p16_ui_filter", "v_cases", sql="SELECT id FROM v_cases WHERE tipo = 'checklist_json' AND norma = '2-HIGH' AND lower(azienda) LIKE '%3%'")
def _(c):
    return files.ui_filter(c, "checklist_json", "2-HIGH", "3").select("id")


@query("p17_route_compact", "v_classified", sql="SELECT doc_id, coalesce(role = 'AGGREGABLE' AND count(*) FILTER (role = 'AGGREGABLE') OVER (PARTITION BY case_id) >= 25, false) AS compact FROM v_classified")
def _(c):
    return files.route_compact(c, "auto", 25).select("doc_id", "compact")


@query("p18_analysable", "v_files", sql="SELECT doc_id FROM v_files WHERE regexp_matches(lower(path), '\\.(pdf|docx?|xlsx?|txt|csv|rtf|eml|msg|html?|xml|odt|ods|pptx?|p7m)$')")
def _(f):
    return files.analysable(f).select("doc_id")


@query("p19_shallow_warnings", "v_evidence", sql="SELECT case_id, path, 'SICUREZZA' AS cluster, 'misure' AS field, ' Presente ' AS value FROM v_evidence WHERE pos % 3 = 0 UNION ALL SELECT case_id, path, 'SICUREZZA', 'testo', text FROM v_evidence WHERE lower(trim(text)) IN ('si', 'sì', 'yes', 'presente', 'present', 'presenti', 'ok')")
def _(e):
    fields = F.create_map(F.lit("misure"), F.when(F.col("pos") % 3 == 0, " Presente ").otherwise("a | b"), F.lit("esito"), F.lit("si"), F.lit("testo"), F.col("text"))
    return files.shallow_warnings(e.select("case_id", "path", F.create_map(F.lit("SICUREZZA"), fields).alias("clusters")), ["misure", "testo"])


# The safety net: W01, W02, D01 and its ledger.
_BASE_NET = f"SELECT c.doc_id, c.case_id, c.path, c.filename, f.text, coalesce(c.role, 'SUPPORT') AS role, CAST(c.role_conf AS DOUBLE) AS role_conf, coalesce({_MATCHES.replace('filename', 'c.filename')}) AS hit FROM v_classified c JOIN v_files f ON c.doc_id = f.doc_id"
_NET = f"""
WITH a AS ({_BASE_NET}),
b AS (SELECT *, CASE WHEN hit IS NOT NULL AND role <> 'CORE' THEN hit END AS matched FROM a),
c AS (SELECT doc_id, case_id, path, filename, matched, CASE WHEN matched IS NULL THEN role ELSE 'CORE' END AS role, CASE WHEN matched IS NULL THEN role_conf ELSE 1.0 END AS role_conf, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM b),
d AS (SELECT *, CASE WHEN length(s) >= 200 THEN sha256(s) END AS h FROM c),
e AS (SELECT *, row_number() OVER w AS n, first_value(path) OVER w AS first_path FROM d WINDOW w AS (PARTITION BY case_id, h ORDER BY filename, path)),
f AS (SELECT *, CASE WHEN h IS NOT NULL AND n > 1 THEN first_path END AS duplicate_of FROM e),
g AS (SELECT doc_id, case_id, path, filename, matched, duplicate_of, CASE WHEN duplicate_of IS NULL THEN role ELSE 'NOISE' END AS role, CASE WHEN duplicate_of IS NULL THEN role_conf ELSE 1.0 END AS role_conf FROM f),
h AS (SELECT *, role = 'NOISE' AND coalesce(round(role_conf, 6), 0) < 0.9 AS low_confidence FROM g),
i AS (SELECT *, CASE WHEN low_confidence THEN 'SUPPORT' ELSE role END AS role2 FROM h),
j AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS files, row_number() OVER (PARTITION BY case_id, role2 = 'NOISE' ORDER BY coalesce(round(role_conf, 6), 0) DESC, filename, path) AS r FROM i),
k AS (SELECT *, role2 = 'NOISE' AND files >= 10 AND r > floor(files * 0.15) AS over_cap FROM j),
net AS (SELECT doc_id, case_id, path, matched, duplicate_of, low_confidence, over_cap, role_conf, CASE WHEN over_cap THEN 'SUPPORT' ELSE role2 END AS role FROM k)
"""


def _net(c, f):
    return safety_net.safety_net(c.join(f.select("doc_id", "text"), "doc_id").withColumn("role_conf", F.col("role_conf").cast("double")))


@query("d01_safety_net", "v_classified", "v_files", sql=_NET + "SELECT doc_id, case_id, path, matched, duplicate_of, low_confidence, over_cap, role, role = 'NOISE' AS skipped, CASE WHEN role = 'NOISE' THEN CASE WHEN duplicate_of IS NULL THEN 'model_marked_noise_high_confidence' ELSE 'duplicate' END END AS reason FROM net")
def _(c, f):
    return _net(c, f).select("doc_id", "case_id", "path", "matched", "duplicate_of", "low_confidence", "over_cap", "role", "skipped", "reason")


@query("d01_safety_stats", "v_classified", "v_files", sql=_NET + "SELECT case_id, count(*) AS files, count(matched) AS whitelisted, count(duplicate_of) AS duplicates, count(*) FILTER (low_confidence) AS low_confidence, count(*) FILTER (over_cap) AS over_cap, count(*) FILTER (role = 'NOISE') AS skipped, count(*) FILTER (role = 'CORE') AS core FROM net GROUP BY case_id")
def _(c, f):
    return safety_net.safety_stats(_net(c, f))


@query("j05_skip_ledger", "v_classified", "v_files", sql=_NET + "SELECT case_id, path, 'NOISE' AS role, role_conf, CASE WHEN duplicate_of IS NULL THEN 'model_marked_noise_high_confidence' ELSE 'duplicate' END AS reason, duplicate_of FROM net WHERE role = 'NOISE'")
def _(c, f):
    return safety_net.skip_ledger(_net(c, f))


@query("w01_dedup_content", "v_classified", "v_files", sql="WITH d AS (SELECT c.doc_id, c.case_id, c.path, c.filename, CASE WHEN length(regexp_replace(f.text, '^\\s+|\\s+$', '', 'g')) >= 200 THEN sha256(regexp_replace(f.text, '^\\s+|\\s+$', '', 'g')) END AS h FROM v_classified c JOIN v_files f ON c.doc_id = f.doc_id) SELECT doc_id, CASE WHEN h IS NOT NULL AND row_number() OVER w > 1 THEN first_value(path) OVER w END AS duplicate_of FROM d WINDOW w AS (PARTITION BY case_id, h ORDER BY filename, path)")
def _(c, f):
    return safety_net.dedup_content(c.join(f.select("doc_id", "text"), "doc_id")).select("doc_id", "duplicate_of")


@query("w02_volume_cap", "v_classified", sql="WITH j AS (SELECT doc_id, role, count(*) OVER (PARTITION BY case_id) AS files, row_number() OVER (PARTITION BY case_id, role = 'NOISE' ORDER BY coalesce(round(CAST(role_conf AS DOUBLE), 6), 0) DESC, filename, path) AS r FROM v_classified) SELECT doc_id, CASE WHEN role = 'NOISE' AND files >= 10 AND r > floor(files * 0.15) THEN 'SUPPORT' ELSE role END AS role FROM j")
def _(c):
    return safety_net.volume_cap(c.withColumn("role_conf", F.col("role_conf").cast("double"))).select("doc_id", "role")


# Joins.
@query("j01_merge_ocr", "v_files", sql="SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 5 = 0 THEN concat('ocr ', CAST(doc_id AS VARCHAR)) END), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END), '')) AS text, coalesce(nullif(trim(CASE WHEN doc_id % 5 = 0 THEN concat('ocr ', CAST(doc_id AS VARCHAR)) END), ''), nullif(trim(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END), '')) IS NULL AS unprocessed FROM v_files")
def _(f):
    key = F.concat_ws("/", "path", F.col("doc_id").cast("string"))
    own = f.select("case_id", key.alias("path"), "doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"))
    ocr = f.filter("doc_id % 5 = 0").select("case_id", key.alias("path"), F.concat(F.lit("ocr "), F.col("doc_id").cast("string")).alias("ocr_text"))
    return joins.merge_ocr(own, ocr).select("doc_id", "text", "unprocessed")


@query("j02_apply_skips", "v_classified", sql="SELECT doc_id FROM v_classified f WHERE NOT EXISTS (SELECT 1 FROM v_classified s WHERE s.role = 'NOISE' AND s.case_id = f.case_id AND s.path = f.path)")
def _(c):
    return joins.apply_skips(c, c.filter("role = 'NOISE'")).select("doc_id")


@query("j03_attach_role", "v_files", "v_classified", sql="SELECT f.doc_id, coalesce(c.role, 'SUPPORT') AS role FROM v_files f LEFT JOIN (SELECT case_id, path, min(role) AS role FROM v_classified WHERE doc_id % 2 = 0 GROUP BY 1, 2) c USING (case_id, path)")
def _(f, c):
    return joins.attach_role(f.select("case_id", "path", "doc_id"), c.filter("doc_id % 2 = 0").groupBy("case_id", "path").agg(F.min("role").alias("role"))).select("doc_id", "role")


@query("j04_merge_rescored", "v_classified", sql="SELECT doc_id, CASE WHEN confidence < 0.6 THEN 'DVR' ELSE 'ALTRO' END AS classe, CASE WHEN confidence < 0.6 THEN 0.9 ELSE CAST(confidence AS DOUBLE) END AS confidence, confidence < 0.6 AS rescored FROM v_classified")
def _(c):
    stage1 = c.select("doc_id", F.lit("ALTRO").alias("classe"), F.col("confidence").cast("double").alias("confidence"))
    stage2 = stage1.filter("confidence < 0.6").select("doc_id", F.lit("DVR").alias("classe"), F.lit(0.9).alias("confidence"))
    return joins.merge_rescored(stage1, stage2, ["doc_id"])


_LIMITS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in [("en", 100, 150), ("fr", 100, 175)])
_COVERAGE = f"WITH w AS (SELECT DISTINCT case_id, norm FROM v_clauses), e AS (SELECT w.case_id, n.norm, n.clause_key FROM w JOIN v_norm_clauses n USING (norm)), x AS (SELECT e.*, c.text, CASE WHEN c.text IS NULL THEN 0 ELSE {words('c.text')} END AS words, coalesce(l.a, 80) AS least, coalesce(l.b, 150) AS warn FROM e LEFT JOIN v_clauses c USING (case_id, norm, clause_key) LEFT JOIN (VALUES {_LIMITS}) l(norm, a, b) USING (norm)), cov AS (SELECT case_id, norm, clause_key, words, CASE WHEN text IS NULL THEN 'missing' WHEN words = 0 THEN 'empty' WHEN words < least THEN 'short' WHEN words < warn THEN 'warning' ELSE 'complete' END AS status FROM x) "


def _limits(c):
    return c.sparkSession.createDataFrame([("en", 100, 150), ("fr", 100, 175)], "norm string, min_words int, warning_words int")


@query("j06_clause_coverage", "v_clauses", "v_norm_clauses", sql=_COVERAGE + "SELECT * FROM cov")
def _(c, n):
    return joins.clause_coverage(c, n, _limits(c))


@query("j07_missing_clauses", "v_clauses", "v_norm_clauses", sql=_COVERAGE + "SELECT case_id, norm, clause_key FROM cov WHERE status = 'missing'")
def _(c, n):
    return joins.missing_clauses(c, n)


_NORM = "CASE norm WHEN 'en' THEN 'ISO 9001' WHEN 'fr' THEN 'ESG' ELSE norm END"


@query("d12_thresholds", "v_clauses", sql=f"WITH t(norm, min_words, warning_words) AS (VALUES {', '.join(str(x) for x in C.CLAUSE_WORDS)}) SELECT c.norm, coalesce(t.min_words, {C.CLAUSE_WORDS_DEFAULT[0]}) AS min_words, coalesce(t.warning_words, {C.CLAUSE_WORDS_DEFAULT[1]}) AS warning_words, c.clauses FROM (SELECT {_NORM} AS norm, count(*) AS clauses FROM v_clauses GROUP BY 1) c LEFT JOIN t ON c.norm = t.norm")
def _(c):
    least, warn = (F.coalesce(n, F.lit(x)).alias(n) for n, x in zip(("min_words", "warning_words"), C.CLAUSE_WORDS_DEFAULT, strict=True))
    norms = c.groupBy(F.expr(_NORM).alias("norm")).agg(F.count(F.lit(1)).alias("clauses"))
    return norms.join(joins.thresholds(c), "norm", "left").select("norm", least, warn, "clauses")


@query("j08_lost_documents", "v_files", sql="SELECT doc_id FROM v_files WHERE doc_id % 10 NOT IN (0, 1, 2, 3, 4, 5, 6)")
def _(f):
    docs = f.withColumn("batch_id", F.col("doc_id") % 10)
    return joins.lost_documents(docs, docs.filter("batch_id < 7")).select("doc_id")


@query("d07_placeholders", "v_files", sql="SELECT case_id, path, '18' AS section_id, 'NON ELABORATO' AS tipo, concat('Documento non elaborato: ', regexp_replace(path, '^.*/', '')) AS titolo FROM v_files WHERE doc_id % 10 > 6")
def _(f):
    docs = f.withColumn("batch_id", F.col("doc_id") % 10)
    return joins.placeholders(joins.lost_documents(docs, docs.filter("batch_id < 7")))


PRICES = [("m-large", 0.40, 1.60, 0.10), ("m-small", 0.15, 0.60, None)]
_CALLS = """WITH c AS (SELECT session_id, regexp_replace(model, '^.*/', '') AS model, kind, greatest(0, input_tokens) AS input_tokens, least(greatest(0, cached_tokens), greatest(0, input_tokens)) AS cached_tokens, greatest(0, output_tokens) AS output_tokens, round(greatest(0.0, duration_seconds), 3) AS duration_seconds, retry_count, error FROM v_calls),
k AS (SELECT c.*, greatest(0, input_tokens - cached_tokens) * coalesce(p.i, 0.0::DOUBLE) / 1000000 + output_tokens * coalesce(p.o, 0.0::DOUBLE) / 1000000 + cached_tokens * coalesce(p.h, 0.0::DOUBLE) / 1000000 AS cost_usd, input_tokens * coalesce(p.i, 0.0::DOUBLE) / 1000000 + output_tokens * coalesce(p.o, 0.0::DOUBLE) / 1000000 AS cost_nocache FROM c LEFT JOIN (VALUES ('m-large', 0.40::DOUBLE, 1.60::DOUBLE, 0.10::DOUBLE), ('m-small', 0.15::DOUBLE, 0.60::DOUBLE, NULL)) p(model, i, o, h) ON c.model = p.model)
"""


def _prices(c):
    return c.sparkSession.createDataFrame(PRICES, "model string, input double, output double, cached_input double")


@query("j09_with_cost", "v_calls", sql=_CALLS + "SELECT session_id, model, kind, sum(input_tokens) AS input_tokens, sum(cached_tokens) AS cached_tokens, round(sum(cost_usd), 8) AS cost_usd, round(sum(cost_nocache), 8) AS cost_nocache FROM k GROUP BY 1, 2, 3")
def _(c):
    out = joins.with_cost(c, _prices(c))
    return out.groupBy("session_id", "model", "kind").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.round(F.sum("cost_usd"), 8).alias("cost_usd"), F.round(F.sum("cost_nocache"), 8).alias("cost_nocache"))


@query("h29_call_cost", "v_calls", sql=_CALLS + "SELECT count(*) AS calls, round(sum(cost_usd), 6) AS usd, round(sum(cost_usd * 0.93), 6) AS eur FROM k")
def _(c):
    return joins.with_cost(c, _prices(c)).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost_usd"), 6).alias("usd"), F.round(F.sum(F.col("cost_usd") * C.USD_TO_EUR), 6).alias("eur"))


@query("h30_clean_call", "v_calls", sql=_CALLS + "SELECT model, kind, count(*) AS n, sum(input_tokens) AS input_tokens, sum(cached_tokens) AS cached_tokens, round(sum(duration_seconds), 4) AS seconds, count(error) AS errors FROM k GROUP BY 1, 2")
def _(c):
    return V.clean_call(c).groupBy("model", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("cached_tokens").alias("cached_tokens"), F.round(F.sum("duration_seconds"), 4).alias("seconds"), F.count("error").alias("errors"))


@query("h20_model_name", "v_calls", sql="SELECT DISTINCT model, regexp_replace(model, '^.*/', '') AS name FROM v_calls")
def _(c):
    return c.select("model", X.model_name("model").alias("name")).distinct()


_KEYS = ", ".join(f"('{k}')" for k in C.STANDARDS)
_NORMA = "CASE o_custkey % 7 WHEN 0 THEN 'UNI EN ISO 9001:2015' WHEN 1 THEN 'iso 27001' WHEN 2 THEN 'Norma ISO/IEC 27001:2022 audit' WHEN 3 THEN 'ISO 14064-1' WHEN 4 THEN 'Bilancio ESG' WHEN 5 THEN 'ISO 22000' ELSE 'iso 50001 certis' END"


@query("j10_detect_standard", "orders", sql=f"WITH n AS (SELECT o_orderkey, {_NORMA} AS norma FROM orders), f AS (SELECT DISTINCT norma, k, upper(norma) = upper(k) AS same FROM n JOIN (VALUES {_KEYS}) s(k) ON upper(norma) = upper(k) OR (contains(upper(norma), upper(k)) AND (len(regexp_extract_all(k, '\\d+')) = 0 OR len(regexp_extract_all(norma, '\\d+')) = 0 OR list_has_any(regexp_extract_all(k, '\\d+'), regexp_extract_all(norma, '\\d+'))))), b AS (SELECT norma, k, row_number() OVER (PARTITION BY norma ORDER BY same DESC, length(k) DESC, k DESC) AS r FROM f) SELECT n.o_orderkey, n.norma, b.k AS standard FROM n LEFT JOIN b ON n.norma = b.norma AND b.r = 1")
def _(o):
    rows = o.select("o_orderkey", F.expr(_NORMA).alias("norma"))
    keys = o.sparkSession.createDataFrame([(k,) for k in C.STANDARDS], "key string")
    return joins.detect_standard(rows, keys).select("o_orderkey", "norma", "standard")


_CATEGORIA = "CASE pos % 4 WHEN 0 THEN 'RISORSE' WHEN 1 THEN '8 LEGALE' WHEN 2 THEN 'SALUTE E SICUREZZA' ELSE categoria END"
_AREAS = ", ".join(f"('{a}', '{a[:2]}', {i + 1})" for i, a in enumerate(C.AREAS))


@query("j11_route_area", "v_evidence", sql=f"WITH e AS (SELECT pos, {_CATEGORIA} AS categoria FROM v_evidence), n AS (SELECT DISTINCT categoria, CASE WHEN TRY_CAST(regexp_extract(categoria, '^\\s*(\\d{{1,2}})\\b', 1) AS INT) BETWEEN 1 AND 18 THEN lpad(CAST(TRY_CAST(regexp_extract(categoria, '^\\s*(\\d{{1,2}})\\b', 1) AS INT) AS VARCHAR), 2, '0') END AS code FROM e), m AS (SELECT n.categoria, min_by(a.area, a.n) AS area FROM n JOIN (VALUES {_AREAS}) a(area, code, n) ON (n.code IS NOT NULL AND n.code = a.code) OR (n.code IS NULL AND (contains(upper(n.categoria), a.area) OR contains(a.area, upper(n.categoria)))) GROUP BY 1) SELECT e.pos, e.categoria, m.area FROM e LEFT JOIN m USING (categoria)")
def _(e):
    return joins.route_area(e.select("pos", F.expr(_CATEGORIA).alias("categoria"))).select("pos", "categoria", "area")


_PRIORITY = "CASE " + " ".join(f"WHEN upper(trim(c)) = '{a}' THEN {i}" for i, a in enumerate(C.REPORT_AREAS)) + " " + " ".join(f"WHEN contains(upper(trim(c)), '{a}') THEN {i}" for i, a in enumerate(C.REPORT_AREAS)) + " ELSE 999 END"
_CAT = "CASE numero % 4 WHEN 0 THEN 'sicurezza sul lavoro' WHEN 1 THEN '03 · FORMAZIONE E ADDESTRAMENTO' WHEN 2 THEN 'Varie' ELSE 'altro' END"


@query("j12_area_priority", "v_paragraphs", sql=f"SELECT case_id, numero, c AS categoria, {_PRIORITY} AS priority FROM (SELECT case_id, numero, {_CAT} AS c FROM v_paragraphs)")
def _(p):
    return joins.area_priority(p.select("case_id", "numero", F.expr(_CAT).alias("categoria")))


@query("j13_matrix", "v_runs", sql="SELECT * FROM (SELECT DISTINCT case_id FROM v_runs) CROSS JOIN (SELECT DISTINCT provider FROM v_runs)")
def _(r):
    return joins.matrix(r, r)


_RUN_MEANS = "SELECT case_id, provider, round(avg(duration_seconds), 3) AS seconds, round(avg(cost_eur), 6) AS cost FROM v_runs GROUP BY 1, 2"


@query("j14_delta_vs", "v_runs", sql=f"WITH m AS ({_RUN_MEANS}) SELECT m.*, CASE WHEN b.seconds <> 0 THEN round(100.0 * (m.seconds - b.seconds) / b.seconds, 1) END AS seconds_pct, CASE WHEN b.cost <> 0 THEN round(100.0 * (m.cost - b.cost) / b.cost, 1) END AS cost_pct FROM m LEFT JOIN m b ON m.case_id = b.case_id AND b.provider = '1-URGENT'")
def _(r):
    means = r.groupBy("case_id", "provider").agg(F.round(F.avg("duration_seconds"), 3).alias("seconds"), F.round(F.avg("cost_eur"), 6).alias("cost"))
    return joins.delta_vs(means, "1-URGENT", ["seconds", "cost"])


# Every file's name against the texts of all files of its case.
@query("j15_coverage_by_tokens", "v_files", sql="WITH n AS (SELECT case_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')), '[^a-z]+'), lambda w: length(w) >= 4)) AS tokens FROM v_files), t AS (SELECT DISTINCT case_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM v_files), x AS (SELECT case_id, doc_id, unnest(tokens) AS token FROM n), h AS (SELECT x.doc_id, count(*) AS hits FROM x JOIN t USING (case_id, token) GROUP BY 1) SELECT n.case_id, n.doc_id, CAST(len(tokens) AS INT) AS tokens, CAST(coalesce(hits, 0) AS INT) AS hits, coalesce(hits, 0) >= least(2, len(tokens)) AS found FROM n LEFT JOIN h USING (doc_id)")
def _(f):
    named = f.select("case_id", F.concat_ws("/", F.col("doc_id").cast("string"), "path").alias("path"))
    out = joins.coverage_by_tokens(named, f.select("case_id", "text"))
    return out.select("case_id", F.split("path", "/")[0].cast("long").alias("doc_id"), "tokens", "hits", "found")


@query("j16_names_agree", "v_candidates", sql="WITH x AS (SELECT batch_idx, nome, concat('ditta azienda ', CAST(batch_idx % 5 AS VARCHAR), ' archivio') AS other FROM v_candidates), y AS (SELECT *, list_sort(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(nome), '[^a-z0-9]+'), lambda w: length(w) > 3)), list_distinct(list_filter(regexp_split_to_array(lower(other), '[^a-z0-9]+'), lambda w: length(w) > 3)))) AS s FROM x) SELECT batch_idx, array_to_string(s, ' ') AS shared, len(s) > 0 AS agree FROM y")
def _(c):
    other = F.concat(F.lit("ditta azienda "), (F.col("batch_idx") % 5).cast("string"), F.lit(" archivio"))
    return joins.names_agree(c.withColumn("other", other), "nome", "other").select("batch_idx", "shared", "agree")


@query("j17_fill_template", "v_cases", sql="SELECT id AS cell_id, concat('Norma ', norma, ' di ', CASE WHEN id % 2 = 0 THEN azienda ELSE '{{AZIENDA}}' END, ' {{x}}') AS filled, CASE WHEN id % 2 = 0 THEN 'x' ELSE 'AZIENDA,x' END AS unfilled FROM v_cases")
def _(c):
    cells = c.select(F.col("id").alias("case_id"), F.col("id").alias("cell_id"), F.lit("Norma {{norma}} di {{AZIENDA}} {{x}}").alias("template"))
    values = c.select(F.col("id").alias("case_id"), F.lit("NORMA").alias("key"), F.col("norma").alias("value")).union(c.filter("id % 2 = 0").select("id", F.lit("azienda"), "azienda"))
    return joins.fill_template(cells, values).select("cell_id", "filled", "unfilled")


@query("j18_match_requirements", "v_clauses", "v_norm_clauses", sql="SELECT c.case_id, c.norm, c.clause_key AS row_id, n.clause_key AS requirement FROM v_clauses c JOIN v_norm_clauses n ON c.clause_key = n.clause_key")
def _(c, n):
    rows = c.select(F.concat_ws("|", "case_id", "norm", "clause_key").alias("row_id"), F.concat(F.lit("Requisito "), "clause_key", F.lit(" (obbligatorio)")).alias("cell"))
    out = joins.match_requirements(rows, n.select(F.col("clause_key").alias("requirement")))
    part = F.split("row_id", r"\|")
    return out.select(part[0].alias("case_id"), part[1].alias("norm"), part[2].alias("row_id"), "requirement")


@query("d11_accept_recovered", "v_clauses", sql=f"WITH n AS (SELECT case_id, clause_key, concat(text, ' ', text) AS t FROM v_clauses WHERE length(text) % 2 = 0) SELECT c.case_id, c.clause_key, CASE WHEN n.t IS NOT NULL AND {words('n.t')} >= 50 THEN n.t ELSE c.text END AS text, coalesce({words('n.t')} >= 50 AND n.t IS NOT NULL, false) AS accepted, trim(CASE WHEN n.t IS NOT NULL AND {words('n.t')} >= 50 THEN n.t ELSE c.text END) = '' AS still_missing FROM v_clauses c LEFT JOIN n ON c.case_id = n.case_id AND c.clause_key = n.clause_key")
def _(c):
    new = c.filter("length(text) % 2 = 0").select("case_id", "clause_key", F.concat_ws(" ", "text", "text").alias("text"))
    return joins.accept_recovered(c.select("case_id", "clause_key", "text"), new, 50)


@query("d13_unprocessed", "v_classified", sql="SELECT case_id, path, CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'unknown' END AS phase, CASE WHEN doc_id % 2 = 0 THEN 'no text' ELSE 'unknown' END AS reason FROM (SELECT case_id, concat(path, '#', CAST(doc_id AS VARCHAR)) AS path, doc_id, role FROM v_classified) WHERE role IS NULL OR role = 'SUPPORT'")
def _(c):
    rows = c.select("case_id", F.concat("path", F.lit("#"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "role")
    why = rows.filter("doc_id % 2 = 0").select("case_id", "path", F.lit("ocr").alias("phase"), F.lit("no text").alias("reason"))
    return joins.unprocessed(rows, rows.filter("role in ('CORE', 'AGGREGABLE')"), rows.filter("role = 'NOISE'"), why)


@query("d13_ledger", "v_classified", sql="SELECT case_id, concat(path, '#', CAST(doc_id AS VARCHAR)) AS path, CASE WHEN role IN ('CORE', 'AGGREGABLE') THEN 'kept' WHEN role = 'NOISE' THEN 'skipped' ELSE 'unprocessed' END AS status, CASE WHEN role IN ('CORE', 'AGGREGABLE', 'NOISE') THEN NULL WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'unknown' END AS phase, CASE WHEN role IN ('CORE', 'AGGREGABLE', 'NOISE') THEN NULL WHEN doc_id % 2 = 0 THEN 'no text' ELSE 'unknown' END AS reason FROM v_classified")
def _(c):
    rows = c.select("case_id", F.concat("path", F.lit("#"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "role")
    why = rows.filter("doc_id % 2 = 0").select("case_id", "path", F.lit("ocr").alias("phase"), F.lit("no text").alias("reason"))
    path = f"{shared_dir(c.sparkSession)}/ledger-{uuid.uuid4().hex}"
    return accounting.ledger(rows, rows.filter("role in ('CORE', 'AGGREGABLE')"), rows.filter("role = 'NOISE'"), why, path)


@query("d14_compare_runs", "v_runs", sql="WITH m AS (SELECT case_id, provider, avg(duration_seconds) AS duration_seconds, avg(cost_eur) AS cost_eur FROM v_runs WHERE provider IN ('1-URGENT', '5-LOW') GROUP BY 1, 2), t AS (SELECT case_id, provider, 'duration_seconds' AS metric, duration_seconds AS v FROM m UNION ALL SELECT case_id, provider, 'cost_eur', cost_eur FROM m), b AS (SELECT case_id, metric, max(v) FILTER (provider = '1-URGENT') AS a, max(v) FILTER (provider = '5-LOW') AS b FROM t GROUP BY 1, 2) SELECT case_id, metric, round(a, 3) AS a, round(b, 3) AS b, CASE WHEN b <> 0 THEN round(100.0 * (a - b) / b, 1) END AS delta_pct FROM b")
def _(r):
    return joins.compare_runs(r, "1-URGENT", "5-LOW", ["duration_seconds", "cost_eur"])


# Batches and scorers.
@query("d02_ffd_batches", "v_files")
def _(f):
    return batching.ffd_batches(f.select("case_id", F.concat_ws("#", "path", F.col("doc_id").cast("string")).alias("path"), F.length("text").alias("n_chars")))


@query("d03_profiles", "v_calls", sql="SELECT DISTINCT p.* FROM (VALUES ('small', 'm-small', 4, 50000, 1.0::DOUBLE, 7), ('large', 'm-large', 10, 100000, 2.5::DOUBLE, 4)) p(provider, model, max_files, max_chars, cap_multiplier, workers) JOIN v_calls c ON regexp_replace(c.model, '^.*/', '') = p.model")
def _(c):
    used = c.select(X.model_name("model").alias("model")).distinct()
    return batching.profiles(c).join(used, "model", "left_semi").select("provider", "model", "max_files", "max_chars", "cap_multiplier", "workers")


@query("d04_cascade", "v_files")
def _(f):
    return batching.cascade(f.select("case_id", F.concat_ws("#", "path", F.col("doc_id").cast("string")).alias("path"), X.file_name("path").alias("filename"), "text"))


def _some(batches):
    for b in batches:
        b = b[(b["batch_id"] % 7 != 0) | (b["path"].str.len() % 2 == 0) & (b["batch_id"] > 1_000_000)]
        yield b[["case_id", "batch_id", "path"]].assign(output=b["path"].str.upper())


@query("d05_recover", "v_files")
def _(f):
    rows = f.select("case_id", (F.col("doc_id") % 21).alias("batch_id"), F.concat_ws("#", "path", F.col("doc_id").cast("string")).alias("path"))
    done, failed = batching.recover(rows, _some, "case_id string, batch_id long, path string, output string")
    return done.select("case_id", "path", F.lit("done").alias("state")).unionByName(failed.select("case_id", "path", F.lit("failed").alias("state")))


@query("d06_with_fallback", "v_files", sql="WITH p AS (SELECT doc_id AS batch_id, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' ELSE 'failed' END AS status, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) // 2) END AS output, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'truncated' END AS s2, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, length(text) // 3) ELSE text END AS o2 FROM v_files), q AS (SELECT *, coalesce(status <> 'ok' AND o2 IS NOT NULL AND (s2 = 'ok' OR length(o2) > length(coalesce(output, ''))), false) AS b FROM p) SELECT batch_id, CASE WHEN b THEN s2 ELSE status END AS status, CASE WHEN b THEN o2 ELSE output END AS output, b AS fell_back FROM q")
def _(f):
    first = f.select(F.col("doc_id").alias("batch_id"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'truncated' ELSE 'failed' END").alias("status"), F.expr("CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) div 2) END").alias("output"))
    second = f.select(F.col("doc_id").alias("batch_id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'truncated' END").alias("status"), F.expr("CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, length(text) div 3) ELSE text END").alias("output"))
    return batching.with_fallback(first, second, ["batch_id"])


# Sorts, limits and sets.
@query("f01_page", "v_cases", sql="SELECT id, user_id FROM v_cases ORDER BY data_creazione DESC, id LIMIT 20 OFFSET 40")
def _(c):
    return ordering.page(c, [F.desc("data_creazione"), "id"], 20, 40).select("id", "user_id")


@query("f02_sort_cases", "v_cases", sql="SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY data_creazione, id) AS n FROM v_cases")
def _(c):
    return windows.renumber(ordering.sort_cases(c, "asc"), ["data_creazione", "id"], ["user_id"], "n").select("id", "user_id", F.col("n").cast("long").alias("n"))


@query("f03_reading_order", "v_files", sql=f"SELECT doc_id, row_number() OVER (PARTITION BY case_id ORDER BY CASE {category(C.CATEGORIES_CLI, False)} WHEN 'pdf' THEN 0 WHEN 'word' THEN 1 WHEN 'excel' THEN 2 WHEN 'images' THEN 3 WHEN 'text' THEN 4 ELSE 5 END, lower(path), path, doc_id) AS n FROM v_files")
def _(f):
    return windows.renumber(ordering.reading_order(f), ["category_no", F.lower("path"), "path", "doc_id"], out="n").select("doc_id", F.col("n").cast("long").alias("n"))


@query("f04_area_order", "v_paragraphs", sql=f"SELECT case_id, numero, row_number() OVER (PARTITION BY case_id ORDER BY {_PRIORITY}, s, numero) AS n FROM (SELECT case_id, numero, {_CAT} AS c, contenuto AS s FROM v_paragraphs)")
def _(p):
    rows = p.select("case_id", "numero", F.expr(_CAT).alias("categoria"), F.col("contenuto").alias("sottotitolo"))
    return windows.renumber(ordering.area_order(rows), ["priority", "sottotitolo", "numero"], out="n").select("case_id", "numero", F.col("n").cast("long").alias("n"))


@query("f05_top_k", "v_cases", sql="SELECT azienda, count(*) AS n FROM v_cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(c):
    return ordering.top_k(c, "azienda", 8)


@query("f06_recent_activity", "events", sql="SELECT event_id, user_id, event_type FROM events WHERE user_id = 5 ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(e):
    return ordering.recent_activity(e, 50, 5).select("event_id", "user_id", "event_type")


@query("f07_page_info", "v_cases", sql='SELECT count(*) AS "rows", CAST(ceil(count(*) / 10.0) AS INT) AS pages FROM v_cases')
def _(c):
    return ordering.page_info(c)


@query("f08_ordered_results", "v_files", sql="SELECT case_id, doc_id AS batch_id, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS n FROM v_files")
def _(f):
    return windows.renumber(ordering.ordered_results(f.withColumnRenamed("doc_id", "batch_id")), ["batch_id"], out="n").select("case_id", "batch_id", F.col("n").cast("long").alias("n"))


@query("u01_union_buckets", "v_files", sql=f"SELECT bucket, doc_id, CASE WHEN bucket = 'native_text' THEN method END AS method FROM ({_TRIAGED}) WHERE bucket IN ('native_text', 'non_pdf')")
def _(f):
    t = files.triage(f, 20_000)
    return ordering.union_buckets(t.filter("bucket = 'native_text'").select("bucket", "doc_id", "method"), t.filter("bucket = 'non_pdf'").select("doc_id", "bucket"))


@query("u02_union_batches", "v_classified", sql="SELECT doc_id, CASE WHEN role = 'AGGREGABLE' THEN 'compact' ELSE 'standard' END AS mode FROM v_classified WHERE role IS NOT NULL")
def _(c):
    return ordering.union_batches(c.filter("role <> 'AGGREGABLE'").select("doc_id"), c.filter("role = 'AGGREGABLE'").select("doc_id"))


@query("u03_append_recovered", "v_files", sql="SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'recovered' END AS note FROM v_files")
def _(f):
    return ordering.union_buckets(f.filter("doc_id % 9 <> 0").select("doc_id"), f.filter("doc_id % 9 = 0").select("doc_id", F.lit("recovered").alias("note")))


@query("u04_catalogue_diff", "v_norm_clauses", "v_clauses", sql="WITH a AS (SELECT DISTINCT clause_key FROM v_norm_clauses), b AS (SELECT DISTINCT clause_key FROM v_clauses) SELECT coalesce(a.clause_key, b.clause_key) AS clause_key, CASE WHEN b.clause_key IS NULL THEN 'a' WHEN a.clause_key IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.clause_key = b.clause_key")
def _(n, c):
    return ordering.catalogue_diff(n.select("clause_key").distinct(), c.select("clause_key").distinct())


@query("u05_distinct_lines", "documents", sql="SELECT lang, min(text) AS text FROM documents GROUP BY lang, substr(text, 1, 50)")
def _(d):
    return ordering.distinct_lines(d, ["lang"]).select("lang", "text")


@query("u06_recovery_set", "v_norm_clauses", "v_clauses", sql="SELECT DISTINCT clause_key FROM v_norm_clauses WHERE pos % 2 = 0 AND clause_key IN (SELECT clause_key FROM v_clauses)")
def _(n, c):
    return ordering.recovery_set(n.filter("pos % 2 = 0").select("clause_key"), c.select("clause_key"))


@query("a37_distinct_values", "v_cases", sql="SELECT DISTINCT norma FROM v_cases WHERE norma IS NOT NULL")
def _(c):
    return ordering.distinct_values(c, "norma")


@query("a38_area_count", "v_evidence", sql="SELECT count(DISTINCT categoria) AS areas FROM v_evidence")
def _(e):
    return ordering.area_count(e)


@query("a01_triage_summary", "v_files", sql=f"SELECT count(*) FILTER (bucket = 'native_text') AS native_text, count(*) FILTER (bucket = 'needs_ocr') AS needs_ocr, count(*) FILTER (bucket = 'unrecoverable') AS unrecoverable, count(*) FILTER (bucket = 'non_pdf') AS non_pdf, count(*) AS total, round(100.0 * count(*) FILTER (bucket = 'native_text') / count(*), 1) AS native_pct FROM ({_TRIAGED})")
def _(f):
    return summaries.triage_summary(files.triage(f, 20_000))


@query("a02_extract_summary", "v_files", sql=f"SELECT {CATEGORY} AS category, count(*) AS files, sum(size)::BIGINT AS bytes, round(sum(size) / 1048576.0, 2) AS mb FROM v_files GROUP BY 1")
def _(f):
    return summaries.extract_summary(f)
