"""Registered queries: aggregations, window operators, functions on text and values."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.functions import values as V
from paperloom.functions.register import register
from paperloom.operators import joins, summaries, windows
from paperloom.plans.files_and_joins import _CALLS, _CLASS_OF, AS_OF_CASES, AS_OF_ERRORS, PRICES, words
from paperloom.plans.views import query


@query("a03_classifier_summary", "v_classified", sql=f"WITH c AS (SELECT trim(upper({_CLASS_OF})) AS classe, coalesce(role, 'SUPPORT') AS role, CAST(confidence AS DOUBLE) AS confidence FROM v_classified) SELECT classe, role, CAST(grouping(classe, role) AS INT) AS level, count(*) AS n, round(avg(confidence), 3) AS avg_confidence, round(100.0 * count(*) FILTER (round(confidence, 6) < 0.6) / count(*), 1) AS low_confidence_pct, round(100.0 * count(*) FILTER (role = 'NOISE') / count(*), 1) AS noise_pct FROM c GROUP BY GROUPING SETS ((classe), (role), ())")
def _(c):
    rows = c.select(F.trim(F.upper(F.expr(_CLASS_OF))).alias("classe"), F.coalesce("role", F.lit("SUPPORT")).alias("role"), F.col("confidence").cast("double").alias("confidence"))
    return summaries.classifier_summary(rows)


@query("a04_ocr_summary", "documents", sql="SELECT count(*) AS files, count(*) FILTER (n_chars > 500) AS ok, round(100.0 * count(*) FILTER (n_chars > 500) / count(*), 1) AS ok_pct, CAST(sum(n_chars) FILTER (n_chars > 500) AS BIGINT) AS chars, CAST(sum(n_chars // 3000 + 1) FILTER (n_chars > 500) AS BIGINT) AS pages, round(sum(n_chars) FILTER (n_chars > 500) / count(*) FILTER (n_chars > 500), 1) AS avg_chars FROM documents")
def _(d):
    return summaries.ocr_summary(d.select((F.col("n_chars") > 500).alias("ok"), F.col("n_chars").alias("chars"), F.expr("n_chars div 3000 + 1").alias("pages")))


@query("a05_section_summary", "v_evidence", sql="WITH s AS (SELECT DISTINCT case_id, substr(categoria, 1, 2) AS section_id FROM v_evidence), t AS (SELECT case_id, section_id, section_id NOT IN ('03', '07') AS ok FROM s) SELECT case_id, count(*) AS sections, count(*) FILTER (ok) AS built, coalesce(string_agg(CASE WHEN NOT ok THEN concat(section_id, ': boom') END, '; ' ORDER BY section_id), '') AS errors FROM t GROUP BY 1")
def _(e):
    rows = e.select("case_id", F.substring("categoria", 1, 2).alias("section_id")).distinct().withColumn("ok", ~F.col("section_id").isin("03", "07"))
    return summaries.section_summary(rows.withColumn("error", F.when(~F.col("ok"), "boom")))


@query("a06_manifest_summary", "v_files", sql="SELECT case_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM v_files GROUP BY 1")
def _(f):
    return summaries.manifest_summary(f)


_KINDS = ", ".join(f"count(*) FILTER (tipo = '{k}') AS {k}" for k in ("report", "checklist_json", "checklist_word"))


@query("a07_user_stats", "v_cases", sql=f"SELECT user_id, count(*) AS total, {_KINDS}, count(*) FILTER (CAST(data_creazione AS DATE) = DATE '{AS_OF_CASES}') AS today, count(*) FILTER (CAST(data_creazione AS DATE) >= DATE '{AS_OF_CASES}' - 7) AS week FROM v_cases GROUP BY 1")
def _(c):
    return summaries.user_stats(c, AS_OF_CASES)


@query("a08_global_stats", "v_cases", sql=f"SELECT user_id, norma, CAST(grouping(user_id, norma) AS INT) AS level, count(*) AS total, count(*) FILTER (CAST(data_creazione AS DATE) = DATE '{AS_OF_CASES}') AS today, round(coalesce(avg(processing_time_seconds) FILTER (processing_time_seconds > 0), 0), 1) AS mean_seconds FROM v_cases GROUP BY GROUPING SETS ((user_id), (norma), ())")
def _(c):
    return summaries.global_stats(c, AS_OF_CASES)


@query("a09_error_dashboard", "v_errors", sql=f"SELECT CAST(created_at AS DATE) AS day, error_subtype, CAST(grouping(CAST(created_at AS DATE), error_subtype) AS INT) AS level, count(*) AS n, count(*) FILTER (auto_recovered) AS recovered, round(100.0 * count(*) FILTER (auto_recovered) / count(*), 1) AS recovery_rate FROM v_errors WHERE error_type = 'partial_error' AND created_at >= TIMESTAMP '{AS_OF_ERRORS}' - INTERVAL 30 DAY GROUP BY GROUPING SETS ((error_subtype), (CAST(created_at AS DATE), error_subtype), ())")
def _(e):
    return summaries.error_dashboard(e, AS_OF_ERRORS)


@query("a10_error_stats", "v_errors", sql=f"SELECT error_type, CAST(grouping(error_type) AS INT) AS level, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF_ERRORS}' - INTERVAL 1 DAY) AS last_24h, count(*) FILTER (created_at >= TIMESTAMP '{AS_OF_ERRORS}' - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (NOT resolved) AS unresolved FROM v_errors GROUP BY ROLLUP (error_type)")
def _(e):
    return summaries.error_stats(e, AS_OF_ERRORS)


@query("a11_usage_report", "v_calls", sql=_CALLS + "SELECT model, kind, CAST(grouping(model, kind) AS INT) AS level, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost_usd), 5) AS cost_usd, round(sum(cost_usd) * 0.93, 5) AS cost_eur, round(greatest(0, sum(cost_nocache) - sum(cost_usd)), 5) AS saved_usd, CAST(sum(retry_count) AS BIGINT) AS retries, count(error) AS errors FROM k GROUP BY GROUPING SETS ((model), (kind), ())")
def _(c):
    prices = c.sparkSession.createDataFrame(PRICES, "model string, input double, output double, cached_input double")
    return summaries.usage_report(joins.with_cost(c, prices))


@query("a12_usage_table", "v_calls", sql=_CALLS + "SELECT model, kind, CAST(grouping(model, kind) AS INT) AS level, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(duration_seconds), 3) AS seconds FROM k GROUP BY ROLLUP (model, kind)")
def _(c):
    return summaries.usage_table(V.clean_call(c))


@query("a13_error_sample", "v_calls", sql="SELECT session_id, model, error FROM v_calls WHERE error IS NOT NULL ORDER BY session_id, model, kind LIMIT 20")
def _(c):
    return summaries.error_sample(c, ["session_id", "model", "kind"]).select("session_id", "model", "error")


@query("a14_phase_stats", "v_calls", sql="SELECT kind AS phase, round(min(duration_seconds), 3) AS min, round(max(duration_seconds), 3) AS max, round(avg(duration_seconds), 3) AS mean, count(*) AS n FROM v_calls WHERE duration_seconds > 0 GROUP BY 1")
def _(c):
    return summaries.phase_stats(c.select(F.col("kind").alias("phase"), F.col("duration_seconds").alias("duration")))


@query("a15_stats_by_norm", "v_cases", sql="SELECT norma, count(*) AS n, round(avg(coalesce(processing_time_seconds, 0)), 3) AS mean_seconds FROM v_cases GROUP BY 1")
def _(c):
    return summaries.stats_by_norm(c)


@query("a16_throughput", "v_runs", sql="SELECT case_id AS key, count(*) AS n, round(avg(duration_seconds / (1 + run_id % 50)), 4) AS s_per_mb, round(avg(CASE WHEN n_truncated > 0 THEN duration_seconds / n_truncated END), 4) AS s_per_file FROM v_runs GROUP BY 1 HAVING count(*) >= 2")
def _(r):
    return summaries.throughput(r.select(F.col("case_id").alias("key"), F.col("duration_seconds").alias("seconds"), (1 + F.col("run_id") % 50).alias("mb"), F.col("n_truncated").alias("files")))


@query("a17_run_report", "v_runs", sql="SELECT provider, case_id, CAST(grouping(provider, case_id) AS INT) AS level, count(*) AS n, round(avg(duration_seconds), 3) AS mean_seconds, CAST(sum(n_truncated) AS BIGINT) AS truncated FROM v_runs GROUP BY GROUPING SETS ((provider, case_id), (provider))")
def _(r):
    return summaries.run_report(r)


@query("a18_clause_stats", "v_clauses", sql=f"SELECT case_id, count(*) AS clauses, count(*) FILTER (trim(text) <> '') AS filled, count(*) FILTER (trim(text) = '') AS empty, CAST(sum({words('text')}) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, round(100.0 * count(*) FILTER (trim(text) <> '') / count(*), 1) AS fill_pct FROM v_clauses GROUP BY 1")
def _(c):
    return summaries.clause_stats(c)


@query("a19_validate_checklist", "v_clauses", sql=f"WITH s AS (SELECT case_id, norm, count(*) FILTER (w = 0) AS empty, count(*) FILTER (w > 0 AND w < 50) AS short FROM (SELECT *, {words('text')} AS w FROM v_clauses) GROUP BY 1, 2) SELECT *, concat_ws('; ', CASE WHEN empty > 0 THEN concat(CAST(empty AS VARCHAR), ' empty') END, CASE WHEN short > 0 THEN concat(CAST(short AS VARCHAR), ' short') END) AS issues, empty + short = 0 AS valid FROM s")
def _(c):
    return summaries.validate_checklist(c)


_CONF = "CASE pos % 4 WHEN 0 THEN 'Conforme' WHEN 1 THEN 'NON CONFORME' WHEN 2 THEN 'conforme con osservazioni' ELSE 'n.a.' END"


@query("a20_conformity_summary", "v_evidence", sql=f"SELECT case_id, count(*) AS items, count(*) FILTER (contains(upper(x), 'CONFORME') AND NOT contains(upper(x), 'NON CONFORME') AND NOT contains(upper(x), 'OSSERVAZION')) AS conforme, count(*) FILTER (contains(upper(x), 'OSSERVAZION') AND NOT contains(upper(x), 'NON CONFORME')) AS osservazione, count(*) FILTER (contains(upper(x), 'NON CONFORME')) AS non_conforme FROM (SELECT case_id, {_CONF} AS x FROM v_evidence) GROUP BY 1")
def _(e):
    return summaries.conformity_summary(e.select("case_id", F.expr(_CONF).alias("conformita")))


@query("a21_clause_matrix", "v_clauses", sql=f"SELECT norm, count(*) AS clauses, count(*) FILTER (w >= 150) AS complete, count(*) FILTER (w >= 100 AND w < 150) AS warning, count(*) FILTER (w > 0 AND w < 100) AS short, count(*) FILTER (w = 0) AS empty, round(100.0 * count(*) FILTER (w >= 150) / count(*), 1) AS complete_pct FROM (SELECT *, {words('text')} AS w FROM v_clauses) GROUP BY 1")
def _(c):
    return summaries.clause_matrix(c)


@query("a22_paragraph_quality", "v_paragraphs", sql=f"SELECT case_id, count(*) AS n, round(avg(w), 2) AS mean_words, min(w)::INT AS min_words, max(w)::INT AS max_words, CAST(max(CAST(contains(h, 'the') AS INT)) + max(CAST(contains(h, 'ion') AS INT)) + max(CAST(contains(h, 'qu') AS INT)) AS INT) AS verbs FROM (SELECT case_id, {words('contenuto')} AS w, lower(substr(contenuto, 1, 100)) AS h FROM v_paragraphs) GROUP BY 1")
def _(p):
    return summaries.paragraph_quality(p, ["the", "ion", "qu"])


@query("a23_evidence_summary", "v_evidence", sql="SELECT case_id, count(DISTINCT categoria) AS sections, count(*) AS documents FROM v_evidence GROUP BY 1")
def _(e):
    return summaries.evidence_summary(e)


@query("a24_majority_name", "v_candidates", sql="SELECT case_id, nome, n AS votes FROM (SELECT case_id, nome, count(*) AS n, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, nome) AS r FROM v_candidates GROUP BY 1, 2) WHERE r = 1")
def _(c):
    return summaries.majority_name(c)


_SCORE = " + ".join(f"CASE WHEN regexp_matches(lower(tipo), '{p}') THEN {n} ELSE 0 END" for p, n in C.SOURCE_SCORES)
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(nome), '[.]', ' ', 'g'), '\\b(srl|s r l|s p a)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("a25_resolve_company", "v_candidates", sql=f"WITH s AS (SELECT case_id, nome, {_SCORE} AS score, {_KEY} AS key FROM v_candidates), g AS (SELECT case_id, key, sum(score) AS score, count(*) AS n FROM s GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, n DESC, key) AS r FROM g), m AS (SELECT case_id, key, nome, row_number() OVER (PARTITION BY case_id, key ORDER BY score DESC, length(nome) DESC, nome) AS r FROM s) SELECT b.case_id, m.nome, b.key, CAST(b.score AS BIGINT) AS score, b.n FROM b JOIN m ON b.case_id = m.case_id AND b.key = m.key AND m.r = 1 WHERE b.r = 1")
def _(c):
    return summaries.resolve_company(c)


@query("a26_resolve_company_single", "v_candidates", sql=f"SELECT case_id, nome, score FROM (SELECT case_id, nome, {_SCORE} AS score, row_number() OVER (PARTITION BY case_id ORDER BY {_SCORE} DESC, batch_idx, nome) AS r FROM v_candidates) WHERE r = 1")
def _(c):
    return summaries.resolve_company(c, "single")


@query("a27_case_meta_facts", "v_evidence", sql="SELECT case_id, count(*) AS documents, min(d) AS first_date, max(d) AS last_date, count(*) FILTER (trim(text) = '') AS empty FROM (SELECT case_id, text, CAST(try_strptime(data_doc, '%d/%m/%Y') AS DATE) AS d FROM v_evidence) GROUP BY 1")
def _(e):
    return summaries.case_meta_facts(e)


@query("a28_run_rollup", "v_progress", sql="SELECT session_id, min(ts) FILTER (type = 'session.start') AS started, min(ts) FILTER (type = 'done') AS ended, min(ts) FILTER (type = 'error') AS failed, count(*) AS events, CASE WHEN count(*) FILTER (type = 'done') > 0 THEN 'OK' WHEN count(*) FILTER (type = 'error') > 0 THEN 'ERROR' ELSE 'INCOMPLETE' END AS status FROM v_progress GROUP BY 1")
def _(p):
    return summaries.run_rollup(p)


@query("a29_session_summary", "v_progress", sql="SELECT session_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (type = '{t}') AS {t.replace('.', '_')}" for t in C.EVENT_TYPES) + " FROM v_progress GROUP BY 1")
def _(p):
    return summaries.session_summary(p)


@query("a30_pattern_hits", "v_evidence", sql="WITH p(pattern, re) AS (VALUES ('the', '\\b[Tt]he\\b'), ('numbers', '\\d+'), ('marks', '[#*]{2,}')) SELECT case_id, pattern, CAST(sum(len(regexp_extract_all(text, re))) AS BIGINT) AS hits, count(*) FILTER (len(regexp_extract_all(text, re)) > 0) AS texts FROM v_evidence CROSS JOIN p GROUP BY 1, 2")
def _(e):
    return summaries.pattern_hits(e, [("the", r"\b[Tt]he\b"), ("numbers", r"[0-9]+"), ("marks", "[#*]{2,}")])


@query("a31_output_profile", "v_evidence", sql=f"SELECT case_id, CAST(sum({words('text')}) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT tipo) AS types, CAST(sum(len(regexp_extract_all(text, '(?m)^#+ '))) AS BIGINT) AS headings FROM v_evidence GROUP BY 1")
def _(e):
    return summaries.output_profile(e)


@query("a32_provider_pivot", "v_runs", sql="SELECT provider, " + ", ".join(f"round(avg(duration_seconds) FILTER (case_id = {k}), 3) AS case_{k}" for k in (1, 2, 3)) + ", round(avg(duration_seconds), 3) AS mean, CAST(sum(n_truncated) AS BIGINT) AS truncated FROM v_runs GROUP BY 1")
def _(r):
    return summaries.provider_pivot(r, "duration_seconds", [1, 2, 3])


_PROVIDERS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("a33_case_metric_table", "v_runs", sql="WITH t AS (SELECT case_id, provider, 'duration_seconds' AS metric, duration_seconds AS v FROM v_runs UNION ALL SELECT case_id, provider, 'cost_eur', cost_eur FROM v_runs) SELECT case_id, metric, " + ", ".join(f"round(avg(v) FILTER (provider = '{p}'), 3) AS p_{i}" for i, p in enumerate(_PROVIDERS)) + " FROM t GROUP BY 1, 2")
def _(r):
    return summaries.case_metric_table(r, ["duration_seconds", "cost_eur"], _PROVIDERS)


@query("a34_validate_jsonl", "v_paragraphs", sql="SELECT CASE WHEN numero % 7 = 6 THEN 'invalid' WHEN numero % 2 = 0 THEN 'paragraph' ELSE 'unknown' END AS kind, count(*) AS \"rows\", count(*) FILTER (trim(contenuto) = '') AS no_content, count(*) FILTER (numero % 5 = 4) AS no_number FROM v_paragraphs GROUP BY 1")
def _(p):
    rows = p.select(F.when(F.col("numero") % 2 == 0, "paragraph").alias("kind"), F.col("contenuto").alias("content"), F.when(F.col("numero") % 5 != 4, F.col("numero")).alias("number"), F.when(F.col("numero") % 7 == 6, "{").alias("corrupt"))
    return summaries.validate_jsonl(rows)


@query("a35_dashboard", "v_cases", sql=f"SELECT count(*) AS total, {_KINDS}, count(*) FILTER (CAST(data_creazione AS DATE) = DATE '{AS_OF_CASES}') AS today FROM v_cases")
def _(c):
    return summaries.dashboard(c, AS_OF_CASES)


@query("a36_admin_panel", "v_cases", sql="SELECT round(avg(processing_time_seconds) FILTER (processing_time_seconds > 0), 2) AS mean_seconds, round(100.0 * count(*) FILTER (processing_time_seconds > 0) / count(*), 1) AS success_pct FROM v_cases")
def _(c):
    return summaries.admin_panel(c)


@query("a36_admin_users", "v_cases", sql="SELECT user_id, n, round(100.0 * n / (SELECT count(*) FROM v_cases), 1) AS share_pct FROM (SELECT user_id, count(*) AS n FROM v_cases GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)")
def _(c):
    return summaries.admin_users(c)


@query("a39_unprocessed_report", "v_files", sql="SELECT phase, reason, path, CAST(row_number() OVER (PARTITION BY phase, reason ORDER BY path) AS INT) AS no, count(*) OVER (PARTITION BY phase, reason) AS n FROM (SELECT path, CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'parse' END AS phase, concat('r', CAST(doc_id % 3 AS VARCHAR)) AS reason FROM v_files)")
def _(f):
    rows = f.select("path", F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("parse").alias("phase"), F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("reason"))
    return summaries.unprocessed_report(rows)


@query("a40_role_audit", "v_classified", sql="SELECT coalesce(role, 'SUPPORT') AS role, count(*) AS n, count(*) FILTER (role = 'NOISE' AND coalesce(round(CAST(role_conf AS DOUBLE), 6), 0) < 0.9) AS low_confidence_noise FROM v_classified GROUP BY 1")
def _(c):
    return summaries.role_audit(c.withColumn("role_conf", F.col("role_conf").cast("double")))


@query("a41_phase_durations", "v_phases", sql="SELECT session_id, phase, started, ended, round(epoch_us(ended) / 1e6 - epoch_us(started) / 1e6, 3) AS seconds FROM (SELECT session_id, phase, min(ts) FILTER (type = 'phase.start') AS started, max(ts) FILTER (type = 'phase.end') AS ended FROM v_phases GROUP BY 1, 2) WHERE ended >= started")
def _(e):
    return summaries.phase_durations(e)


@query("a42_unresolved_count", "v_errors", sql="SELECT count(*) FILTER (NOT resolved) AS unresolved FROM v_errors")
def _(e):
    return summaries.unresolved_count(e)


# Windows.
@query("w03_latest_runs", "v_runs", sql="SELECT case_id, provider, finished_at, run_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, provider ORDER BY finished_at DESC, run_id DESC) AS r FROM v_runs) WHERE r = 1")
def _(r):
    return windows.latest_runs(r)


@query("w04_renumber", "v_paragraphs", sql="SELECT case_id, contenuto, CAST(row_number() OVER (PARTITION BY case_id ORDER BY categoria, numero) AS INT) AS numero FROM v_paragraphs")
def _(p):
    return windows.renumber(p.withColumn("old", F.col("numero")), ["categoria", "old"]).select("case_id", "contenuto", "numero")


@query("w05_build_index", "v_evidence", sql="SELECT case_id, pos, CAST(row_number() OVER (PARTITION BY case_id ORDER BY categoria, pos) AS INT) AS n FROM v_evidence")
def _(e):
    return windows.renumber(e, ["categoria", "pos"], out="n").select("case_id", "pos", "n")


@query("w06_batch_offsets", "v_files", sql="SELECT doc_id, CAST(1 + coalesce(sum(size) OVER (PARTITION BY case_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM v_files")
def _(f):
    return windows.running_offset(f, "size", ["doc_id"], ["case_id"]).select("doc_id", "offset")


@query("w07_phase_offsets", "v_calls", sql="WITH k AS (SELECT kind, CAST(sum(output_tokens) AS BIGINT) AS weight FROM v_calls GROUP BY 1) SELECT kind, weight, CAST(coalesce(sum(weight) OVER (ORDER BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM k")
def _(c):
    return windows.running_offset(c.groupBy("kind").agg(F.sum("output_tokens").alias("weight")).withColumn("one", F.lit(1)), "weight", ["kind"], ["one"], 0).drop("one")


@query("w08_homogeneous_groups", "v_evidence", sql="SELECT case_id, section_id, tipo, n, first_pos, CAST(row_number() OVER (PARTITION BY case_id, section_id ORDER BY first_pos) AS INT) AS group_no FROM (SELECT case_id, substr(categoria, 1, 2) AS section_id, tipo, count(*) AS n, min(pos) AS first_pos FROM v_evidence GROUP BY 1, 2, 3) WHERE n >= 3")
def _(e):
    return windows.homogeneous_groups(e.withColumn("section_id", F.substring("categoria", 1, 2)))


_OWN = "CASE WHEN pos % 3 = 0 THEN substr(categoria, 1, 2) END"
_HEAD = "CASE WHEN pos % 7 = 1 THEN lpad(CAST(pos % 18 + 1 AS VARCHAR(20)), 2, '0') END"


@query("w09_fill_section", "v_evidence", sql=f"WITH e AS (SELECT case_id, pos, {_OWN} AS own, {_HEAD} AS header FROM v_evidence) SELECT pos, coalesce(own, last_value(header IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '18') AS section FROM e")
def _(e):
    return windows.fill_section(e.select("case_id", "pos", F.expr(_OWN).alias("own"), F.expr(_HEAD).alias("header"))).select("pos", "section")


@query("w10_merge_first", "v_evidence", sql="SELECT case_id, min_by(tipo, pos) FILTER (pos % 5 = 3) AS tipo, min_by(azienda, pos) FILTER (pos % 4 = 2) AS azienda FROM v_evidence GROUP BY 1")
def _(e):
    rows = e.select("case_id", "pos", F.when(F.col("pos") % 5 == 3, F.col("tipo")).otherwise(" ").alias("tipo"), F.when(F.col("pos") % 4 == 2, F.col("azienda")).alias("azienda"))
    return windows.merge_first(rows, ["tipo", "azienda"], "pos")


@query("w11_round_robin", "v_norm_clauses", sql="SELECT norm, clause_key, CAST((row_number() OVER (PARTITION BY norm ORDER BY pos) - 1) % 6 AS INT) AS group_no FROM v_norm_clauses")
def _(n):
    return windows.round_robin(n, ["pos"], ["norm"]).select("norm", "clause_key", "group_no")


@query("w12_chunk", "v_files", sql="SELECT doc_id, CAST((row_number() OVER (PARTITION BY case_id ORDER BY doc_id) - 1) // 100 AS INT) AS chunk_no FROM v_files")
def _(f):
    return windows.chunk(f, ["doc_id"], ["case_id"]).select("doc_id", "chunk_no")


@query("w13_rotate", "v_runs", sql="SELECT run_id, ['analizza', 'legge', 'verifica'][run_id % 3 + 1] AS label FROM v_runs")
def _(r):
    return windows.rotate(r, "run_id", ["analizza", "legge", "verifica"]).select("run_id", "label")


@query("w14_progress_pct", "v_phases", sql="SELECT event_id, CASE WHEN max(CASE WHEN type = 'phase.end' THEN 1 ELSE 0 END) OVER w = 1 THEN 100.0 ELSE least(99.0, max(coalesce(pct, 0)) OVER w) END AS shown FROM v_phases WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(e):
    return windows.progress_pct(e.withColumn("type", F.when(F.col("type") == "phase.end", "done").otherwise(F.col("type")))).select("event_id", "shown")


@query("w15_gaps", "v_phases", sql="SELECT event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) AS silence FROM v_phases WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id) QUALIFY round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 3) > 36000")
def _(e):
    return windows.gaps(e, 36_000).select("event_id", "silence")


@query("w16_cap_stream", "conversations", sql="SELECT conv_id AS session_id, turn AS seq, length(text) > 400 - b AS truncated, substr(text, 1, CAST(400 - b AS INT)) AS text FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b < 400")
def _(c):
    return windows.cap_stream(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text"), 400)


@query("w17_first_match", "v_files", sql="SELECT case_id, min(path) AS path FROM v_files WHERE contains(lower(path), 'visura') GROUP BY 1")
def _(f):
    return windows.first_match(f, "visura")


# Functions on text.
def _text(name: str, sql: str, column, view: str = "documents", key: str = "doc_id") -> None:
    query(name, view, sql=f"SELECT {key}, {sql} AS value FROM {view}")(lambda d: d.select(key, column().alias("value")))


_text("h01_py_strip", "regexp_replace(concat(chr(9), text, chr(10), ' '), '^\\s+|\\s+$', '', 'g')", lambda: X.py_strip(F.concat(F.lit("\t"), "text", F.lit("\n "))))
_text("h02_word_count", f"CAST({words('text')} AS INT)", lambda: X.word_count("text"))
_text("h03_sanitize", "CASE WHEN length(replace(text, '.', chr(10))) > 1000 THEN concat(substr(replace(text, '.', chr(10)), 1, 1000), chr(10), '[TESTO TRONCATO V2]') ELSE replace(text, '.', chr(10)) END", lambda: X.sanitize(F.replace("text", F.lit("."), F.lit("\r\n")), 1000))
_text("h04_xml_safe", "replace(text, '.', '')", lambda: X.xml_safe(F.replace("text", F.lit("."), F.lit("\x0b"))))
_text("h05_printable_ratio", "CASE WHEN text = '' THEN 0 ELSE 1.0 - (length(concat(text, chr(1))) - length(text)) / length(concat(text, chr(1))) END", lambda: F.when(F.col("text") == "", 0.0).otherwise(X.printable_ratio(F.concat("text", F.lit("\x01")))))
_text("h06_compress_text", "trim(regexp_replace(text, '\\s+', ' ', 'g'))", lambda: X.optimize_text("text"))
_text("h07_clean_company", "trim(regexp_replace(nome, '(?i)\\s+(s\\.?r\\.?l\\.?|s\\.?p\\.?a\\.?)\\s*$', ''))", lambda: X.clean_company("nome"), "v_candidates", "batch_idx")
_text("h08_clean_in_text", "concat('la ', trim(regexp_replace(nome, '(?i)\\s+(s\\.?r\\.?l\\.?|s\\.?p\\.?a\\.?)\\s*$', '')), ' opera')", lambda: X.clean_in_text(F.concat(F.lit("la "), F.lower("nome"), F.lit(" opera")), "nome"), "v_candidates", "batch_idx")
_text("h09_company_key", "trim(regexp_replace(regexp_replace(regexp_replace(lower(nome), '[.]', ' ', 'g'), '\\b(srl|s r l|s p a)\\b', ' ', 'g'), '\\s+', ' ', 'g'))", lambda: X.company_key("nome"), "v_candidates", "batch_idx")
_text("h10_valid_company", "CASE WHEN batch_idx % 3 = 0 THEN '' ELSE nome END", lambda: X.valid_company(F.when(F.col("batch_idx") % 3 == 0, " N.D. ").otherwise(F.col("nome"))), "v_candidates", "batch_idx")
_text("h11_source_score", _SCORE, lambda: X.source_score("tipo"), "v_candidates", "batch_idx")
_CAPS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{w}') OR contains(n, '{w}')" for w in ws) + f" THEN {cap}" for ws, cap in C.CHAR_CAPS) + f" ELSE {C.CHAR_CAP_DEFAULT} END"


@query("h12_char_cap", "v_files", sql=f"SELECT doc_id, {_CAPS} AS value FROM (SELECT doc_id, translate(lower(regexp_replace(path, '^.*/', '')), '_-', '  ') AS n, translate(lower(substr(text, 1, 1500)), '_-', '  ') AS h FROM v_files)")
def _(f):
    return f.select("doc_id", X.char_cap(X.file_name("path"), "text").alias("value"))


_text("h13_area_code", "CASE WHEN CAST(substr(categoria, 1, 2) AS INT) BETWEEN 1 AND 18 THEN substr(categoria, 1, 2) END", lambda: X.area_code("categoria"), "v_evidence", "pos")
_text("h14_slug", "substr(regexp_replace(translate(lower(categoria), 'àèé', 'aee'), '[^a-z0-9]+', '_', 'g'), 1, 60)", lambda: X.slug("categoria"), "v_evidence", "pos")
_text("h15_redact", "concat('CF [dato privacy rimosso], ', text)", lambda: X.redact(F.concat(F.lit("CF RSSMRA80A01H501U, "), "text")))
_text("h16_anonymise", "replace(replace(nome, 'AZIENDA', 'DITTA'), 'DITTA 1', 'UNO')", lambda: X.anonymise("nome", [("AZIENDA", "DITTA"), ("DITTA 1", "UNO")]), "v_candidates", "batch_idx")
_text("h17_name_from_archive", "CASE WHEN id % 4 = 0 THEN NULL ELSE upper(azienda) END", lambda: X.name_from_archive(F.when(F.col("id") % 4 == 0, "tmp/Documenti_audit.zip").otherwise(F.concat(F.lit("in/audit-"), F.replace("azienda", F.lit(" "), F.lit("_")), F.lit("_20240101.zip")))), "v_cases", "id")
_text("h18_name_from_registry", "CASE WHEN batch_idx % 2 = 0 THEN concat('AZIENDA ALFA ', CAST(batch_idx % 9 AS VARCHAR), ' SRL') END", lambda: X.name_from_registry(F.when(F.col("batch_idx") % 2 == 0, F.concat(F.lit("Visura n. 5\nDenominazione: Azienda Alfa "), (F.col("batch_idx") % 9).cast("string"), F.lit(" Srl\nSede: via"))).otherwise("niente")), "v_candidates", "batch_idx")
_text("h21_strip_fences", "text", lambda: X.strip_fences(F.concat(F.lit("```yaml\n"), "text")))
_text("h24_name_key", "regexp_replace(lower(path), '[^a-z0-9]+', '', 'g')", lambda: X.name_key("path"), "v_files")
_text("h25_snippet", "regexp_replace(substr(text, 1, 200), '^\\s+|\\s+$', '', 'g')", lambda: X.snippet("text", 200))
_text("h26_content_hash", "sha256(text)", lambda: X.content_hash("text"))
_text("h27_it_date", "CAST(try_strptime(data_doc, '%d/%m/%Y') AS DATE)", lambda: X.it_date("data_doc"), "v_evidence", "pos")
_text("h28_age_days", f"concat(CAST(DATE '{AS_OF_CASES}' - CAST(data_creazione AS DATE) AS VARCHAR), ' ', strftime(data_creazione, '%Y-%m'))", lambda: F.concat_ws(" ", V.age_days("data_creazione", AS_OF_CASES).cast("string"), V.yyyy_mm("data_creazione")), "v_cases", "id")
_text("h31_pct", "CASE WHEN n_truncated <> 0 THEN round(100.0 * duration_seconds / n_truncated, 6) ELSE 0 END", lambda: V.pct(F.col("duration_seconds"), F.col("n_truncated"), 6), "v_runs", "run_id")
_text("h32_backoff", "least(60.0, 2.0 * pow(2, n_truncated))", lambda: V.backoff(F.col("n_truncated")), "v_runs", "run_id")
_text("h33_md_tables", "len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^\\|.*\\|$') AND NOT regexp_matches(trim(x), '^\\|[\\s:|-]+\\|$')))::INT + 2", lambda: F.size(X.md_tables(F.concat(F.lit("| a | b |\n|---|:--|\n| 1 | 2 |\n"), "text"))))


@query("h33_md_records", "v_evidence", sql="SELECT pos, tipo, data_doc, k.n AS n, CASE WHEN k.n = 0 THEN azienda ELSE '' END AS ente FROM v_evidence, (SELECT unnest([0, 1]) AS n) k")
def _(e):
    table = F.concat(F.lit("| tipo | data | ente |\n|---|---|---|\n| "), "tipo", F.lit(" | "), "data_doc", F.lit(" | "), "azienda", F.lit(" | x |\n| "), "tipo", F.lit(" | "), "data_doc", F.lit(" |\n"))
    rows = e.select("pos", F.posexplode(X.md_records(F.concat(F.regexp_replace("text", r"\|", "/"), F.lit("\n"), table))).alias("n", "r"))
    return rows.select("pos", F.col("r")["tipo"].alias("tipo"), F.col("r")["data"].alias("data_doc"), "n", F.col("r")["ente"].alias("ente"))


@query("h37_dedup_runs", "documents", sql="SELECT doc_id, array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), ' ') AS value FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents)")
def _(d):
    return d.select("doc_id", F.array_join(X.dedup_runs(F.split("text", " ")), " ").alias("value"))


@query("h19_resolve_case_name", "v_candidates", sql="SELECT batch_idx AS case_id, CASE WHEN batch_idx % 2 = 0 THEN concat('AZIENDA ALFA ', CAST(batch_idx % 9 AS VARCHAR), ' SRL') WHEN batch_idx % 3 = 0 THEN 'AZIENDA BETA' ELSE nome END AS name, CASE WHEN batch_idx % 2 = 0 AND batch_idx % 3 = 0 THEN 'registry_and_archive' WHEN batch_idx % 2 = 0 THEN 'registry' WHEN batch_idx % 3 = 0 THEN 'archive' ELSE 'vote' END AS how FROM v_candidates")
def _(c):
    registry = F.when(F.col("batch_idx") % 2 == 0, F.concat(F.lit("Denominazione: Azienda Alfa "), (F.col("batch_idx") % 9).cast("string"), F.lit(" Srl\n")))
    archive = F.when(F.col("batch_idx") % 3 == 0, "azienda_beta.zip").otherwise("allegati.zip")
    return joins.resolve_case_name(c.select(F.col("batch_idx").alias("case_id"), archive.alias("archive"), registry.alias("registry_text"), F.col("nome").alias("voted")))


@query("h19_names_in_text", "v_evidence", sql="SELECT case_id, concat('CONSORZIO ', chr(65 + CAST(pos % 3 AS INT)), 'LFA ', tipo_up) AS name, 'text' AS how FROM (SELECT case_id, pos, tipo_up, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first, pos % 3) AS r FROM (SELECT case_id, upper(tipo) AS tipo_up, any_value(pos % 3) AS pos, count(*) AS n, min(pos) AS first FROM v_evidence GROUP BY case_id, upper(tipo), pos % 3)) WHERE r = 1")
def _(e):
    named = F.concat(F.lit("consorzio "), F.char(F.col("pos") % 3 + 65), F.lit("lfa  "), F.col("tipo"), F.lit("; "), F.col("text"))
    texts = e.select("case_id", F.col("pos").alias("numero"), F.lit("").alias("sottotitolo"), named.alias("contenuto"))
    cases = e.select("case_id").distinct().select("case_id", *(F.lit(None).cast("string").alias(c) for c in ("archive", "registry_text", "voted")))
    return joins.resolve_case_name(cases, texts)


@query("h23_value_to_text", "v_evidence", sql="SELECT pos, CASE WHEN pos % 5 = 0 THEN 'n.d.' ELSE concat('data: ', data_doc, ' | tipo: ', tipo) END AS value FROM v_evidence")
def _(e):
    m = F.when(F.col("pos") % 5 != 0, F.create_map(F.lit("tipo"), F.col("tipo"), F.lit("data"), F.col("data_doc")))
    return e.select("pos", V.value_to_text(m).alias("value"))


@query("h34_scrub", "v_evidence", sql="SELECT pos, concat('nota=CF [dato privacy rimosso];tipo=', tipo) AS value FROM v_evidence")
def _(e):
    m = V.scrub(F.create_map(F.lit("tipo"), F.col("tipo"), F.lit("nota"), F.lit("CF RSSMRA80A01H501U"), F.lit("Password"), F.lit("x")), ["password"])
    return e.select("pos", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"]))), ";").alias("value"))


@query("h35_split_card", "v_evidence", sql="SELECT pos, tipo AS head, categoria AS free FROM v_evidence")
def _(e):
    head, free = V.split_card(F.create_map(F.lit("tipo"), F.col("tipo"), F.lit("SICUREZZA"), F.col("categoria")))
    return e.select("pos", F.array_join(F.map_values(head), ",").alias("head"), F.array_join(F.map_values(free), ",").alias("free"))


@query("h36_flat_doc", "v_evidence", sql="SELECT pos, pos % 2 = 0 AS flat FROM v_evidence")
def _(e):
    card = F.map_filter(F.create_map(F.lit("tipo"), F.col("tipo"), F.lit("sezioni"), F.when(F.col("pos") % 2 == 1, "x")), lambda _, v: v.isNotNull())
    return e.select("pos", V.flat_doc(card).isNotNull().alias("flat"))


@query("h38_batch_payload", "v_files", sql="SELECT case_id, doc_id // 100 AS batch_id, string_agg(concat('### FILE: ', path, chr(10), substr(text, 1, 300)), concat(chr(10), chr(10)) ORDER BY doc_id) AS payload, count(*) AS files FROM v_files GROUP BY 1, 2")
def _(f):
    return V.batch_payload(f.select("case_id", F.expr("doc_id div 100").alias("batch_id"), F.col("doc_id").alias("pos"), F.col("path").alias("filename"), "text"), F.lit(300))


@query("h39_group_schema", "v_norm_clauses", sql="SELECT norm, concat('{', string_agg(concat('\"', clause_key, '\":\"string\"'), ',' ORDER BY clause_key), '}') AS value FROM v_norm_clauses GROUP BY 1")
def _(n):
    return n.groupBy("norm").agg(F.sort_array(F.collect_list("clause_key")).alias("keys")).select("norm", V.group_schema(F.col("keys")).alias("value"))


@query("x06_sql_functions", "v_candidates", sql=r"SELECT case_id, batch_idx, regexp_replace(nome, '\s+S\.?(R\.?L|P\.?A)\.?\s*$', '', 'i') AS azienda, lower(regexp_replace(nome, '\s+S\.?(R\.?L|P\.?A)\.?\s*$', '', 'i')) AS chiave, CASE tipo WHEN 'visura camerale' THEN 100 WHEN 'statuto' THEN 80 WHEN 'fattura' THEN 30 WHEN 'dvr' THEN -50 ELSE 0 END::INT AS punti FROM v_candidates")
def _(c):
    register(c.sparkSession)
    return c.sparkSession.sql("SELECT case_id, batch_idx, pl_clean_company(nome) AS azienda, pl_company_key(nome) AS chiave, pl_source_score(tipo) AS punti FROM {c}", c=c)
