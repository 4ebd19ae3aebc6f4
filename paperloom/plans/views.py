"""Views over the given tables that stand for the library's inputs, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_files": "SELECT doc_id, lang AS case_id, CASE WHEN doc_id % 11 = 3 THEN concat('d', CAST(doc_id AS VARCHAR(20)), '/scan.pdf') ELSE concat('d', CAST(doc_id % 7 AS VARCHAR(20)), '/', CASE doc_id % 11 WHEN 0 THEN 'Visura_' WHEN 1 THEN 'DVR_' WHEN 2 THEN 'ISO_9001_' ELSE 'file_' END, CAST(doc_id AS VARCHAR(20)), CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.exe' ELSE '.HTML' END) END AS path, n_chars AS size, text FROM documents",
    "v_classified": "SELECT f.doc_id, f.case_id, f.path, regexp_replace(f.path, '^.*/', '') AS filename, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 'NOISE' WHEN l.quality = 1 THEN 'CORE' WHEN f.doc_id % 3 = 0 THEN 'AGGREGABLE' WHEN f.doc_id % 3 = 1 THEN 'NOISE' ELSE NULL END AS role, CASE WHEN f.doc_id % 13 = 0 THEN NULL ELSE 0.8 + (f.doc_id * 7 % 20) / 100.0 END AS role_conf, ((f.doc_id * 31) % 100) / 100.0 AS confidence FROM v_files f LEFT JOIN labels l ON f.doc_id = l.doc_id",
    "v_calls": "SELECT l_orderkey AS session_id, CASE l_returnflag WHEN 'A' THEN 'models/m-large' WHEN 'N' THEN 'm-small' ELSE 'm-unknown' END AS model, CASE l_linenumber % 4 WHEN 0 THEN 'classify' WHEN 1 THEN 'analyze' WHEN 2 THEN 'ocr' ELSE 'other' END AS kind, CAST(floor(l_extendedprice) AS BIGINT) AS input_tokens, CAST(floor(l_extendedprice * l_discount * 12) AS BIGINT) AS cached_tokens, CAST(floor(l_quantity * 10) AS BIGINT) AS output_tokens, l_tax * 100 AS duration_seconds, l_linenumber % 3 AS retry_count, CASE WHEN l_linenumber = 7 THEN 'timeout' ELSE NULL END AS error FROM lineitem",
    "v_cases": "SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'report' WHEN 'O' THEN 'checklist_json' ELSE 'checklist_word' END AS tipo, concat('Azienda ', CAST(o_custkey % 50 AS VARCHAR(20))) AS azienda, o_orderpriority AS norma, o_orderdate AS data_creazione, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice / 1000 END AS processing_time_seconds FROM orders",
    "v_errors": "SELECT event_id AS id, user_id, CASE WHEN event_id % 2 = 0 THEN 'partial_error' ELSE 'api' END AS error_type, CASE WHEN event_id % 2 = 0 THEN concat('sub', CAST(event_id % 6 AS VARCHAR(20))) ELSE NULL END AS error_subtype, event_id % 5 = 0 AS auto_recovered, event_id % 3 = 0 AS resolved, ts AS created_at FROM events WHERE event_type = 'error'",
    "v_progress": "SELECT user_id AS session_id, ts, CASE event_type WHEN 'signup' THEN 'session.start' WHEN 'view' THEN 'phase.tick' WHEN 'click' THEN 'file.done' WHEN 'error' THEN 'error' ELSE 'done' END AS type, value FROM events",
    "v_clauses": "SELECT source AS case_id, lang AS norm, concat(lang, '_', CAST(doc_id AS VARCHAR(20))) AS clause_key, CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE text END AS text, doc_id FROM documents",
    "v_norm_clauses": "SELECT d.lang AS norm, concat(d.lang, '_', CAST(b.item_id AS VARCHAR(20))) AS clause_key, b.item_id AS pos FROM (SELECT DISTINCT lang FROM documents) d CROSS JOIN benchmark b",
    "v_norm_topics": "SELECT d.lang AS norm, concat(d.lang, '_', n.n_name) AS clause_key, n.n_nationkey AS pos FROM (SELECT DISTINCT lang FROM documents) d CROSS JOIN nation n",
    "v_runs": "SELECT o_custkey % 40 AS case_id, o_orderpriority AS provider, o_orderdate AS finished_at, o_orderkey AS run_id, o_totalprice / 100 AS duration_seconds, o_totalprice / 100000 AS cost_eur, o_orderkey % 7 AS n_truncated, o_orderstatus <> 'P' AS success FROM orders",
    "v_candidates": "SELECT o_custkey % 60 AS case_id, o_orderkey AS batch_idx, concat('AZIENDA ', CAST(o_custkey % 9 AS VARCHAR(20)), CASE o_orderkey % 4 WHEN 0 THEN ' S.R.L.' WHEN 1 THEN ' SRL' WHEN 2 THEN ' S.p.A.' ELSE ' s.r.l' END) AS nome, CASE o_orderpriority WHEN '1-URGENT' THEN 'visura camerale' WHEN '2-HIGH' THEN 'fattura' WHEN '3-MEDIUM' THEN 'dvr' WHEN '5-LOW' THEN 'statuto' ELSE 'attestato' END AS tipo FROM orders",
    "v_paragraphs": "SELECT conv_id AS case_id, turn AS numero, role AS categoria, text AS contenuto FROM conversations",
    # Evidence cards, and events with phases: as the others, of the given tables.
    "v_evidence": "SELECT f.case_id, f.doc_id AS pos, f.path, concat(lpad(CAST(f.doc_id % 20 + 1 AS VARCHAR(20)), 2, '0'), ' · AREA ', CAST(f.doc_id % 5 AS VARCHAR(20))) AS categoria, CASE f.doc_id % 4 WHEN 0 THEN 'Visura' WHEN 1 THEN 'Attestato' WHEN 2 THEN 'DVR' ELSE 'Fattura' END AS tipo, concat('AZIENDA ', CAST(f.doc_id % 9 AS VARCHAR(20)), ' SRL') AS azienda, concat(lpad(CAST(f.doc_id % 30 + 1 AS VARCHAR(20)), 2, '0'), '/', lpad(CAST(f.doc_id % 14 + 1 AS VARCHAR(20)), 2, '0'), '/', CAST(2000 + f.doc_id % 25 AS VARCHAR(20))) AS data_doc, f.text FROM v_files f",
    "v_phases": "SELECT user_id AS session_id, ts, CASE event_type WHEN 'signup' THEN 'phase.start' WHEN 'purchase' THEN 'phase.end' ELSE 'phase.tick' END AS type, CASE event_id % 3 WHEN 0 THEN 'triage' WHEN 1 THEN 'ocr' ELSE 'analyze' END AS phase, event_id, value AS pct FROM events",
}

_NAME = re.compile(r"\b(?P<by>FROM|JOIN)\s+(?P<name>[a-z]\w*)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of VIEWS as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = {m["name"] for m in _NAME.finditer(VIEWS[name]) if m["name"] in VIEWS or m["name"] in TABLES}
    sql = _NAME.sub(lambda m: f"{m['by']} {{{m['name']}}}" if m["name"] in used else m[0], VIEWS[name])
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it uses in front of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for m in re.finditer(r"\bv_\w+", text):
            if m[0] in VIEWS and m[0] not in needed:
                need(VIEWS[m[0]])
                needed.append(m[0])

    need(sql)
    if not needed:
        return sql
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in dict.fromkeys(needed))
    return f"WITH {parts}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {parts} {sql}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function of the named views' DataFrames, with the SQL that gives the same rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(view(spark, sf_dir, v) for v in views))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(" ".join(sql.split()) if "--" not in sql else sql)
        return f

    return add
