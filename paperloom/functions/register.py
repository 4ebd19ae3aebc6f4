"""The functions on values (H) under names for SQL, as SQL functions that Catalyst inlines.

Those that are no expressions stay DataFrame operators: H22 (parser of cards), scrub_json of H34 (nesting of any depth).
H30 has a function for each field of a call, H38 takes the documents of a batch as an array, and optimize_text of H06
is pl_one_line.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from paperloom.functions import catalog as C
from paperloom.functions.text import NAMED_IN_TEXT, REGISTRY, TRUNCATED, _ACCENTS
from paperloom.functions.values import CARD_FIELDS

_STRIP = r"(?U)^\s+|\s+$"
_PRINTS = r"[\p{C}\p{Z}&&[^ \n\r\t]]"


def _text(x: str) -> str:
    """A literal of SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _replaced(x: str, *changes: tuple[str, str]) -> str:
    for pattern, new in changes:
        x = f"regexp_replace({x}, {_text(pattern)}, {_text(new)})"
    return x


def _texts(known: list[str]) -> str:
    return ", ".join(map(_text, known))


def _capped_list(x: str, most: str = "most") -> str:
    return f"CASE WHEN length({x}) > {most} THEN concat(substring({x}, 1, {most}), '…') ELSE {x} END"


def _chosen(x: str, names: dict[str, list[str]], default: str) -> str:
    """The last name whose list holds x."""
    whens = [f"WHEN {x} IN ({', '.join(map(_text, known))}) THEN {_text(name)}" for name, known in reversed(names.items())]
    return f"CASE {' '.join(whens)} ELSE {_text(default)} END"


_CLEAN = _replaced("coalesce(x, '')", (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"\r\n?", "\n"))
_EXTENSION = f"lower(regexp_extract(x, {_text(r'[^/.][^/]*\.([^./]*)$')}, 1))"
_SLUG = _replaced("translate(lower(x), 'àáâãèéêìíîòóôùúû', 'aaaaeeeiiiooouuu')", ("[^a-z0-9]+", "_"))
_SLASHES = _replaced("x", (r"\\", "/"))
_COMPANY = f"trim({_replaced('x', *((f'(?i){p}', '') for p in C.LEGAL_FORMS))})"
_KEY = _replaced(f"translate(lower(x), {_text(_ACCENTS[0])}, {_text(_ACCENTS[1])})", (r"[^\x00-\x7F]", ""), (r"[.,;:'\"`\-]", " "), *((p, " ") for p in C.KEY_FORMS))
_WORDS = rf"filter(split({_KEY}, r'\s+'), w -> w <> '' AND w NOT IN ({_texts(C.KEY_WORDS)}))"
_RUNS = "aggregate({}, CAST(array() AS ARRAY<STRING>), (a, w) -> CASE WHEN size(a) > 0 AND element_at(concat(array(''), a), -1) = w THEN a ELSE concat(a, array(w)) END)"
_PLAIN = "translate(lower(coalesce({}, '')), '_-', '  ')"
_HEAD = _PLAIN.format("substring(x, 1, 1500)")
_CAPS = " ".join(f"WHEN {' OR '.join(f'contains({y}, {_text(w)})' for w in words for y in (_PLAIN.format('name'), _HEAD))} THEN CAST({cap} * mult AS INT)" for words, cap in C.CHAR_CAPS)
_BASE = _replaced("regexp_extract(x, '([^/\\\\\\\\]*)$', 1)", (r"(?<=.)\.[^.]*$", ""))
_ARCHIVE = _replaced("trim(" + _replaced(f"translate({_BASE}, '_-', '  ')", (r"(?i)\b(audit|report|relazione|doc|files|documenti|\d{8}|\d{6})\b", "")) + ")", (r"\s+", " "))
_FOUND = [_replaced(f"upper(trim(regexp_extract(substring(x, 1, 8000), {_text('(?im)' + p)}, 1)))", (r"\s+", " ")) for p in REGISTRY]
_FOUND = [f"trim({_replaced(f, ('^[^A-Z]+', ''))})" for f in _FOUND]
_NAMED = [f"trim({_replaced(f'upper(trim(regexp_extract(y, {_text('(?i)' + p)}, 1)))', (r'\s+', ' '))})" for p in NAMED_IN_TEXT]
_FORBIDDEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFE}\x{FFFF}]"
_PAIRS = _replaced("array_join(transform(array_sort(map_entries(x)), e -> concat(e.key, ': ', coalesce(e.value, 'None'))), ' | ')", (_FORBIDDEN, ""))
_ITEMS = _replaced("array_join(x, ' | ', 'None')", (_FORBIDDEN, ""))
_COUNT = "greatest(0L, coalesce({}, 0L))"
_CELLS = r"transform(filter({}, l -> trim(l) RLIKE r'^\|.*\|$' AND NOT trim(l) RLIKE r'^\|[\s:|-]+\|$'), l -> transform(split(btrim(trim(l), '|'), r'\|'), c -> trim(c)))"
_LINES = r"split(coalesce(x, ''), '\n')"
_ROWS = r"split(b, '\n')"
_BLOCKS = r"filter(split(array_join(transform(" + _LINES + r", l -> CASE WHEN trim(l) RLIKE r'^\|.*\|$' THEN l ELSE '\u0000' END), '\n'), '\u0000'), b -> contains(b, '|'))"
_TABLES = f"transform({_BLOCKS}, b -> {_CELLS.format(_ROWS)})"
_RECORD = "map_from_entries(filter(transform(t[0], (h, i) -> CASE WHEN i = size(t[0]) - array_position(reverse(t[0]), h) THEN struct(h, coalesce(get(w, i), '')) END), e -> e IS NOT NULL))"
_SAID = "trim(coalesce(try_element_at(x, '{}'), '')) <> ''"

#: name(parameters) type: body.
FUNCTIONS = {
    "pl_strip(x STRING) RETURNS STRING": r"regexp_replace(x, r'(?U)^\s+|\s+$', '')",
    "pl_word_count(x STRING) RETURNS INT": r"size(filter(split(coalesce(x, ''), r'(?U)\s+'), w -> w <> ''))",
    "pl_one_line(x STRING) RETURNS STRING": r"trim(regexp_replace(x, r'\s+', ' '))",
    "pl_file_name(x STRING) RETURNS STRING": "regexp_replace(x, '^.*/', '')",
    "pl_model_name(x STRING) RETURNS STRING": "trim(substring_index(coalesce(x, ''), '/', -1))",
    "pl_name_key(x STRING) RETURNS STRING": "regexp_replace(lower(x), '[^a-z0-9]+', '')",
    "pl_content_hash(x STRING) RETURNS STRING": "sha2(x, 256)",
    "pl_it_date(x STRING) RETURNS DATE": r"CASE WHEN x RLIKE r'^\d{2}/\d{2}/\d{4}$' THEN try_to_date(x, 'dd/MM/yyyy') END",
    "pl_sanitize(x STRING, most INT) RETURNS STRING": f"CASE WHEN length({_CLEAN}) > most THEN concat(substring({_CLEAN}, 1, most), {_text(TRUNCATED)}) ELSE {_CLEAN} END",
    "pl_cap_lines(x STRING, most INT) RETURNS STRING": r"array_join(transform(split(x, '\n'), l -> substring(l, 1, most)), '\n')",
    "pl_xml_safe(x STRING) RETURNS STRING": _replaced("x", (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{FFFE}\x{FFFF}]", "")),
    "pl_printable_ratio(x STRING) RETURNS DOUBLE": f"CASE WHEN coalesce(x, '') = '' THEN 0.0 ELSE length({_replaced('x', (_PRINTS, ''))}) / length(x) END",
    "pl_compress_text(x STRING) RETURNS STRING": f"trim({_replaced('x', (r'[ \t]+', ' '), (r' ?\n ?', '\n'), (r'\n{3,}', '\n\n'))})",
    "pl_area_code(x STRING) RETURNS STRING": r"CASE WHEN try_cast(regexp_extract(x, r'^\s*(\d{1,2})\b', 1) AS INT) BETWEEN 1 AND 18 THEN lpad(CAST(try_cast(regexp_extract(x, r'^\s*(\d{1,2})\b', 1) AS INT) AS STRING), 2, '0') END",
    "pl_slug(x STRING, n INT) RETURNS STRING": f"CASE WHEN substring(btrim({_SLUG}, '_'), 1, n) = '' THEN 'section' ELSE substring(btrim({_SLUG}, '_'), 1, n) END",
    "pl_safe_name(x STRING, n INT) RETURNS STRING": "substring(" + _replaced("trim(" + _replaced("x", (r"[^\w\s-]", "")) + ")", (r"\s+", "_")) + ", 1, n)",
    "pl_redact(x STRING) RETURNS STRING": _replaced("x", *((p, C.PERSONAL_MARK) for p in C.PERSONAL)),
    "pl_strip_fences(x STRING) RETURNS STRING": _replaced("x", (r"(?m)^```(?:yaml|yml|json)?[ \t]*$\n?", "")),
    "pl_snippet(x STRING, n INT) RETURNS STRING": _replaced("substring(" + _replaced("coalesce(x, '')", (r"[\p{C}\p{Z}&&[^ \n\t]]", "")) + ", 1, n)", (_STRIP, "")),
    "pl_extension(x STRING) RETURNS STRING": _EXTENSION,
    "pl_category(x STRING) RETURNS STRING": f"CASE WHEN {_EXTENSION} IN ({', '.join(map(_text, C.SKIPPED_EXTENSIONS))}) THEN 'skip' ELSE {_chosen(_EXTENSION, C.CATEGORIES, 'other')} END",
    "pl_safe_path(x STRING) RETURNS BOOLEAN": f"NOT startswith({_SLASHES}, '/') AND NOT {_SLASHES} RLIKE '^[A-Za-z]:' AND NOT array_contains(split({_SLASHES}, '/'), '..')",
    "pl_valid_case_id(x STRING) RETURNS BOOLEAN": "coalesce(x RLIKE '^[A-Za-z0-9_-]{1,200}$', false)",
    "pl_is_artifact(x STRING) RETURNS BOOLEAN": f"startswith({_SLASHES}, '__MACOSX/') OR contains({_SLASHES}, '/__MACOSX/') OR startswith(regexp_replace(x, '^.*/', ''), '.') OR startswith(regexp_replace(x, '^.*/', ''), '__')",
    "pl_whitelist_match(x STRING) RETURNS STRING": "coalesce(" + ", ".join(f"nullif(regexp_extract(coalesce(x, ''), {_text(p)}, 0), '')" for p in C.WHITELIST) + ")",
    "pl_clean_company(x STRING) RETURNS STRING": _COMPANY,
    "pl_clean_in_text(x STRING, name STRING) RETURNS STRING": f"CASE WHEN coalesce(name, '') = '' THEN x ELSE regexp_replace(x, concat('(?i)', {_replaced('name', (r'([\\.\[\]{}()*+?^$|-])', r'\\$1'))}), {_replaced(_COMPANY.replace('(x,', '(name,'), (r'([\\$])', r'\\$1'))}) END",
    "pl_company_key(x STRING) RETURNS STRING": f"array_join({_RUNS.format(_WORDS)}, ' ')",
    "pl_valid_company(x STRING) RETURNS STRING": f"CASE WHEN lower(trim(coalesce(x, ''))) IN ({_texts(C.PLACEHOLDER_NAMES)}) OR (startswith(trim(x), '[') AND endswith(trim(x), ']')) THEN '' ELSE trim(coalesce(x, '')) END",
    "pl_source_score(x STRING) RETURNS INT": " + ".join(f"CASE WHEN lower(coalesce(x, '')) RLIKE {_text(p)} THEN {n} ELSE 0 END" for p, n in C.SOURCE_SCORES),
    "pl_char_cap(name STRING, x STRING, mult DOUBLE) RETURNS INT": f"CASE {_CAPS} ELSE CAST({C.CHAR_CAP_DEFAULT} * mult AS INT) END",
    "pl_anonymise(x STRING, names ARRAY<STRUCT<old: STRING, new: STRING>>) RETURNS STRING": "aggregate(names, x, (t, n) -> replace(t, n.old, n.new))",
    "pl_name_from_archive(x STRING) RETURNS STRING": f"CASE WHEN length({_ARCHIVE}) > 3 AND NOT contains(upper({_ARCHIVE}), 'UPLOAD') AND NOT contains(upper({_ARCHIVE}), 'CARTELLA') AND lower({_ARCHIVE}) NOT IN ({_texts(C.GENERIC_ARCHIVES)}) THEN upper({_ARCHIVE}) END",
    "pl_name_from_registry(x STRING) RETURNS STRING": f"coalesce({', '.join(f'CASE WHEN length({f}) BETWEEN 6 AND 99 THEN {f} END' for f in _FOUND)})",
    "pl_names_in_text(title STRING, x STRING) RETURNS ARRAY<STRING>": f"filter(flatten(transform(array(concat(coalesce(title, ''), ' ', substring(coalesce(x, ''), 1, 800))), y -> array({', '.join(_NAMED)}))), n -> length(n) > 3)",
    "pl_value_to_text(x MAP<STRING, STRING>, most INT) RETURNS STRING": f"CASE WHEN x IS NULL OR cardinality(x) = 0 THEN 'n.d.' ELSE {_capped_list(_PAIRS)} END",
    "pl_list_to_text(x ARRAY<STRING>, most INT) RETURNS STRING": f"CASE WHEN x IS NULL OR cardinality(x) = 0 THEN 'n.d.' ELSE {_capped_list(_ITEMS)} END",
    "pl_age_days(x TIMESTAMP, as_of DATE) RETURNS INT": "datediff(as_of, to_date(x))",
    "pl_yyyy_mm(x TIMESTAMP) RETURNS STRING": "date_format(x, 'yyyy-MM')",
    "pl_call_cost(input_tokens BIGINT, cached_tokens BIGINT, output_tokens BIGINT, input DOUBLE, cached DOUBLE, output DOUBLE) RETURNS DOUBLE": "greatest(0L, input_tokens - cached_tokens) * coalesce(input, 0.0D) / 1000000 + output_tokens * coalesce(output, 0.0D) / 1000000 + cached_tokens * coalesce(cached, 0.0D) / 1000000",
    "pl_call_kind(x STRING) RETURNS STRING": f"CASE WHEN x IN ({_texts(C.CALL_KINDS)}) THEN x ELSE 'other' END",
    "pl_call_count(x BIGINT) RETURNS BIGINT": _COUNT.format("x"),
    "pl_cached_tokens(x BIGINT, input_tokens BIGINT) RETURNS BIGINT": f"least({_COUNT.format('x')}, {_COUNT.format('input_tokens')})",
    "pl_call_seconds(x DOUBLE) RETURNS DOUBLE": "round(greatest(0.0D, coalesce(x, 0.0D)), 3)",
    "pl_call_error(x STRING) RETURNS STRING": "nullif(substring(x, 1, 200), '')",
    "pl_pct_delta(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "CASE WHEN b <> 0 THEN round(100.0 * (a - b) / b, 1) END",
    "pl_backoff(attempt INT, base DOUBLE, most DOUBLE) RETURNS DOUBLE": "least(most, base * pow(2.0D, attempt))",
    "pl_md_tables(x STRING) RETURNS ARRAY<ARRAY<STRING>>": _CELLS.format(_LINES),
    "pl_md_records(x STRING) RETURNS ARRAY<MAP<STRING, STRING>>": f"flatten(transform({_TABLES}, t -> transform(slice(t, 2, greatest(size(t) - 1, 0)), w -> {_RECORD})))",
    "pl_scrub(x MAP<STRING, STRING>, drop ARRAY<STRING>) RETURNS MAP<STRING, STRING>": f"transform_values(map_filter(x, (k, v) -> NOT array_contains(drop, lower(k))), (k, v) -> {_replaced('v', *((p, C.PERSONAL_MARK) for p in C.PERSONAL))})",
    "pl_card_head(x MAP<STRING, STRING>) RETURNS MAP<STRING, STRING>": f"map_filter(x, (k, v) -> k IN ({_texts(CARD_FIELDS)}))",
    "pl_card_clusters(x MAP<STRING, STRING>) RETURNS MAP<STRING, STRING>": f"map_filter(x, (k, v) -> k NOT IN ({_texts(CARD_FIELDS)}))",
    "pl_flat_doc(x MAP<STRING, STRING>) RETURNS MAP<STRING, STRING>": f"CASE WHEN NOT map_contains_key(x, 'sezioni') AND ({_SAID.format('tipo')} OR {_SAID.format('titolo')}) THEN map_filter(x, (k, v) -> k NOT IN ('meta', 'sezioni')) END",
    "pl_dedup_runs(x ARRAY<STRING>) RETURNS ARRAY<STRING>": _RUNS.format("x"),
    "pl_payload(docs ARRAY<STRUCT<pos: BIGINT, filename: STRING, text: STRING>>, most INT) RETURNS STRING": r"array_join(transform(sort_array(transform(docs, d -> struct(d.pos, concat('### FILE: ', d.filename, '\n', substring(d.text, 1, most)) AS part))), d -> d.part), '\n\n')",
    "pl_group_schema(x ARRAY<STRING>) RETURNS STRING": "to_json(map_from_arrays(x, transform(x, k -> 'string')))",
    "pl_pct(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "CASE WHEN b <> 0 THEN round(100.0 * a / b, 1) ELSE 0.0 END",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
