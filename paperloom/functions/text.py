"""Text functions as columns: all run in the JVM and take columns or names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import catalog as C


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def py_strip(c) -> Column:
    """Strip white space of any script from both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def word_count(c) -> Column:
    """Words between runs of white space; a null has none."""
    return F.size(F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+"), lambda x: x != ""))


#: What Python takes for white space and word_count does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def count_words(text: str) -> int:
    """H02 inside a Python task: as word_count."""
    return len(_SEPARATORS.sub("x", text).split())


#: Fixed value: what follows a text that was cut.
TRUNCATED = "\n[TESTO TRONCATO V2]"


def sanitize(c, cap: int | None = 200_000, tag: str = TRUNCATED) -> Column:
    """LF line ends, no control characters below blank but tab and LF, cut at cap, if any, with a tag; a null is empty."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"\r\n?", "\n")
    if cap is None:
        return clean
    return F.when(F.length(clean) > cap, F.concat(F.substring(clean, 1, cap), F.lit(tag))).otherwise(clean)


def cap_lines(c, cap: int = 1000) -> Column:
    """Lines of at most cap characters."""
    return F.array_join(F.transform(F.split(_col(c), "\n"), lambda x: F.substring(x, 1, cap)), "\n")


def xml_safe(c) -> Column:
    """Without characters that XML forbids."""
    return F.regexp_replace(_col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F￾￿]", "")


def printable_ratio(c) -> Column:
    """Share of printable characters, line ends and tabs among them; 0 for an empty text."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(c == "", F.lit(0.0)).otherwise(F.length(F.regexp_replace(c, r"[\p{C}\p{Z}&&[^ \n\r\t]]", "")) / F.length(c))


def compress_text(c) -> Column:
    """At most one blank line, single blanks."""
    one = F.regexp_replace(F.regexp_replace(_col(c), r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(one, r"\n{3,}", "\n\n"))


def optimize_text(c) -> Column:
    """Every run of white space as one blank."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def clean_company(c) -> Column:
    """A company's name without legal forms at its end."""
    out = _col(c)
    for p in C.LEGAL_FORMS:
        out = F.regexp_replace(out, f"(?i){p}", "")
    return F.trim(out)


def clean_in_text(text, name) -> Column:
    """The full company name replaced by the clean one, whatever its case."""
    name = _col(name)
    quoted = F.concat(F.lit("(?i)"), F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|-])", r"\\$1"))
    clean = F.regexp_replace(clean_company(name), r"([\\$])", r"\\$1")
    return F.when(F.coalesce(name, F.lit("")) == "", _col(text)).otherwise(F.regexp_replace(_col(text), quoted, clean))


_ACCENTS = ("àáâãäåèéêëìíîïòóôõöùúûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy")


def company_key(c) -> Column:
    """A key that is the same for all spellings of a company's legal form."""
    out = F.translate(F.lower(_col(c)), *_ACCENTS)
    out = F.regexp_replace(F.regexp_replace(out, r"[^\x00-\x7F]", ""), r"[.,;:'\"`\-]", " ")
    for p in C.KEY_FORMS:
        out = F.regexp_replace(out, p, " ")
    words = F.filter(F.split(out, r"\s+"), lambda w: (w != "") & ~w.isin(C.KEY_WORDS))
    return F.array_join(dedup_runs(words), " ")


def valid_company(c) -> Column:
    """The trimmed name, or an empty text for a placeholder."""
    name = F.trim(F.coalesce(_col(c), F.lit("")))
    return F.when(F.lower(name).isin(C.PLACEHOLDER_NAMES) | (name.startswith("[") & name.endswith("]")), F.lit("")).otherwise(name)


def source_score(types) -> Column:
    """How reliable a batch is as source of the company's name, by the kinds of its documents in one text."""
    low = F.lower(F.coalesce(_col(types), F.lit("")))
    parts = [F.when(low.rlike(p), n).otherwise(0) for p, n in C.SOURCE_SCORES]
    return sum(parts[1:], parts[0])


def char_cap(name, text, mult: float = 1.0) -> Column:
    """Most characters to keep of a document, by words in its name or first 1500 characters."""
    plain = lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "_-", "  ")
    name, head = plain(_col(name)), plain(F.substring(_col(text), 1, 1500))
    out = F.lit(int(C.CHAR_CAP_DEFAULT * mult))
    for words, cap in reversed(C.CHAR_CAPS):
        out = F.when(any_of([x.contains(w) for w in words for x in (name, head)]), F.lit(int(cap * mult))).otherwise(out)
    return out


def area_code(c) -> Column:
    """The number 01 to 18 that a text starts with; else null."""
    n = F.regexp_extract(_col(c), r"^\s*(\d{1,2})\b", 1).try_cast("int")
    return F.when(n.between(1, 18), F.lpad(n.cast("string"), 2, "0"))


def slug(c, n: int = 60) -> Column:
    """Lower case letters, digits and underscores; section if nothing is left."""
    out = F.regexp_replace(F.translate(F.lower(_col(c)), "àáâãèéêìíîòóôùúû", "aaaaeeeiiiooouuu"), "[^a-z0-9]+", "_")
    out = F.substring(F.btrim(out, F.lit("_")), 1, n)
    return F.when(out == "", "section").otherwise(out)


def safe_name(c, n: int = 50) -> Column:
    """A name for files: letters, digits, blanks, hyphens and underscores, blanks as underscores."""
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(_col(c), r"[^\w\s-]", "")), r"\s+", "_"), 1, n)


def redact(c) -> Column:
    """Personal identifiers replaced by a mark."""
    out = _col(c)
    for p in C.PERSONAL:
        out = F.regexp_replace(out, p, C.PERSONAL_MARK)
    return out


def anonymise(c, mapping: list[tuple[str, str]]) -> Column:
    """Each text of mapping replaced, in order."""
    out = _col(c)
    for old, new in mapping:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def name_from_archive(c) -> Column:
    """The company that an archive is named after, in upper case; null for a generic name."""
    base = F.regexp_replace(F.regexp_extract(_col(c), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.translate(base, "_-", "  "), r"(?i)\b(audit|report|relazione|doc|files|documenti|\d{8}|\d{6})\b", "")
    clean = F.regexp_replace(F.trim(clean), r"\s+", " ")
    good = (F.length(clean) > 3) & ~F.upper(clean).contains("UPLOAD") & ~F.upper(clean).contains("CARTELLA") & ~F.lower(clean).isin(C.GENERIC_ARCHIVES)
    return F.when(good, F.upper(clean))


# Legal forms and the patterns, in order, that find a company in a registry extract.
_FORMS = r"(?:S\.?R\.?L\.?|S\.?P\.?A\.?|S\.?N\.?C\.?|S\.?A\.?S\.?|SOCIETA'?\s+(?:PER\s+AZIONI|A\s+RESPONSABILITA'?\s+LIMITATA)|(?:SOC\.?\s*)?COOP(?:ERATIVA)?(?:\s+SOCIALE)?|COOPERATIVA\s+SOCIALE|CONSORZIO|O\.?N\.?L\.?U\.?S\.?|IMPRESA\s+SOCIALE|SOC\.?\s*CONSORTILE)"
REGISTRY = [
    r"VISURA\s+ORDINARIA\s+SOCIET[A']'?\s+DI\s+CAPITALE\s+(?:relativa?\s+a|ente)\s+([A-Z][A-Z0-9\s\.'\-&]+?" + _FORMS + ")",
    r"(?:Denominazione|Ragione\s+sociale)[:\s]+([A-Z][A-Z0-9\s\.'\-&]+?" + _FORMS + ")",
    r"([A-Z][A-Z0-9\s\.'\-&]*?COOPERATIVA\s+SOCIALE[A-Z0-9\s\.'\-&]*)",
    r"(CONSORZIO\s+[A-Z][A-Z0-9\s\.'\-&]+)",
    r"([A-Z][A-Z0-9\s\.'\-&]+SOC\.?\s*COOP[A-Z0-9\s\.'\-&]*)",
    r"denominata?\s+anche\s+([A-Z][A-Z0-9\.\s\-&]+(?:S\.?P\.?A\.?|S\.?R\.?L\.?))",
    r"([A-Z][A-Z0-9\s\.'\-&]+(?:S\.?R\.?L\.?|S\.?P\.?A\.?|S\.?N\.?C\.?|S\.?A\.?S\.?))",
]


def name_from_registry(text) -> Column:
    """The company of a registry extract, from its first 8000 characters; null if no pattern gives 6 to 99 characters."""
    head = F.substring(_col(text), 1, 8000)
    found = []
    for p in REGISTRY:
        name = F.regexp_replace(F.upper(F.trim(F.regexp_extract(head, f"(?im){p}", 1))), r"\s+", " ")
        name = F.trim(F.regexp_replace(name, "^[^A-Z]+", ""))
        found.append(F.when(F.length(name).between(6, 99), name))
    return F.coalesce(*found)


# The patterns, in order, that find a company in a paragraph.
NAMED_IN_TEXT = [
    r"VISURA\s+(?:ORDINARIA|CAMERALE)[^:]*(?:relativa?\s+a|ente|di)\s+([A-Z][A-Z0-9\s\.'\-&]+?" + _FORMS + ")",
    r"denominata?\s+anche\s+([A-Z][A-Z0-9\.\s]+(?:S\.?P\.?A\.?|S\.?R\.?L\.?))",
    r"(CONSORZIO\s+[A-Z][A-Z0-9\s\.'\-&]+)",
]


def names_in_text(title, text, head: int = 800) -> Column:
    """Companies that a paragraph's title and the first characters of its text name, at most one for each pattern, in order."""
    both = F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), F.substring(F.coalesce(_col(text), F.lit("")), 1, head))
    found = [F.regexp_replace(F.upper(F.trim(F.regexp_extract(both, f"(?i){p}", 1))), r"\s+", " ") for p in NAMED_IN_TEXT]
    return F.filter(F.array(*(F.trim(x) for x in found)), lambda x: F.length(x) > 3)


def model_name(c) -> Column:
    """What follows the last slash."""
    return F.trim(F.substring_index(F.coalesce(_col(c), F.lit("")), "/", -1))


def strip_fences(c) -> Column:
    """Without lines that open or close a code block."""
    return F.regexp_replace(_col(c), r"(?m)^```(?:yaml|yml|json)?[ \t]*$\n?", "")


def name_key(c) -> Column:
    """Lower case letters and digits of a file's name."""
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def snippet(c, n: int = 200) -> Column:
    """Printable characters, tabs and line ends, cut at n and stripped."""
    clean = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[\p{C}\p{Z}&&[^ \n\t]]", "")
    return py_strip(F.substring(clean, 1, n))


def content_hash(c) -> Column:
    """H26."""
    return F.sha2(_col(c), 256)


def it_date(c) -> Column:
    """DD/MM/YYYY as a date; null for anything else."""
    c = _col(c)
    return F.when(c.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(c, "dd/MM/yyyy"))


def dedup_runs(words: Column) -> Column:
    """An array without elements equal to the one before."""
    # In an array of one, so that a lambda names the words and they are computed once, not for every element.
    kept = lambda ws: F.filter(ws, lambda w, i: ~F.coalesce(F.get(ws, i - 1) == w, F.lit(False)))
    return F.get(F.transform(F.array(words), kept), F.lit(0))


def _rows(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"^\|.*\|$") & ~F.trim(x).rlike(r"^\|[\s:|-]+\|$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.btrim(F.trim(x), F.lit("|")), r"\|"), lambda y: F.trim(y)))


def md_tables(c) -> Column:
    """Rows of the pipe tables of a text, as arrays of cells; rules between head and body are dropped."""
    return _rows(F.coalesce(_col(c), F.lit("")))


def md_records(c) -> Column:
    """The records of the pipe tables of a text, maps of cell by header; a table ends at the first line that is none of its own.

    A row short of cells has empty ones, cells beyond the header are left out, of equal headers the last one counts. A
    table of one row has no records; a row of blanks alone reads as a rule.
    """
    lines = F.split(F.coalesce(_col(c), F.lit("")), "\n")
    marked = F.transform(lines, lambda x: F.when(F.trim(x).rlike(r"^\|.*\|$"), x).otherwise(F.lit("\x00")))
    blocks = F.filter(F.split(F.array_join(marked, "\n"), "\x00"), lambda x: x.contains("|"))

    def last(head: Column) -> Column:
        places = F.transform(head, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.filter(places, lambda e: e["i"] == F.size(head) - F.array_position(F.reverse(head), e["h"]))

    # A step each, so that rows and header are made once for a table, not once for a row.
    tables = F.transform(F.transform(blocks, _rows), lambda r: F.struct(r.alias("rows"), last(F.get(r, F.lit(0))).alias("head")))
    cell = lambda row, e: F.struct(e["h"], F.coalesce(F.get(row, e["i"].cast("int")), F.lit("")))
    record = lambda row, head: F.map_from_entries(F.transform(head, lambda e: cell(row, e)))
    body = lambda t: F.slice(t["rows"], F.lit(2), F.greatest(F.size(t["rows"]) - 1, F.lit(0)))
    return F.flatten(F.transform(tables, lambda t: F.transform(body(t), lambda row: record(row, t["head"]))))


def file_name(path) -> Column:
    """What follows the last slash of a path."""
    return F.regexp_replace(_col(path), "^.*/", "")


def extension(path) -> Column:
    """The lower-case extension of a file's name, empty if it has none; a leading point starts no extension."""
    return F.lower(F.regexp_extract(_col(path), r"[^/.][^/]*\.([^./]*)$", 1))


def _categories(profile: str) -> dict[str, list[str]]:
    return {"v2": C.CATEGORIES, "v1": {**C.CATEGORIES, **C.CATEGORIES_V1}, "cli": C.CATEGORIES_CLI}[profile]


def categorize(path, profile: str = "v2") -> Column:
    """Category of a file by its extension; skip and other for the rest. Profiles: v2, v1, cli."""
    known = _categories(profile)
    ext = extension(path)
    out = F.lit("other")
    for name, extensions in known.items():
        out = F.when(ext.isin(extensions), name).otherwise(out)
    return out if profile == "cli" else F.when(ext.isin(C.SKIPPED_EXTENSIONS), "skip").otherwise(out)


def category_of(path: str) -> str:
    """P01 inside a Python task: as categorize with profile v2."""
    found = re.search(r"[^/.][^/]*\.([^./]*)$", path)
    ext = found[1].lower() if found else ""
    return "skip" if ext in C.SKIPPED_EXTENSIONS else next((k for k, v in _categories("v2").items() if ext in v), "other")


def whitelist_match(name) -> Column:
    """The part of a file's name that the first fitting pattern of WHITELIST matches; else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(F.coalesce(_col(name), F.lit("")), p, 0), F.lit("")) for p in C.WHITELIST))


def safe_path(path) -> Column:
    """Whether a member's path stays inside its archive."""
    path = F.regexp_replace(_col(path), r"\\", "/")
    return ~path.startswith("/") & ~path.rlike("^[A-Za-z]:") & ~F.exists(F.split(path, "/"), lambda x: x == "..")


def valid_case_id(c) -> Column:
    """P03."""
    return F.coalesce(_col(c).rlike("^[A-Za-z0-9_-]{1,200}$"), F.lit(False))


def is_artifact(path) -> Column:
    """Whether a path is a leftover of an operating system."""
    path, base = F.regexp_replace(_col(path), r"\\", "/"), file_name(path)
    return path.startswith("__MACOSX/") | path.contains("/__MACOSX/") | base.startswith(".") | base.startswith("__")
