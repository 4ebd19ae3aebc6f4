"""Evidence from a scorer's raw output: parsing that loses nothing, and assembly by case."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.functions.catalog import MARKERS
from paperloom.operators.cards import parse_chunk
from paperloom.operators.joins import counted_coverage
from paperloom.operators.shared import bounded_batches, checked, numbered, stored
from paperloom.operators.summaries import resolve_company
from paperloom.operators.windows import round_robin

_CARD = "case_id string, batch_id int, chunk int, ok boolean, azienda string, cards array<struct<section: string, card: map<string, string>>>, raw string, reason string, dropped array<struct<line: int, reason: string, text: string>>"


def parse_evidence(raw: DataFrame) -> DataFrame:
    """raw(case_id, batch_id, text) split at lines of hyphens; each chunk becomes cards, or a failure that stops no other.

    One row for each chunk: ok, azienda, cards, the text and the reason of those that failed, and the lines that were
    left out or taken otherwise than they stand. Chunks are dealt anew before parsing, as one file may hold them all.
    """
    chunks = raw.select(F.col("case_id").cast("string").alias("case_id"), F.col("batch_id").cast("int").alias("batch_id"), F.posexplode(F.split(X.strip_fences("text"), r"(?m)^---[ \t]*$")).alias("chunk", "text"))
    chunks = chunks.filter(F.trim("text") != "").repartition("case_id", "batch_id", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse_chunk(t) for t in b["text"]]
            yield b[["case_id", "batch_id", "chunk"]].assign(
                ok=[f[3] is None for f in found],
                azienda=[f[0] for f in found],
                cards=[f[1] for f in found],
                raw=[t if f[3] else None for f, t in zip(found, b["text"], strict=True)],
                reason=[f[3] for f in found],
                dropped=[[dict(zip(("line", "reason", "text"), x, strict=True)) for x in f[2]] for f in found],
            )

    return chunks.mapInPandas(run, _CARD)


def dropped_lines(parsed: DataFrame) -> DataFrame:
    """The ledger of parse_evidence: case_id, batch_id, chunk, line (from 1), reason and text of every line left out or taken otherwise."""
    return parsed.select("case_id", "batch_id", "chunk", F.explode("dropped").alias("x")).select("case_id", "batch_id", "chunk", "x.*")


def parse_evidence_v1(raw: DataFrame) -> DataFrame:
    """The older form: documents apart by lines of "# ── DOC n ──", or else by lines that start with tipo."""
    text = X.strip_fences("text")
    marked = F.regexp_replace(text, r"(?m)^#\s*─+\s*DOC\s*\d+\s*─+.*$", "---")
    marked = F.when(marked.rlike(r"(?m)^---[ \t]*$"), marked).otherwise(F.regexp_replace(text, "(?m)^tipo:", "---\ntipo:"))
    return parse_evidence(raw.withColumn("text", marked))


def cards(parsed: DataFrame) -> DataFrame:
    """One row for each card of parse_evidence, with a position in its case."""
    each = parsed.filter("ok").select("case_id", "batch_id", "chunk", F.posexplode("cards").alias("n", "x")).select("case_id", "batch_id", "chunk", "n", "x.section", "x.card")
    return numbered(each, ["case_id"], ["batch_id", "chunk", "n"], "pos").drop("chunk", "n")


def assemble(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evidence, case_meta, failures): cards with sections merged by name whatever its case, the company and count of each case, and failed chunks."""
    parsed = stored(parse_evidence(raw), "parsed")
    found = stored(cards(parsed).withColumn("section_key", F.upper(F.trim("section"))), "cards")
    names = found.groupBy("case_id", "section_key").agg(F.min_by("section", "pos").alias("section"))
    evidence = found.drop("section").join(names, ["case_id", "section_key"], "left").drop("section_key")
    kinds = found.groupBy("case_id", "batch_id").agg(F.array_join(F.sort_array(F.collect_list(F.lower(F.coalesce(F.try_element_at("card", F.lit("tipo")), F.lit(""))))), " ").alias("tipo"))
    named = parsed.filter("azienda is not null").groupBy("case_id", "batch_id").agg(F.min_by("azienda", "chunk").alias("nome"))
    companies = resolve_company(named.join(kinds, ["case_id", "batch_id"], "left").select("case_id", F.col("batch_id").alias("batch_idx"), "nome", "tipo"))
    meta = found.groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("section_key").alias("sections")).join(companies.select("case_id", F.col("nome").alias("company")), "case_id", "left")
    return evidence, meta, parsed.filter("not ok").select("case_id", "batch_id", "chunk", "reason", "raw")


_PARAGRAPHS = "array<struct<numero: int, categoria: string, sottotitolo: string, contenuto: string>>"


#: The rest of a quoted string and its closing quote.
_QUOTED = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
_BRACE, _BRACE_OR_QUOTE = re.compile("[{}]"), re.compile('[{}"]')


def _braces(text: str) -> list[str]:
    """Outermost objects of a text, found by matching braces outside quotes."""
    out, depth, start, at = [], 0, 0, 0
    while (found := (_BRACE_OR_QUOTE if depth else _BRACE).search(text, at)) is not None:
        c, at = found[0], found.end()
        if c == '"':
            quoted = _QUOTED.match(text, at)
            if quoted is None:
                break
            at = quoted.end()
        elif c == "{":
            depth, start = depth + 1, start if depth else at - 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(text[start:at])
    return out


def _lenient(text: str):
    """JSON with commas before closing brackets and raw control characters; None if it is none."""
    try:
        return json.loads(re.sub(r",\s*([}\]])", r"\1", text), strict=False)
    except ValueError:
        return None


def _objects(found: list) -> list[dict]:
    """The objects of a list, and those of paragrafi and of lists one level deeper."""
    inner = lambda x: x["paragrafi"] if isinstance(x, dict) and isinstance(x.get("paragrafi"), list) else x if isinstance(x, list) else [x]
    return [y for x in found for y in inner(x) if isinstance(y, dict)]


def _repaired(text: pd.Series) -> pd.Series:
    """The tier, 2 or 3, and the objects as JSON: of the text between its outermost brackets, else of matching braces."""

    def one(t: str | None) -> str:
        t = t or ""
        starts = [i for i in (t.find("["), t.find("{")) if i >= 0]
        whole = _lenient(t[min(starts) : max(t.rfind("]"), t.rfind("}")) + 1]) if starts else None
        objects = [] if whole is None else _objects([whole])
        tier = 2 if objects else 3
        objects = objects or _objects([x for x in map(_lenient, _braces(t)) if x is not None])
        return f"{tier}{json.dumps(objects, ensure_ascii=False)}"

    return text.map(one)


def parse_narrative(raw: DataFrame) -> DataFrame:
    """raw(case_id, batch_id, text) as paragraphs: strict JSON first, then lenient, what that leaves by matching braces.

    tier tells which; a text that gives nothing has no rows, and failed_narrative finds it.
    """
    plain = F.trim(X.strip_fences("text"))
    strict = F.when(F.try_parse_json(plain).isNotNull(), F.from_json(F.when(plain.startswith("["), plain), _PARAGRAPHS))
    tried = bounded_batches(raw).select("case_id", "batch_id", plain.alias("text"), strict.alias("strict"))
    ok = tried.filter("strict is not null").select("case_id", "batch_id", F.lit(1).alias("tier"), F.posexplode("strict").alias("n", "x"))
    mended = tried.filter("strict is null").select("case_id", "batch_id", F.pandas_udf(_repaired, "string")("text").alias("found"))
    rest = mended.select("case_id", "batch_id", F.substring("found", 1, 1).cast("int").alias("tier"), F.posexplode(F.from_json(F.expr("substr(found, 2)"), _PARAGRAPHS)).alias("n", "x"))
    return ok.unionByName(rest).select("case_id", "batch_id", "tier", "n", "x.*")


def failed_narrative(raw: DataFrame) -> DataFrame:
    """The rows of raw(case_id, batch_id, text) that give no paragraph; keys may be null."""
    found = parse_narrative(raw).select(F.col("case_id").alias("_case"), F.col("batch_id").alias("_batch")).distinct()
    return raw.join(found, F.col("case_id").eqNullSafe(F.col("_case")) & F.col("batch_id").eqNullSafe(F.col("_batch")), "left_anti")


def assemble_narrative(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(case_id, batch_id, n, categoria, contenuto) in the order of batches, numbered anew, with the areas that the case touches."""
    out = numbered(paragraphs, ["case_id"], ["batch_id", "n"], "numero")
    areas = paragraphs.groupBy("case_id").agg(F.count_distinct(F.coalesce("categoria", F.lit("18"))).cast("int").alias("areas"))
    return out.join(areas, "case_id", "left")


def build_checklist(report: DataFrame, norm_clauses: DataFrame, scorer, groups: int = 6, least: int = 50) -> DataFrame:
    """report(case_id, norm, text) → clauses with status, of a scorer that is asked for a group of clauses at a time.

    The scorer maps (case_id, norm, groups, report), where groups is an array of arrays of keys, to (case_id, norm,
    clause_key, text), and goes over a report's groups itself: so a report travels once a round, however many clauses are
    asked of it. Clauses that it leaves out, or answers in too few words, are asked for once more, each as its own group;
    a report without any answer is asked for all. A report of a norm without clauses gives no rows.
    """
    dealt = round_robin(norm_clauses, ["pos"], ["norm"], groups)
    asked = dealt.groupBy("norm", "group_no").agg(F.sort_array(F.collect_list("clause_key")).alias("keys"))
    asked = stored(asked.groupBy("norm").agg(F.transform(F.sort_array(F.collect_list(F.struct("group_no", "keys"))), lambda x: x["keys"]).alias("groups")), "asked")
    key, columns = ["case_id", "norm", "clause_key"], ["case_id", "norm", "groups", "report"]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in scorer(batches):
            yield b[key].assign(words=pd.array([None if t is None or t is pd.NA or t != t else X.count_words(t) for t in b["text"]], "Int32"))

    # Answers are many times the reports: their words are counted where they are given, and no answer is stored or shuffled.
    answers = lambda asked: stored(asked.select(*columns).mapInPandas(counted, "case_id string, norm string, clause_key string, words int"), "answers")
    named = bounded_batches(report).select(F.col("case_id").cast("string").alias("case_id"), "norm", F.col("text").alias("report"))
    first = answers(named.join(checked(asked), "norm"))
    cases = named.select("case_id", "norm").distinct()
    missing = counted_coverage(first, norm_clauses, cases=cases).filter(F.col("status").isin("missing", "empty", "short"))
    alone = missing.groupBy("case_id", "norm").agg(F.transform(F.sort_array(F.collect_list("clause_key")), lambda k: F.array(k)).alias("groups"))
    again = answers(named.join(alone, ["case_id", "norm"])).withColumnRenamed("words", "_new")
    # As accept_recovered (D11) does with texts.
    words = F.when(F.coalesce("_new", F.lit(0)) >= least, F.col("_new")).otherwise(F.col("words"))
    return counted_coverage(first.join(again, key, "full").select(*key, words.alias("words")), norm_clauses, cases=cases)


def markers_of(text: Column) -> Column:
    """The markers of a whole text, as an array of (kind, value) in the order of kinds."""
    each = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1 if "(" in p.split("*", 1)[-1] and kind not in ("meta_azienda", "meta_indice") else 0)), lambda v, k=kind: F.struct(F.lit(k).alias("kind"), F.trim(v).alias("value"))) for kind, p in MARKERS]
    return F.concat(*each)
