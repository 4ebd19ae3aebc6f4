"""Joins between files, classifications, costs, clauses and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.functions import values as V
from paperloom.operators.dictionary import matches
from paperloom.operators.shared import checked, stored

def merge_ocr(files: DataFrame, ocr: DataFrame) -> DataFrame:
    """Files with the text of ocr(case_id, path, ocr_text) where they have one; unprocessed tells those without any."""
    out = files.join(ocr, ["case_id", "path"], "left")
    text = F.coalesce(F.nullif(F.trim("ocr_text"), F.lit("")), F.nullif(F.trim("text"), F.lit("")))
    return out.withColumn("text", text).withColumn("unprocessed", text.isNull()).drop("ocr_text")


def apply_skips(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents that the ledger does not skip."""
    return docs.join(ledger.select("case_id", "path").distinct(), ["case_id", "path"], "left_anti")


def attach_role(docs: DataFrame, classified: DataFrame, default: str = "SUPPORT") -> DataFrame:
    """Documents with their role, the default where there is none."""
    return docs.join(classified.select("case_id", "path", "role"), ["case_id", "path"], "left").withColumn("role", F.coalesce("role", F.lit(default)))


def merge_rescored(stage1: DataFrame, stage2: DataFrame, keys: list[str] = ["case_id", "path"]) -> DataFrame:  # noqa: B006
    """Rows of the first stage, replaced by those of the second where there are; rescored tells which."""
    again = stage2.select(*keys, F.col("classe").alias("_classe"), F.col("confidence").alias("_confidence"), F.lit(True).alias("_again"))
    out = stage1.join(again, keys, "left")
    pick = lambda c: F.coalesce(f"_{c}", c)
    return out.withColumn("classe", pick("classe")).withColumn("confidence", pick("confidence")).withColumn("rescored", F.coalesce("_again", F.lit(False))).drop("_classe", "_confidence", "_again")


def thresholds(df: DataFrame) -> DataFrame:
    """Fewest words of a clause, and those below which it gets a warning, by norm."""
    return df.sparkSession.createDataFrame(C.CLAUSE_WORDS, "norm string, min_words int, warning_words int")


def clause_coverage(clauses: DataFrame, norm_clauses: DataFrame, limits: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """Every expected clause of the norms of a case, and its status: missing, empty, short, warning or complete.

    cases(case_id, norm) tells the cases and their norms, each once; without it they are those that have a clause.
    """
    counted = clauses.select("case_id", "norm", "clause_key", F.when(F.col("text").isNotNull(), X.word_count("text")).alias("words"))
    return counted_coverage(counted, norm_clauses, limits, cases)


def counted_coverage(clauses: DataFrame, norm_clauses: DataFrame, limits: DataFrame | None = None, cases: DataFrame | None = None) -> DataFrame:
    """J06 of clauses(case_id, norm, clause_key, words), whose texts are counted already; words is null where there is no text."""
    limits = thresholds(clauses) if limits is None else limits
    cases = clauses.select("case_id", "norm").distinct() if cases is None else cases
    wanted = cases.join(checked(norm_clauses), "norm")
    out = wanted.join(clauses.select("case_id", "norm", "clause_key", "words"), ["case_id", "norm", "clause_key"], "left").join(checked(limits), "norm", "left")
    least, warn = F.coalesce("min_words", F.lit(C.CLAUSE_WORDS_DEFAULT[0])), F.coalesce("warning_words", F.lit(C.CLAUSE_WORDS_DEFAULT[1]))
    words = F.coalesce("words", F.lit(0))
    status = F.when(F.col("words").isNull(), "missing").when(words == 0, "empty").when(words < least, "short").when(words < warn, "warning").otherwise("complete")
    return out.select("case_id", "norm", "clause_key", words.alias("words"), status.alias("status"))


def missing_clauses(clauses: DataFrame, norm_clauses: DataFrame) -> DataFrame:
    """Expected clauses of which a case has none."""
    wanted = clauses.select("case_id", "norm").distinct().join(checked(norm_clauses), "norm").select("case_id", "norm", "clause_key")
    return wanted.join(clauses.select("case_id", "norm", "clause_key"), ["case_id", "norm", "clause_key"], "left_anti")


def lost_documents(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents of batches that gave no result."""
    return docs.join(results.select("case_id", "batch_id").distinct(), ["case_id", "batch_id"], "left_anti")


def with_cost(calls: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cleaned calls with cost_usd and cost_nocache; an unknown model costs nothing."""
    out = V.clean_call(calls).join(checked(pricing), "model", "left")
    return out.withColumn("cost_usd", V.call_cost()).withColumn("cost_nocache", V.call_cost(cached=False)).drop("input", "output", "cached_input")


def detect_standard(df: DataFrame, standards: DataFrame, norm: str = "norma") -> DataFrame:
    """Rows with standard: the key that equals the norm, whatever its case, else the longest key in it with a number of its own there.

    Each distinct norm is scanned once for all keys of standards(key).
    """
    names = df.select(norm, F.upper(norm).alias("_upper")).distinct()
    keys = standards.select("key", F.upper("key").alias("_up")).distinct()
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"(\d+)"), F.lit(1))
    found = matches(names, "_upper", keys, "_up").join(names, "_upper").join(checked(keys), "_up")
    same = F.col("_upper") == F.col("_up")
    found = found.filter(same | (F.size(numbers("key")) == 0) | (F.size(numbers(norm)) == 0) | F.arrays_overlap(numbers("key"), numbers(norm)))
    best = found.groupBy(norm).agg(F.max(F.struct(same.alias("same"), F.length("key").alias("n"), "key")).alias("best"))
    return df.join(checked(stored(best.select(norm, F.col("best.key").alias("standard")), "standards")), norm, "left")


def areas(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, a[:2], i + 1) for i, a in enumerate(C.AREAS)], "area string, code string, area_no int")


def route_area(evidence: DataFrame, table: DataFrame | None = None, name: str = "categoria") -> DataFrame:
    """Evidence with its area: by number where the name starts with one, else by either name being part of the other.

    Each distinct name is scanned once for all areas, in both directions.
    """
    table = checked(areas(evidence) if table is None else table)
    names = evidence.select(name).distinct().withColumn("code", X.area_code(name))
    by_code = names.filter("code is not null").join(table, "code").select(name, "area")
    others = names.filter("code is null").select(name, F.upper(name).alias("_name"))
    places = table.select("area", "area_no", F.upper("area").alias("_area"))
    found = matches(others, "_name", places, "_area", around=True).join(others, "_name").join(places, "_area")
    by_name = found.groupBy(name).agg(F.min_by("area", "area_no").alias("area"))
    return evidence.join(by_code.unionByName(by_name), name, "left")


def area_priority(df: DataFrame, order: list[str] = C.REPORT_AREAS, name: str = "categoria") -> DataFrame:
    """Rows with priority: that of the area of the same name, else of the first one that the name contains, else 999.

    Each distinct name is scanned once for all areas.
    """
    clean = F.upper(F.trim(F.coalesce(F.col(name), F.lit("ALTRO"))))
    ranks = df.sparkSession.createDataFrame(list(enumerate(order)), "_rank int, _area string")
    keyed = df.withColumn("_clean", clean)
    found = matches(keyed, "_clean", ranks, "_area").join(F.broadcast(ranks), "_area")
    best = found.groupBy("_clean").agg(F.min(F.struct((F.col("_clean") != F.col("_area")).alias("other"), "_rank")).alias("_best"))
    out = keyed.join(checked(stored(best, "priorities")), "_clean", "left")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce("_best._rank", F.lit(999)).alias("priority"))


def matrix(cases: DataFrame, providers: DataFrame) -> DataFrame:
    """Every case with every provider, of which there are few."""
    return cases.select("case_id").distinct().crossJoin(checked(providers.select("provider").distinct()))


def delta_vs(df: DataFrame, baseline: str, metrics: list[str]) -> DataFrame:
    """df(case_id, provider, metrics) with the difference of each metric to the baseline provider's in percent."""
    base = df.filter(F.col("provider") == baseline).select("case_id", *(F.col(m).alias(f"_{m}") for m in metrics))
    out = df.join(base, "case_id", "left")
    return out.select(*df.columns, *(V.pct_delta(F.col(m), F.col(f"_{m}")).alias(f"{m}_pct") for m in metrics))


def coverage_by_tokens(files: DataFrame, outputs: DataFrame) -> DataFrame:
    """files(case_id, path) with found: whether two of the words of four letters or more of the name, or all if fewer, are in the case's output.

    outputs(case_id, text). The words of each output are a set, so that words of names are looked up by equality.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: F.length(w) >= 4))
    names = files.select("case_id", "path", words(F.regexp_replace(X.file_name("path"), r"\.[^.]*$", "")).alias("tokens"))
    there = outputs.select("case_id", F.explode(words(F.col("text"))).alias("token")).distinct()
    hits = names.select("case_id", "path", F.explode("tokens").alias("token")).join(there, ["case_id", "token"]).groupBy("case_id", "path").agg(F.count(F.lit(1)).alias("hits"))
    out = names.join(hits, ["case_id", "path"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.select("case_id", "path", F.size("tokens").alias("tokens"), F.col("hits").cast("int").alias("hits"), (F.col("hits") >= F.least(F.lit(2), F.size("tokens"))).alias("found"))


def name_words(c) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\d]+"), lambda w: F.length(w) > 3))


def names_agree(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with shared: the words longer than three letters that both names have, and whether there are any."""
    shared = F.array_join(F.array_sort(F.array_intersect(name_words(F.col(a)), name_words(F.col(b)))), " ")
    return df.withColumn("shared", shared).withColumn("agree", F.col("shared") != "")


def fill_template(cells: DataFrame, values: DataFrame) -> DataFrame:
    """cells(case_id, cell_id, template) with every {{key}}, in either case, replaced by the value of values(case_id, key, value); unfilled lists the keys without one."""
    keys = F.array_distinct(F.regexp_extract_all("template", F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1)))
    each = cells.select("case_id", "cell_id", "template", F.explode_outer(keys).alias("key"))
    known = values.select("case_id", F.lower("key").alias("low"), "value").groupBy("case_id", "low").agg(F.min("value").alias("value"))
    each = each.withColumn("low", F.lower("key")).join(known, ["case_id", "low"], "left")
    pairs = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("key", "value"))))
    none = F.sort_array(F.collect_list(F.when(F.col("key").isNotNull() & F.col("value").isNull(), F.col("key"))))
    out = each.groupBy("case_id", "cell_id", "template").agg(pairs.alias("pairs"), none.alias("none"))
    filled = F.aggregate("pairs", F.col("template"), lambda a, x: F.replace(a, F.concat(F.lit("{{"), x["key"], F.lit("}}")), x["value"]))
    return out.select("case_id", "cell_id", filled.alias("filled"), F.array_join("none", ",").alias("unfilled"))


def match_requirements(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows(row_id, cell) with the requirement of items(requirement) whose id is in the cell, the longest, then the first.

    Ids are runs of letters, digits, points and underscores, so that they join by equality with those of the cell.
    """
    ids = F.array_distinct(F.regexp_extract_all("cell", F.lit(r"([A-Za-z0-9_.]+)"), F.lit(1)))
    each = rows.select("row_id", F.explode(ids).alias("requirement")).join(items.select("requirement").distinct(), "requirement")
    return each.groupBy("row_id").agg(F.min(F.struct((-F.length("requirement")).alias("n"), "requirement")).alias("best")).select("row_id", "best.requirement")


def accept_recovered(old: DataFrame, new: DataFrame, least: int = 50, key: list[str] = ["case_id", "clause_key"]) -> DataFrame:  # noqa: B006
    """Clauses with the new text where it has enough words; still_missing tells those that stay empty or absent."""
    out = old.join(new.select(*key, F.col("text").alias("_new")), key, "full")
    good = X.word_count("_new") >= least
    text = F.when(good, F.col("_new")).otherwise(F.col("text"))
    return out.select(*key, text.alias("text"), F.coalesce(good, F.lit(False)).alias("accepted"), (F.trim(F.coalesce(text, F.lit(""))) == "").alias("still_missing"))


def placeholders(lost: DataFrame) -> DataFrame:
    """Evidence rows that stand for lost documents."""
    return lost.select("case_id", "path", F.lit("18").alias("section_id"), F.lit("NON ELABORATO").alias("tipo"), F.concat(F.lit("Documento non elaborato: "), X.file_name("path")).alias("titolo"))


def unprocessed(inputs: DataFrame, kept: DataFrame, skipped: DataFrame, failures: DataFrame) -> DataFrame:
    """Files of inputs(case_id, path) that are neither kept nor skipped, with phase and reason of failures(case_id, path, phase, reason) or unknown."""
    key = ["case_id", "path"]
    left = inputs.select(*key).join(kept.select(*key), key, "left_anti").join(skipped.select(*key), key, "left_anti")
    why = failures.groupBy(*key).agg(F.min(F.struct("phase", "reason")).alias("why"))
    return left.join(why, key, "left").select(*key, F.coalesce("why.phase", F.lit("unknown")).alias("phase"), F.coalesce("why.reason", F.lit("unknown")).alias("reason"))


def compare_runs(runs: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """Means of each metric of two providers for a case, one row each, with the difference in percent."""
    means = runs.filter(F.col("provider").isin(a, b)).groupBy("case_id", "provider").agg(*(F.avg(m).alias(m) for m in metrics))
    tall = means.unpivot(["case_id", "provider"], metrics, "metric", "value").groupBy("case_id", "metric")
    both = tall.agg(F.max(F.when(F.col("provider") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("provider") == b, F.col("value"))).alias("b"))
    return both.select("case_id", "metric", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), V.pct_delta(F.col("a"), F.col("b")).alias("delta_pct"))


def text_names(paragraphs: DataFrame) -> DataFrame:
    """Of paragraphs(case_id, numero, sottotitolo, contenuto), the company that those of a case name most often; of equals the one named first."""
    each = paragraphs.select("case_id", "numero", F.posexplode(X.names_in_text("sottotitolo", "contenuto")).alias("at", "name"))
    counts = each.groupBy("case_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("numero", "at")).alias("first"))
    best = counts.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "name")).alias("best"))
    return best.select("case_id", F.col("best.name").alias("by_text"))


def resolve_case_name(cases: DataFrame, paragraphs: DataFrame | None = None) -> DataFrame:
    """cases(case_id, archive, registry_text, voted) with name and how it was found.

    The registry's name wins where the archive's has none of its own or shares a word of more than three letters with it;
    else the archive's, unless it is shorter than five characters; then the voted one, the one that the case's paragraphs
    name most often, or none. A case without a row in paragraphs has no name from texts.
    """
    if paragraphs is None:
        cases = cases.withColumn("by_text", F.lit(None).cast("string"))
    else:
        cases = cases.join(text_names(paragraphs), "case_id", "left")
    found = cases.select("*", X.name_from_registry("registry_text").alias("registry"), X.name_from_archive("archive").alias("by_archive"))
    registry, archive = F.col("registry"), F.col("by_archive")
    bare = lambda c: F.split(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\w\s]", ""), r"\s+")
    agree = F.size(F.filter(F.array_intersect(bare(registry), bare(archive)), lambda w: F.length(w) > 3)) > 0
    voted = F.nullif(X.valid_company("voted"), F.lit(""))
    trusted = registry.isNotNull() & (agree | archive.isNull() | (F.length(archive) < 5))
    how = F.when(registry.isNotNull() & agree, "registry_and_archive").when(trusted, "registry").when(archive.isNotNull(), "archive").when(voted.isNotNull(), "vote").when(F.col("by_text").isNotNull(), "text").otherwise("none")
    name = F.coalesce(F.when(trusted, registry), archive, voted, F.col("by_text"), F.lit("Azienda non identificata"))
    return found.select("case_id", name.alias("name"), how.alias("how"))


def latest_ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")
