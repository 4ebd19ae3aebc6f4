"""Aggregations: summaries of files, calls, runs, errors, clauses and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.functions import values as V
from paperloom.operators.shared import checked, numbered


def _share(part: Column, of: Column, digits: int = 1) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return F.when(of > 0, F.round(100.0 * part / of, digits)).otherwise(F.lit(0.0))


def triage_summary(triaged: DataFrame) -> DataFrame:
    """Files by bucket, their total and the share of native text."""
    n = F.count(F.lit(1))
    native = F.count_if(F.col("bucket") == "native_text")
    buckets = [F.count_if(F.col("bucket") == b).alias(b) for b in ("native_text", "needs_ocr", "unrecoverable", "non_pdf")]
    return triaged.agg(*buckets, n.alias("total"), _share(native, n).alias("native_pct"))


def extract_summary(files: DataFrame) -> DataFrame:
    """Files and size by category."""
    each = files.groupBy(X.categorize("path").alias("category"))
    return each.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.round(F.sum("size") / (1024 * 1024), 2).alias("mb"))


def classifier_summary(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """df(classe, role, confidence) by class, by role and in total, in one pass over grouping sets."""
    low = F.count_if(F.round("confidence", 6) < threshold)
    noise = F.count_if(F.coalesce("role", F.lit("SUPPORT")) == "NOISE")
    n = F.count(F.lit(1))
    named = df.withColumn("role", F.coalesce("role", F.lit("SUPPORT")))
    each = named.groupingSets([["classe"], ["role"], []], "classe", "role").agg(F.grouping_id().cast("int").alias("level"), n.alias("n"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), _share(low, n).alias("low_confidence_pct"), _share(noise, n).alias("noise_pct"))
    return each


def ocr_summary(df: DataFrame) -> DataFrame:
    """df(ok, chars, pages): how many succeeded, with characters and pages of those."""
    n, ok = F.count(F.lit(1)), F.count_if("ok")
    chars = F.coalesce(F.sum(F.when(F.col("ok"), F.col("chars"))), F.lit(0))
    return df.agg(n.alias("files"), ok.alias("ok"), _share(ok, n).alias("ok_pct"), chars.alias("chars"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("pages"))), F.lit(0)).alias("pages"), F.when(ok > 0, F.round(chars / ok, 1)).otherwise(0.0).alias("avg_chars"))


def section_summary(df: DataFrame) -> DataFrame:
    """df(case_id, section_id, ok, error): sections built, and the failed ones with their errors in order."""
    failed = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.concat_ws(": ", "section_id", F.coalesce("error", F.lit(""))))))
    return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("sections"), F.count_if("ok").alias("built"), F.array_join(failed, "; ").alias("errors"))


def manifest_summary(df: DataFrame) -> DataFrame:
    """Files and bytes of a manifest by case."""
    return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def user_stats(cases: DataFrame, as_of: str) -> DataFrame:
    """Cases of each user: all, by type, of the day and of the last seven days."""
    today = F.to_date("data_creazione") == F.lit(as_of).cast("date")
    week = F.col("data_creazione") >= F.date_sub(F.lit(as_of).cast("date"), 7)
    kinds = [F.count_if(F.col("tipo") == k).alias(k) for k in ("report", "checklist_json", "checklist_word")]
    return cases.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), *kinds, F.count_if(today).alias("today"), F.count_if(week).alias("week"))


def global_stats(cases: DataFrame, as_of: str) -> DataFrame:
    """Cases in total, by user and by norm, in one pass over grouping sets; the mean time leaves zeros out."""
    today = F.count_if(F.to_date("data_creazione") == F.lit(as_of).cast("date"))
    mean = F.round(F.coalesce(F.avg(F.when(F.col("processing_time_seconds") > 0, F.col("processing_time_seconds"))), F.lit(0.0)), 1)
    each = cases.groupingSets([["user_id"], ["norma"], []], "user_id", "norma")
    return each.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("total"), today.alias("today"), mean.alias("mean_seconds"))


def error_dashboard(errors: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Partial errors of the last days by subtype, by day and subtype, and in total, with those recovered."""
    recent = errors.filter((F.col("error_type") == "partial_error") & (F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days")))
    n, recovered = F.count(F.lit(1)), F.count_if("auto_recovered")
    each = recent.select(F.to_date("created_at").alias("day"), "error_subtype", "auto_recovered").groupingSets([["error_subtype"], ["day", "error_subtype"], []], "day", "error_subtype")
    return each.agg(F.grouping_id().cast("int").alias("level"), n.alias("n"), recovered.alias("recovered"), _share(recovered, n).alias("recovery_rate"))


def error_stats(errors: DataFrame, as_of: str) -> DataFrame:
    """A10: errors of the last day and week and unresolved ones, in total and by type."""
    since = lambda days: F.count_if(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {days} days"))
    return errors.rollup("error_type").agg(F.grouping_id().cast("int").alias("level"), since(1).alias("last_24h"), since(7).alias("last_7d"), F.count_if(~F.col("resolved")).alias("unresolved"))


def usage_report(costed: DataFrame, fx: float = C.USD_TO_EUR) -> DataFrame:
    """Calls with costs (see with_cost) in total, by model and by kind."""
    each = costed.groupingSets([["model"], ["kind"], []], "model", "kind")
    total = lambda c: F.sum(c)
    saved = F.greatest(F.lit(0.0), F.sum("cost_nocache") - F.sum("cost_usd"))
    return each.agg(
        F.grouping_id().cast("int").alias("level"),
        F.count(F.lit(1)).alias("calls"),
        total("input_tokens").alias("input_tokens"),
        total("cached_tokens").alias("cached_tokens"),
        total("output_tokens").alias("output_tokens"),
        F.round(total("cost_usd"), 5).alias("cost_usd"),
        F.round(total("cost_usd") * fx, 5).alias("cost_eur"),
        F.round(saved, 5).alias("saved_usd"),
        total("retry_count").alias("retries"),
        F.count("error").alias("errors"),
    )


def usage_table(calls: DataFrame) -> DataFrame:
    """Calls by model and kind, with subtotals."""
    return calls.rollup("model", "kind").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("duration_seconds"), 3).alias("seconds"))


def error_sample(calls: DataFrame, order: list, n: int = 20) -> DataFrame:
    """The first n failing calls."""
    return calls.filter("error is not null").orderBy(*order).limit(n)


def phase_stats(runs: DataFrame) -> DataFrame:
    """runs(phase, duration) by phase; nulls and zeros are left out."""
    return runs.filter("duration > 0").groupBy("phase").agg(F.round(F.min("duration"), 3).alias("min"), F.round(F.max("duration"), 3).alias("max"), F.round(F.avg("duration"), 3).alias("mean"), F.count(F.lit(1)).alias("n"))


def stats_by_norm(cases: DataFrame) -> DataFrame:
    """Cases and mean time by norm; a null time counts as 0."""
    return cases.groupBy("norma").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce("processing_time_seconds", F.lit(0.0))), 3).alias("mean_seconds"))


def throughput(runs: DataFrame) -> DataFrame:
    """runs(key, seconds, mb, files): means of each run's seconds for a MB and a file; keys of one run are left out."""
    ratio = lambda c: F.avg(F.when(F.col(c) > 0, F.col("seconds") / F.col(c)))
    return runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.round(ratio("mb"), 4).alias("s_per_mb"), F.round(ratio("files"), 4).alias("s_per_file")).filter("n >= 2")


def run_report(runs: DataFrame) -> DataFrame:
    """runs(provider, case_id, duration_seconds, n_truncated) by provider, and by provider and case."""
    return runs.rollup("provider", "case_id").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_seconds"), 3).alias("mean_seconds"), F.sum("n_truncated").alias("truncated")).filter("level < 3")


def clause_stats(clauses: DataFrame) -> DataFrame:
    """Clauses of each case: filled and empty ones, words and characters."""
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    n = F.count(F.lit(1))
    return clauses.groupBy("case_id").agg(n.alias("clauses"), F.count_if(filled).alias("filled"), F.count_if(~filled).alias("empty"), F.sum(X.word_count("text")).cast("long").alias("words"), F.sum(F.length("text")).cast("long").alias("chars"), _share(F.count_if(filled), n).alias("fill_pct"))


def validate_checklist(clauses: DataFrame) -> DataFrame:
    """Checklists by case and norm: empty and short clauses, the issues they make, and whether there is none."""
    words = X.word_count("text")
    empty, short = F.count_if(words == 0), F.count_if((words > 0) & (words < 50))
    issues = F.concat_ws("; ", F.when(empty > 0, F.concat(empty.cast("string"), F.lit(" empty"))), F.when(short > 0, F.concat(short.cast("string"), F.lit(" short"))))
    return clauses.groupBy("case_id", "norm").agg(empty.alias("empty"), short.alias("short"), issues.alias("issues"), ((empty + short) == 0).alias("valid"))


def conformity(c: str) -> Column:
    """What an answer says, the negative first."""
    up = F.upper(F.coalesce(F.col(c), F.lit("")))
    return F.when(up.contains("NON CONFORME"), "non_conforme").when(up.contains("OSSERVAZION"), "osservazione").when(up.contains("CONFORME"), "conforme")


def conformity_summary(items: DataFrame) -> DataFrame:
    """items(case_id, conformita) counted by what they say."""
    kinds = items.select("case_id", conformity("conformita").alias("kind"))
    return kinds.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("conforme", "osservazione", "non_conforme")))


def clause_matrix(clauses: DataFrame) -> DataFrame:
    """Clauses by status, complete from 150 words on, warning from 100, and the share of complete ones."""
    words, n = X.word_count("text"), F.count(F.lit(1))
    complete = F.count_if(words >= 150)
    return clauses.groupBy("norm").agg(n.alias("clauses"), complete.alias("complete"), F.count_if((words >= 100) & (words < 150)).alias("warning"), F.count_if((words > 0) & (words < 100)).alias("short"), F.count_if(words == 0).alias("empty"), _share(complete, n).alias("complete_pct"))


def paragraph_quality(paragraphs: DataFrame, verbs: list[str]) -> DataFrame:
    """Paragraphs of each case: words, and how many of the verbs open one (in its first 100 characters)."""
    words, head = X.word_count("contenuto"), F.lower(F.substring("contenuto", 1, 100))
    used = [F.max(head.contains(v.lower()).cast("int")) for v in verbs]
    return paragraphs.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(words), 2).alias("mean_words"), F.min(words).alias("min_words"), F.max(words).alias("max_words"), sum(used[1:], used[0]).alias("verbs"))


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """Sections and documents of each case."""
    return evidence.groupBy("case_id").agg(F.count_distinct("categoria").alias("sections"), F.count(F.lit(1)).alias("documents"))


def majority_name(candidates: DataFrame) -> DataFrame:
    """The name that most batches of a case give, of equals the first by name."""
    counts = candidates.groupBy("case_id", "nome").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("case_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "nome")).alias("best")).select("case_id", "best.nome", (-F.col("best.n")).alias("votes"))


def resolve_company(candidates: DataFrame, mode: str = "sum") -> DataFrame:
    """candidates(case_id, batch_idx, nome, tipo): the company of each case.

    Scores of all spellings of a name are summed; the highest sum wins, then the most candidates, then the key. Of its
    spellings the one of highest score is shown, then the longest, then the first by name. mode single (A26): the one
    candidate of highest score wins, of equals the earliest batch.
    """
    scored = candidates.withColumn("nome", X.valid_company("nome")).filter("nome <> ''").withColumn("score", X.source_score("tipo"))
    if mode == "single":
        best = scored.groupBy("case_id").agg(F.min(F.struct((-F.col("score")).alias("score"), "batch_idx", "nome")).alias("best"))
        return best.select("case_id", "best.nome", (-F.col("best.score")).alias("score"))
    keyed = scored.withColumn("key", X.company_key("nome")).filter("key <> ''")
    shown = F.min(F.struct((-F.col("score")).alias("s"), (-F.length("nome")).alias("l"), "nome")).alias("shown")
    groups = keyed.groupBy("case_id", "key").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n"), shown)
    best = groups.groupBy("case_id").agg(F.min(F.struct((-F.col("score")).alias("score"), (-F.col("n")).alias("n"), "key", F.col("shown.nome").alias("nome"))).alias("best"))
    return best.select("case_id", "best.nome", "best.key", (-F.col("best.score")).alias("score"), (-F.col("best.n")).alias("n"))


def case_meta_facts(evidence: DataFrame) -> DataFrame:
    """Documents of each case, their dates, and how many have no text."""
    date = X.it_date("data_doc")
    return evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("documents"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"))


def run_rollup(events: DataFrame) -> DataFrame:
    """Each session from its events: first start, end and error, and OK, ERROR or INCOMPLETE."""
    first = lambda t: F.min(F.when(F.col("type") == t, F.col("ts")))
    status = F.when(first("done").isNotNull(), "OK").when(first("error").isNotNull(), "ERROR").otherwise("INCOMPLETE")
    return events.groupBy("session_id").agg(first("session.start").alias("started"), first("done").alias("ended"), first("error").alias("failed"), F.count(F.lit(1)).alias("events"), status.alias("status"))


def session_summary(log: DataFrame) -> DataFrame:
    """Counts of each type of event by session."""
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("type") == t).alias(t.replace(".", "_")) for t in C.EVENT_TYPES))


def pattern_hits(texts: DataFrame, patterns: list[tuple[str, str]], by: str = "case_id") -> DataFrame:
    """How often each pattern occurs, by case, and in how many texts; one row for each pattern."""
    hits = F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("hits")) for n, p in patterns))).alias("x")
    each = texts.select(by, hits).select(by, "x.*")
    return each.groupBy(by, "pattern").agg(F.sum("hits").cast("long").alias("hits"), F.count_if(F.col("hits") > 0).alias("texts"))


def output_profile(evidence: DataFrame) -> DataFrame:
    """Words, characters, distinct types and headings of the output of each case."""
    return evidence.groupBy("case_id").agg(F.sum(X.word_count("text")).cast("long").alias("words"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_distinct("tipo").alias("types"), F.sum(F.regexp_count("text", F.lit("(?m)^#+ "))).cast("long").alias("headings"))


def provider_pivot(runs: DataFrame, metric: str, cases: list[int]) -> DataFrame:
    """The mean metric of each provider and case, a column for each of the cases, with their mean and all truncations."""
    wide = runs.filter(F.col("case_id").isin(cases)).groupBy("provider").pivot("case_id", cases).agg(F.round(F.avg(metric), 3))
    mean = runs.groupBy("provider").agg(F.round(F.avg(metric), 3).alias("mean"), F.sum("n_truncated").alias("truncated"))
    return wide.join(mean, "provider").select("provider", *(F.col(f"`{c}`").alias(f"case_{c}") for c in cases), "mean", "truncated")


def case_metric_table(runs: DataFrame, metrics: list[str], providers: list[str]) -> DataFrame:
    """Of each case a row for each metric and a column for each provider."""
    means = runs.groupBy("case_id", "provider").agg(*(F.round(F.avg(m), 3).alias(m) for m in metrics))
    tall = means.unpivot(["case_id", "provider"], metrics, "metric", "value")
    wide = tall.groupBy("case_id", "metric").pivot("provider", providers).agg(F.first("value"))
    return wide.select("case_id", "metric", *(F.col(f"`{p}`").alias(f"p_{i}") for i, p in enumerate(providers)))


def validate_jsonl(rows: DataFrame) -> DataFrame:
    """rows(kind, content, number, corrupt) of a report file by kind: invalid lines, and those without content or number."""
    kind = F.when(F.col("corrupt").isNotNull(), "invalid").otherwise(F.coalesce("kind", F.lit("unknown")))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) == "").alias("no_content"), F.count_if(F.col("number").isNull()).alias("no_number"))


def dashboard(cases: DataFrame, as_of: str) -> DataFrame:
    """Cases by type and of the day."""
    kinds = [F.count_if(F.col("tipo") == k).alias(k) for k in ("report", "checklist_json", "checklist_word")]
    return cases.agg(F.count(F.lit(1)).alias("total"), *kinds, F.count_if(F.to_date("data_creazione") == F.lit(as_of).cast("date")).alias("today"))


def admin_panel(cases: DataFrame) -> DataFrame:
    """Mean time and share of cases that took any; admin_users has the panel's list."""
    worked = F.col("processing_time_seconds") > 0
    return cases.agg(F.round(F.avg(F.when(worked, F.col("processing_time_seconds"))), 2).alias("mean_seconds"), _share(F.count_if(worked), F.count(F.lit(1))).alias("success_pct"))


def admin_users(cases: DataFrame, k: int = 8) -> DataFrame:
    """The k users of most cases, of equals the first by user, with the share of all cases."""
    total = cases.count()
    top = cases.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(k)
    return top.withColumn("share_pct", _share(F.col("n"), F.lit(total)))


def unprocessed_report(df: DataFrame) -> DataFrame:
    """Unprocessed files, a row each, numbered by name within phase and reason, with how many those have (n)."""
    rows = numbered(df.select("phase", "reason", "path"), ["phase", "reason"], ["path"], "no")
    counts = checked(df.groupBy("phase", "reason").agg(F.count(F.lit(1)).alias("n")))
    same = rows.phase.eqNullSafe(counts.phase) & rows.reason.eqNullSafe(counts.reason)
    return rows.join(counts, same).select(rows.phase, rows.reason, "no", "path", "n")


def role_audit(df: DataFrame) -> DataFrame:
    """Files by role, and those of NOISE without enough confidence."""
    role = F.coalesce("role", F.lit("SUPPORT"))
    low = (role == "NOISE") & (F.coalesce(F.round("role_conf", 6), F.lit(0.0)) < 0.9)
    return df.groupBy(role.alias("role")).agg(F.count(F.lit(1)).alias("n"), F.count_if(low).alias("low_confidence_noise"))


def phase_durations(events: DataFrame) -> DataFrame:
    """Seconds from the first start to the last end of each phase of a session."""
    start, end = F.min(F.when(F.col("type") == "phase.start", F.col("ts"))), F.max(F.when(F.col("type") == "phase.end", F.col("ts")))
    each = events.groupBy("session_id", "phase").agg(start.alias("started"), end.alias("ended")).filter("ended >= started")
    return each.withColumn("seconds", F.round(V.seconds_between("started", "ended"), 3))


def unresolved_count(errors: DataFrame) -> DataFrame:
    """A42."""
    return errors.agg(F.count_if(~F.col("resolved")).alias("unresolved"))
