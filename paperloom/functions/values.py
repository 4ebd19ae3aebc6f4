"""Functions on numbers, dates, maps and JSON as columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X


def seconds_between(start: str, end: str) -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6


def age_days(c: str, as_of: str) -> Column:
    """H28."""
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(c))


def yyyy_mm(c: str) -> Column:
    """H28."""
    return F.date_format(c, "yyyy-MM")


def clean_call(calls: DataFrame) -> DataFrame:
    """Calls with no negative numbers, no more cached than input tokens, known kinds, short errors and plain model names."""
    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0)))
    return (
        calls.withColumn("model", X.model_name("model"))
        .withColumn("kind", F.when(F.col("kind").isin(C.CALL_KINDS), F.col("kind")).otherwise("other"))
        .withColumn("input_tokens", count("input_tokens"))
        .withColumn("cached_tokens", F.least(count("cached_tokens"), F.col("input_tokens")))
        .withColumn("output_tokens", count("output_tokens"))
        .withColumn("duration_seconds", F.round(F.greatest(F.lit(0.0), F.coalesce("duration_seconds", F.lit(0.0))), 3))
        .withColumn("retry_count", count("retry_count"))
        .withColumn("error", F.nullif(F.substring("error", 1, 200), F.lit("")))
    )


def call_cost(cached: bool = True) -> Column:
    """USD of a call with prices for a million tokens; cached tokens are part of the input, and free where they have no price."""
    million = lambda tokens, price: tokens * F.coalesce(price, F.lit(0.0)) / 1_000_000
    if not cached:
        return million(F.col("input_tokens"), F.col("input")) + million(F.col("output_tokens"), F.col("output"))
    fresh = F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens"))
    return million(fresh, F.col("input")) + million(F.col("output_tokens"), F.col("output")) + million(F.col("cached_tokens"), F.col("cached_input"))


def pct(a: Column, b: Column, digits: int = 1) -> Column:
    """A as a percentage of b, 0 where b is 0 or null."""
    return F.when(b != 0, F.round(100.0 * a / b, digits)).otherwise(F.lit(0.0))


def pct_delta(a: Column, b: Column, digits: int = 1) -> Column:
    """How much a is more than b, in percent; null where b is 0 or null."""
    return F.when(b != 0, F.round(100.0 * (a - b) / b, digits))


def backoff(attempt: Column, base: float = 2.0, cap: float = 60.0) -> Column:
    """Seconds to wait before an attempt, without jitter."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), attempt))


def value_to_text(c: Column, cap: int = 5000) -> Column:
    """A map of strings as "k: v | k: v" in the order of its keys, n.d. for none, cut at cap."""
    pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None"))))
    out = F.when(c.isNull() | (F.size(c) == 0), "n.d.").otherwise(X.xml_safe(F.array_join(pairs, " | ")))
    return F.when(F.length(out) > cap, F.concat(F.substring(out, 1, cap), F.lit("…"))).otherwise(out)


def list_to_text(c: Column, cap: int = 5000) -> Column:
    """An array of strings."""
    out = F.when(c.isNull() | (F.size(c) == 0), "n.d.").otherwise(X.xml_safe(F.array_join(c, " | ", "None")))
    return F.when(F.length(out) > cap, F.concat(F.substring(out, 1, cap), F.lit("…"))).otherwise(out)


#: Fields of an evidence card's head.
CARD_FIELDS = "tipo titolo categoria riferimento data_doc emesso_da soggetto scadenza stato note pagine lingua".split()


def split_card(card: Column) -> tuple[Column, Column]:
    """The head fields of a card and its free clusters, of a map of strings."""
    return F.map_filter(card, lambda k, _: k.isin(CARD_FIELDS)), F.map_filter(card, lambda k, _: ~k.isin(CARD_FIELDS))


def flat_doc(card: Column) -> Column:
    """The card of a text that is one document: no sections, but a type or title; else null."""
    said = lambda k: F.trim(F.coalesce(F.try_element_at(card, F.lit(k)), F.lit(""))) != ""
    return F.when(~F.map_contains_key(card, "sezioni") & (said("tipo") | said("titolo")), F.map_filter(card, lambda k, _: ~k.isin("meta", "sezioni")))


def scrub(c: Column, drop: list[str]) -> Column:
    """A map of strings without the keys to drop, personal identifiers redacted in all values."""
    return F.transform_values(F.map_filter(c, lambda k, _: ~F.lower(k).isin(drop)), lambda _, v: X.redact(v))


def scrub_json(c: Column, drop: list[str]) -> Column:
    """JSON of any depth without the keys to drop, personal identifiers redacted in all its strings; null if it is no JSON."""
    keys = {k.lower() for k in drop}

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k.lower() not in keys}
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, str):
            for p in C.PERSONAL:
                x = re.sub(p, C.PERSONAL_MARK, x)
        return x

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(clean(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def scrubbed(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return scrubbed(c)


def group_schema(clauses: Column) -> Column:
    """The answer that is expected for a group of clauses, as JSON."""
    return F.to_json(F.map_from_arrays(clauses, F.transform(clauses, lambda _: F.lit("string"))))


def batch_payload(docs: DataFrame, cap: Column) -> DataFrame:
    """docs(case_id, batch_id, pos, filename, text) as one text for each batch, each document cut at cap and headed by its name."""
    part = F.concat(F.lit("### FILE: "), "filename", F.lit("\n"), F.substring(F.col("text"), F.lit(1), cap))
    parts = F.sort_array(F.collect_list(F.struct("pos", part.alias("part"))))
    return docs.groupBy("case_id", "batch_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n\n").alias("payload"), F.count(F.lit(1)).alias("files"))
