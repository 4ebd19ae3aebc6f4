"""Batches of documents for a scorer, and what becomes of those that fail."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import catalog as C
from paperloom.functions import text as X
from paperloom.operators.joins import merge_rescored
from paperloom.operators.shared import numbered, stored

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def first_fit_runs(lengths: list[int], counts: list[int], max_files: int, max_chars: int) -> list[tuple[int, int, int, int, int]]:
    """First fit of documents of falling lengths: (length, first, last + 1, batch, each).

    The documents of a length from the first to the last go to batches from batch on, each of them a batch. Batches in
    one state lie in runs, so that the work grows with the distinct lengths and not with the documents: those of a
    length fill run after run that has room for one, batch by batch, and then open batches of their own.
    """
    start, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    files, room = np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, opened = [], 0
    for length, count in zip(lengths, counts, strict=True):
        placed = 0
        cuts = []
        for i in np.flatnonzero((files < max_files) & (room >= length)):
            if placed == count:
                break
            each = int(max_files - files[i]) if length == 0 else min(int(max_files - files[i]), int(room[i]) // length)
            n = min(count - placed, each * int(size[i]))
            out.append((length, placed, placed + n, int(start[i]), each))
            placed += n
            full, part = divmod(n, each)
            if full < size[i]:
                # The run's batches that are full, the one that is partly so, and those left as they were.
                cuts.append((i, full, part, each))
            else:
                files[i] += each
                room[i] -= each * length
        for i, full, part, each in cuts:
            pieces = [(n, f, r) for n, f, r in ((full, files[i] + each, room[i] - each * length), (int(part > 0), files[i] + part, room[i] - part * length), (size[i] - full - (part > 0), files[i], room[i])) if n > 0]
            starts = start[i] + np.cumsum([0, *(n for n, _, _ in pieces[:-1])])
            replaced = [np.array([p[k] for p in pieces], np.int64) for k in range(3)]
            start, size, files, room = (np.concatenate((x[:i], y, x[i + 1 :])) for x, y in ((start, starts), (size, replaced[0]), (files, replaced[1]), (room, replaced[2])))
        left = count - placed
        if left:
            each = max_files if length == 0 else max(1, min(max_files, max_chars // length))
            out.append((length, placed, count, opened, each))
            full, part = divmod(left, each)
            for n, f in ((full, each), (int(part > 0), part)):
                if n:
                    start, size = np.append(start, opened), np.append(size, n)
                    files, room = np.append(files, f), np.append(room, max_chars - f * length)
                    opened += n
    return out


def ffd_batches(docs: DataFrame, max_files: int = 4, max_chars: int = 50_000) -> DataFrame:
    """docs(case_id, path, n_chars) with batch_id: first fit decreasing within each case.

    Longest first, of equals by path, each document goes to the first batch that has room for it; one that is longer
    than a batch gets its own. A case is packed from how many documents of each length it has, at most max_chars + 2
    lengths, since those longer than a batch count as one; its documents, numbered by length over ranges, then look up
    their batch. So a case of any size is packed exactly, and no task holds its documents. A null length is none.
    """
    too_long = max_chars + 1
    slim = docs.select("case_id", "path", F.coalesce(F.col("n_chars").cast("long"), F.lit(0)).alias("n_chars"))
    slim = slim.withColumn("_length", F.least(F.col("n_chars"), F.lit(too_long)))
    ranked = stored(numbered(slim, ["case_id", "_length"], [F.desc("n_chars"), F.col("path")], "_n", 0), "ranked")
    kind = docs.schema["case_id"].dataType.simpleString()

    def pack(case: pd.DataFrame) -> pd.DataFrame:
        case = case.sort_values("_length", ascending=False)
        runs = first_fit_runs(case["_length"].tolist(), case["_count"].tolist(), max_files, max_chars)
        return pd.DataFrame(runs, columns=["_of", "_first", "_last", "_batch", "_each"]).assign(_case=case["case_id"].iloc[0])[["_case", "_of", "_first", "_last", "_batch", "_each"]]

    counts = ranked.groupBy("case_id", "_length").agg(F.count(F.lit(1)).alias("_count"))
    runs = stored(counts.groupBy("case_id").applyInPandas(pack, f"_case {kind}, _of long, _first long, _last long, _batch long, _each long"), "batches")
    same = F.col("case_id").eqNullSafe(F.col("_case")) & (F.col("_length") == F.col("_of")) & (F.col("_n") >= F.col("_first")) & (F.col("_n") < F.col("_last"))
    batch = (F.col("_batch") + F.floor((F.col("_n") - F.col("_first")) / F.col("_each"))).cast("int")
    return ranked.join(runs, same).select("case_id", "path", "n_chars", batch.alias("batch_id"))


def profiles(df: DataFrame) -> DataFrame:
    """Limits of batches by provider."""
    return df.sparkSession.createDataFrame(C.PROFILES, "provider string, model string, max_files int, max_chars int, cap_multiplier double, workers int")


def keyword_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A deterministic scorer of (case_id, path, filename, text): the first class whose name is in the file's name or text."""
    names = [c for c, *_ in C.CLASSES if c != "ALTRO"]
    for b in batches:
        low = (b["filename"].fillna("") + " " + b["text"].fillna("")).str.upper()
        classe = pd.Series("ALTRO", index=b.index)
        confidence = pd.Series(0.5, index=b.index)
        for name in reversed(names):
            hit = low.str.contains(name.replace("_", " "), regex=False) | low.str.contains(name, regex=False)
            classe[hit], confidence[hit] = name, 0.9
        yield b[["case_id", "path"]].assign(classe=classe, confidence=confidence)


_SCORED = "case_id string, path string, classe string, confidence double"


def cascade(files: DataFrame, cheap: Scorer = keyword_scorer, strong: Scorer = keyword_scorer, threshold: float = 0.6, partitions: int | None = None) -> DataFrame:
    """files(case_id, path, filename, text) classified by a cheap scorer, again by a strong one below the threshold.

    Files with too little name and text skip both. partitions bounds how many tasks call a scorer at once.
    """
    least = F.length(X.snippet("text", 500)) + F.length(X.snippet("filename")) < 50
    keyed = files.select(F.col("case_id").cast("string").alias("case_id"), "path", "filename", "text")
    low = keyed.filter(least).select("case_id", "path", F.lit("ALTRO").alias("classe"), F.lit(0.3).alias("confidence"))
    asked = keyed.filter(~least)
    asked = asked if partitions is None else asked.repartition(partitions)
    # Scored once each: a scorer may cost much, and need not say the same twice.
    stage1 = stored(asked.mapInPandas(cheap, _SCORED), "scored")
    doubt = asked.join(stage1.filter(F.col("confidence") < threshold).select("case_id", "path"), ["case_id", "path"], "left_semi")
    merged = merge_rescored(stage1, stored(doubt.mapInPandas(strong, _SCORED), "rescored"))
    return merged.unionByName(low.withColumn("rescored", F.lit(False)))


def recover(batches: DataFrame, scorer: Scorer, schema: str, key: list[str] = ["case_id", "batch_id"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Results of batches(case_id, batch_id, path, text), and the documents that give none.

    A batch without a result is scored again as a whole, then document by document (as batches of one). The scorer
    maps rows to (case_id, batch_id, path, output) rows of what it could do.
    """
    # Each round is stored: it is scored once, and what it lost is fixed.
    first = stored(batches.mapInPandas(scorer, schema), "first")
    lost = batches.join(first.select(*key).distinct(), key, "left_anti")
    again = stored(lost.mapInPandas(scorer, schema), "again")
    still = lost.join(again.select(*key).distinct(), key, "left_anti")
    single = numbered(still, key, ["path"], "_n").withColumn("batch_id", F.col("batch_id") * 1_000_000 + F.col("_n")).drop("_n")
    alone = stored(single.mapInPandas(scorer, schema), "alone")
    failed = single.join(alone.select(*key, "path"), [*key, "path"], "left_anti")
    return first.unionByName(again).unionByName(alone), failed.select("case_id", "path")


def with_fallback(primary: DataFrame, secondary: DataFrame, key: list[str] = ["case_id", "batch_id"]) -> DataFrame:  # noqa: B006
    """primary(key, status, output) with the secondary's output where the primary failed or was cut and the secondary has more."""
    other = secondary.select(*key, F.col("status").alias("_status"), F.col("output").alias("_output"))
    out = primary.join(other, key, "left")
    better = (F.col("status") != "ok") & F.col("_output").isNotNull() & ((F.col("_status") == "ok") | (F.length("_output") > F.length(F.coalesce("output", F.lit("")))))
    better = F.coalesce(better, F.lit(False))
    return out.select(*key, F.when(better, F.col("_status")).otherwise(F.col("status")).alias("status"), F.when(better, F.col("_output")).otherwise(F.col("output")).alias("output"), better.alias("fell_back"))
