"""Substring dedup: repeated word windows, found by doubling the length of windows that repeat."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import spent, stored

#: Words of short texts that are looked at together.
WORDS_AT_ONCE = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mixed(left * _ODD + right)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Levels:
    """The lengths of one window: base words, doubled while that fits, and at last the window itself."""

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("a window has one word at least")
        self.window, self.base = window, window
        while self.base >= 16:
            self.base = (self.base + 1) // 4
        self.double = min(2 * self.base, window)

    def hashes(self, words: np.ndarray, length: int) -> np.ndarray:
        """The hash of each run of length words, made of those of runs of half the length."""
        n = len(words) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        done, now = 1, _mixed(words)
        while done < length:
            step = min(done, length - done)
            now = _joined(now[: len(now) - step], now[step:])
            done += step
        return now[:n]

    def anchors(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
        """(at, first, last, base, before, after, context) of the words of several texts one after another; text has each word's text.

        An anchor is the base run of smallest hash, the leftmost of equal ones, of the windows that start from first
        to last. Equal windows have it at the same place, so that all copies of a window meet at its hash. before and
        after are the runs of twice the length that end and start with it, where they lie in the text, as (hashes,
        there). context tells all the words of all these windows.
        """
        n = len(words) - self.window + 1
        starts = np.nonzero(text[: max(n, 0)] == text[self.window - 1 :])[0] if n > 0 else np.zeros(0, np.int64)
        runs = self.hashes(words, self.base)
        low, at, have, wide = runs, np.arange(len(runs)), 1, self.window - self.base + 1
        while len(starts) and have < wide:
            step = min(have, wide - have)
            less = low[step:] < low[:-step]
            low, at = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step])
            have += step
        at = at[starts]
        new = np.nonzero(np.r_[True, at[1:] != at[:-1]] if len(at) else at)[0]
        at, first, last = at[new], starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1][: len(new)]]
        doubles, grow = self.hashes(words, self.double), self.double - self.base
        whole = self.hashes(words, self.window)
        sums = np.r_[np.uint64(0), np.cumsum(_mixed(whole))]
        places = ((at - first) * 4096 + (last - first)).astype(np.uint64)
        context = _joined(_joined(whole[first], whole[last]), _mixed(sums[last + 1] - sums[first]) + places)
        return at, first, last, runs[at], _inside(doubles, at - grow, at, text), _inside(doubles, at, at + self.double - 1, text), context


def _inside(hashes: np.ndarray, start: np.ndarray, other: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the runs from start, and which of them lie in one text with the word at other."""
    there = (start >= 0) & (start < len(hashes)) & (other < len(text))
    there[there] = text[start[there]] == text[other[there]]
    return np.where(there, hashes[np.where(there, start, 0)] if len(hashes) else np.uint64(0), np.uint64(0)), there


_ANCHORS = "id binary, at int, first int, last int, base long, before long, after long, context long"


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Anchors of docs(id, text): place, its windows, and hashes of the base run, its doubles to both sides, and all its windows' words.

    A double that would leave the text is null.
    """
    levels = Levels(window)

    def found(ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(x) for x in texts]
        text, began = np.repeat(np.arange(len(texts)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
        at, first, last, base, before, after, context = levels.anchors(np.concatenate(texts), text)
        own = text[at]
        places = [pa.array((x - began[own]).astype(np.int32)) for x in (at, first, last)]
        doubles = [pa.array(h.view(np.int64), mask=~there) for h, there in (before, after)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()).take(pa.array(own)), *places, pa.array(base.view(np.int64)), *doubles, pa.array(context.view(np.int64))], [x.split()[0] for x in _ANCHORS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for k, text in zip(b.column("id"), b.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                if len(words) >= window:
                    ids.append(k.as_py())
                    texts.append(_word_hashes(words))
                    size += len(words)
                if size > WORDS_AT_ONCE:
                    yield found(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield found(ids, texts)

    return docs.mapInArrow(run, _ANCHORS)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that two rows or more have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(id, first, last): runs of starts of the windows of docs(id binary, text) whose words start anywhere else too.

    Each window hangs on its anchor, the base run of smallest hash in it, and anchors are about one in fourteen
    places. The levels: anchors whose base run repeats; of these, those whose run of twice the length repeats, to the
    left or to the right, and a window goes on only if the doubles that lie in it do; then the windows. Where all
    windows of an anchor recur together (copies of a longer passage), one hash settles them; only the others are
    looked at one by one, against one example of each group that is settled.
    """
    levels = Levels(window)
    found = stored(_anchors(docs, window), "anchors")
    # Keys that repeat are tables of their own: Spark splits a hot key of a join only if both sides come by a shuffle.
    bases = stored(_repeated(found.select("base"), ["base"]), "bases")
    level1 = stored(found.join(bases, "base"), "level1")
    spent(found, bases)
    sides = level1.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("h")), F.struct(F.lit(1).alias("side"), F.col("after").alias("h")))).alias("x")).select("x.*").filter("h is not null")
    doubled = stored(_repeated(sides, ["side", "h"]), "level2")
    left = doubled.filter("side = 0").select(F.col("h").alias("before"), F.lit(True).alias("left"))
    right = doubled.filter("side = 1").select(F.col("h").alias("after"), F.lit(True).alias("right"))
    level2 = level1.join(left, "before", "left").join(right, "after", "left").filter("left or right")
    # A window that starts at s holds the double before the anchor if s <= at - grow, the one after it if s >= at + double - window.
    grow, reach = levels.double - levels.base, window - levels.double
    level2 = level2.withColumn("first", F.when(F.col("left").isNull(), F.greatest("first", F.expr(f"at - {grow} + 1"))).otherwise(F.col("first"))).withColumn("last", F.when(F.col("right").isNull(), F.least("last", F.expr(f"at - {reach} - 1"))).otherwise(F.col("last")))
    level2 = stored(level2.filter("first <= last").select("id", "at", "first", "last", "base", "context", (F.col("left") & F.col("right")).alias("full")), "doubled")
    spent(level1, doubled)
    groups = level2.groupBy("base", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at", "first", "last")).alias("example"))
    groups = stored(groups, "contexts")
    settled = level2.join(groups.filter("n > 1").select("base", "context"), ["base", "context"])
    single = groups.filter("n = 1").select("base", "example.*", F.lit(False).alias("settled"))
    open_bases = single.select("base").distinct()
    examples = groups.filter("n > 1").join(open_bases, "base", "left_semi").select("base", "example.*", F.lit(True).alias("settled"))
    asked = stored(single.union(examples).groupBy("id").agg(F.collect_list(F.struct("base", "first", "last", "settled")).alias("asked")), "asked")
    windows = stored(_windows(docs, asked, window), "windows")
    spent(asked)
    twice = stored(_repeated(windows.select("base", "h"), ["base", "h"]), "twice")
    last = windows.filter("not settled").join(twice, ["base", "h"])
    return settled.select("id", "first", "last").union(last.select("id", F.col("at").alias("first"), F.col("at").alias("last")))


def _windows(docs: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """(id, base, at, h, settled) of every window that asked(id, asked) names."""
    levels = Levels(window)
    fields = "id binary, base long, at int, h long, settled boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text, ask in zip(b.column("id"), b.column("text"), b.column("asked"), strict=True):
                whole = levels.hashes(_word_hashes((text.as_py() or "").encode().split()), window).view(np.int64)
                k, out = k.as_py(), []
                for x in ask.as_py():
                    at = np.arange(x["first"], x["last"] + 1)
                    out.append((np.full(len(at), x["base"]), at, whole[at], np.full(len(at), x["settled"])))
                base, at, h, done = map(np.concatenate, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.binary()), pa.array(base), pa.array(at.astype(np.int32)), pa.array(h), pa.array(done)], ["id", "base", "at", "h", "settled"])

    # asked grows with the documents, as gone below does, so neither is broadcast at any size. Rows that repeat doc_id
    # and text have one id; their windows are asked for once, as examples count once.
    once = docs.join(asked, "id")
    return once.select("id", "text", "asked").mapInArrow(run, fields).distinct()


def without_repeats(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256, text (the kept words; null if not asked for).

    A word goes if a window of that many words of its document, whose words also start anywhere else, covers it. All
    windows are judged on the input. A null text has no words; its kept text is empty. Texts of fewer words than the
    window stay. Repeated rows are places of their own, so that their windows repeat. An empty table gives no rows.
    """
    named = docs.select("doc_id", "text", F.unhex(F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)).alias("id"))
    named = named.withColumn("id", F.substring("id", 1, 16))
    runs = repeated_windows(named.select("id", "text"), window)
    gone = stored(runs.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("gone")), "gone")
    kind = docs.schema["doc_id"].dataType
    fields = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, digests, texts = [], [], [], []
            for text, spans in zip(b.column("text"), b.column("gone"), strict=True):
                words = (text.as_py() or "").encode().split()
                kept, end = [], 0
                for x in spans.as_py() or []:
                    kept += words[end : max(end, x["first"])]
                    end = max(end, x["last"] + window)
                kept += words[end:]
                joined = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], fields.names)

    return named.join(gone, "id", "left").select("doc_id", "text", "gone").mapInArrow(run, fields)
