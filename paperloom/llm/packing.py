"""Packing into fixed windows: repeat counts of length combinations by non-negative least squares, then a greedy rest."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from paperloom.llm.common import bounded_batches, small, stored
from paperloom.llm.tokens import ended_ids

#: Combinations of three lengths that are looked at; from windows with more, every k-th least length is taken.
TRIPLES = 400_000
#: The least squares are solved when no combination would change by more than this many repeats, and this share of an
#: average length's count.
REPEATS, SHARE = 0.5, 0.02
#: Words and pieces that a worker remembers; texts with much junk fill any memory, and the pipeline's workers are old by then.
WORDS = 200_000


def combinations(window: int, lengths: np.ndarray, triples: int = TRIPLES) -> np.ndarray:
    """Combinations of at most three of the lengths that fill the window, a row each with zeros for none: the window alone, pairs, then threes."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    have[0] = False
    found = [np.array([[window, 0, 0]] if have[window] else [], int).reshape(-1, 3)]
    step = max(1, window * window // 12 // triples)
    for a in [0, *range(1, window // 3 + 1, step)]:
        if a == 0 or have[a]:
            b = np.arange(max(a, 1), (window - a) // 2 + 1)
            b = b[have[b] & have[window - a - b]]
            found.append(np.stack([window - a - b, b, np.full(len(b), a)], 1))
    return np.concatenate(found)


def repeats(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """How often to use each combination: least squares of the lengths used against the histogram, none negative, rounded.

    Coordinate descent: in turn each combination that is not at its best takes the count that fits the rest of the
    histogram best, so that few combinations get all the weight, until every one is within REPEATS and SHARE. Then, the
    most used first, counts are rounded and held to what there is.
    """
    rest, x = histogram.astype(float), np.zeros(len(combos))
    rest[0] = 0
    weights = 1.0 * (combos > 0).sum(1) + 2 * (combos[:, 0] == combos[:, 1]) + 2 * ((combos[:, 1] == combos[:, 2]) & (combos[:, 2] > 0)) + 2 * ((combos[:, 0] == combos[:, 2]) & (combos[:, 2] > 0))
    most = REPEATS + SHARE * histogram.sum() / len(histogram)
    each = [tuple(i for i in c if i) for c in combos.tolist()]
    while len(todo := np.nonzero(np.abs(np.maximum(rest[combos].sum(1) / weights, -x)) > most)[0]):
        left = rest.tolist()
        for k in todo.tolist():
            c = each[k]
            change = max(sum([left[i] for i in c]) / weights[k], -x[k])
            x[k] += change
            for i in c:
                left[i] -= change
        rest = np.array(left)
    left, use = histogram.tolist(), np.zeros(len(combos), np.int64)
    for k in np.argsort(-x, kind="stable").tolist():
        if x[k] < 0.5:
            break
        use[k] = _taken(left, each[k], round(x[k]))
    return use


def _taken(left: list[int], lengths: tuple[int, ...], most: int | None = None) -> int:
    """Take the lengths that often from what is left, at most as often as there are enough; how often that was."""
    n = min(left[i] // lengths.count(i) for i in lengths)
    n = n if most is None else min(n, most)
    for i in lengths:
        left[i] -= n
    return n


def greedy(window: int, left: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) of sequences that the lengths left fill whole, each built from the largest ones that still fit.

    What is left then fills none: a sequence that begins with the largest length has room that nothing fits.
    """
    found, end = [], window
    lengths = [i for i in range(window, 0, -1) if left[i]]
    while end:
        lengths = [i for i in lengths if left[i]]
        room, c = window, []
        for i in lengths:
            if i <= end and i <= room:
                n = min(left[i], room // i)
                c += [i] * n
                room -= n * i
        if not c:
            break
        if room:
            # Nothing completes the largest length: the next one begins.
            end = c[0] - 1
        else:
            found.append((tuple(c), _taken(left, tuple(c))))
    return found


class Plan:
    """Where the piece of each length and rank goes; made of the histogram of lengths alone.

    For each length, runs of ranks: (first rank, sequence of the first, offset). Ranks beyond the last run are the
    rest, which no sequence takes whole, laid end to end by length, largest first, and rank, and cut at the window's
    ends.
    """

    def __init__(self, window: int, histogram: np.ndarray, triples: int = TRIPLES):
        self.window = window
        combos = combinations(window, np.nonzero(histogram)[0], triples)
        times = repeats(histogram, combos)
        chosen = [(tuple(i for i in combos[k].tolist() if i), int(times[k])) for k in np.nonzero(times)[0]]
        left = histogram.tolist()
        for c, n in chosen:
            _taken(left, c, n)
        chosen += greedy(window, left)
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        used, sequence = [0] * (window + 1), 0
        for c, n in chosen:
            for offset, length in zip(np.cumsum((0, *c)).tolist(), c, strict=False):
                runs[length].append((used[length], sequence, offset))
                used[length] += n
            sequence += n
        self.runs = {k: tuple(np.array(v).T) for k, v in runs.items()}
        self.used, self.first_rest = used, sequence
        rest = histogram - np.array(used)
        tokens = (rest * np.arange(window + 1))[::-1]
        self.rest_at = (np.cumsum(tokens) - tokens)[::-1]

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(tokens, sequence, offset) of the parts of a piece."""
        if rank < self.used[length]:
            first, sequence, offset = self.runs[length]
            k = int(np.searchsorted(first, rank, side="right")) - 1
            return [(length, int(sequence[k]) + rank - int(first[k]), int(offset[k]))]
        at = int(self.rest_at[length]) + (rank - self.used[length]) * length
        sequence, offset = self.first_rest + at // self.window, at % self.window
        n = min(length, self.window - offset)
        return [(n, sequence, offset)] + ([(length - n, sequence + 1, 0)] if n < length else [])


_TOKENS = [("ids", "binary"), ("doc_tokens", "long"), ("part", "long"), ("length", "int"), ("rank", "long"), ("full", "long")]


def tokenized(docs: DataFrame, window: int, path: str | None, end_id: int) -> DataFrame:
    """docs(doc_id, text) as ids (16 or 32 bits each), with the number of its rest and of its full windows in this partition.

    part is the partition, length that of the rest (0: none), rank how many rests of this length, and full how many
    full windows, the partition had before.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rests, full = TaskContext.get().partitionId(), [0] * (window + 1), 0
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            size, since = 0, 0
            for i, ids in enumerate(ended_ids(b.column("text"), path, end_id, limit=WORDS)):
                n = len(ids)
                rest = n % window
                for x, v in zip(out, (packed(ids), n, part, rest, rests[rest], full), strict=True):
                    x.append(v)
                rests[rest] += rest > 0
                full, size = full + n // window, size + n
                if size > 4_000_000:
                    yield _batch(b.column("doc_id").slice(since, i + 1 - since), out)
                    out, size, since = ([], [], [], [], [], []), 0, i + 1
            yield _batch(b.column("doc_id").slice(since), out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {t}" for n, t in _TOKENS))


def _batch(ids: pa.Array, out: tuple[list, ...]) -> pa.RecordBatch:
    types = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([ids, *(pa.array(x, types[t]) for x, (_, t) in zip(out, _TOKENS, strict=True))], ["doc_id", *(n for n, _ in _TOKENS)])


def packed(ids: np.ndarray) -> bytes:
    """One byte that tells the width, then the ids in 16 bits each where all fit, else in 32."""
    narrow = ids.dtype.itemsize == 2 or len(ids) == 0 or int(ids.max()) < 65536
    return (b"\x02" + ids.astype("<u2", copy=False).tobytes()) if narrow else (b"\x04" + ids.astype("<u4", copy=False).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def pack(docs: DataFrame, window: int = 2048, path: str | None = None, end_id: int = 1, with_ids: bool = True, triples: int = TRIPLES) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    A document's ids are those of the tokenizer and then end_id; a null or empty text has end_id alone. Full windows
    of a long document and the rest of each document are pieces; the histogram of their lengths (at most window
    numbers) decides the whole plan. Pieces that a combination of exact fill takes, or the greedy filling of the rest,
    stay whole; the others are laid end to end and cut at the window's ends, so that at most one sequence is short.
    triples is how many combinations of three lengths the least squares look at; all there are at windows up to 2190,
    and further ones leave more to the greedy filling. ids are little-endian 32-bit numbers, null unless asked for. Sequences are numbered from 0 without gaps. Repeated rows and null doc_ids are
    packed like others; an empty table gives no rows.
    """
    rows = stored(tokenized(bounded_batches(docs), window, path, end_id), "tokens")
    rests = rows.filter("length > 0").groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    wholes = rows.groupBy("part").agg(F.sum(F.expr(f"doc_tokens div {window}")).alias("n")).select("part", F.lit(window).alias("length"), "n")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(rests.union(wholes).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = np.zeros(window + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = docs.sparkSession.sparkContext.broadcast(Plan(window, histogram, triples))
    offsets = lambda which, name: small(counts.filter(which).select("part", "length", F.col("before").alias(name)))
    found = rows.join(offsets(f"length < {window}", "rest_before"), ["part", "length"], "left").join(offsets(f"length = {window}", "full_before").drop("length"), "part", "left")
    found = found.select("doc_id", "ids", "doc_tokens", (F.col("rank") + F.coalesce("rest_before", F.lit(0))).alias("rank"), (F.col("full") + F.coalesce("full_before", F.lit(0))).alias("full"))
    kind = docs.schema["doc_id"].dataType
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in longs), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = plan.value
        for b in batches:
            source, out, raw = [], [], []
            for i, (data, n, rank, full) in enumerate(zip(b.column("ids"), b.column("doc_tokens").to_pylist(), b.column("rank").to_pylist(), b.column("full").to_pylist(), strict=True)):
                ids = memoryview(unpacked(data.as_py()).tobytes())
                at = 0
                for piece, r in [*((window, full + k) for k in range(n // window)), *([(n % window, rank)] if n % window else [])]:
                    for length, sequence, offset in to.places(piece, r):
                        part = ids[4 * at : 4 * (at + length)]
                        source.append(i)
                        out.append((at, length, crc32(part), n, sequence, offset))
                        raw.append(bytes(part) if with_ids else None)
                        at += length
            columns = np.array(out, np.int64).reshape(-1, len(longs)).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(source, pa.int64())), *(pa.array(x) for x in columns), pa.array(raw, pa.binary())], fields.names)

    return found.mapInArrow(run, fields)


def padded_tokens(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """(sequences, tokens, padding) of packed pieces: a sequence is filled up to the window unless it ends at a power of two."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padding = F.when(F.bit_count("n") == 1, 0).otherwise(window - F.col("n"))
    return each.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(padding).alias("padding"))
