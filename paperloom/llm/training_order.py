"""Training-order materialisation: a keyed permutation gives every sequence its slot; range partitions write the shards."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import stored
from paperloom.llm.packing import packed, unpacked
from paperloom.llm.tokens import ended_ids


class Feistel:
    """A keyed permutation of range(n): Feistel rounds over an even number of bits, walked along its cycle into range(n)."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        mixed, keys = np.uint64(key & (2**64 - 1)), []
        for _ in range(rounds):
            mixed = _mixed(np.bitwise_xor(mixed, np.uint64(0x9E3779B97F4A7C15)))
            keys.append(mixed)
        self.keys = keys

    def _once(self, x: np.ndarray, keys: list, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (_mixed(left + k) & self.mask), left
            else:
                left, right = right, left ^ (_mixed(right + k) & self.mask)
        return left << half | right

    def _walk(self, x, keys: list, back: bool) -> np.ndarray:
        x = np.array(x, np.uint64, ndmin=1)
        with np.errstate(over="ignore"):
            x = self._once(x, keys, back)
            while (out := x >= self.n).any():
                x[out] = self._once(x[out], keys, back)
        return x.astype(np.int64)

    def slots(self, index) -> np.ndarray:
        """The slot of each index."""
        return self._walk(index, self.keys, False)

    def indexes(self, slot) -> np.ndarray:
        """The index of each slot."""
        return self._walk(slot, self.keys[::-1], True)


def _mixed(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def sequences(docs: DataFrame, window: int, path: str | None, end_id: int) -> DataFrame:
    """(doc_id, digest, start, length, ids) of docs(doc_id, digest, text): the ids of each text and end_id, cut into windows."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, start, length, ids, size = [], [], [], [], 0
            for i, whole in enumerate(ended_ids(b.column("text"), path, end_id, size=4_000_000)):
                for s in range(0, len(whole), window):
                    part = whole[s : s + window]
                    source.append(i)
                    start.append(s)
                    length.append(len(part))
                    ids.append(packed(part))
                size += len(whole)
                if size > 4_000_000:
                    yield _taken(b, source, start, length, ids)
                    source, start, length, ids, size = [], [], [], [], 0
            yield _taken(b, source, start, length, ids)

    fields = [T.StructField("doc_id", kind), T.StructField("digest", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType())]
    return docs.select("doc_id", "digest", "text").mapInArrow(run, T.StructType(fields))


def _taken(b: pa.RecordBatch, source: list, start: list, length: list, ids: list) -> pa.RecordBatch:
    at = pa.array(source, pa.int64())
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("digest").take(at), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "digest", "start", "length", "ids"])


def materialise(docs: DataFrame, key: int, window: int = 2048, per_shard: int = 4096, path: str | None = None, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """One row per sequence, ordered by slot: slot, shard, at (its place in the shard), doc_id, start, length, ids_crc32, record.

    The ids of a text and end_id are cut into sequences of at most window ids. They are numbered in the order of
    doc_id, the text's hash and start, and the permutation of key moves each number to its slot, so that table, key
    and window alone tell the order, whatever the partitions. record holds the ids as little-endian 32-bit numbers,
    filled up with pad_id: all have the same stride, so that slot s is record s % per_shard of shard s // per_shard,
    and a reader resumes at any slot. A shard's slots lie in one partition, in order. Null and empty texts are one
    sequence of end_id; rows that repeat are sequences of their own, and null doc_ids come first. An empty table
    gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    text = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    # By range first: then the numbers of a partition are next to each other.
    ordered = text.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    cut = sequences(ordered, window, path, end_id)
    each = numbered_in_order(cut)
    n = each.count()
    fields = T.StructType([T.StructField("slot", T.LongType()), T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Feistel(n, key)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(order.slots(b.column("index").to_numpy())), *(b.column(c) for c in fields.names[1:])], fields.names)

    shards = -(-n // per_shard) or 1
    slots = each.select("index", "doc_id", "start", "length", "ids").mapInArrow(placed, fields).withColumn("shard", F.expr(f"slot div {per_shard}"))
    # A range of slots for each shard, by number: the range is known, so that nothing needs sampling. Several shards
    # share a task only if there are very many.
    tasks = min(shards, 100_000)
    slots = slots.repartitionById(tasks, F.expr(f"cast(shard * {tasks} div {shards} as int)")).sortWithinPartitions("slot")

    out = T.StructType([T.StructField("slot", T.LongType()), T.StructField("shard", T.LongType()), T.StructField("at", T.LongType()), T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType()), T.StructField("ids_crc32", T.LongType()), T.StructField("record", T.BinaryType())])
    padding = np.full(window, pad_id, "<u4").tobytes()

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                ids = [unpacked(x.as_py()).tobytes() for x in b.column("ids")]
                records = [x + padding[len(x) :] for x in ids]
                slot = b.column("slot").to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("shard"), pa.array(slot % per_shard), b.column("doc_id"), b.column("start"), b.column("length"), pa.array([crc32(x) for x in ids], pa.int64()), pa.array(records, pa.binary())], out.names)

    return slots.mapInArrow(finished, out)


def numbered_in_order(cut: DataFrame) -> DataFrame:
    """cut, whose partitions are in order, with index from 0 without gaps over all of them."""
    placed = stored(cut.withColumn("_at", F.monotonically_increasing_id()), "sequences").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()
    # One short row for each partition of the job, whatever its size.
    before, shifts = 0, []
    for part, n, first in sorted(counts):
        shifts.append((part, before - first))
        before += n
    runs = cut.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    return placed.join(F.broadcast(runs), "_part").withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


#: A record in a file ends with this byte, as Spark's text writer puts it.
TRAILER = "\n"


def write_shards(rows: DataFrame, path: str) -> None:
    """Write records as files of fixed stride, a folder shard=k with one file for each shard, by Spark's own committer.

    The stride is 4 * window + 1: the ids and a trailing byte. Slot s starts at stride * (s % per_shard) of its shard.
    Rows are sorted by shard and slot once more right before the writer, which would else sort by shard alone and might
    mix a shard's slots when that sort spills. A second run into the same path fails before it writes anything, as
    Spark's writer does; an empty table writes no shard.
    """
    # The writer takes an order that begins with the partition column as it is; slot goes along as a second one would.
    ordered = rows.select("shard", "slot", F.col("record").cast("string").alias("value")).sortWithinPartitions("shard", "slot")
    ordered.select("shard", "value").write.partitionBy("shard").option("lineSep", TRAILER).text(path)


def read_shard(spark, path: str, shard: int, window: int, start: int = 0, stop: int | None = None, step: int = 1024) -> Iterator[np.ndarray]:
    """The records of a shard from place start on, up to stop if told, one array of window ids each.

    The file is opened in its store and sought, and step records are read at a time, so that resuming reads nothing of
    what lies before. A shard that was not written raises FileNotFoundError at the first record asked for.
    """
    jvm, stride = spark._jvm, 4 * window + 1
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [f for f in (store.listStatus(folder) if store.exists(folder) else []) if f.getPath().getName().startswith("part-")]
    if not files:
        raise FileNotFoundError(f"{path}/shard={shard}")
    last = files[0].getLen() // stride
    last = last if stop is None else min(stop, last)
    file = store.open(files[0].getPath())
    try:
        for at in range(start, last, step):
            n = min(step, last - at)
            file.seek(at * stride)
            data = jvm.org.apache.commons.io.IOUtils.toByteArray(file, n * stride)
            for i in range(n):
                yield np.frombuffer(data, "<u4", window, i * stride)
    finally:
        file.close()
