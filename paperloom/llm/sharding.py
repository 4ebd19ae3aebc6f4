"""Longest-processing-time sharding: groups that stay together go to the least loaded shard, the largest first."""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import numbered, small, stored

#: Sizes below 2 ** DIGITS are classes of their own; of larger ones the leading DIGITS binary digits tell the class.
DIGITS = 13


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size class, shard, first, last + 1): which groups of each class (size, groups, bytes) go to which shard.

    The classes come largest first. Groups of a class weigh its mean; while they are few, each goes to the top of a
    heap of loads. Of many, all but the last few rounds are dealt at once, to the level that the heap would reach.
    """
    heap = [(0.0, s) for s in range(shards)]
    heapify(heap)
    out = []
    for size, groups, total in sorted(classes, reverse=True):
        mean, given = total / groups, [0] * shards
        left = groups
        if left > 16 * shards:
            left -= _in_bulk(heap, given, mean, left - 8 * shards)
        for _ in range(left):
            load, s = heap[0]
            given[s] += 1
            heapreplace(heap, (load + mean, s))
        first = 0
        for s, n in enumerate(given):
            if n:
                out.append((size, s, first, first + n))
            first += n
    return out


def _in_bulk(heap: list[tuple[float, int]], given: list[int], mean: float, groups: int) -> int:
    """Fill the shards up to the highest level that takes at most that many groups; how many that were."""
    loads = sorted(heap)
    level = 0.0
    for k in range(len(loads), 0, -1):
        level = (sum(x for x, _ in loads[:k]) + groups * mean) / k
        if level >= loads[k - 1][0]:
            break
    done = 0
    for i, (load, s) in enumerate(loads):
        n = max(0, int((level - load) // mean))
        n = min(n, groups - done)
        given[s] += n
        done += n
        loads[i] = (load + n * mean, s)
    heap[:] = loads
    heapify(heap)
    return done


def shard(docs: DataFrame, shards: int = 8, digits: int = DIGITS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    A row's size is its text's bytes and one more; a null text has none. Equal texts are a group and share a shard
    (null and empty ones too). The groups' sizes are counted by class, at most 2 ** digits classes for each doubling
    of the size, so that the driver holds a bounded list however many groups there are; the schedule over the classes
    is exact for sizes under 2 ** digits and within that fraction above. A group larger than a shard's fair share
    stays whole, which then bounds the balance. Slots number the rows of a shard from 0 without gaps. Repeated rows
    and null doc_ids are rows like others; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = stored(docs.select("doc_id", F.octet_length(text).cast("long").alias("n"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")).withColumn("size", F.col("n") + 1).drop("n"), "sizes")
    groups = slim.groupBy("digest").agg(F.sum("size").alias("bytes"))
    # The class is the size without the binary digits after the first ones.
    shift = F.greatest(F.lit(0), F.floor(F.log2(F.col("bytes").cast("double"))).cast("int") + 1 - digits)
    groups = groups.withColumn("class", F.call_function("shiftleft", F.call_function("shiftright", F.col("bytes"), shift), shift))
    ranked = stored(numbered(groups, ["class"], ["digest"], "rank", "groups"), "ranked")
    classes = ranked.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes")).collect()
    runs = docs.sparkSession.createDataFrame(deal([tuple(r) for r in classes], shards), T.StructType([T.StructField("class", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    placed = ranked.join(F.broadcast(runs), "class").filter("rank >= from and rank < to").select("digest", "shard")
    each = slim.join(placed, "digest")
    each = numbered(each.select("doc_id", "size", "text_crc32", "shard"), ["shard"], ["doc_id"], "slot", "slots")
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
