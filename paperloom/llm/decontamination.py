"""Benchmark decontamination: one Aho-Corasick automaton over the word windows of all test items, run once over each text."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import columns, small, stored, unused

#: Characters of test items up to which one automaton holds them all; more are dealt to several, one pass each. An
#: automaton takes about 130 bytes a character in each Python worker.
AUTOMATON_CHARS = 4_000_000

#: Bytes of ASCII that end a word become blanks, A-Z lower case; all other bytes stay.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Windows:
    """The automaton: its alphabet are the items' words, its patterns their windows of some words; shorter items are one pattern."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.items = [k for k, _ in items]
        patterns: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for i, (_, text) in enumerate(items):
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in normal_words(text)]
            for s in range(max(1, len(words) - window + 1) if words else 0):
                patterns[tuple(words[s : s + window])].add(i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, owners in patterns.items():
            self.automaton.add_word(p, (len(p), tuple(sorted(owners))))
        self.any = bool(patterns)
        if self.any:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end) that windows cover, merged, and the items that have them."""
        get = self.numbers.get
        sequence = tuple([get(w, 0) for w in words])
        spans, found = [], set()
        if self.any and any(sequence):
            for end, (n, owners) in self.automaton.iter(sequence):
                spans.append((end + 1 - n, end + 1))
                found.update(owners)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of code points of the text itself."""
    if not spans:
        return []
    raw, found, at = text.encode(), {}, 0
    normal, wanted = raw.translate(_NORMAL), {x for s, e in spans for x in (s, e - 1)}
    for n, w in enumerate(normal.split()):
        at = normal.index(w, at)
        if n in wanted:
            found[n] = (at, at + len(w))
        at += len(w)
    # Spans ascend, so that only what lies between neighbouring places is decoded.
    out, byte, point = [], 0, 0
    for s, e in spans:
        for to in (found[s][0], found[e - 1][1]):
            point, byte = point + len(raw[byte:to].decode()), to
            out.append(point)
    return list(zip(out[::2], out[1::2], strict=True))


#: The automaton that this worker built last, by the name of its items.
_BUILT: dict[str, Windows] = {}


def _automaton(name: str, items: list[tuple[str, str | None]], window: int) -> Windows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items, window)
    return _BUILT[name]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, chars: int = AUTOMATON_CHARS, with_places: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_hit, item_ids, n_items, items_sha256, contaminated, places.

    Words are runs of digits, ASCII letters (as lower case) and other characters outside ASCII. A word is hit if it
    lies in a run of words that is a window of an item of benchmark(item_id, text), all of the item where it is
    shorter. places are the hit runs as (start, end) in code points of the text, null without with_places. A text is contaminated if it has hit
    words, and those are a twentieth of its words or more. Null, empty and wordless texts and items hit nothing; a
    null item_id counts as an empty one; items with the same id count once. Repeated rows stay; an empty benchmark
    hits nothing; an empty table gives no rows.

    The benchmark goes to the driver and by broadcast to the tasks in parts of about chars characters, usually one. Of
    several, each costs one more pass that stores the texts with hits alone; a part leaves the driver and the tasks
    before the next one comes.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()), T.StructField("places", spans)])
    arrow_spans, arrow_ids = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    parts = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // chars) or 1

    def loaded(p: int):
        """The items of a part in this worker, as an automaton."""
        part = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        shared, name = spark.sparkContext.broadcast([tuple(r) for r in part.collect()]), uuid.uuid4().hex
        return shared, lambda: _automaton(name, shared.value, window)

    def judged(b: pa.RecordBatch, found) -> pa.RecordBatch:
        rows = []
        for i, text in enumerate(b.column("text")):
            text = text.as_py()
            words = normal_words(text)
            hit, ids = found(i, words)
            where = [{"start": s, "end": e} for s, e in places(text, hit)] if with_places else None
            rows.append((len(words), sum(e - s for s, e in hit), ids, sha256(",".join(ids).encode()).hexdigest(), where))
        types = [pa.int64(), pa.int64(), arrow_ids, pa.string(), arrow_spans]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True))], out.names)

    if parts == 1:
        _, only = loaded(0)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = only()

            def found(_: int, words: list[bytes]) -> tuple[list, list]:
                hit, ids = automaton.hits(words)
                return hit, sorted({automaton.items[k] for k in ids})

            for b in batches:
                yield judged(b, found)

        done = docs.select("doc_id", "text").mapInArrow(scan, out)
    else:
        digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
        hits = []
        for p in range(parts):
            shared, automaton = loaded(p)
            hits.append(_hits(docs.select(digest, "text"), automaton, p))
            shared.destroy()
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        merge = every.groupBy("digest").agg(F.flatten(F.collect_set("hit")).alias("hit"), F.flatten(F.collect_set("item_ids")).alias("item_ids"))
        known = docs.select(digest, "doc_id", "text").join(small(stored(merge, "hits"), each=F.size("hit") + F.size("item_ids")), "digest", "left")

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit, ids = b.column("hit"), b.column("item_ids")
                yield judged(b, lambda i, _, hit=hit, ids=ids: (merged([(x["start"], x["end"]) for x in hit[i].as_py() or []]), sorted(set(ids[i].as_py() or []))))

        done = known.select("doc_id", "text", "hit", "item_ids").mapInArrow(finish, out)
    return done.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _hits(texts: DataFrame, automaton, part: int) -> DataFrame:
    """(digest, hit, item_ids) of those texts(digest, text) that one part of the benchmark hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = automaton()
        for b in batches:
            at, hit, ids = [], [], []
            for i, text in enumerate(b.column("text")):
                spans, found = here.hits(normal_words(text.as_py()))
                if spans:
                    at.append(i)
                    hit.append([{"start": s, "end": e} for s, e in spans])
                    ids.append(sorted({here.items[k] for k in found}))
            yield pa.RecordBatch.from_arrays([b.column("digest").take(pa.array(at, pa.int64())), pa.array(hit, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(ids, pa.list_(pa.string()))], ["digest", "hit", "item_ids"])

    return stored(texts.mapInArrow(run, "digest binary, hit array<struct<start: int, end: int>>, item_ids array<string>"), f"hits-{part}")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs whose text is not contaminated.

    Found by text, so that rows that repeat or lack a doc_id are judged each by its own; a null text stays. Other
    columns stay as they are, whatever their names.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    keyed = docs.select(digest.alias("doc_id"), "text")
    own = unused("digest", docs)
    gone = stored(matches(keyed, benchmark, window, with_places=False).filter("contaminated").select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return docs.withColumn(own, digest).join(small(gone), own, "left_anti").select(*columns(docs))
