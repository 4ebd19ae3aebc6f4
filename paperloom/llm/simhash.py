"""SimHash near-dedup: 64-bit fingerprints, linked through BK-trees of shards, grouped by connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import WHITE, columns, small, stored, unused
from paperloom.llm.components import components

#: Shards of more fingerprints than this are dealt anew by narrower blocks.
SHARD_ROWS = 2048


def fingerprint(text: bytes, width: int = 3) -> int:
    """The SimHash of a text over its shingles of words, in which A-Z are lower case."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n, ones, block = 0, np.zeros(64, np.int64), []
    for s in shingles:
        block.append(xxh64_intdigest(s, 42))
        if len(block) == 65536:
            ones, n, block = ones + _ones(block), n + len(block), []
    ones, n = ones + _ones(block), n + len(block)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    """How often each bit is set, the highest bit first."""
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
    return bits.sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with fp, a signed long, in place of its column text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint((x or "").encode(), width) for x in _each(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(fps.view(np.int64), pa.int64())], [*rest, "fp"])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), T.StructField("fp", T.LongType())]))


def _each(column: pa.Array) -> Iterator[str | None]:
    """The values one at a time, so that only one long text is held twice."""
    return (x.as_py() for x in column)


class BKTree:
    """Fingerprints by distance: a node's children are keyed by their Hamming distance to it."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def add(self, fp: int) -> list[int]:
        """Put fp in; those that lie in the tree within the radius."""
        if self.root is None:
            self.root = (fp, {})
            return []
        near, todo, radius = [], [self.root], self.radius
        while todo:
            at, children = todo.pop()
            d = (at ^ fp).bit_count()
            if d <= radius:
                near.append(at)
            todo += [child for k, child in children.items() if d - radius <= k <= d + radius]
        at, children = self.root
        while (child := children.get(d := (at ^ fp).bit_count())) is not None:
            at, children = child
        if d:
            children[d] = (fp, {})
        return near


def _forest(fps: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join all fingerprints that the radius joins, one for each but the first of a group."""
    tree, parent = BKTree(radius), {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for fp in fps:
        for other in tree.add(fp):
            a, b = top(fp), top(other)
            if a != b:
                parent[a] = b
                yield fp, other


def _link_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fps = None, []
        for b in batches:
            out: list[tuple[int, int]] = []
            for k, fp in zip(b.column("shard").to_pylist(), (b.column("fp").to_numpy().view(np.uint64)).tolist(), strict=True):
                if k != shard:
                    out += _forest(fps, radius)
                    shard, fps = k, []
                fps.append(fp)
            yield _pairs(out)
        yield _pairs(list(_forest(fps, radius)))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fps(fp) that connect exactly those that steps of at most radius bits connect.

    Two fingerprints within the radius agree in one of radius + 1 blocks of bits, so that each of the blocks deals
    all fingerprints into shards, and a BK-tree for each shard finds the links. A shard of too many is dealt again,
    by the blocks of the bits that are left, which its members agree in likewise; as they are distinct and the bits
    get fewer, every shard gets small. The trees are built where the shuffle brings their shards: all
    fingerprints together have no bound and are never broadcast.
    """
    found, bits, level = None, list(range(64)), fps.select("fp", F.lit("").alias("shard"), F.lit(-1).cast("long").alias("left"))
    while True:
        level = _dealt(level, radius)
        level = stored(level, "shards")
        counts = stored(level.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
        counted = level.join(counts, "shard")
        few = counted.filter(F.col("n") <= shard_rows).select("shard", "fp")
        now = few.repartition("shard").sortWithinPartitions("shard").mapInArrow(_link_shards(radius), "a long, b long")
        found = now if found is None else found.union(now)
        bits = bits[: len(bits) - len(bits) // (radius + 1)]
        large = counted.filter(F.col("n") > shard_rows).select("fp", "shard", "left")
        if len(bits) <= radius + 1 or 2 ** len(bits) <= shard_rows:
            return found
        level = stored(large, "large")
        if level.isEmpty():
            return found


def _dealt(level: DataFrame, radius: int) -> DataFrame:
    """Each row once for each block of those bits that are set in left; the block's bits leave left and join the shard."""
    fields = "shard string, left long, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, left, shard = b.column("fp").to_numpy(), b.column("left").to_numpy(), b.column("shard").to_pylist()
            out_shard, out_left, out_fp = [], [], []
            for f, m, s in zip(fp.tolist(), left.tolist(), shard, strict=True):
                for i, mask in enumerate(_blocks(m & (2**64 - 1), radius + 1)):
                    out_shard.append(f"{s}/{i}:{(f & mask) & (2**64 - 1):x}")
                    rest = (m & ~mask) & (2**64 - 1)
                    out_left.append(rest - 2**64 if rest >= 2**63 else rest)
                    out_fp.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(out_shard, pa.string()), pa.array(out_left, pa.int64()), pa.array(out_fp, pa.int64())], ["shard", "left", "fp"])

    return level.select("fp", "left", "shard").mapInArrow(run, fields)


def _blocks(mask: int, n: int, known: dict = {}) -> list[int]:  # noqa: B006
    """The set bits of mask in n blocks of nearly equal numbers of bits."""
    if (mask, n) not in known:
        bits = [i for i in range(64) if mask >> i & 1]
        known[mask, n] = [sum(1 << i for i in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]
    return known[mask, n]


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fingerprint (16 hex digits), component_id, n_component (rows).

    Documents whose fingerprints differ in at most radius bits are linked, and component_id is the smallest doc_id
    that links reach. Null, empty and blank texts have the fingerprint zero, linked like any other; a text of fewer
    words than a shingle is one shingle. Rows with a null doc_id are members too, but never name a component unless
    there is no other member (then it is null). Repeated rows stay; an empty table gives no rows.
    """
    each = stored(fingerprints(docs.select("doc_id", "text"), width), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")), "classes")
    groups = components(links(classes, radius, shard_rows))
    named = classes.join(groups, classes.fp == groups.node, "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    whole = named.groupBy("component").agg(F.min("low").alias("component_id"), F.sum("n").alias("n_component"))
    found = named.select("fp", "component").join(whole, "component").select("fp", "component_id", "n_component")
    return each.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_component")


#: Bits of a wide fingerprint, and shards that a text goes to by its smallest shingles.
WIDE, KEYS = 1024, 6
#: Rows, and bytes of text, from which a shard or group is led: its rows are held against some leaders first.
GROUP_ROWS, TILE_BYTES = 512, 32_000_000
#: Leaders of a large shard or group.
LEADERS = 4


def shingles(text: bytes, width: int = 5) -> np.ndarray | None:
    """The distinct hashes of a text's shingles of words, in order; None without a word."""
    from xxhash import xxh3_64_intdigest

    words = text.lower().split()
    if not words:
        return None
    each = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh3_64_intdigest, each), np.uint64))


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The wide SimHash of a set of shingles, and the smallest hash under each of KEYS hash functions."""
    ones, keys = np.zeros(WIDE, np.int64), np.full(KEYS, 2**64 - 1, np.uint64)
    seeds = _mixed(np.arange(1, max(WIDE // 64, KEYS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for part in np.array_split(hashes, len(hashes) // 4096 + 1):
        each = _mixed(part[:, None] ^ seeds)
        keys = np.minimum(keys, _mixed(each[:, :KEYS]).min(0))
        bits = np.unpackbits(np.ascontiguousarray(each[:, : WIDE // 64]).view(np.uint8), axis=1)
        ones += bits.sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes)).tobytes(), keys.view(np.int64).tolist()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distance_of(similarity: float) -> float:
    """The share of bits in which fingerprints of sets of that Jaccard similarity differ: the angle between the sets."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def loose_bits(similarity: float) -> float:
    """Bits of a wide fingerprint in which a pair of that similarity differs at most: the mean and four deviations.

    The mean is the angle's for sets that differ by many shingles, and up to sqrt(pi / 2) of it for one shingle.
    """
    mean = min(0.5, np.sqrt(np.pi / 2) * distance_of(similarity))
    return float(mean * WIDE + 4 * np.sqrt(WIDE * mean * (1 - mean)))


def similar(texts: DataFrame, width: int = 5, similarity: float = 0.8, shard_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between the digests of distinct texts(digest, text) that connect those of that Jaccard similarity.

    The similarity is that of the sets of shingles. The smallest shingle under each of KEYS hash functions deals a text
    into shards, which misses one pair in 15,000 at 0.8, and wide fingerprints link the pairs of a shard that may be
    similar. The groups of these loose links come together with their texts, and only pairs whose shingles reach the
    similarity are linked. The rows of a shard or group of more than shard_rows rows or TILE_BYTES are first held
    against its leaders; those that one leader links need no look at each other, and the rest is laid out in tiles that
    meet each other and those rows, so that none is left out. Texts without a word are left out.
    """
    fields = "digest binary, wide binary, keys array<long>, size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, wide, keys = [], [], []
            for x in _each(b.column("text")):
                text = (x or "").encode()
                hashes = shingles(text, width)
                w, k = (None, None) if hashes is None else sketch(hashes)
                sizes.append(len(text))
                wide.append(w)
                keys.append(k)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["digest", "wide", "keys", "size"])

    each = stored(texts.select("digest", "text").mapInArrow(run, fields).filter("wide is not null"), "sketches")
    most = loose_bits(similarity)
    wides, tall = each.select("digest", "wide"), texts.select("digest", "text")
    shards = each.select("digest", F.posexplode("keys").alias("k", "key"), F.lit(0).cast("long").alias("size"))
    dealt, starred = _dealt_to_tiles(shards, ["k", "key"], wides, lambda a, b: _bits_apart(a, b) <= most, shard_rows)
    grouped = dealt.join(wides, "digest").repartition("shard").sortWithinPartitions("shard", "digest").select("shard", "digest", "wide")
    loose = stored(grouped.mapInArrow(_link_shards_loosely(most), "a binary, b binary").union(starred), "loose")
    groups = components(loose).withColumnRenamed("node", "digest")
    members = stored(groups.join(each.select("digest", "size"), "digest"), "members")

    def alike(a: str, b: str) -> bool:
        return _alike(_shingles(a, width), _shingles(b, width), similarity)

    marked, starred = _dealt_to_tiles(members, ["component"], tall, alike, shard_rows)
    grouped = tall.join(small(stored(marked, "marked")), "digest").repartition("shard").sortWithinPartitions("shard", "digest").select("shard", "digest", "text")
    return grouped.mapInArrow(_link_groups(width, similarity, most), "a binary, b binary").union(starred)


def _dealt_to_tiles(rows: DataFrame, keys: list[str], values: DataFrame, linked, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(digest, shard) of the rows(keys, digest, size) of groups of two and more, and links (a, b) to the leaders of large groups.

    A small group is one shard. Of a large one the rows that link to its best leader, by linked(value, leader's value)
    of values(digest, value), know each other; the others are tiles of which every two meet, and each meets every tile
    of the former.
    """
    value = next(c for c in values.columns if c != "digest")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    counts = counts.withColumn("tiles", F.greatest(F.ceil(F.col("n") / shard_rows), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int"))
    counts = stored(counts.select(*keys, "tiles", "n"), "groups")
    few = rows.join(counts.filter("tiles = 1"), keys).select("digest", F.xxhash64(*keys).alias("shard"))
    large = small(counts.filter("tiles > 1"))
    hot = stored(rows.join(large, keys).select(*keys, "digest", "tiles", "n"), "large")
    lowest = [F.min(F.struct(F.xxhash64("digest", F.lit(i)), "digest"))["digest"] for i in range(LEADERS)]
    leaders = hot.groupBy(*keys).agg(F.array_distinct(F.array(*lowest)).alias("leaders"))
    leaders = leaders.select(*keys, F.posexplode("leaders").alias("no", "leader"))
    led = leaders.join(values.select(F.col("digest").alias("leader"), F.col(value).alias("_led")), "leader")
    led = small(stored(led.select(*keys, "no", "leader", "_led"), "leaders"), each=F.length("_led") / 16)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [i for i, (x, y) in enumerate(zip(_each(b.column(value)), _each(b.column("_led")), strict=True)) if linked(x, y)]
            yield b.select([*keys, "digest", "no", "leader"]).take(pa.array(near, pa.int64()))

    asked = values.join(small(hot.select(*keys, "digest")), "digest").join(led, keys).filter("digest <> leader")
    star = stored(asked.select(*keys, "digest", "no", "leader", value, "_led").mapInArrow(stars, f"{kinds}, digest binary, no int, leader binary"), "stars")
    best = star.groupBy(*keys, "no", "leader").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max(F.struct("n", "no", "leader")).alias("x"))
    best = small(stored(best.select(*keys, "x.no", "x.leader", "x.n"), "best"))
    known = star.join(best, [*keys, "no", "leader"]).select(*keys, "digest").union(best.select(*keys, "leader")).withColumn("known", F.lit(True))
    parts = hot.join(known, [*keys, "digest"], "left").join(best.select(*keys, (F.col("n") + 1).alias("n_known")), keys, "left")
    n_known = F.coalesce("n_known", F.lit(0))
    # Tiles in proportion to the whole group's, so that they bound rows and bytes alike.
    share = lambda x: F.ceil(F.col("tiles") * x / F.col("n")).cast("int")
    parts = parts.select(*keys, "digest", F.coalesce("known", F.lit(False)).alias("known"), share(n_known).alias("of_known"), share(F.col("n") - n_known).alias("of_rest"))
    own = F.pmod(F.xxhash64("digest"), F.when(F.col("known"), F.col("of_known")).otherwise(F.col("of_rest"))).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_rest = F.transform(upto(F.col("of_rest")), lambda j: F.when(F.col("known"), F.struct(F.lit(1).alias("a"), own.alias("b"), j.alias("c"))).otherwise(F.struct(F.lit(0).alias("a"), F.least(own, j).alias("b"), F.greatest(own, j).alias("c"))))
    with_known = F.when(F.col("known"), F.array().cast("array<struct<a:int,b:int,c:int>>")).otherwise(F.transform(upto(F.col("of_known")), lambda j: F.struct(F.lit(1).alias("a"), j.alias("b"), own.alias("c"))))
    many = parts.withColumn("t", F.explode(F.concat(with_rest, with_known))).select("digest", F.xxhash64(*keys, "t.a", "t.b", "t.c").alias("shard"))
    return few.union(many), star.select(F.col("digest").alias("a"), F.col("leader").alias("b"))


def _link_shards_loosely(most: float):
    def links(digests: list[bytes], wides: list[bytes]) -> list[tuple[bytes, bytes]]:
        return [(digests[i], digests[j]) for i, j in _joined(wides, most)]

    return _by_shard("wide", links)


@lru_cache(maxsize=LEADERS)
def _shingles(text: str, width: int) -> np.ndarray:
    """As shingles(); a leader's text comes with many rows one after another."""
    return shingles(text.encode(), width)


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of shingles reach the Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common) - 1e-9


def _link_groups(width: int, similarity: float, most: float):
    """Links of the pairs of a group whose distinct shingles have the similarity."""

    def links(digests: list[bytes], texts: list[str]) -> list[tuple[bytes, bytes]]:
        sets = [shingles(x.encode(), width) for x in texts]
        return [(digests[i], digests[j]) for i, j in _joined([sketch(x)[0] for x in sets], most, lambda i, j: _alike(sets[i], sets[j], similarity))]

    return _by_shard("text", links)


def _by_shard(column: str, links):
    """Hand the digests and the column of each shard, whose rows follow each other, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, digests, values = None, [], []
        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            for k, digest, value in zip(b.column("shard").to_pylist(), b.column("digest").to_pylist(), _each(b.column(column)), strict=True):
                if k != shard:
                    out += links(digests, values) if len(digests) > 1 else []
                    shard, digests, values = k, [], []
                digests.append(digest)
                values.append(value)
            yield _links(out)
        yield _links(links(digests, values) if len(digests) > 1 else [])

    return run


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])


def _bits_apart(a: bytes, b: bytes) -> int:
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _joined(wides: list[bytes], most: float, alike=None) -> list[tuple[int, int]]:
    """Links (place, place) that join what pairs within most bits join, of which alike, where given, holds as well.

    A BK-tree of the fingerprints finds the pairs. Pairs of one group need no look; a pair that is not alike joins nothing.
    """
    tree, places = BKTree(int(most)), {}
    group, out = list(range(len(wides))), []

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for i, wide in enumerate(wides):
        fp = int.from_bytes(wide)
        near = tree.add(fp)
        # The latest first; one of a group that is alike speaks for all of it.
        for j in sorted((j for x in near for j in places[x]), reverse=True):
            if top(j) != top(i) and (alike is None or alike(i, j)):
                out.append((i, j))
                group[top(j)] = top(i)
        places.setdefault(fp, []).append(i)
    return out


def without_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, shard_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of docs but for near-duplicates: one row of each group stays, with all its columns.

    A group is what links of similar() connect; equal texts are in one, and so are all texts without a word (null,
    empty or blank). Of a group the row of the smallest doc_id stays, a null one last; of rows with the same doc_id
    the one whose text has the smallest SHA-256; of rows that repeat both, one. Other columns stay as they are,
    whatever their names. An empty table gives no rows.
    """
    own = unused("digest", docs)
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE)) == ""
    keyed = docs.withColumn(own, F.unhex(F.sha2(F.when(blank, "").otherwise(F.col("text")), 256)))
    rows = stored(keyed.groupBy(F.col(own).alias("_digest"), "doc_id").agg(F.count(F.lit(1)).alias("rows")), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))
    texts = rows.groupBy("_digest").agg(first.alias("first"))
    # One row tells each text: sketches are made of one copy only.
    one = stored(texts.select("_digest", "first.doc_id"), "texts")
    thin = keyed.select(F.col(own).alias("digest"), "doc_id", "text")
    sample = thin.join(small(one), thin.digest.eqNullSafe(one._digest) & thin.doc_id.eqNullSafe(one.doc_id), "left_semi")
    links = stored(similar(sample.select("digest", "text"), width, similarity, shard_rows), "links")
    groups = components(links)
    named = one.join(groups, one._digest == groups.node, "left").select("_digest", "doc_id", F.coalesce("component", "_digest").alias("component"))
    lead = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_digest")).alias("lead"))
    lead = lead.select(F.col("lead.doc_id").alias("_id"), F.col("lead._digest").alias("_lead"))
    lead = stored(lead.join(rows, lead._id.eqNullSafe(rows.doc_id) & (lead._lead == rows._digest)).select("_id", "_lead", "rows"), "leads")
    here = lambda some: keyed.join(small(some), keyed[own].eqNullSafe(some._lead) & keyed.doc_id.eqNullSafe(some._id), "left_semi")
    stay, repeated = here(lead), lead.filter("rows > 1")
    if not repeated.isEmpty():
        stay = here(lead.filter("rows = 1")).union(here(repeated).dropDuplicates(["doc_id", own]))
    return stay.select(*columns(docs))
