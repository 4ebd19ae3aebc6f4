"""Prefix trie of conversations: ROLLUP over positional turn columns aggregates all prefixes of a block of turns at once."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import numbered, scratch, small, stored

#: Turns in a block: the positional columns of one ROLLUP.
WIDTH = 8
#: Blocks whose digests are joined in one row on the way to the prefixes of a long conversation.
SEGMENT = 64
#: Most conv_ids in one string on the way to a node's list of ends.
CHUNK = 1024
#: Turns that a conversation takes from the first of its hundred: at most this many.
SHARED = 5

_TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, id, chars): each conversation's turns from 0, in order of turn, null first.

    Turns of one number are ordered by the digest of role and text, so that ties and repeated rows have a defined
    place. A null role or text is empty; a row without a conv_id belongs to no conversation. Only digests and lengths
    are shuffled, over ranges of (conv_id, turn), so that no task holds a whole conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        "turn",
        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("id"),
        F.length(text).cast("long").alias("chars"),
    )
    return numbered(slim.repartitionByRange("conv_id", "turn", "id"), ["conv_id"], ["turn", "id"], "pos", "turns").select("conv_id", "pos", "id", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sizes): of every conversation the first h turns of the first of its hundred, then its own after its first h.

    h is the conversation's crc32 mod 6. turns: conv_id, pos, id, chars; sizes: conv_id, n_turns, chars, also of
    conversations without turns. The shared turns are at most five for each hundred conversations.
    """
    own = stored(turns(conversations), "own")
    first = own.filter((F.col("conv_id") % 100 == 0) & (F.col("pos") < SHARED)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "chars"))).alias("first")).withColumnRenamed("conv_id", "base")
    h = (F.crc32(F.col("conv_id").cast("string")) % (SHARED + 1)).cast("int")
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h)
    convs = convs.join(small(stored(first, "first"), F.size("first") * 4), "base", "left")
    convs = stored(convs.select("conv_id", "h", F.slice(F.coalesce("first", F.array().cast("array<struct<pos:bigint,id:binary,chars:bigint>>")), F.lit(1), F.col("h")).alias("taken")), "convs")
    taken = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.pos", "t.id", "t.chars")
    rest = own.join(convs.select("conv_id", "h", F.size("taken").alias("n")), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "id", "chars")
    all_turns = stored(taken.union(rest), "rebuilt")
    sizes = all_turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("chars").alias("chars"))
    sizes = convs.select("conv_id").join(sizes, "conv_id", "left").select("conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), F.coalesce("chars", F.lit(0)).alias("chars"))
    return all_turns, stored(sizes, "sizes")


def blocks(rows: DataFrame) -> DataFrame:
    """(conv_id, block, t1.., digest, chars) of turns: one row for each WIDTH turns of a conversation; t1.. are (id, chars)."""
    at = F.col("pos") % WIDTH
    turn = F.struct("id", "chars")
    wide = rows.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).alias("block")).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), turn.alias("t")))).alias("_t"), F.sum("chars").alias("chars"))
    # get() gives null beyond the conversation's end.
    each = [F.get("_t", F.lit(j))["t"].alias(t) for j, t in enumerate(_TURNS)]
    ids = F.expr("unhex(sha2(aggregate(_t, cast('' as binary), (a, x) -> concat(a, x.t.id)), 256))")
    return wide.select("conv_id", "block", *each, ids.alias("digest"), "chars")


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, block, node, after, chars_before): the prefixes that end where each block of rows(conv_id, block, digest, chars) begins and ends.

    chars_before are the characters of the first. A node is empty at a conversation's start; equal prefixes have equal
    nodes. SEGMENT blocks are joined in a row; the segments of a long conversation are blocks for the next round, so
    that it is dealt to many rows and takes as many rounds as its length has digits to the base SEGMENT.
    """
    seg = rows.groupBy("conv_id", F.floor(F.col("block") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("block", "digest", "chars"))).alias("b"))
    seg = stored(seg.withColumn("full", F.size("b") == SEGMENT), "segments")
    none = F.lit(b"")
    if seg.agg(F.max("seg")).first()[0]:
        # A segment that is not full ends its conversation, so that what comes after it is not asked for.
        sums = F.expr("aggregate(b, 0L, (a, x) -> a + x.chars)").alias("chars")
        upper = prefixes(seg.select("conv_id", F.col("seg").alias("block"), F.when(F.col("full"), _joined("cast('' as binary)", "b")).otherwise(none).alias("digest"), sums))
        seg = seg.join(upper.select("conv_id", F.col("block").alias("seg"), F.col("node").alias("above"), F.col("after").alias("beyond"), F.col("chars_before").alias("so_far")), ["conv_id", "seg"])
    else:
        seg = seg.withColumn("above", none).withColumn("beyond", _joined("cast('' as binary)", "b")).withColumn("so_far", F.lit(0).cast("long"))
    # Inside a segment a node is the digest of what is above and of the blocks so far.
    node = lambda n: f"unhex(sha2(aggregate(slice(b, 1, {n}), above, (a, y) -> concat(a, y.digest)), 256))"
    steps = F.expr(
        f"transform(b, (x, i) -> struct(x.block as block, case when i = 0 then above else {node('i')} end as node, case when i = {SEGMENT - 1} then beyond else {node('i + 1')} end as after,"
        " aggregate(slice(b, 1, i), so_far, (a, y) -> a + y.chars) as chars_before))"
    )
    return seg.select("conv_id", F.explode(steps).alias("s")).select("conv_id", "s.block", "s.node", "s.after", "s.chars_before")


def _joined(start: str, blocks: str) -> Column:
    return F.expr(f"unhex(sha2(aggregate({blocks}, {start}, (a, x) -> concat(a, x.digest)), 256))")


def _key(levels: Column | None = None) -> Column:
    """The node that a row of the ROLLUP stands for, or the one above it where levels are told."""
    ids = [F.coalesce(F.col(f"{t}.id") if levels is None else F.when(levels > j, F.col(f"{t}.id")), F.lit(b"")) for j, t in enumerate(_TURNS, 1)]
    return _digest(F.col("node"), *ids)


def _rolled(wide: DataFrame, sums: str) -> DataFrame:
    """One ROLLUP over the turn columns of every block: a row for each prefix that ends in it, with level, key and depth."""
    turns = ", ".join(_TURNS)
    rows = wide.sparkSession.sql(f"SELECT block, node, chars_before, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, {sums} FROM {{wide}} GROUP BY block, node, chars_before, ROLLUP ({turns})", wide=wide)
    # A conversation that ends in the block has null columns; a block's empty prefix is the former one's last.
    last = F.coalesce(*(F.when(F.col("level") == j, F.col(f"{t}.chars")) for j, t in enumerate(_TURNS, 1)))
    rows = rows.withColumn("last_chars", F.when(F.col("level") == 0, 0).otherwise(last)).filter("last_chars is not null and (level > 0 or block = 0)")
    key = F.when(F.col("level") == 0, F.col("node")).when(F.col("level") == WIDTH, F.col(f"{_TURNS[-1]}.after")).otherwise(_key())
    return rows.withColumn("key", key).withColumn("depth", F.col("block") * WIDTH + F.col("level"))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in sorted rows(key, conv_id) as strings of at most CHUNK ids, with the first of them."""
    key, ids = None, []
    for batch in batches:
        out = []
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or len(ids) == CHUNK):
                out.append((key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = k
            ids.append(c)
        yield _batch(out)
    if ids:
        yield _batch([(key, ids[0], ",".join(map(str, ids)))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    k, f, i = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(f, pa.int64()), pa.array(i, pa.string())], ["key", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined strings of each key in sorted rows(key, first, ids), taken in string by string."""
    key, h = None, None
    names = ["key", "ends_sha256"]
    for batch in batches:
        keys, hashes = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                h.update(b"," + ids.encode())
                continue
            if h is not None:
                keys.append(key)
                hashes.append(h.hexdigest())
            key, h = k, sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names)
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names)


def ends(of: DataFrame) -> DataFrame:
    """(key, ends_sha256) of rows(key, conv_id): the digest of each key's ids, ascending and comma-joined.

    The ids of a key are ordered over ranges and joined to strings there; only the digest itself, which has to see
    them in order, runs over a key's strings in one task, a CHUNK-th of the rows, and keeps none of them.
    """
    strings = of.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_ids, "key binary, first long, ids string")
    return strings.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations(conv_id, turn, role, text), from the root without turns on.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Rows are
    read as turns() says; other columns are ignored, whatever their names. A very long text counts whole, as its digest
    and length. An empty table has no node, not even the root.

    Sums over subtrees need no walk: a conversation owns the nodes whose smallest member it is, which are the deepest of
    its path. A subtree's distinct nodes are those that its members own, but that the top's owner counts from the top on
    only; so that sums over members, which ROLLUP gives for all prefixes together, tell n_leaves and saved_tokens.
    """
    with scratch(conversations.sparkSession) as keep:
        all_turns, sizes = rebuilt(conversations)
        wide = stored(blocks(all_turns), "blocks")
        found = prefixes(wide.select("conv_id", "block", "digest", "chars"))
        wide = wide.drop("digest", "chars").join(found, ["conv_id", "block"])
        last = _TURNS[-1]
        with_after = F.when(F.col(last).isNotNull(), F.struct(F.col(f"{last}.id").alias("id"), F.col(f"{last}.chars").alias("chars"), F.col("after").alias("after")))
        wide = wide.withColumn(last, with_after).drop("after")
        wide = sizes.join(wide, "conv_id", "left").withColumn("block", F.coalesce("block", F.lit(0).cast("long"))).withColumn("node", F.coalesce("node", F.lit(b""))).withColumn("chars_before", F.coalesce("chars_before", F.lit(0).cast("long")))
        wide = stored(wide, "wide")

        owners = _rolled(wide, "min(conv_id) AS conv_id, max(n_turns) AS most").groupBy("conv_id").agg(F.sum("last_chars").alias("owned"), F.max((F.col("most") == F.col("depth")).cast("long")).alias("leaf"))
        owners = stored(sizes.select("conv_id", F.col("chars").alias("chars_of_owner")).join(owners, "conv_id").select("conv_id", "owned", "leaf", "chars_of_owner"), "owners")
        members = wide.join(owners.select("conv_id", "owned", "leaf"), "conv_id", "left")
        nodes = _rolled(members, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(chars) AS all_chars, coalesce(sum(owned), 0) AS all_owned, coalesce(sum(leaf), 0) AS n_leaves")
        above = F.when(F.col("level") == 1, F.col("node")).when(F.col("level") > 1, _key(F.col("level")))
        path = F.col("chars_before") + sum((F.when(F.col("level") > j, F.col(f"{t}.chars")).otherwise(0) for j, t in enumerate(_TURNS, 1)), F.lit(0))
        nodes = nodes.select("key", above.alias("above"), path.alias("path"), "conv_id", "depth", "n_convs", "all_chars", "all_owned", "n_leaves")
        nodes = stored(nodes.join(owners.drop("leaf"), "conv_id"), "nodes")

        n_last = F.col("n_turns") - F.col("block") * WIDTH
        at_end = wide.filter((n_last <= WIDTH) | (F.col("n_turns") == 0))
        at_end = at_end.select(F.when(F.col("n_turns") == 0, F.lit(b"")).when(n_last == WIDTH, F.col(f"{last}.after")).otherwise(_key()).alias("key"), "conv_id")
        kids = nodes.filter("above is not null").groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
        own = stored(nodes.join(kids, "key", "left").join(ends(at_end), "key", "left"), "own")
        parents = own.filter("n_children is not null").select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
        saved = (F.col("all_chars") - F.col("n_convs") * F.col("path")) - (F.col("all_owned") - F.col("owned") + F.col("chars_of_owner") - F.col("path"))
        out = own.join(parents, "above", "left").select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            "n_leaves",
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        )
        keep.append(out := stored(out, "trie"))
    return out
