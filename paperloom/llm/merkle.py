"""Merkle manifest of a dataset: trees of fan-out 16 in blocks whose nodes lie in the van Emde Boas order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import ascii_lower, numbered, scratch, stored

FAN = 16
#: Levels of a block above its leaves: a block is an aligned subtree of FAN ** LEVELS leaves.
LEVELS = 2
BLOCK = FAN**LEVELS
SIZE = 32

_BLOCKS = "tree string, block long, up int, n int, root binary, layout binary"
_PATHS = "tree string, block long, path binary"
_PROOFS = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def address(depth: int, index: np.ndarray | int, height: int):
    """Where the layout of a tree of height levels holds the nodes index of a depth (the root has depth 0).

    The tree is split at half its height: the top comes first, then the subtrees below it from left to right, each laid
    out by the same rule. No node is looked at, so that parents, children and siblings are found by arithmetic.
    """
    if height == 1:
        return index * 0
    top = height // 2
    if depth < top:
        return address(depth, index, top)
    below = FAN ** (depth - top)
    return nodes(top) + index // below * nodes(height - top) + address(depth - top, index % below, height - top)


def nodes(height: int) -> int:
    """Nodes of a full tree of height levels."""
    return (FAN**height - 1) // (FAN - 1)


@lru_cache(maxsize=64)
def _places(depth: int, height: int) -> np.ndarray:
    return address(depth, np.arange(FAN**depth), height)


def _levels(n: int) -> int:
    """Levels above n leaves until one node remains."""
    return 0 if n < 2 else len(f"{n - 1:x}")


def _widths(n: int, up: int) -> list[int]:
    """Nodes of each depth above n leaves, from the root's on."""
    return [-(-n // FAN ** (up - d)) for d in range(up + 1)]


def _join(digests) -> bytes:
    return "".join(x.hex() for x in digests).encode()


def lay_out(leaves: list[bytes], up: int) -> bytes:
    """The layout of the tree of up levels over the leaves; nodes that the last runs lack are zero bytes."""
    out = np.zeros((nodes(up + 1), SIZE), np.uint8)
    level = leaves
    for depth in range(up, -1, -1):
        out[_places(depth, up + 1)[: len(level)]] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, SIZE)
        if depth:
            level = [sha256(_join(level[i : i + FAN])).digest() for i in range(0, len(level), FAN)]
    return out.tobytes()


def _rows(layout: bytes, n: int, up: int) -> list[list[bytes]]:
    """Digests by depth of a stored block."""
    flat = np.frombuffer(layout, np.uint8).reshape(-1, SIZE)
    return [[x.tobytes() for x in flat[_places(d, up + 1)[:w]]] for d, w in enumerate(_widths(n, up))]


def _steps(rows: list[list[bytes]], index: int) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Siblings before and after the node on the path from leaf index to the block's root, from the leaf on."""
    for level in reversed(rows[1:]):
        first = index - index % FAN
        yield level[first:index], level[index + 1 : first + FAN]
        index //= FAN


def _packed(steps) -> bytes:
    """Steps as bytes: how many siblings before, how many in all, the digests."""
    return b"".join(bytes((len(a), len(a) + len(b))) + b"".join(a) + b"".join(b) for a, b in steps)


def _unpacked(path: bytes) -> list[tuple[list[bytes], list[bytes]]]:
    out, at = [], 0
    while at < len(path):
        before, n = path[at], path[at + 1]
        digests = [path[i : i + SIZE] for i in range(at + 2, at + 2 + n * SIZE, SIZE)]
        out.append((digests[:before], digests[before:]))
        at += 2 + n * SIZE
    return out


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    tree, block = key
    leaves = list(rows.sort_values("place")["digest"])
    # A tree's only block ends at the tree's root, every other one LEVELS above its leaves, however few these are.
    up = LEVELS if block or len(leaves) == BLOCK else _levels(len(leaves))
    layout = lay_out(leaves, up)
    return pd.DataFrame({"tree": [tree], "block": [block], "up": [up], "n": [len(leaves)], "root": [layout[:SIZE]], "layout": [layout]})


def build(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Stored blocks(tree, block, up, n, root, layout) of leaves(tree, place, digest), tier by tier from the leaves on.

    Places number the leaves of each tree from 0 without gaps. A task holds one block at a time; the roots of a tier's
    blocks are the leaves of the next, until every tree has one block, after one tier for each LEVELS levels.
    """
    tiers = []
    while True:
        blocks = leaves.withColumn("block", F.floor(F.col("place") / BLOCK)).groupBy("tree", "block").applyInPandas(_block, _BLOCKS)
        tiers.append(stored(blocks, f"{name}-{len(tiers)}"))
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        leaves = tiers[-1].select("tree", F.col("block").alias("place"), F.col("root").alias("digest"))


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for b in batch.itertuples():
            rows = _rows(b.layout, b.n, b.up)
            yield pd.DataFrame({"tree": [b.tree] * b.n, "block": [b.block * BLOCK + i for i in range(b.n)], "path": [_packed(_steps(rows, i)) + b.path for i in range(b.n)]})


def paths(tiers: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """(tree, block, path): the siblings from the root of each block of the lowest tier to the root of its tree.

    The steps of above(tree, path), where given, follow. Each upper block is read once and gives a row for each of its
    children, so that a block's layout is never copied to them.
    """
    top = tiers[-1].select("tree", "block")
    found = top.withColumn("path", F.lit(b"")) if above is None else top.join(above, "tree").select("tree", "block", "path")
    for tier in reversed(tiers[1:]):
        found = tier.join(found, ["tree", "block"]).select("tree", "block", "up", "n", "layout", "path").mapInPandas(_children, _PATHS)
    return found


def _fold(digest: bytes, place: int, steps, memo: dict) -> bytes:
    """The root that a digest leads to. memo has the parents known so far, by the child's place and digest."""
    for i, (before, after) in enumerate(steps):
        key = (i, place // FAN**i, digest)
        if key not in memo:
            memo[key] = sha256(_join([*before, digest, *after])).digest()
        digest = memo[key]
    return digest


def _proofs(key: tuple, docs: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    if not len(docs):
        return pd.DataFrame(columns=[c.split()[0] for c in _PROOFS.split(", ")])
    b = next(blocks.itertuples())
    rows, upper, memo, out = _rows(b.layout, b.n, b.up), _unpacked(b.path), {}, []
    tail = _join(x for before, after in upper for x in (*before, *after))
    for d in docs.itertuples():
        steps = list(_steps(rows, d.place % BLOCK))
        proof = sha256(_join(x for before, after in steps for x in (*before, *after)) + tail).hexdigest()
        folded = _fold(d.digest if d.tampered is None else d.tampered, d.place, [*steps, *upper], memo)
        out.append((d.doc_id, d.digest.hex(), b.subroot.hex(), b.top.hex(), proof, folded.hex(), folded == b.top))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PROOFS.split(", ")])


def _piece(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row: doc_id, source, lang, n_chars and the text, each - if null, else its bytes, a colon and itself."""
    return F.unhex(F.sha2(F.concat(*(_piece(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _piece(text)), 256))


def manifest(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(leaves, tiers of the sources' trees, tiers of the tree over their subroots) of docs, all stored.

    leaves: tree, place, doc_id, digest, tampered. A tree's name is = and the source, or empty for the null source,
    so that trees ascend by source, bytewise, null first. Leaves ascend by doc_id, null first; rows of one doc_id by
    digest, so that repeated rows are leaves each. The order comes from a range shuffle and counts by partition: a
    source with a third of all rows is spread over tasks like any other. An empty table has no leaves and no trees.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(hit & (ascii_lower(F.col("text")) != F.col("text")), leaf(ascii_lower(F.col("text"))))
    slim = docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", leaf(F.col("text")).alias("digest"), tampered.alias("tampered"))
    leaves = stored(numbered(slim.repartitionByRange("tree", "doc_id", "digest"), ["tree"], ["doc_id", "digest"], "place", "leaves"), "numbered")
    tiers = build(leaves.select("tree", "place", "digest"), "tiers")
    subroots = tiers[-1].select(F.lit("").alias("all"), F.col("tree").alias("source"), F.col("root").alias("digest"))
    order = numbered(subroots.repartitionByRange("source"), ["all"], ["source"], "place", "subroots")
    order = stored(order.select(F.col("all").alias("tree"), "place", "source", "digest"), "order")
    return leaves, tiers, [order, *build(order.select("tree", "place", "digest"), "roots")]


def proofs(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    folded_root is computed anew from the leaf and its siblings; of documents whose doc_id has a crc32 that 5 divides,
    the leaf is that of the text with A-Z lower-cased. A null doc_id is not tampered with, and neither is a null text.
    Other columns are ignored, whatever their names; null values, repeated rows and the empty table are as in
    manifest(). What is stored on the way is deleted, but for the result.
    """
    with scratch(docs.sparkSession) as keep:
        leaves, tiers, (order, *roots) = manifest(docs)
        top = roots[-1].select("root").first()
        # The way from each subroot to the root: from the places in their block, then on from the block's root.
        found = roots[0].join(paths(roots), ["tree", "block"]).select("tree", "block", "up", "n", "layout", "path").mapInPandas(_children, _PATHS)
        above = stored(order.join(found.select(F.col("block").alias("place"), "path"), "place").select(F.col("source").alias("tree"), F.col("digest").alias("subroot"), "path"), "above")
        blocks = tiers[0].join(paths(tiers, above.select("tree", "path")), ["tree", "block"]).join(above.select("tree", "subroot"), "tree")
        blocks = blocks.withColumn("top", F.lit(bytes(top[0]) if top else b""))
        blocks = blocks.select("tree", "block", "up", "n", "layout", "path", "subroot", "top")
        # pandas would turn numbers with nulls among them into fractions.
        each = leaves.withColumn("block", F.floor(F.col("place") / BLOCK)).withColumn("doc_id", F.col("doc_id").cast("string"))
        rows = each.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(_proofs, _PROOFS)
        keep.append(out := stored(rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "proofs"))
    return out
