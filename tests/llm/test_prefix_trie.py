"""The prefix trie against a plain version."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from paperloom.llm import prefix_trie


def _id(role, text):
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, _id(role, text), (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + t[h:]
    members, kids = defaultdict(list), defaultdict(set)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
            if d < len(t):
                kids[tuple(t[:d])].add(tuple(t[: d + 1]))
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
    out = []
    for p, m in members.items():
        stop = sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], stop))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, node string, `t1.x` int, T1 int, level int, key binary"


def _conv(c, texts):
    return [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def _random(seed, convs, most):
    r = random.Random(seed)
    return [x for c in range(convs) for x in _conv(c, [f"{'é' * (i % 4)}{r.randint(0, 2)}" for i in range(r.randint(0, most))])]


CASES = {
    "empty": [],
    "random": _random(1, 450, 12),
    "eights": [x for c in range(60) for x in _conv(c, [str(i) if i < 15 else f"{c}" for i in range(7 + c % 19)])],
    "copies": [x for c in range(3000, 5400) for x in _conv(c, ["system", "hello", "world"])] + _random(2, 90, 3),
    "odd": [
        (1, None, None, None), (1, None, None, None), (1, 3, "", ""), (1, 3, "user", "b"), (1, 3, "user", "a"), (2, 3, "us", "era"), (None, 1, "user", "lost"),
        *_conv(100, ["x", "y"]), (107, 0, "user", "z"), (199, 5, "user", "X" * 100_000), (-5, 0, "user", "minus"), (2**60, 1, "user", "far"),
    ],
}


@pytest.mark.parametrize("name", CASES)
def test_trie(spark, name):
    rows = [(*r, "n", 1, 2, 3, b"k") for r in CASES[name]]
    found = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _plain(CASES[name])


def test_long_conversations(spark, monkeypatch):
    """Segments of segments: three rounds, and conversations that end at every place of a block and a segment."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 3)
    rows = [x for c in range(1, 40) for x in _conv(c, [str(i) if i < 90 or c % 3 else f"{i}-{c}" for i in range(70 + c)])] + [x for c in (41, 42) for x in _conv(c, ["t"] * (8 * 27 + 1))]
    found = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _plain(rows)
