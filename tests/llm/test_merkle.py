"""The Merkle manifest against a plain version, and its address arithmetic against a recursive layout."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from paperloom.llm import merkle


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[2], row[3], row[4], text)))


def _tree(level):
    """Levels of digests from the leaves to the root."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _way(levels, i):
    steps = []
    for level in levels[:-1]:
        first = i - i % 16
        steps.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return steps


def _plain(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = _tree([trees[s][-1][0] for s in sources]) if sources else []
    out = []
    for k, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            steps = [*_way(trees[s], i), *_way(top, k)]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = _leaf(r, text)
            for a, b in steps:
                folded = _h(*a, folded, *b)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], _h(*(x for a, b in steps for x in (*a, *b))), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, tree string, `place.x` int, PLACE int"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _rows(n, source, first=0):
    return [(first + i, f"Text {i} É" if i % 7 else None, source, "en" if i % 3 else None, i if i % 4 else None, "t", 1, 2) for i in range(n)]


CASES = {
    "empty": [],
    "one": _rows(1, "a"),
    "one level": _rows(16, "a"),
    "a run of one": _rows(17, None),
    "a block": _rows(256, "a"),
    "a block and one": _rows(257, "a"),
    "many": _rows(4500, "hot") + _rows(3, None, 5000) + _rows(300, "é", 6000) + _rows(1, "", 7000) + [x for k in range(40) for x in _rows(2, f"s{k}", 8000 + 2 * k)],
    "odd": [(None, "A", "a", None, None, "", 0, 0), (None, "B", "a", None, None, "", 0, 0), (5, "", "a", None, None, "", 0, 0), (5, "", "a", None, None, "", 0, 0), (5, "X" * 100_000, "a", None, None, "", 0, 0), (2**60 + 1, "Z", "A", None, -3, "", 0, 0)],
}


@pytest.mark.parametrize("name", CASES)
def test_proofs(spark, name):
    rows = CASES[name]
    found = merkle.proofs(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == NAMES
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _plain(rows)


@pytest.mark.parametrize("height", [1, 2, 3, 4])
def test_layout(height):
    def lay(depth, index, height):
        """The nodes of a subtree in van Emde Boas order, as (depth, index)."""
        if height == 1:
            return [(depth, index)]
        top = height // 2
        out = lay(depth, index, top)
        for i in range(merkle.FAN**top):
            out += lay(depth + top, index * merkle.FAN**top + i, height - top)
        return out

    order = lay(0, 0, height)
    assert len(order) == merkle.nodes(height)
    where = {node: at for at, node in enumerate(order)}
    for depth in range(height):
        assert [int(x) for x in merkle.address(depth, np.arange(merkle.FAN**depth), height)] == [where[depth, i] for i in range(merkle.FAN**depth)]


def test_levels():
    for n in [*range(1, 600), 4096, 4097, 65536, 65537]:
        assert merkle._levels(n) == len(_tree(["0"] * n)) - 1
