"""Language and packing against plain models: every feature by hand, every path by dynamic programming, exact least squares."""

from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from conftest import SF

from paperloom.llm import language_id, packing

WORD = 2**64 - 1


def _mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WORD
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WORD
    return x ^ (x >> 31)


def _features(word):
    """Buckets of the runs of one to four characters of an edged word, and of the word."""
    codes = [ord(c) for c in f"<{word}>"]
    for n in range(1, 5):
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = (h * 0x100000001B3 + c) & WORD
            yield _mixed((h + n) & WORD) % language_id.BUCKETS
    yield _mixed(sum(_mixed((c + (i << 32)) & WORD) for i, c in enumerate(codes)) & WORD) % language_id.BUCKETS


def _bare(text):
    return [b for w in (text or "").split() for b in map(language_id.plain, language_id.pieces(w)) if b]


class Plain:
    def __init__(self, rows):
        words = defaultdict(Counter)
        for text, lang in rows:
            words[lang].update((text or "").split())
        self.langs = sorted(k for k, v in words.items() if any(_bare(w) for w in v))
        self.counts, scripts = [], []
        for lang in self.langs:
            seen, share = Counter(), Counter()
            for w, n in words[lang].items():
                for b in _bare(w):
                    share[int(language_id.scripts_of([b])[0])] += n
                    for f in _features(b):
                        seen[f] += n**0.5
            self.counts.append(seen)
            scripts.append(share)
        self.total = [sum(c.values()) + 0.5 * language_id.BUCKETS for c in self.counts]
        fits = {s: [sh[s] >= 0.01 * sum(sh.values()) for sh in scripts] for s in range(len(language_id.NAMES))}
        self.allowed = {s: f if any(f) else [True] * len(f) for s, f in fits.items()}
        self.known = {}

    def scores(self, word):
        if word not in self.known:
            x = [sum(log(c[f] + 0.5) - log(t) for f in _features(word)) for c, t in zip(self.counts, self.total, strict=True)]
            ok = self.allowed[int(language_id.scripts_of([word])[0])]
            top = max(v for v, o in zip(x, ok, strict=True) if o)
            self.known[word] = [max(-language_id.MOST, v - top) if o else -language_id.MOST for v, o in zip(x, ok, strict=True)]
        return self.known[word]

    def predict(self, text):
        steps = [self.scores(b) for b in _bare(text)]
        if not steps:
            return "und", 0.0
        best, back = list(steps[0]), []
        for s in steps[1:]:
            top = max(range(len(best)), key=lambda k: (best[k], -k))
            came = [top if best[top] - language_id.SWITCH > v else k for k, v in enumerate(best)]
            best = [max(v, best[top] - language_id.SWITCH) + x for v, x in zip(best, s, strict=True)]
            back.append(came)
        state = max(range(len(best)), key=lambda k: (best[k], -k))
        path = [state]
        for came in reversed(back):
            path.append(state := came[state])
        n = Counter(path)
        top = max(n, key=lambda k: (n[k], -k))
        return self.langs[top], n[top] / len(path)


def test_language_of_whole_texts(spark):
    """Every document's language and score are those of the plain model, odd texts included."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r.text, r.lang) for r in docs.filter("doc_id % 4 <> 2").collect() if r.lang is not None and r.text is not None]
    plain = Plain(rows)
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == plain.langs
    texts = [r.text for r in docs.collect()]
    texts += [None, "", " \n", "123 !?", "a", "Жизнь 漢字", texts[0][:300] + " " + texts[1][:300] + " " + texts[2][:300], "x" * 500]
    out = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model, with_spans=False).orderBy("i").collect()
    found = [(r.lang_pred, r.score) for r in out]
    assert found == [plain.predict(t) for t in texts]


def _exact(a, h):
    """Non-negative least squares by active sets."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1]):
        w = a.T @ (h - a @ x)
        if free.all() or (w[~free] <= 1e-7).all():
            break
        free[np.argmax(np.where(free, -np.inf, w))] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], h, rcond=None)[0]
            if (z[free] > 0).all():
                break
            low = free & (z <= 0)
            x = x + (x[low] / np.maximum(x[low] - z[low], 1e-300)).min() * (z - x)
            free &= x > 1e-9
        x = z
    return x


def _used(combos, times, n):
    return sum((t * np.bincount(c, minlength=n) for c, t in zip(combos, times, strict=True)), np.zeros(n))


@pytest.mark.parametrize("seed", range(6))
def test_repeats_by_exact_least_squares(seed):
    """What rounded repeats leave of the histogram is little more than what the exact solution, rounded alike, leaves."""
    rng = np.random.default_rng(seed)
    window = 24
    histogram = rng.integers(0, 400, window + 1) * (rng.random(window + 1) < 0.7)
    histogram[0] = 0
    combos = packing.combinations(window, np.nonzero(histogram)[0])
    a = np.array([np.bincount(c, minlength=window + 1) for c in combos]).T.astype(float)
    a[0] = 0
    x = _exact(a, histogram.astype(float))
    assert (x >= 0).all() and (a.T @ (histogram - a @ x) <= 1e-4).all()
    times = packing.repeats(histogram, combos)
    left = histogram - _used(combos, times, window + 1)
    left[0] = 0
    assert (times >= 0).all() and (left >= 0).all()
    # Least squares may use a length more often than it is there; both solutions are held to what there is, most used first.
    rest = histogram.tolist()
    for k in np.argsort(-x, kind="stable").tolist():
        packing._taken(rest, tuple(i for i in combos[k].tolist() if i), round(x[k]))
    # The stopping rule moves each combination by at most that much, and a combination has at most three lengths.
    most = packing.REPEATS + packing.SHARE * histogram.sum() / len(histogram)
    assert np.linalg.norm(left) <= np.linalg.norm(rest) + 3 * most * np.sqrt(len(combos))


@pytest.mark.parametrize("seed", range(4))
def test_plan_by_enumeration(seed):
    """Every token of every piece has a slot of its own, slots are gapless, and one sequence at most isn't full."""
    rng = np.random.default_rng(seed)
    window = 20
    histogram = rng.integers(0, 30, window + 1) * (rng.random(window + 1) < 0.6)
    histogram[0] = 0
    plan = packing.Plan(window, histogram)
    slots = Counter()
    for length in range(1, window + 1):
        for rank in range(int(histogram[length])):
            parts = plan.places(length, rank)
            assert sum(p[0] for p in parts) == length and all(p[0] > 0 for p in parts)
            for n, sequence, offset in parts:
                slots.update((sequence, i) for i in range(offset, offset + n))
    assert max(slots.values(), default=1) == 1
    size = Counter(s for s, _ in slots)
    assert sorted(size) == list(range(len(size))) and sum(v < window for v in size.values()) <= 1
    assert all({i for s, i in slots if s == k} == set(range(v)) for k, v in size.items())
