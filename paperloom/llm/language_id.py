"""Language spans: script ranges narrow the candidates of a word, Viterbi over word scores with a penalty for switching."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import stored

#: First and last code point of the ranges of scripts; letters outside all of them are of the script "other".
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
NAMES = [*dict.fromkeys(s for s, _, _ in SCRIPTS), "other"]
#: Documents of the sample that the model is fitted on (about; chosen by a hash of text, the same at every size).
SAMPLE = 20_000
#: Features of words are hashed to so many numbers.
BUCKETS = 1 << 16
#: Log-odds that a change of language between two words costs, and the most that one word counts.
SWITCH, MOST = 8.0, 6.0
#: Words that a worker remembers.
KNOWN = 400_000
#: Characters of a piece at most.
LONGEST = 60
#: Words that are one piece as they are.
_WHOLE = re.compile(f"[\0-\u024f\u1e00-\u1eff]{{0,{LONGEST}}}")


_FIRST = np.array([first for _, first, _ in sorted(SCRIPTS, key=lambda x: x[1])])
_LAST = np.array([last for _, _, last in sorted(SCRIPTS, key=lambda x: x[1])])
_NUMBER = np.array([NAMES.index(s) for s, _, _ in sorted(SCRIPTS, key=lambda x: x[1])])
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&@/+-=_~0123456789«»“”„’…"


def _scripts(points: np.ndarray) -> np.ndarray:
    at = np.maximum(np.searchsorted(_FIRST, points, side="right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _NUMBER[at], len(NAMES) - 1)


def scripts_of(words: list[str]) -> np.ndarray:
    """The number of the script of each word's first character."""
    return _scripts(np.fromiter((ord(w[0]) for w in words), np.int64, len(words)))


def pieces(word: str) -> list[str]:
    """The word cut wherever its letters' script changes, and into parts of at most LONGEST characters; one piece, mostly.

    Characters that are no letters go with the letter before them, those at the start with the first letter. So every
    character of a text without spaces counts.
    """
    if _WHOLE.fullmatch(word):
        return [word]
    points = np.frombuffer(word.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letters = np.nonzero(np.fromiter(map(str.isalpha, word), bool, len(word)))[0]
    ends = {0, len(word)}
    if len(letters):
        script = _scripts(points[letters])
        ends |= set(letters[1:][script[1:] != script[:-1]].tolist())
    cuts = sorted(ends)
    return [word[i : min(i + LONGEST, b)] for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, LONGEST)]


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of all words, as pairs of (feature, word): the runs of one to four characters between edges, and the word."""
    edged = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(edged).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, edged), np.int64, len(edged))
    word = np.repeat(np.arange(len(words)), sizes)
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, 5):
        h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = word[: len(h)] == word[n - 1 :]
        out.append((_bucket(h[inside] + np.uint64(n)), word[: len(h)][inside]))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.add.reduceat(_mixed(codes + (place.astype(np.uint64) << np.uint64(32))), np.cumsum(sizes) - sizes)
    return [*out, (_bucket(whole), np.arange(len(words)))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (_mixed(h) % np.uint64(BUCKETS)).astype(np.int64)


def plain(word: str) -> str:
    """The word in lower case without marks and digits at its ends; empty if it has no letter."""
    word = word.strip(_MARKS).lower()
    if not word or word[0].isalpha() and word[-1].isalpha():
        return word
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while end > start and not word[end - 1].isalpha():
        end -= 1
    return word[start:end]


class Model:
    """Log-probabilities of features for each language, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        self.logs = (np.log(counts + 0.5) - np.log(total + 0.5 * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        # A language is a candidate for a script that one in a hundred of its words has; a script without one keeps all.
        self.allowed = (share >= 0.01).T
        self.allowed[~self.allowed.any(1)] = True

    def scores(self, words: list[str]) -> np.ndarray:
        """The scores of plain words for each language, none above zero or below -MOST."""
        x = np.zeros((len(words), len(self.langs)))
        for feature, word in features(words):
            for k in range(len(self.langs)):
                x[:, k] += np.bincount(word, self.logs[feature, k], len(words))
        allowed = self.allowed[scripts_of(words)]
        x -= np.where(allowed, x, -np.inf).max(1, keepdims=True)
        return np.where(allowed, np.clip(x, -MOST, 0), -MOST).astype(np.float32)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on docs(text, lang); rows with a null or wordless text, or a null lang, teach nothing.

    Of more than about sample rows, those count whose hash of text is lowest in proportion. Tasks count words, one row
    for each word and language of a partition, then features; the driver gets the sums of at most BUCKETS features
    for each language.
    """
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    part = min(1.0, sample / max(1, rows.count()))
    rows = rows.filter(F.xxhash64("text").cast("double") <= (2 * part - 1) * 2.0**63)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                seen.setdefault(lang.as_py(), Counter()).update(text.as_py().split())
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    words = stored(rows.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            rows: dict[str, tuple[list[str], list[int]]] = {}
            for lang, word, n in zip(*(b.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                words, numbers = rows.setdefault(lang, ([], []))
                bare = [x for x in map(plain, pieces(word)) if x]
                words += bare
                numbers += [n] * len(bare)
            for lang, (words, numbers) in ((k, v) for k, v in rows.items() if v[0]):
                x = seen.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                n = np.array(numbers, float)
                # A word counts by the root of its number, so that the commonest ones leave room for the others.
                for feature, word in features(words):
                    x[:BUCKETS] += np.bincount(feature, np.sqrt(n)[word], BUCKETS)
                x[BUCKETS:] += np.bincount(scripts_of(words), n, len(NAMES))
        for lang, x in seen.items():
            at = np.nonzero(x)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "at", "n"])

    sums = words.mapInArrow(count_features, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(pc.unique(sums["lang"]).to_pylist())
    x = np.zeros((BUCKETS + len(NAMES), len(langs)), np.float64)
    x[sums["at"].to_numpy(), pc.index_in(sums["lang"], pa.array(langs, pa.string())).to_numpy()] = sums["n"].to_numpy()
    return Model(langs, x[:BUCKETS], x[BUCKETS:].T)


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best languages of each step of several texts: scores (steps, texts, languages).

    All texts advance together, one step at a time; a path stays or comes from the best other state at the cost of
    switch. A shorter text has zeros at its end, which change no path.
    """
    steps, texts, langs = scores.shape
    best, came = np.zeros((texts, langs), np.float32), np.zeros((steps, texts), np.int16)
    moved = np.zeros((steps, texts, langs), bool)
    each = np.arange(texts)
    for t in range(steps):
        top = best.argmax(1)
        jump = best[each, top][:, None] - np.float32(switch)
        moved[t] = jump > best
        came[t] = top
        best = np.maximum(best, jump) + scores[t]
        best -= best.max(1, keepdims=True)
    path = np.zeros((steps, texts), np.int16)
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        path[t] = state
        state = np.where(moved[t, each, state] & (t > 0), came[t], state)
    return path


class Labels:
    """Labels whole texts by a model, piece by piece, with a bounded memory of words."""

    def __init__(self, model: Model, switch: float):
        self.model, self.switch = model, switch
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.place: dict[str, int] = {}
        self.several: list[np.ndarray] = []
        self.rows = np.zeros((1024, len(self.model.langs)), np.float32)
        self.n = 0

    def words(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By text, the number of each piece's scores in rows, -1 for one without a letter, and the number of its word."""
        split = [t.split() for t in texts]
        fresh = [w for w in set().union(*split) if w not in self.number]
        cut = [pieces(w) for w in fresh]
        bare = [plain(x) for c in cut for x in c]
        known = [b for b in dict.fromkeys(bare) if b and b not in self.place]
        # A very long text is scored in parts, to bound the lists of features.
        for i in range(0, len(known), 200_000):
            some = known[i : i + 200_000]
            if self.n + len(some) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self.rows) + len(some), self.rows.shape[1]), np.float32)])
            self.rows[self.n : self.n + len(some)] = self.model.scores(some)
            self.place.update(zip(some, range(self.n, self.n + len(some)), strict=True))
            self.n += len(some)
        at = iter([self.place[b] if b else -1 for b in bare])
        for w, c in zip(fresh, cut, strict=True):
            if len(c) == 1:
                self.number[w] = next(at)
            else:
                # A word of several pieces: below -1, and its pieces' numbers aside.
                self.number[w] = -2 - len(self.several)
                self.several.append(np.array([next(at) for _ in c]))
        return [self._expanded(np.fromiter(map(self.number.__getitem__, x), np.int64, len(x))) for x in split]

    def _expanded(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.arange(len(numbers))
        if not (numbers < -1).any():
            return numbers, words
        parts = [self.several[-2 - n] if n < -1 else [n] for n in numbers.tolist()]
        return np.concatenate(parts).astype(np.int64), np.repeat(words, [len(x) for x in parts])

    def label(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The language of each piece with letters, by text. Texts of similar length go together."""
        out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            group, end = [], at
            while end < len(order) and (len(group) + 1) * max(1, len(texts[order[end]])) <= 1_000_000 or end == at:
                group.append(order[end])
                end += 1
            at = end
            lengths = np.array([len(texts[i]) for i in group])
            if lengths.max():
                scores = np.zeros((lengths.max(), len(group), len(self.model.langs)), np.float32)
                for g, i in enumerate(group):
                    scores[: lengths[g], g] = self.rows[texts[i]]
                path = viterbi(scores, self.switch)
                for g, i in enumerate(group):
                    out[i] = path[: lengths[g], g]
        return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = True) -> DataFrame:
    """docs with lang_pred, score and spans; docs needs a column text, and only text is looked at.

    The steps are words, cut at 60 characters and where their script changes, so that whole texts count whatever their
    spaces. lang_pred is the language of most steps, of equals the first by name, and score its share of the steps with
    a letter. A null text, one without a letter, and any text for a model without languages is und with score 0. spans
    tells each stretch of one language: (lang, first, words), counted in words between white space, from the first
    word with a letter on; null unless asked for. Columns of docs with these names are replaced; repeated rows stay.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    span = T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())])
    fields = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, langs = Labels(shared.value, switch), shared.value.langs
        for whole in batches:
            for b in _parts(whole, "text", 8_000_000):
                if len(labels.number) > KNOWN:
                    labels.forget()
                texts = [x.as_py() or "" for x in b.column("text")]
                steps = labels.words(texts) if langs else [(np.zeros(0, np.int64),) * 2] * len(texts)
                found = labels.label([x[x >= 0] for x, _ in steps]) if langs else [x.astype(np.int16) for x, _ in steps]
                pred, score, spans = [], [], []
                for (x, words), path in zip(steps, found, strict=True):
                    share = np.bincount(path, minlength=1)
                    top = int(share.argmax())
                    pred.append(langs[top] if len(path) else "und")
                    score.append(float(share[top] / len(path)) if len(path) else 0.0)
                    spans.append(_spans(words[x >= 0], int(words[-1]) + 1 if len(words) else 0, path, langs) if with_spans else None)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, arrow)], fields.names)

    return docs.mapInArrow(run, fields)


def _parts(b: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose texts have about so many bytes together, or are one text."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
        if total and total + n > size:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    yield b.slice(start)


def _spans(places: np.ndarray, n: int, path: np.ndarray, langs: list[str]) -> list[dict]:
    """Stretches of one language over the n words of a text; places is the word of each step of path."""
    if not len(path):
        return []
    starts = np.nonzero(np.r_[True, path[1:] != path[:-1]])[0]
    first = places[starts]
    # A word in which the language changes belongs to both stretches' words but starts only one of them.
    return [{"lang": langs[path[s]], "first": int(f), "words": max(1, int(e - f))} for s, f, e in zip(starts, first, np.r_[first[1:], n], strict=True)]
