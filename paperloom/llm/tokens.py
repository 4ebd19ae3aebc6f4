"""Token ids of whole texts with a public tokenizer, inside Python tasks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Pieces:
    """Strings by number, each with its token ids; ids of many are gathered at once."""

    def __init__(self, kind: np.dtype):
        self.number: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Put in names, none of which is there, each once."""
        self.number.update(zip(names, range(len(self.number), len(self.number) + len(names)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])

    def numbers(self, names: list[str]) -> np.ndarray:
        """The number of each string, -1 for an unknown one."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings one after another, and where each one's begin and the last one's end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], np.concatenate([[0], ends])


class WordTokenizer:
    """The ids of a tokenizer that never joins text over white space, by a bounded memory of words.

    The texts are cut at ASCII white space, at which such a tokenizer (word_bpe_49k.json) cuts as well, so that the
    ids of the words one after another are the ids of the text. The new words of a batch that have only ASCII and
    Latin-1 letters and marks are cut into the tokenizer's own pieces, and the new pieces go to its model together; any
    other word goes through the whole tokenizer.
    """

    #: Words of two pieces, letters and then marks or none.
    MARKS = ".,;:!?"
    LETTERS = f"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]*$"
    #: Words that PIECES cuts as the tokenizer does; special tokens are not among them.
    PLAIN = re.compile("(?!.*<[|])[!-~À-ÖØ-öø-ÿ]+")
    #: The tokenizer's pieces of such a word in lower case.
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel, WhitespaceSplit

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        # The model alone: pieces come in lower case, their bytes as the letters that stand for them, each but once.
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = Tokenizer(BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"]))
        self.model.pre_tokenizer = WhitespaceSplit()
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.closes = np.zeros(size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(model["end_of_word_suffix"])]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.pieces = Pieces(self.type), Pieces(self.type)
        self.pieces.add([""], np.zeros(0, self.type), np.zeros(1, np.int64))

    def _learn(self, fresh: list[str]) -> np.ndarray:
        """Give each word its number and ids: of the model's pieces where its cuts are known, else of the whole tokenizer."""
        words = pa.array(fresh, pa.string())
        plain = pc.match_substring_regex(words, self.LETTERS).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(words.filter(pa.array(plain)))
        letters = pc.utf8_rtrim(low, self.MARKS)
        marks = (pc.utf8_length(low).to_numpy() - pc.utf8_length(letters).to_numpy()).tolist()
        letters = letters.dictionary_encode()
        first = self._numbers(_strings(letters.dictionary))[letters.indices.to_numpy()]
        second = self._numbers([w[-k:] if k else "" for w, k in zip([fresh[i] for i in np.nonzero(plain)[0].tolist()], marks, strict=True)])
        ids, starts = self.pieces.gather(np.stack([first, second], 1).ravel())
        self.words.add([fresh[i] for i in np.nonzero(plain)[0].tolist()], ids, np.diff(starts[::2]))
        flat, counts, whole = [], [], []
        other = [fresh[i] for i in np.nonzero(~plain)[0].tolist()]
        for word in other:
            if self.PLAIN.fullmatch(word):
                pieces = self.PIECES.findall(word.lower())
                flat += pieces
                counts.append(len(pieces))
            else:
                # Under a name that no piece has.
                flat.append("\n" + word if word else "")
                counts.append(1)
                whole += [word] if word else []
        if whole:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
            self.pieces.add(["\n" + w for w in whole], np.array([i for x in ids for i in x], self.type), np.array([len(x) for x in ids], np.int64))
        ids, starts = self.pieces.gather(self._numbers(flat))
        self.words.add(other, ids, np.diff(starts[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]))
        # Plain words came first, then the others, each in their order.
        numbers = np.empty(len(fresh), np.int64)
        numbers[np.concatenate([np.nonzero(plain)[0], np.nonzero(~plain)[0]])] = np.arange(len(self.words.number) - len(fresh), len(self.words.number))
        return numbers

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces; new ones go to the model first."""
        numbers = self.pieces.numbers(pieces)
        unknown = np.nonzero(numbers < 0)[0].tolist()
        new = list(dict.fromkeys([pieces[i] for i in unknown]))
        if new:
            coded = [x if x.isascii() else x.translate(self.letters) for x in new]
            parts = [self.model.encode_batch_fast([" ".join(coded[i : i + 1000])], add_special_tokens=False)[0].ids for i in range(0, len(new), 1000)]
            ids = np.concatenate([np.array(x, self.type) for x in parts])
            # The last token of each piece, and no other one, closes a word.
            self.pieces.add(new, ids, np.diff(np.nonzero(self.closes[ids])[0], prepend=-1))
            numbers[unknown] = self.pieces.numbers([pieces[i] for i in unknown])
        return numbers

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and where each text's begin and the last one's end."""
        if len(self.words.number) + len(self.pieces.number) > self.limit:
            self._forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        numbers = np.zeros(0, np.int64)
        if len(words.dictionary):
            names = _strings(words.dictionary)
            numbers = self.words.numbers(names)
            fresh = np.nonzero(numbers < 0)[0].tolist()
            # A very long text is learned in parts, to bound the lists.
            for i in range(0, len(fresh), 100_000):
                numbers[fresh[i : i + 100_000]] = self._learn([names[k] for k in fresh[i : i + 100_000]])
            numbers = numbers[words.indices.to_numpy()]
        ids, starts = self.words.gather(numbers)
        bounds = split.offsets.to_numpy()
        return ids, starts[bounds - bounds[0]]


def _strings(words: pa.Array) -> list[str]:
    """Words, which have no line ends, by one long string: quicker than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().split("\n") if len(words) else []


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ended_ids(texts: pa.Array, path: str | None, end_id: int, size: int = 2_000_000, limit: int = 600_000) -> Iterator[np.ndarray]:
    """The ids and end_id of each text of a batch; texts of about so many bytes are looked at together.

    limit is how many words and pieces the worker remembers, at some 250 bytes each.
    """
    tok = tokenizer(path or default_path())
    tok.limit = limit
    end = np.array([end_id], tok.type if end_id < 1 << 16 else "<u4")
    first, total = 0, 0
    for i, n in enumerate([*pc.fill_null(pc.binary_length(texts), 0).to_pylist(), size]):
        if total + n > size and i > first or i == len(texts):
            ids, starts = tok.ids(texts.slice(first, i - first))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield np.concatenate([ids[a:b], end])
            first, total = i, 0
        total += n
