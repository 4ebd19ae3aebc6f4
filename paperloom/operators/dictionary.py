"""Many fixed words looked for at once (J10-J12): one automaton over the dictionary, one scan for each distinct text."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words that a worker's automaton may hold, at some 100 bytes of memory each.
DICTIONARY_BYTES = 1_000_000


class Dictionary:
    """Words by which a text is searched: those that it contains, and those that contain it."""

    def __init__(self, words: list[str], around: bool = False):
        self.words = sorted(set(words))
        self.automaton = ahocorasick.Automaton()
        for w in self.words:
            if w:
                self.automaton.add_word(w, w)
        self.automaton.make_automaton()
        # A text lies in a word if it begins one of the word's ends, and those that it begins are neighbours in order.
        self.ends = sorted((w[i:], w) for w in self.words for i in range(len(w) + 1)) if around else []

    def inside(self, text: str) -> set[str]:
        """The words that a text contains; an empty word is in every text."""
        found = {w for _, w in self.automaton.iter(text)} if len(self.automaton) else set()
        return found | {""} if self.words[:1] == [""] else found

    def around(self, text: str) -> set[str]:
        """The words that contain a text."""
        out, i = set(), bisect_left(self.ends, (text, ""))
        while i < len(self.ends) and self.ends[i][0].startswith(text):
            out.add(self.ends[i][1])
            i += 1
        return out


def matches(texts: DataFrame, text: str, words: DataFrame, word: str, around: bool = False, most: int = DICTIONARY_BYTES) -> DataFrame:
    """Each distinct text with each distinct word that it contains or, if asked for, that contains it: (text, word).

    A null matches nothing. Up to a bound of bytes the words go to every task, which scans a text once, whatever their
    number; ends of words are held only for `around`, so their bytes count once for each place in the word. A larger
    dictionary is joined by Spark on the same condition, with the same rows.
    """
    wanted = words.select(F.col(f"`{word}`").alias("_word")).filter("_word is not null").distinct()
    size = F.octet_length("_word").cast("long")
    held = wanted.agg(F.sum(size * (size + 1) if around else size)).first()[0] or 0
    each = texts.select(F.col(f"`{text}`").alias("_text")).filter("_text is not null").distinct()
    if held > most:
        fits = F.col("_text").contains(F.col("_word"))
        fits = fits | F.col("_word").contains(F.col("_text")) if around else fits
        return each.join(wanted, fits).select(F.col("_text").alias(text), F.col("_word").alias(word))
    known = [r[0] for r in wanted.collect()]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Dictionary(known, around)
        for b in batches:
            rows = [(t, w) for t in b["_text"] for w in (d.inside(t) | d.around(t) if around else d.inside(t))]
            yield pd.DataFrame(rows, columns=["_text", "_word"])

    return each.mapInPandas(scan, "_text string, _word string").select(F.col("_text").alias(text), F.col("_word").alias(word))
