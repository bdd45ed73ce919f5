"""Frequent words of a corpus, counted by Spark, and codes for all words."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Memo

#: Unique words that a task holds before it passes their counts on.
HELD = 200_000
_SYMBOLS = frozenset(b"#*$%&|<>")
#: Codes of :func:`shape`.
SHAPES = 26


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): how often each word occurs in all rows of (utf8). Words stand between ASCII white space.

    Tasks add up what they read before the shuffle, so a very frequent word arrives as a few rows.
    """
    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for utf8 in batch.column(0).to_pylist():
                held.update(utf8.split())
                if len(held) > HELD:
                    yield packed(held)
                    held = Counter()
        if held:
            yield packed(held)

    def packed(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())],
                                          names=["word", "n"])

    return texts.select("utf8").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(texts: DataFrame, size: int) -> list[bytes]:
    """The ``size`` most frequent words, the smaller one first among equals: a fixed number of rows."""
    return [bytes(r["word"]) for r in word_counts(texts).orderBy(F.desc("n"), "word").limit(size).collect()]


def shape(word: bytes) -> int:
    """Class of a word by what it looks like: symbols, digits, or letters by case, last character and length."""
    if not _SYMBOLS.isdisjoint(word):
        return 0
    if word.isdigit():
        return 1
    case = 0 if word.islower() else 1 if word.istitle() else 2 if word.isupper() else 3
    marked = word[-1] < 128 and not word[-1:].isalnum()
    return 2 + case * 6 + marked * 3 + min(len(word) // 4, 2)


def coder(words: list[bytes], others, first: int = 0) -> Memo:
    """Codes of words: their rank from ``first`` on, and after those, ``others`` of the word."""
    ranks = {w: first + i for i, w in enumerate(words)}
    after = first + len(words)
    return Memo(lambda w: ranks[w] if w in ranks else after + others(w))
