"""Token counts by byte-pair merging, without making the tokens."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache

import regex
from pyspark.sql import DataFrame

from .text import Memo, as_bytes, by_row

END = "</w>"
#: The pre-tokenizer's pattern in the tokenizer's file, fixed value; it states white space as the library's own \\s.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]"
    r"|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+")
#: The same for text in Latin-1, in lower case.
PRETOKEN_LATIN = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\t-\r \x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def is_latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0100"


def lower_each(text: str) -> str:
    """Lower case letter by letter: a final sigma is no special case."""
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def pretokens(word: str) -> list[str]:
    """The parts of a text that are merged apart from each other, in lower case and composed form."""
    if is_latin(word):
        return PRETOKEN_LATIN.findall(word.lower())
    return PRETOKEN.findall(lower_each(unicodedata.normalize("NFC", word)))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable Latin-1, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b if b in printable else free))
        free += b not in printable
    return letters


class MergeTable:
    """Ranks of the pairs and the special strings of a tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, known = held["model"], held["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.letters = byte_letters()
        self.known = known
        self.special = [t["content"] for t in held["added_tokens"]]
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.of_part = Memo(self.part_tokens)
        self.of_word = Memo(self.word_tokens)

    def symbols(self, part: str) -> list[str]:
        out = [self.letters[b] for b in part.encode()]
        out[-1] += END
        return out

    def part_tokens(self, part: str) -> int:
        """Initial symbols minus merges.

        A heap holds the adjacent pairs by rank, then place; the symbols are a linked list. An entry whose
        symbols have changed since is passed over when popped.
        """
        symbols = self.symbols(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            rank = ranks.get((symbols[i], symbols[i + 1]))
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((symbols[i], symbols[k]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0:
                rank = ranks.get((symbols[h], symbols[i]))
                if rank is not None:
                    heapq.heappush(heap, (rank, h, symbols[h], symbols[i]))
        return n - merges

    def word_tokens(self, word: bytes) -> int:
        """Tokens of a run without ASCII white space; a special string in it is one token."""
        text = word.decode("utf-8", "replace")
        n = 0
        if self.marks and "<" in text:
            n = len(self.marks.findall(text))
            if n:
                return n + sum(self.of_part[p] for piece in self.marks.split(text) for p in pretokens(piece))
        return sum(self.of_part[p] for p in pretokens(text))

    def count(self, utf8: bytes) -> int:
        return sum(map(self.of_word.__getitem__, utf8.split()))


@cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``path`` names a byte-level BPE file with word ends, readable on every executor. White space never joins what
    it parts, so runs between ASCII white space are counted by themselves and remembered, within a bound, by the worker.
    A null text counts as empty, with no tokens; null and repeated ids stay as they are; other columns are not read.
    """
    def count(i, utf8):
        n = merge_table(path).count(utf8)
        return [(i, len(utf8), n, n > limit)]

    return by_row(as_bytes(docs, doc_id, text=text), count, f"{doc_id} long, n_bytes long, n_tokens long, over_limit boolean")
