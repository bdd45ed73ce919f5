"""Packing of token sequences: vector bins under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import gc
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import PRETOKEN_LATIN
from .text import Memo, as_bytes, batch_of, few, turn_to

END_OF_DOCUMENT = 2
#: Bytes of text that are tokenized together.
TOGETHER = 2 << 20
#: Parts that a worker remembers.
REMEMBERED = 900_000
#: New parts that are given to the library as one text, and what stands between them there.
JOINED, MARK = 500, "\x01"


@dataclass(frozen=True)
class Limits:
    """Most that a sequence holds."""

    tokens: int = 4096
    segments: int = 2048
    loss: int = 4096


def simple(text: str) -> bool:
    """Whether PRETOKEN_LATIN tells the parts: Latin-1, without special strings and the mark."""
    if "<|" in text or MARK in text:
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Ids of whole texts from the tokenizers library, which sees each remembered part of a text once.

    The library cuts a text into parts that never join, so a text's ids are those of its parts. New parts go to the
    library many at a time, with a mark between them whose one id tells where each ends. Texts for which
    :func:`simple` does not hold go there whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark, = self.encode([MARK])[0].tolist()
        self.parts = Memo()  # filled many at a time

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, found: set[str]) -> None:
        new = [p for p in found if p not in self.parts]
        if len(self.parts) + len(new) > REMEMBERED:
            self.parts.clear()
            new = list(found)
        for i in range(0, len(new), JOINED):
            group = new[i:i + JOINED]
            ids, = self.encode([f" {MARK} ".join(group)])
            raw, ends = ids.tobytes(), np.flatnonzero(ids == self.mark) * 4
            self.parts.update(zip(group, [raw[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(raw)])]))

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        read = [t.decode("utf-8", "replace") for t in texts]
        cut = [PRETOKEN_LATIN.findall(t.lower()) if simple(t) else None for t in read]
        collecting = gc.isenabled()
        gc.disable()  # many small objects without cycles
        self.learn(set().union(*[c for c in cut if c]))
        if collecting:
            gc.enable()
        for t, c in zip(read, cut):
            yield self.encode([t])[0].tobytes() if c is None else b"".join(map(self.parts.__getitem__, c))


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Pool:
    """What waits to be placed: a demand on each limit, as parts of what a sequence holds."""

    def __init__(self, limits: Limits, size: int):
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.demand = np.zeros((size, 3))
        self.items: list = [None] * size
        self.free = list(range(size))

    def __len__(self) -> int:
        return len(self.items) - len(self.free)

    def put(self, item: Item) -> None:
        at = self.free.pop()
        self.items[at] = item
        self.demand[at] = item.demand() / self.capacity

    def take(self, at: int) -> Item:
        item, self.items[at] = self.items[at], None
        self.demand[at] = 0
        self.free.append(at)
        return item

    def best(self, room: np.ndarray) -> int | None:
        """The item that fits and has the largest dot product with the room left; None if none fits."""
        fits = (self.demand <= room + 1e-12).all(1) & (self.demand[:, 0] > 0)
        if not fits.any():
            return None
        return int(np.where(fits, self.demand @ room, -1.0).argmax())

    def longest(self) -> int:
        return int(self.demand[:, 0].argmax())


@dataclass
class Item:
    """What is left of an example: its ids from ``start`` on. The first ``masked`` ids bear no loss."""

    doc_id: int | None
    ids: bytes
    masked: int = 0
    start: int = 0

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    @property
    def left(self) -> int:
        return self.tokens - self.start

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.masked, self.start))

    def demand(self) -> np.ndarray:
        return np.array([self.left, 1, self.loss(self.left)], float)


class Packer:
    """Fills one sequence after the other from a bounded pool.

    The item with the largest dot product of demand and remaining room goes next. When none fits, the longest is
    cut to the room. What the last sequence holds is cut into lengths that are powers of two, which need no padding.
    """

    def __init__(self, limits: Limits, first_sequence: int, pool: int = 256):
        self.limits, self.pool, self.sequence, self.size = limits, Pool(limits, pool), first_sequence, pool
        self.open: list[tuple[Item, int, int]] = []
        self.used = np.zeros(3)

    def add(self, item: Item) -> Iterator[tuple]:
        while len(self.pool) >= self.size - 1:
            yield from self.step()
        self.pool.put(item)

    def end(self) -> Iterator[tuple]:
        while len(self.pool):
            yield from self.step()
        yield from self.flush()

    def step(self) -> Iterator[tuple]:
        """Places one item or a part of one; gives the pieces of a sequence once it is full."""
        room = self.pool.capacity - self.used
        at = self.pool.best(room / self.pool.capacity)
        if at is None and (room < 1).any():
            yield from self.flush()
            return
        item = self.pool.take(self.pool.longest() if at is None else at)
        length = item.left
        if at is None:
            length = min(length, int(room[0]), int(room[2]) + max(0, item.masked - item.start))
        self.open.append((item, item.start, length))
        self.used += (length, 1, item.loss(length))
        item.start += length
        if item.left:
            self.pool.put(item)
        if self.used[0] >= self.limits.tokens:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        total = int(self.used[0])
        whole = total == self.limits.tokens
        sizes = [total] if whole else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        offset, sizes = 0, iter(sizes)
        size = next(sizes, 0)
        for item, start, length in self.open:
            while length:
                part = min(length, size - offset)
                crc = zlib.crc32(item.ids[4 * start:4 * (start + part)])
                yield (item.doc_id, start, part, crc, item.tokens, self.sequence, offset)
                start, length, offset = start + part, length - part, offset + part
                if offset == size:
                    offset, size = 0, next(sizes, 0)
                    self.sequence += 1
        self.open, self.used = [], np.zeros(3)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), masked: str | None = None, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of documents in sequences within ``limits``; every id, an end-of-document id included, lies in one piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each partition of the input fills its
    own sequences from a bounded pool, so nothing is shuffled; sequence ids hold the partition's number above 2**32.
    ``masked`` names a column with the number of leading ids that bear no loss (null: 0). A null text is empty and
    is one piece, its end. Null and repeated ids are packed like others. ``path`` must be readable on every executor.
    """
    columns = [doc_id] + ([masked] if masked else [])
    schema = to_arrow_schema(StructType.fromDDL(PIECES))
    end = np.array([END_OF_DOCUMENT], "<u4").tobytes()

    def run(batches):
        turn_to("packing")
        packer = Packer(limits, TaskContext.get().partitionId() << 32)
        out = []
        for batch in (part for whole in batches for part in few(whole, 1024)):
            *ids, texts = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size < TOGETHER):
                    size += len(texts[upto])
                    upto += 1
                for i, tokens in zip(range(at, upto), word_ids(path).of(texts[at:upto])):
                    out.extend(packer.add(Item(ids[0][i], tokens + end, (ids[1][i] or 0) if masked else 0)))
                at = upto
                if len(out) >= 4096:
                    yield batch_of(out, schema)
                    out = []
        out.extend(packer.end())
        if out:
            yield batch_of(out, schema)

    return as_bytes(docs, *columns, text=text).mapInArrow(run, PIECES)
