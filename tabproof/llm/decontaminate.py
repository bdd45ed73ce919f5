"""Benchmark items inside documents: SimHash of item-sized windows, blocks of bits, then exact similarity."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import stored
from .text import as_bytes, by_row, mixed, plain_words, shingles, word_hashes

SHINGLE = 5
#: Bits of a table of the items' shingles: 2 MB, whatever the number of items.
GATE_BITS = 1 << 24
BITS, BLOCKS = 64, 8


def item_table(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, words, f, hs): words, SimHash and sorted shingle hashes of each item that has a word."""
    def prepare(i, utf8):
        words = plain_words(utf8)
        if words:
            h = shingles(word_hashes(words), SHINGLE)
            yield i, len(words), simhash(h), np.sort(h).tobytes()

    return by_row(as_bytes(items.where(F.col(item_id).isNotNull()), item_id, text=text), prepare,
                  "item_id long, words int, f long, hs binary")


def simhash(h: np.ndarray) -> int:
    """64 bits, each the majority of the shingles' bits, a shingle as often as it occurs; signed."""
    ones = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(
        0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger ones, for two lists of shingles with repeats."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return (x & y).total() / max(1, (x | y).total())


def spots(h: np.ndarray, words: int = 0) -> np.ndarray:
    """Places of shingles in a gate; with ``words``, in the gate for shingles of items of that many words."""
    return (mixed(h + np.uint64(words * 0x9E3779B97F4A7C15 % 2 ** 64)) % np.uint64(GATE_BITS)).astype(np.int64)


def gate(table: DataFrame, sized: bool) -> bytes:
    """A bit for each place that an item's shingle falls on, in a table of fixed size."""
    def places(words, hs):
        return [(int(x),) for x in np.unique(spots(np.frombuffer(hs, np.uint64), words if sized else 0))]

    rows = by_row(table.select("words", "hs"), places, "spot long").groupBy(F.expr("spot div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 AS INT))")).alias("w")).collect()
    out = np.zeros(GATE_BITS // 64, np.int64)
    for row in rows:
        out[row["at"]] = row["w"]
    return out.tobytes()


def passes(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def block_keys(f: int, reach: int) -> list[tuple[int, int]]:
    """(block, bits) of all values within ``reach`` bits of each 8-bit block of a fingerprint."""
    width = BITS // BLOCKS
    near = [0] + [1 << i for i in range(width)] * (reach > 0)
    if reach > 1:
        near += [1 << i | 1 << j for i in range(width) for j in range(i)]
    f &= (1 << BITS) - 1
    return [(b, (f >> (b * width) & (2 ** width - 1)) ^ x) for b in range(BLOCKS) for x in near]


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, radius: int = 20, doc_id: str = "doc_id",
                 text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): the best window of a document for each item in it.

    A window has as many words as the item; a document with fewer is one window, as a whole. It counts if its SimHash differs in at most ``radius`` bits and the
    weighted Jaccard similarity of the five-word shingles is at least ``similarity`` (shorter items are one shingle).
    Words have no punctuation and no letter case. The least similarity tells how many shingles of a window must be some
    shingle of an item of its size; windows with fewer, which cannot count, are passed over with the help of two tables
    of bits of fixed size, right for any number of items. Of ``radius`` differing bits, some 8-bit block has at
    most ``radius // 8``, so items and windows meet on a block, the items put down under all values that near:
    every fingerprint within the radius is found. Windows of equal text are compared once. Null ids and null or
    wordless texts have no windows; rows that share an id are one document; equal items each get their row; other
    columns are not read.
    """
    if not 0 <= radius < 3 * BLOCKS:
        raise ValueError("radius: 0 to 23")
    table = stored(item_table(items, item_id, item_text), "items")
    sizes = [r["words"] for r in table.select("words").distinct().collect()]
    context = docs.sparkSession.sparkContext
    both = [context.broadcast(gate(table, sized)) for sized in (False, True)]
    texts = as_bytes(docs.where(F.col(doc_id).isNotNull()), doc_id, text=text, names=("doc_id",))

    def windows(i, utf8):
        hashes = word_hashes(plain_words(utf8))
        some, sized = (np.frombuffer(g.value, np.uint64) for g in both)
        found: dict[int, tuple] = {}
        for n in sizes:
            k = min(n, SHINGLE)
            size = min(n, len(hashes))
            if size < k:
                continue
            if k not in found:
                h = shingles(hashes, k)
                found[k] = h, np.flatnonzero(passes(some, spots(h)))
            h, hits = found[k]
            m = size - k + 1
            least = int(np.ceil(similarity * (m + n - k + 1) / (1 + similarity) - 1e-9))
            if least > m or len(hits) < least:
                continue
            hits = hits[passes(sized, spots(h[hits], n))]
            if len(hits) < least:
                continue
            held = np.zeros(len(h) + 1, np.int64)
            held[hits + 1] = 1
            held = np.cumsum(held)
            for start in np.flatnonzero(held[m:] - held[:-m] >= least).tolist():
                own = h[start:start + m]
                yield i, start, size, n, simhash(own), np.sort(own).tobytes()

    found = stored(by_row(texts, windows, "doc_id long, start int, size int, words int, f long, hs binary").withColumn(
        "c", F.xxhash64("words", "hs")), "windows")
    distinct = found.groupBy("c").agg(*[F.first(x).alias(x) for x in ("words", "f", "hs")])
    keyed = by_row(table.select("item_id", "words", "f"), lambda i, n, f: [(i, n, f, *x) for x in block_keys(f, radius // BLOCKS)],
                   "item_id long, words int, g long, block int, bits int")
    dealt = distinct.select("c", "words", "f", F.posexplode(F.array(*[
        F.expr(f"cast(shiftrightunsigned(f, {8 * b}) & 255 AS INT)") for b in range(BLOCKS)])).alias("block", "bits"))
    near = dealt.join(keyed, ["words", "block", "bits"]).withColumn(
        "distance", F.expr("cast(bit_count(f ^ g) AS INT)")).where(F.col("distance") <= radius).select(
        "c", "item_id", "distance").distinct()

    def verify(c, i, distance, ours, theirs):
        alike = weighted_similarity(np.frombuffer(ours, np.uint64), np.frombuffer(theirs, np.uint64))
        if alike >= similarity:
            yield c, i, distance, alike

    alike = by_row(
        near.join(distinct.select("c", "hs"), "c").join(table.selectExpr("item_id", "hs AS theirs"), "item_id")
        .select("c", "item_id", "distance", "hs", "theirs"), verify,
        "c long, item_id long, distance int, similarity double")
    return found.select("c", "doc_id", "start", "size").join(alike, "c").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("similarity", F.expr("-start").alias("s"), "size", F.expr("-distance").alias("d"))).alias("w")).select(
        "doc_id", "item_id", F.expr("-w.s").alias("start_word"), F.col("w.size").alias("n_words"),
        F.expr("-w.d").alias("distance"), "w.similarity")
