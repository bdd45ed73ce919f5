"""How the sources of a language differ in their terms, counted twice and exactly.

The first pass counts documents by term and keeps the terms of enough documents. Those are sorted and cut into shards of
bounded size, and every shard gets a minimal perfect hash with its keys beside it. The second pass looks each word up in the
broadcast shards, as many at a time as a stated number of bytes holds, compares the stored key, and adds one to the
word's slot in a dense array of its group. Slots follow the order of the terms, so that they also break ties.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .store import Stored
from .text import Memo, few, mixed, turn_to

#: Terms of a shard, mean terms of a hash's bucket, and displacements tried at a time.
SHARD, BUCKET, TRIED = 16_384, 4, 64
#: Bytes of shards that are broadcast together; unique terms, and slots, that a task holds before it passes counts on.
BROADCAST, HELD, HELD_SLOTS = 64 << 20, 200_000, 8_000_000
#: Slots of a language that are compared between its sources together.
BLOCK = 512

_TERMS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_STEP, _ONES = 0x9E3779B97F4A7C15, (1 << 64) - 1


def terms(utf8: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, only A-Z in lower case."""
    return utf8.lower().translate(_TERMS).split()


def spots(h: np.ndarray, displaced: np.ndarray, n: int) -> np.ndarray:
    return mixed(h + displaced * np.uint64(_STEP)) % np.uint64(n)


class PerfectHash:
    """Minimal perfect hash of distinct sorted keys, by hash and displace.

    Keys fall into buckets; the larger buckets first, each takes the first displacement that sends its keys to free places.
    A bucket of one key simply names its place (a negative entry). ``rank`` gives the key's number in sorted order.
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        for self.salt in count():  # until the 64-bit hashes are distinct, which they nearly always are
            h = np.array([xxhash.xxh3_64_intdigest(k, self.salt) for k in keys], np.uint64)
            if len(np.unique(h)) == n:
                break
        buckets = n // BUCKET + 1
        self.displaced, self.rank = np.zeros(buckets, np.int32), np.zeros(n, np.int32)
        bucket = (h % np.uint64(buckets)).astype(int)
        by, sizes = bucket.argsort(kind="stable"), np.bincount(bucket, minlength=buckets)
        starts, taken = sizes.cumsum() - sizes, np.zeros(n, bool)
        largest = (-sizes).argsort(kind="stable")
        for b in largest[:int((sizes > 1).sum())].tolist():
            own = by[starts[b]:starts[b] + sizes[b]]
            for tried in count(0, TRIED):
                at = spots(h[own], np.arange(tried, tried + TRIED, dtype=np.uint64)[:, None], n).astype(int)
                ordered = np.sort(at, axis=1)
                good = ~taken[at].any(1) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
                if good.any():
                    d = int(good.argmax())
                    break
            self.displaced[b], taken[at[d]], self.rank[at[d]] = tried + d, True, own
        alone = by[starts[sizes == 1]]
        free = np.flatnonzero(~taken)
        self.displaced[bucket[alone]], self.rank[free] = -1 - free, alone


class Shard:
    """A hash with its keys: the number of a term in sorted order, None for a term that is not among the keys."""

    def __init__(self, salt: int, displaced: bytes, rank: bytes, blob: bytes, ends: bytes):
        self.salt, self.blob = salt, blob
        self.displaced, self.rank = np.frombuffer(displaced, np.int32), np.frombuffer(rank, np.int32)
        self.ends = np.frombuffer(ends, np.int32)

    def find(self, term: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(term, self.salt)
        d = int(self.displaced[h % len(self.displaced)])
        if d < 0:
            at = -1 - d
        else:
            x = (h + d * _STEP) & _ONES
            x = ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) & _ONES
            x = ((x ^ x >> 29) * 0xC4CEB9FE1A85EC53) & _ONES
            at = (x ^ x >> 32) % len(self.rank)
        k = int(self.rank[at])
        return k if self.blob[self.ends[k]:self.ends[k + 1]] == term else None


class Slots:
    """Slots of a language's terms among the shards of one broadcast: ``low`` upwards; ``size`` for all other terms."""

    def __init__(self, rows: list):
        self.firsts, self.low = [bytes(r["first"]) for r in rows], rows[0]["base"]
        self.bases = [r["base"] - self.low for r in rows]
        self.size = self.bases[-1] + rows[-1]["n"]
        self.shards = [Shard(r["salt"], *[bytes(r[c]) for c in ("displaced", "rank", "blob", "ends")]) for r in rows]
        self.of = Memo(self._of)

    def _of(self, term: bytes) -> int:
        at = bisect_right(self.firsts, term) - 1
        k = self.shards[at].find(term) if at >= 0 else None
        return self.size if k is None else self.bases[at] + k


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("utf8"))


def frequent_terms(texts: DataFrame, least: int) -> DataFrame:
    """(lang, term binary) of the terms in at least ``least`` rows of (lang, utf8). Tasks add up before the shuffle."""
    def run(batches):
        turn_to("frequent_terms")
        held: dict[str, Counter] = {}
        for batch in (part for whole in batches for part in few(whole)):
            for lang, utf8 in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault(lang, Counter()).update(set(terms(utf8)))
            if sum(map(len, held.values())) > HELD:
                yield from passed(held)
                held = {}
        yield from passed(held)

    def passed(held):
        for lang, n in held.items():
            if not n:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())],
                                             names=["lang", "term", "n"])

    return texts.select("lang", "utf8").mapInArrow(run, "lang string, term binary, n long").groupBy("lang", "term").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def shards(kept: DataFrame, size: int = SHARD) -> DataFrame:
    """A row for each shard: lang, first (its first term), n, keys, and the hash in salt, displaced and rank.

    Terms are range-sorted, so that a shard never crosses a language or holds more than ``size`` terms, and no
    language gathers in one task.
    """
    schema = "lang string, first binary, n long, keys array<binary>, salt int, displaced binary, rank binary"
    arrow = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("n", pa.int64()), ("keys", pa.list_(pa.binary())),
                       ("salt", pa.int32()), ("displaced", pa.binary()), ("rank", pa.binary())])

    def run(batches):
        lang, keys = None, []
        for batch in batches:
            for own, term in zip(*[c.to_pylist() for c in batch.columns]):
                if keys and (own != lang or len(keys) == size):
                    yield built(lang, keys)
                    keys = []
                lang = own
                keys.append(term)
        if keys:
            yield built(lang, keys)

    def built(lang, keys):
        h = PerfectHash(keys)
        return pa.RecordBatch.from_pylist([dict(lang=lang, first=keys[0], n=len(keys), keys=keys, salt=h.salt,
                                                displaced=h.displaced.tobytes(), rank=h.rank.tobytes())], arrow)

    return kept.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, schema)


def together(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of items whose sizes add up to at most ``most``, or that are one item."""
    at = 0
    while at < len(sizes):
        upto, total = at + 1, sizes[at]
        while upto < len(sizes) and total + sizes[upto] <= most:
            total += sizes[upto]
            upto += 1
        yield at, upto
        at = upto


def recount(texts: DataFrame, sharded: DataFrame, most: int = BROADCAST) -> list[Stored]:
    """(lang, source, slot, n) of every occurring kept term, a table for each broadcast of shards with their ``base``."""
    spark = texts.sparkSession
    size = F.expr("4 * (n + 1) + length(displaced) + length(rank) + aggregate(keys, 0L, (a, k) -> a + length(k))")
    order = sharded.select("lang", "first", size.alias("bytes")).orderBy("lang", "first").collect()  # a row for each SHARD terms
    out = []
    for a, b in together([r["bytes"] for r in order], most):
        ends = [F.struct(F.lit(r["lang"]).alias("lang"), F.lit(bytes(r["first"])).alias("first")) for r in (order[a], order[b - 1])]
        rows: dict[str, list] = {}
        for r in sharded.where(F.struct("lang", "first").between(*ends)).orderBy("lang", "first").toLocalIterator():
            keys = list(map(bytes, r["keys"]))
            rows.setdefault(r["lang"], []).append({**{c: r[c] for c in ("first", "n", "base", "salt", "displaced", "rank")}, "blob": b"".join(keys),
                                                   "ends": np.cumsum([0, *map(len, keys)], dtype=np.int32).tobytes()})
        sent = spark.sparkContext.broadcast(rows)
        counted = texts.mapInArrow(_counter(sent), "lang string, source string, slot long, n long")
        out.append(Stored(counted.groupBy("lang", "source", "slot").agg(F.sum("n").alias("n")), "slots"))
        sent.destroy()
    return out


def _counter(sent):
    def run(batches):
        turn_to("recount")
        slots = {lang: Slots(rows) for lang, rows in sent.value.items()}
        dense: dict[tuple, np.ndarray] = {}
        for batch in (part for whole in batches for part in few(whole)):
            for lang, source, utf8 in zip(*[c.to_pylist() for c in batch.columns]):
                words = terms(utf8) if lang in slots else []
                if not words:
                    continue
                own = slots[lang]
                if (lang, source) not in dense:
                    if dense and sum(map(len, dense.values())) + own.size > HELD_SLOTS:
                        yield from passed(dense, slots)
                        dense = {}
                    dense[lang, source] = np.zeros(own.size + 1, np.int64)
                np.add.at(dense[lang, source], np.fromiter(map(own.of.__getitem__, words), np.int64, len(words)), 1)
        yield from passed(dense, slots)

    def passed(dense, slots):
        for (lang, source), n in dense.items():
            at = np.flatnonzero(n[:-1])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([source] * len(at)), pa.array(at + slots[lang].low),
                                                  pa.array(n[at])], names=["lang", "source", "slot", "n"])

    return run


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), exactly."""
    if n.max(initial=0) > 9 * 10 ** 9:
        n = n.astype(object)
    return (1 + 10 ** 9 * (n + 2) // (total + 2 * kept)).astype(np.int64)


def _compared(top: int):
    """Of a block of a language's slots: sums over it for each two sources, and the ``top`` terms of each source."""
    def run(key, counts, groups):
        lang, block = key[0].as_py(), key[1].as_py()
        sources = groups.column("source").to_pylist()
        by = np.array(sorted(range(len(sources)), key=lambda i: sources[i].encode()), int)
        sources = [sources[i] for i in by]
        totals, kept = groups.column("total").to_numpy()[by], groups.column("kept")[0].as_py()
        low = block * BLOCK
        n = np.zeros((len(sources), min(BLOCK, kept - low)), np.int64)
        line = {s: i for i, s in enumerate(sources)}
        row = np.fromiter(map(line.__getitem__, counts.column("source").to_pylist()), int, counts.num_rows)
        n[row, counts.column("slot").to_numpy() - low] = counts.column("n").to_numpy()
        p = np.stack([shares(x, int(t), kept) for x, t in zip(n, totals)])
        q = shares(n.sum(0), int(totals.sum()), kept)
        out = []
        for i, source in enumerate(sources):
            f = ((p[i + 1:] - p[i]) ** 2 // (p[i + 1:] + p[i])).sum(1)
            out.extend((lang, source, other, None, v) for other, v in zip(sources[i + 1:], f.tolist()))
            at = np.flatnonzero((n[i] > 0) & (p[i] > q))
            f = (p[i][at] - q[at]) ** 2 // (p[i][at] + q[at])
            best = np.lexsort((at, -f))[:top]
            out.extend((lang, source, None, low + s, v) for s, v in zip(at[best].tolist(), f[best].tolist()))
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        columns = zip(*out) if out else [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names="lang source other slot value".split())

    return run


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its distance to each other source (``pair``)
    and the ``top`` terms that it has more of than the language (``term``).

    Terms in at least ``least`` documents of a language are kept. A group of n counts gives a kept term the share
    p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); the value of two shares is floor((p - q)**2 / (p + q)), summed over all
    kept terms for pairs (0 without kept terms), taken with the whole language's q for terms with a count and p > q.
    Ranks start at 1, value descending, item ascending as UTF-8. Null text, lang and source count as empty; every
    row is a document, repeated or not; other columns are not read; an empty table gives no rows.
    """
    texts = _texts(docs, lang, source, text)
    kept = Stored(frequent_terms(texts, least), "frequent-terms")
    built = Stored(shards(kept.df), "term-shards")
    kept.discard()
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SHARD terms
    bases = built.df.select("lang", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    sharded = Stored(built.df.join(bases, ["lang", "first"]), "term-shards")
    built.discard()
    counted = recount(texts, sharded.df)
    empty = docs.sparkSession.createDataFrame([], "lang string, source string, slot long, n long")
    counts = empty
    for c in counted:
        counts = counts.unionByName(c.df)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = Stored(texts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(
        sharded.df.groupBy("lang").agg(F.sum("n").alias("kept")), "lang", "left").na.fill(0, ["total", "kept"]), "groups").df
    # Every block of slots gets all groups of its language, also those that use none of its terms.
    blocks = groups.where("kept > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(kept - 1) div {BLOCK}"))))
    compared = Stored(
        counts.withColumn("block", F.expr(f"slot div {BLOCK}")).groupBy("lang", "block").cogroup(blocks.groupBy("lang", "block")).applyInArrow(
            _compared(top), "lang string, source string, other string, slot long, value long"), "compared").df
    sums = compared.where("other IS NOT NULL").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.expr("array(struct(source, other AS item, value), struct(other AS source, source AS item, value))")).alias("p"))
    without = groups.where("kept = 0")
    others = without.groupBy("lang").agg(F.collect_list("source").alias("items"))
    same = without.join(others, "lang").select("lang", "source", F.explode("items").alias("item")).where("source <> item")
    pairs = both.select("lang", "p.*").unionByName(same.withColumn("value", F.lit(0).cast("long")))
    own = Window.partitionBy("lang", "source")
    pairs = pairs.withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))
    best = compared.where("slot IS NOT NULL").withColumn("rank", F.row_number().over(own.orderBy(F.desc("value"), "slot"))).where(F.col("rank") <= top)
    names = sharded.df.select("lang", "base", F.posexplode("keys").alias("k", "term")).select(
        "lang", (F.col("base") + F.col("k")).alias("slot"), F.col("term").cast("string").alias("item"))
    best = best.join(names, ["lang", "slot"]).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(best.select(columns))
