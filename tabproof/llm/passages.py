"""Passages that repeat across documents, found by chaining shared seeds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabproof.operators.running import greatest_before

from .store import Bucketed, Stored, stored
from .text import as_bytes, by_row, few, mixed, shingles, spaced_codes, word_hashes

#: Words of a seed; in WINDOW consecutive seeds the least hash is kept, so a shared run of SEED + WINDOW - 1 words shares one.
SEED, WINDOW = 5, 16
#: Matches on one diagonal are one run while no more words than this lie between them.
GAP = 40
#: What a chain pays for each word that it skips on either side.
PRICE = 0.1
#: Words beyond a chain's outer seeds that its alignment reads at first; a passage that reaches the end of them is aligned
#: again with WIDER times as many.
MARGIN, WIDER = 64, 16
#: Occurrences of a seed that one window sorts; those of others are range-sorted over several partitions, for the same matches.
HOT = 2048
#: For what is joined with the bucketed texts: their rows then need no sorting.
HASHED = "shuffle_hash"
#: Ranges that are cut from one document in one row.
RANGES = 256


def slide(h: np.ndarray, w: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each run of ``w`` values."""
    size = 1
    while size * 2 <= w:
        h = least(h[:-size], h[size:])
        size *= 2
    return least(h[:len(h) - (w - size)], h[w - size:]) if size < w else h


def seeds(words: list[bytes], seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the seeds that have the least hash of some ``window`` consecutive ones."""
    return seeds_of(word_hashes(words), seed, window)


def seeds_of(hashes: np.ndarray, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The :func:`seeds` of words with these hashes."""
    if len(hashes) < seed:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = shingles(hashes, seed)
    w = min(window, len(h))
    order = mixed(h)
    edge = np.zeros(w - 1, np.uint64)
    kept = slide(np.concatenate((edge, slide(order, w, np.minimum), edge)), w, np.maximum) == order
    places = np.flatnonzero(kept)
    return places, h[places]


class Fenwick:
    """Largest (score, item) over a prefix of keys."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (n + 1)

    def put(self, key: int, value: tuple[float, int]) -> None:
        key += 1
        while key < len(self.best):
            if value > self.best[key]:
                self.best[key] = value
            key += key & -key

    def upto(self, key: int) -> tuple[float, int]:
        """Over keys below ``key``."""
        out = (-np.inf, -1)
        while key > 0:
            if self.best[key] > out:
                out = self.best[key]
            key -= key & -key
        return out


def runs(x: np.ndarray, y: np.ndarray, seed: int = SEED, gap: int = GAP) -> np.ndarray:
    """Matches on one diagonal, each within ``gap`` words of the one before, as rows (x, y, end of x, matched words)."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    step = np.diff(x)
    new = np.concatenate(([True], (np.diff(x - y) != 0) | (step > gap)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(x)])) - 1
    gain = np.where(new, seed, np.minimum(np.concatenate(([0], step)), seed))
    covered = np.concatenate(([0], np.cumsum(gain)))
    return np.column_stack((x[first], y[first], x[last] + seed, covered[last + 1] - covered[first]))


def chains(x: list[int], y: list[int], seed: int = SEED, gap: int = GAP) -> Iterator[list[tuple[int, int, int, int]]]:
    """Collinear chains, as runs (x, y, end of x, matched words), of seed matches at x here and y there.

    Runs are taken in the order of x. A run may follow any that ends before it on both sides, for its score less
    PRICE for each skipped word; put as score plus PRICE times the ends, the best is a prefix maximum over the ends in
    y, which a Fenwick tree holds. Chains, from the best on, don't share runs.
    """
    rows = runs(np.asarray(x, np.int64), np.asarray(y, np.int64), seed, gap)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    n, ends_y = len(rows), rows[:, 1] + rows[:, 2] - rows[:, 0]
    if n == 1:
        yield [tuple(rows[0].tolist())]
        return
    keys = np.unique(ends_y)
    tree, slot = Fenwick(len(keys)), np.searchsorted(keys, ends_y).tolist()
    upto = np.searchsorted(keys, rows[:, 1] + seed - 1, side="right").tolist()
    by_end = np.argsort(rows[:, 2], kind="stable").tolist()
    rows, ends_y = rows.tolist(), ends_y.tolist()
    score, before, entered = [0.0] * n, [-1] * n, 0
    for i, (a, b, end, matched) in enumerate(rows):
        while entered < n and rows[by_end[entered]][2] <= a + seed - 1 and by_end[entered] < i:
            j = by_end[entered]
            tree.put(slot[j], (score[j] + PRICE * (rows[j][2] + ends_y[j]), j))
            entered += 1
        best, j = tree.upto(upto[i])
        score[i] = float(matched)
        if j >= 0 and rows[j][1] < b and best - PRICE * (a + b) > 0:
            score[i], before[i] = matched + best - PRICE * (a + b), j
    taken = [False] * n
    for i in sorted(range(n), key=lambda k: -score[k]):
        path = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            path.append(tuple(rows[i]))
            i = before[i]
        if path:
            yield path[::-1]


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words from the start on."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def aligned(chain: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, margin: int = MARGIN) -> list[tuple[int, int, int, int, int]]:
    """The chain's alignment as steps (x, y, words of x, words of y, weight): +1 for an equal word, -4 for another.

    Runs, and ``margin`` words before the first and after the last, are compared word by word. Between two of them, what
    equals along the first one's diagonal and back along the second one's is taken; the rest is different.
    """
    x, y, _ = chain[0]
    back = min(margin, x, y)
    at_x, at_y = x - back, y - back
    steps = []

    def along(n: int) -> None:
        nonlocal at_x, at_y
        same = a[at_x:at_x + n] == b[at_y:at_y + n]
        n = len(same)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(same)) + 1, [n])).tolist()
        for u, v in zip(cuts, cuts[1:]):
            if v > u:
                steps.append((at_x + u, at_y + u, v - u, v - u, v - u if same[u] else -4 * (v - u)))
        at_x, at_y = at_x + n, at_y + n

    along(back)
    for x, y, end in chain:
        late = max(0, at_x - x, at_y - y)
        x, y = x + late, y + late
        if end <= x:
            continue
        most = min(x - at_x, y - at_y)
        ahead = _equal(a[at_x:at_x + most], b[at_y:at_y + most])
        along(ahead)
        back = _equal(a[x - most + ahead:x][::-1], b[y - most + ahead:y][::-1])
        dx, dy = x - back - at_x, y - back - at_y
        if dx or dy:
            steps.append((at_x, at_y, dx, dy, -4 * max(dx, dy)))
            at_x, at_y = at_x + dx, at_y + dy
        along(end - at_x)
    along(min(margin, len(a) - at_x, len(b) - at_y))
    return steps


def hopeless(run: tuple[int, int, int], a: np.ndarray, b: np.ndarray, least: int, margin: int) -> bool:
    """Whether a run's alignment has too few equal words for a passage of ``least``, and none at an end where it may go on.

    More than four fifths of a passage's words are equal.
    """
    x, y, end = run
    back = min(margin, x, y)
    n = min(end - x + back + margin, len(a) - x + back, len(b) - y + back)
    same = a[x - back:x - back + n] == b[y - back:y - back + n]
    return 5 * np.count_nonzero(same) <= 4 * least and not (same[0] and back >= margin) and not (
        same[-1] and min(len(a) - end, len(b) - (y + end - x)) >= margin)


def best_parts(steps: list[tuple[int, int, int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """All maximal scoring parts of an alignment, as (start, end, start there, end there, equal words).

    As an equal word weighs +1 and another -4, at least four fifths of each part are equal. Linear time: a part is
    merged into the last one that starts lower, for as long as that ends lower too.
    """
    parts: list[list] = []
    total = 0
    for k, step in enumerate(steps):
        low, total = total, total + step[4]
        if step[4] <= 0:
            continue
        part = [k, k, low, total]
        while True:
            j = len(parts) - 1
            while j >= 0 and parts[j][2] >= part[2]:
                j -= 1
            if j < 0 or parts[j][3] >= part[3]:
                break
            part = [parts[j][0], part[1], parts[j][2], part[3]]
            del parts[j:]
        parts.append(part)
    for first, last, _, _ in parts:
        (x, y, *_), (u, v, n, m, _) = steps[first], steps[last]
        yield x, u + n, y, v + m, sum(s[4] for s in steps[first:last + 1] if s[4] > 0)


def places_of(df: DataFrame, fn: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, at, h): the places and hashes that ``fn`` finds in each row; the row's first value is doc_id, the others go to ``fn``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("h", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in few(batch):
                ids, *rest = (c.to_pylist() for c in part.columns)
                found = [fn(*values) for values in zip(*rest)]
                if found:
                    at, h = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(np.asarray(ids, np.int64), [len(x) for x, _ in found])), pa.array(at.astype(np.int32)),
                        pa.array(h.view(np.int64))], schema=arrow)

    return df.mapInArrow(run, "doc_id long, at int, h long")


def coded_texts(texts: DataFrame, least: int) -> Bucketed:
    """(doc_id, words, places, hashes) of the texts with ``least`` words or more, in buckets of doc_id: 32 bits for each word, and the seeds."""
    def code(i, utf8):
        codes = spaced_codes(utf8)
        if len(codes) >= least:
            at, h = seeds_of(codes)
            yield i, codes.astype(np.uint32).tobytes(), at.astype(np.int32).tobytes(), h.tobytes()

    return Bucketed(by_row(texts, code, "doc_id long, words binary, places binary, hashes binary", packed=512), "doc_id", "passage-words")


def shared_seeds(texts: DataFrame) -> DataFrame:
    """(doc_id, at, h, n, first_id): the places of seeds that several documents have, how many places these are, and the first document."""
    found = Stored(places_of(texts.select("doc_id", "places", "hashes"), lambda at, h: (
        np.frombuffer(at, np.int32), np.frombuffer(h, np.uint64))), "passage-seeds")
    shared = found.df.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    # A plain table, so that Spark can split a hot seed's rows.
    kept = Stored(shared.select("h", "n", "first_id"), "passage-shared")
    hits = stored(found.df.join(kept.df, "h").select("doc_id", "at", "h", "n", "first_id"), "passage-hits")
    found.discard()
    kept.discard()
    return hits


def possible_starts(words: int, places: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Of so many ``words``, places where a run of ``least`` may begin that another document holds, as ``shared`` of the seeds' places are of shared ones.

    Seeds that lie WINDOW - 1 or more from both ends of a run are seeds wherever the run stands, so all of them are shared.
    """
    n, last = words - least + 1, least - SEED + 1 - WINDOW
    if n <= 0 or last < WINDOW - 1:
        return np.arange(max(0, n))
    lone = np.zeros(words + 1, np.int64)
    lone[np.setdiff1d(places, shared, assume_unique=False) + 1] = 1
    lone = np.cumsum(lone)
    starts = np.arange(n)
    return np.flatnonzero(lone[starts + last + 1] == lone[starts + WINDOW - 1])


def rarest(places: np.ndarray, known: np.ndarray, occurrences: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each pair of bounds (included), the index of the place between them that has the fewest ``occurrences``, given for
    the ``known`` places; the first of several. There is one for every pair.
    """
    counts = np.full(len(places), np.iinfo(np.int64).max)
    counts[np.searchsorted(places, known)] = occurrences
    first, last = np.searchsorted(places, low), np.searchsorted(places, high, side="right") - 1
    best, at = first.copy(), first
    for _ in range(int((last - first).max(initial=0))):
        at = np.minimum(at + 1, last)
        best = np.where(counts[at] < counts[best], at, best)
    return best


def run_hashes(words: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """64 bits for the run of ``least`` words from each start."""
    size = min(SEED, least)
    h, out = shingles(words, size), np.zeros(len(starts), np.uint64)
    for at in [*range(0, least - size, size), least - size]:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[starts + at]
    return mixed(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words without those that lie inside others, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """The number of each hash among its equals, from 0."""
    order = np.argsort(hashes, kind="stable")
    places = np.arange(len(hashes))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(hashes[order]) != 0)), places, 0))
    out = np.empty(len(hashes), np.int64)
    out[order] = places - first
    return out


def equal_runs(texts: DataFrame, hits: DataFrame, covers: DataFrame, least: int) -> DataFrame:
    """(doc_id, ref_id, start_word, end_word, ref_start): runs of ``least`` words that an earlier document holds and no span
    of ``covers(doc_id, start_word, end_word)`` covers, in the first document that holds them; along a diagonal they are put together.

    A run may have an earlier holder only if all its inner seeds have one, and only such runs are looked up. Others that
    hold it have all its inner seeds, so only the places of the one with the fewest places are hashed. A hot seed's places in one
    document are looked up together, as a line repeated over and over has many.
    """
    inner = least - SEED + 1 - WINDOW
    held = hits.where("first_id < doc_id")
    places = held.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("own")).select("doc_id", "own.at", "own.n")
    spans = covers.groupBy(F.col("doc_id").alias("covered_id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))

    def needy(ats, counts, spans, words, at, h):
        words, at, h = np.frombuffer(words, np.uint32), np.frombuffer(at, np.int32), np.frombuffer(h, np.uint64)
        ats = np.asarray(ats, np.int64)
        starts = possible_starts(len(words), at, ats, least)
        if spans and len(starts):
            merged = np.array(_merged([tuple(s.values()) for s in spans]), np.int64)
            last = np.searchsorted(merged[:, 0], starts, side="right") - 1
            starts = starts[(last < 0) | (starts + least > merged[last, 1])]
        if not len(starts):
            return None
        if inner >= WINDOW - 1:
            own = rarest(at, ats, np.asarray(counts, np.int64), starts + WINDOW - 1, starts + inner)
            seed, away = h[own].view(np.int64), at[own] - starts
        else:
            seed = away = np.zeros(len(starts), np.int64)
        hashes = run_hashes(words, starts, least)
        return starts, hashes.view(np.int64), _numbered(hashes), seed, away

    def wanted_runs(batches):
        for batch in batches:
            for part in few(batch):
                ids, *rest = (c.to_pylist() for c in part.columns)
                found = [(i, columns) for i, *values in zip(ids, *rest) if (columns := needy(*values)) is not None]
                if found:
                    columns = [np.concatenate(c) for c in zip(*(c for _, c in found))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _ in found], np.int64), [len(c[0]) for _, c in found])), *[
                        pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, list(arrow)[1:])]], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("nth", pa.int32()), ("seed", pa.int64()), ("away", pa.int32())])
    looked = places.join(spans, F.col("doc_id") == F.col("covered_id"), "left").hint(HASHED).join(texts, "doc_id").select("doc_id", "at", "n", "spans", "words", "places", "hashes")
    wanted = stored(looked.mapInArrow(wanted_runs, "doc_id long, at int, h long, nth int, seed long, away int"), "passage-runs")
    if inner >= WINDOW - 1:
        asked = wanted.groupBy("seed").agg(F.collect_set("away").alias("aways"))
        own = hits.where(F.col("n") <= HOT).select("h", "doc_id", F.array("at").alias("ats")).unionByName(
            hits.where(F.col("n") > HOT).groupBy("h", "doc_id").agg(F.collect_list("at").alias("ats")))
        where = own.join(asked, F.col("h") == F.col("seed")).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(
            F.collect_list(F.expr("flatten(transform(ats, x -> transform(aways, a -> x - a)))"))))).alias("starts"))
    else:
        where = texts.select("doc_id").distinct().withColumn("starts", F.lit(None).cast("array<int>"))

    def runs(starts, words):
        words = np.frombuffer(words, np.uint32)
        every = np.arange(max(0, len(words) - least + 1))
        own = every if starts is None else np.asarray(starts, np.int64)
        own = own[(own >= 0) & (own < len(every))]
        return own, run_hashes(words, own, least) if len(own) else np.zeros(0, np.uint64)

    holders = places_of(where.hint(HASHED).join(texts, "doc_id").select("doc_id", "starts", "words"), runs).join(
        wanted.select("h").distinct(), "h", "left_semi")
    # The first holder with all places of the run there: the n-th here goes with the n-th there, so that what repeats inside a
    # document stays on one diagonal.
    first = stored(holders.groupBy("h", "doc_id").agg(F.sort_array(F.collect_set("at")).alias("ats")).groupBy("h").agg(
        F.min(F.struct("doc_id", "ats")).alias("first")), "passage-first")
    met = wanted.join(first, "h").where("first.doc_id < doc_id").select(
        "doc_id", F.col("first.doc_id").alias("ref_id"), "at", F.expr("at - first.ats[nth % size(first.ats)]").alias("off"))
    grouped = met.groupBy("doc_id", "ref_id", "off").agg(F.sort_array(F.collect_set("at")).alias("ats"))

    def ranges(i, ref, off, ats):
        at = np.asarray(ats, np.int64)
        cuts = np.flatnonzero(np.diff(at) > 1)
        for a, b in zip(at[np.concatenate(([0], cuts + 1))].tolist(), at[np.concatenate((cuts, [len(at) - 1]))].tolist()):
            yield i, ref, a, b + least, a - off

    return by_row(grouped, ranges, "doc_id long, ref_id long, start_word int, end_word int, ref_start int")


def seed_matches(hits: DataFrame) -> DataFrame:
    """(doc_id, ref_id, xs, ys): for pairs of documents, the places of seeds that both have; ref_id is smaller.

    Every occurrence of a seed is matched with its first one over all documents and with the last one in the document
    before it: two matches an occurrence at most, however many documents share the seed. So a passage of many documents
    leads to one chain for each, not one for each pair. The occurrences of a hot seed are sorted over many partitions.
    """
    spot = F.struct("doc_id", "at")
    earlier = Window.partitionBy("h").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    few = hits.where(F.col("n") <= HOT).withColumns({"first": F.min(spot).over(earlier), "previous": F.max(spot).over(earlier)}).select(
        "doc_id", "at", "first", "previous")
    hot = hits.where(F.col("n") > HOT)
    first = hot.where("doc_id = first_id").groupBy("h").agg(F.struct(F.first("doc_id").alias("doc_id"), F.min("at").alias("at")).alias("first"))
    many = greatest_before(hot.groupBy("h", "doc_id").agg(F.collect_list("at").alias("ats")), ["h"], ["doc_id"],
                           F.struct("doc_id", F.array_max("ats").alias("at")), "previous")
    many = many.join(first, "h").select("doc_id", F.explode("ats").alias("at"), "first", "previous")
    near = few.unionByName(many).select(
        "doc_id", "at", F.explode(F.expr("""filter(array_distinct(array(first, previous)),
            x -> x IS NOT NULL AND x.doc_id < doc_id)""")).alias("ref"))
    return near.groupBy("doc_id", F.col("ref.doc_id").alias("ref_id")).agg(
        F.collect_list(F.struct("at", F.col("ref.at").alias("y"))).alias("m")).select(
        "doc_id", "ref_id", F.col("m.at").alias("xs"), F.col("m.y").alias("ys"))


def outer_matches(x: np.ndarray, y: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Of the places x within ``gap`` words of each other that match one place y, as in a line again and again, the first and the last."""
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (np.diff(y) != 0) | (np.diff(x) > gap), [True]))
    kept = new[:-1] | new[1:]
    return x[kept], y[kept]


def one_run(xs: list[int], ys: list[int], seed: int = SEED, gap: int = GAP) -> list[int] | None:
    """The run (x, y, end of x) of matches that all lie on one diagonal within ``gap`` words of each other, as most do.

    Null if they don't, or if they cover less than an eighth of it.
    """
    off = xs[0] - ys[0]
    if any(x - y != off for x, y in zip(xs, ys)):
        return None
    at = sorted(xs)
    steps = [v - u for u, v in zip(at, at[1:])]
    if max(steps) > gap or 8 * (seed + sum(min(s, seed) for s in steps)) < at[-1] + seed - at[0]:
        return None
    return [at[0], at[0] - off, at[-1] + seed]


def candidate_chains(matches: DataFrame, least: int) -> DataFrame:
    """Chains of pairs of documents, as their runs (x, y, end of x) one after the other; ``sure``: whether their own seeds may
    span a passage of ``least`` words.

    Also a single seed is a chain: the next seeds of a passage may have been matched with other documents. A chain whose
    runs lie too far apart to be one passage is taken run by run. Equal words beyond the outer seeds would hold another
    seed if they were WINDOW or more.
    """
    def find(doc_id, ref_id, xs, ys):
        if len(xs) == 1:
            yield doc_id, ref_id, [xs[0], ys[0], xs[0] + SEED], False
            return
        if (run := one_run(xs, ys)) is not None:
            yield doc_id, ref_id, run, run[2] - run[0] + 2 * (WINDOW - 1) >= least
            return
        xs, ys = outer_matches(np.asarray(xs, np.int64), np.asarray(ys, np.int64))
        for chain in chains(xs, ys):
            (x, y, *_), (u, v, end, _) = chain[0], chain[-1]
            span = min(end - x, v + end - u - y)
            together = 8 * sum(run[3] for run in chain) >= span
            for part in [chain] if together else [[run] for run in chain]:
                yield doc_id, ref_id, [n for run in part for n in run[:3]], together and len(xs) > 1 and span + 2 * (WINDOW - 1) >= least

    return by_row(matches, find, "doc_id long, ref_id long, runs array<int>, sure boolean")


def _alignments(found: DataFrame, texts: DataFrame, least: int, margin: int) -> DataFrame:
    """Passages of chains whose alignment reads ``margin`` words on both sides; ``runs`` is not null where one may go on beyond."""
    n = "size(runs)"
    found = found.selectExpr(
        "doc_id", "ref_id", "runs", f"greatest(0, runs[0] - {margin}) AS x", f"runs[{n} - 1] + {margin} AS x_end",
        f"greatest(0, runs[1] - {margin}) AS y", f"runs[{n} - 2] + runs[{n} - 1] - runs[{n} - 3] + {margin} AS y_end")
    cut = Stored(found.selectExpr("doc_id", "x AS a", "x_end AS b").unionByName(
        found.selectExpr("ref_id AS doc_id", "y AS a", "y_end AS b")).distinct(), "passage-spans")
    spans = cut.df
    sizes = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    dealt = spans.join(sizes, "doc_id").groupBy("doc_id", F.expr(f"pmod(xxhash64(a, b), n div {RANGES} + 1)").alias("salt")).agg(
        F.collect_list(F.struct("a", "b")).alias("ranges"))
    pieces = Stored(
        by_row(dealt.hint(HASHED).join(texts, "doc_id").select("doc_id", "ranges", "words"), _cut, "doc_id long, a int, b int, words binary")
        .groupBy("doc_id", "a", "b").agg(F.max("words").alias("words")), "passage-slices")
    slices = pieces.df
    sides = found.join(slices.selectExpr("doc_id", "a AS x", "b AS x_end", "words AS ours"), ["doc_id", "x", "x_end"]).join(
        slices.selectExpr("doc_id AS ref_id", "a AS y", "b AS y_end", "words AS theirs"), ["ref_id", "y", "y_end"])

    def align(doc_id, ref_id, x, y, runs, ours, theirs):
        ours, theirs = np.frombuffer(ours, np.uint32), np.frombuffer(theirs, np.uint32)
        chain = [(runs[i] - x, runs[i + 1] - y, runs[i + 2] - x) for i in range(0, len(runs), 3)]
        if len(chain) == 1 and hopeless(chain[0], ours, theirs, least, margin):
            return
        steps = aligned(chain, ours, theirs, margin)
        if not steps:
            return
        parts = list(best_parts(steps))
        begins, ends = steps[0][0], steps[-1][0] + steps[-1][2]
        before = min(chain[0][0], chain[0][1]) >= margin and any(p[0] == begins for p in parts)
        after = min(len(ours) - chain[-1][2], len(theirs) - (chain[-1][1] + chain[-1][2] - chain[-1][0])) >= margin and any(p[1] == ends for p in parts)
        if before or after:
            yield doc_id, ref_id, None, None, None, None, None, runs
            return
        for a, b, c, d, equal in parts:
            if b - a >= least and d - c >= least:
                yield doc_id, ref_id, x + a, x + b, y + c, y + d, equal / max(b - a, d - c), None

    rows = stored(by_row(sides.select("doc_id", "ref_id", "x", "y", "runs", "ours", "theirs"), align,
                         "doc_id long, ref_id long, start_word int, end_word int, ref_start int, ref_end int, identity double, runs array<int>"),
                  "passage-rows")
    cut.discard()
    pieces.discard()
    return rows


def _settled(chained: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The passages of chains, each aligned as far as it goes."""
    open_, margin, done = stored(chained, "passage-open"), MARGIN, None
    while done is None or not open_.isEmpty():
        rows = _alignments(open_, texts, least, margin)
        settled = rows.where("runs IS NULL").drop("runs")
        done = settled if done is None else done.unionByName(settled)
        open_, margin = rows.where("runs IS NOT NULL").select("doc_id", "ref_id", "runs"), margin * WIDER
    return done.distinct()


def repeated_passages(docs: DataFrame, least: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Passages of at least ``least`` words that a document has in common with an earlier one, some words apart.

    Chains of seeds find passages with differences, each followed along its diagonal as far as it goes. Runs of ``least``
    equal words that they leave out, because other documents hold the run's seeds too, are found by the run itself
    and followed in the same way. A document has no row for a passage that lies inside another one of its own.
    Returns doc_id, ref_id (a smaller id), start_word, end_word, ref_start, ref_end (the ends excluded) and identity:
    the equal words as a part of the longer side, at least 0.8. Words stand between ASCII white space, with A-Z in
    lower case. Every document after the first that holds a passage has a row for it, so removing the found spans
    leaves the first one whole. Null ids and null, empty or short texts give no rows. Rows that share an id are never
    matched with each other. Other columns are not read.
    """
    kept = coded_texts(as_bytes(docs.where(F.col(doc_id).isNotNull()), doc_id, text=text, names=("doc_id",)), least)
    texts = kept.df
    hits = shared_seeds(texts)
    found = stored(candidate_chains(seed_matches(hits), least), "passage-chains")
    done = _settled(found.where("sure").drop("sure"), texts, least)
    # The others are followed where no passage of the document was found.
    known = done.groupBy(F.col("doc_id").alias("known_id")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    rest = found.where("NOT sure").join(known, F.col("doc_id") == F.col("known_id"), "left").where(F.expr(
        "NOT coalesce(exists(spans, s -> s.start_word <= runs[0] AND s.end_word >= runs[size(runs) - 1]), false)"))
    done = done.unionByName(_settled(rest.select("doc_id", "ref_id", "runs"), texts, least))
    missed = equal_runs(texts, hits, done.select("doc_id", "start_word", "end_word"), least)
    done = done.unionByName(_settled(missed.selectExpr("doc_id", "ref_id", "array(start_word, ref_start, end_word) AS runs"), texts, least))
    kept.discard()
    return _outermost(done)


def _outermost(rows: DataFrame) -> DataFrame:
    """The passages whose span lies in no other one of the same document; of equal spans that with the smallest ref_id."""
    own = rows.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", F.expr("-end_word").alias("e"), "ref_id", "ref_start", "ref_end", "identity")).alias("found"))

    def kept(i, found):
        reach = -1
        for start, end, ref, *rest in sorted(tuple(f.values()) for f in found):
            if -end > reach:
                reach = -end
                yield i, ref, start, -end, *rest

    return by_row(own, kept, "doc_id long, ref_id long, start_word int, end_word int, ref_start int, ref_end int, identity double")


def _cut(doc_id, ranges, words):
    for r in ranges:
        yield doc_id, r["a"], r["b"], words[4 * r["a"]:4 * r["b"]]


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_words(utf8: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words in the ranges; what lies between two removed words goes with them."""
    spans = [m.span() for m in _WORD.finditer(utf8)]
    kept, at = [], 0
    for first, end in sorted(ranges):
        if first < end and first < len(spans):
            begin = spans[first][0]
            if begin > at:
                kept.append(utf8[at:begin])
            at = max(at, spans[end][0] if end < len(spans) else len(utf8))
    return b"".join(kept) + utf8[at:]


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    length: str = "n_chars") -> DataFrame:
    """``docs``, all columns, with the found passages cut out of their texts and ``length`` (if there) counted anew.

    A document that had words and has none left is dropped; others stay, those with a null id or text included. A
    document's own ranges are brought together, which its length bounds.
    """
    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_words(t, [(r["start_word"], r["end_word"]) for r in x]).decode("utf-8", "replace")
                          for t, x in zip(texts, ranges)], dtype=object)

    found = passages.groupBy(F.col("doc_id").alias("passages_of")).agg(
        F.collect_set(F.struct("start_word", "end_word")).alias("passages_found"))
    hit = F.col("passages_of").isNotNull()
    joined = docs.join(found, F.col(doc_id) == F.col("passages_of"), "left").withColumn(
        "passages_left", cut(F.when(hit, F.col(text).cast("binary")), F.col("passages_found")))
    left = joined.where(~hit | F.col("passages_left").rlike(r"[^\x20\x09-\x0D]"))
    changed = {text: F.when(hit, F.col("passages_left")).otherwise(F.col(text))}
    if length in docs.columns:
        changed[length] = F.when(hit, F.length("passages_left").cast(docs.schema[length].dataType)).otherwise(F.col(length))
    return left.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])
