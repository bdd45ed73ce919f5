"""Product codes of vectors: codebooks by Lloyd rounds over cover trees, exact in integers.

Each task plants, for every part position, cover trees over some thousand of its vectors' parts and stores them. A
round walks the stored trees with the codebooks: what the triangle inequality settles is assigned as a whole subtree, its
sum a difference of two cumulative sums; only what stays open descends, at last to exact comparisons of parts with the
entries still possible. Vectors are read once; a round moves one row for each entry's axis and task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Stored
from .text import few, turn_to

#: Vectors of a tree, and distinct parts of a node that is not divided further.
PLANTED, LEAF = 4096, 8
#: Integers below this are squared and added up in 64 bits (up to 8192 components), larger ones as Python's own.
SMALL = 1 << 24
#: Sums travel in two numbers, the lower one of so many bits.
LOW_BITS = 40


def whole(x: np.ndarray) -> np.ndarray:
    """Floats without fraction as exact integers: of 64 bits where squares fit, else Python's."""
    if not x.size or abs(x).max() < SMALL:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


@dataclass
class Tree:
    """A cover tree over distinct points. Every node is a stretch of ``points``, all within ``radius`` of its ``center``;
    its children lie next to each other, their centers more than half its radius apart."""

    points: np.ndarray
    weights: np.ndarray
    place: np.ndarray  # of each row among the points
    low: np.ndarray
    high: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray

    @cached_property
    def exact(self) -> np.ndarray:
        return whole(self.points.astype(float))

    @cached_property
    def upto(self) -> np.ndarray:
        """Sums of all points before each place, by weight."""
        return np.concatenate([np.zeros_like(self.exact[:1]), np.cumsum(self.exact * self.weights[:, None], axis=0)])

    @cached_property
    def counted(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.weights)])


def plant(rows: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over the rows (at least one) of a float array; equal rows are one point with a weight."""
    points, place, weights = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    order = np.arange(len(points))
    away = np.sqrt(((points - points[0]) ** 2).sum(1))
    nodes = [[0, len(points), 0, away.max(), 0, 0]]  # low, high, center, radius, first child, children
    for node in nodes:
        a, b, middle, radius, _, _ = node
        if b - a <= leaf or radius == 0:
            continue
        own = order[a:b]
        x, centers = points[own], [middle]
        near, holder = np.sqrt(((x - points[middle]) ** 2).sum(1)), np.zeros(b - a, int)
        while near[far := near.argmax()] > radius / 2:
            d = np.sqrt(((x - x[far]) ** 2).sum(1))
            closer = d < near
            near[closer], holder[closer] = d[closer], len(centers)
            centers.append(own[far])
        by = holder.argsort(kind="stable")
        order[a:b] = own[by]
        ends = np.bincount(holder, minlength=len(centers)).cumsum()
        reach = np.maximum.reduceat(near[by], np.concatenate([[0], ends[:-1]]))
        node[4:] = len(nodes), len(centers)
        nodes.extend([a + s, a + e, c, r, 0, 0] for s, e, c, r in zip([0, *ends[:-1]], ends, centers, reach))
    low, high, center, radius, first, children = map(np.array, zip(*nodes))
    at = np.empty(len(points), np.int32)
    at[order] = np.arange(len(points), dtype=np.int32)
    points = points[order]
    small = abs(points).max(initial=0) < 1 << 31
    return Tree(points.astype(np.int32) if small else points, weights[order].astype(np.int32), at[place.ravel()], low.astype(np.int32),
                high.astype(np.int32), at[center], radius.astype(float), first.astype(np.int32), children.astype(np.int32))


def stretches(lows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each size, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(lows - (sizes.cumsum() - sizes), sizes)


@dataclass
class Walk:
    """Where a tree's points go: ``entry`` takes all points from ``low`` up to ``high``. ``compared`` pairs were looked at exactly."""

    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    entry: list = field(default_factory=list)
    compared: int = 0

    def add(self, low, high, entry) -> None:
        for held, new in ((self.low, low), (self.high, high), (self.entry, entry)):
            held.append(new)

    def ended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in (self.low, self.high, self.entry))


def nearest(points: np.ndarray, entries: np.ndarray, possible: np.ndarray) -> np.ndarray:
    """For each point the nearest of its possible entries, exactly; the lowest index among equals."""
    row, entry = np.nonzero(possible)
    d = ((points[row] - entries[entry]) ** 2).sum(1)
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    best = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, starts), np.diff(starts, append=len(row))))
    return entry[best[np.flatnonzero(np.diff(row[best], prepend=-1))]]


def walk(tree: Tree, book: list[list[int]]) -> Walk:
    """Assigns all points of a tree. A node whose center is nearer to one entry than to all others by more than twice the
    node's radius goes there whole; else entries beyond that distance are ruled out for everything below it."""
    rough = np.array(book, float)
    points, exact = tree.points.astype(float), None
    slack = 1e-11 * max(abs(rough).max(), abs(points).max(), 1.0)  # floats may be off by far less
    nodes, possible, out = np.zeros(1, int), np.ones((1, len(book)), bool), Walk()
    while len(nodes):
        d = np.sqrt(((points[tree.center[nodes]][:, None] - rough) ** 2).sum(2))
        d[~possible] = np.inf
        bound = d.min(1) + 2 * tree.radius[nodes]
        possible = d <= (bound * (1 + 1e-11) + slack)[:, None]
        settled = possible.sum(1) == 1
        out.add(tree.low[nodes[settled]], tree.high[nodes[settled]], possible[settled].argmax(1))
        nodes, possible = nodes[~settled], possible[~settled]
        last = tree.children[nodes] == 0
        if last.any():
            if exact is None:
                exact, entries = tree.exact, np.array(book, object)
                if exact.dtype != object and max(map(abs, entries.ravel().tolist()), default=0) < SMALL:
                    entries = entries.astype(np.int64)
                else:
                    exact = exact.astype(object)
            sizes = tree.high[nodes[last]] - tree.low[nodes[last]]
            at, open_to = stretches(tree.low[nodes[last]], sizes), np.repeat(possible[last], sizes, axis=0)
            out.compared += int(open_to.sum())
            out.add(at, at + 1, nearest(exact[at], entries, open_to))
        nodes, possible = nodes[~last], possible[~last]
        sizes = tree.children[nodes]
        nodes, possible = stretches(tree.first[nodes], sizes), np.repeat(possible, sizes, axis=0)
    return out


def _planted(vectors: DataFrame, kept: list[str], parts: int, scale: int) -> Stored:
    """Rows of up to PLANTED vectors: the ``kept`` columns as arrays, ``trees`` with one tree for each part position."""
    fields = [vectors.schema[c] for c in kept]
    schema = ", ".join([f"`{f.name}` array<{f.dataType.simpleString()}>" for f in fields] + ["trees array<binary>"])

    def run(batches):
        turn_to("vector_codes")
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, PLANTED - size)
                held.append(part)
                at, size = at + part.num_rows, size + part.num_rows
                if size == PLANTED:
                    yield planted(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            yield planted(pa.Table.from_batches(held))

    def planted(table):
        lists = table.column(len(kept)).combine_chunks()
        x = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) * scale)
        trees = [pickle.dumps(plant(p), 5) for p in np.split(x, parts, axis=1)]
        columns = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(i).combine_chunks()) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([trees], pa.list_(pa.binary()))], names=[*kept, "trees"])

    return Stored(vectors.mapInArrow(run, schema), "vector-trees")


def _trees(batches) -> Iterator[tuple[pa.RecordBatch, list[Tree]]]:
    """Rows of the stored trees one at a time."""
    turn_to("vector_codes")
    for batch in batches:
        for row in few(batch, 1):
            yield row, [pickle.loads(t) for t in row.column(row.num_columns - 1)[0].as_py()]


def _replaced(trees: DataFrame, books: list) -> list:
    """The codebooks after a round: each entry the floored mean of its parts; unused ones stay."""
    def run(batches):
        count = [[0] * len(book) for book in books]
        total = [[[0] * len(e) for e in book] for book in books]
        for _, row in _trees(batches):
            for p, (tree, book) in enumerate(zip(row, books)):
                low, high, entry = walk(tree, book).ended()
                n, s = tree.counted[high] - tree.counted[low], tree.upto[high] - tree.upto[low]
                for e in np.unique(entry).tolist():
                    mine = entry == e
                    count[p][e] += int(n[mine].sum())
                    total[p][e] = [int(a) + b for a, b in zip(s[mine].sum(0).tolist(), total[p][e])]
        rows = [(p, e, i, n, Decimal(s >> LOW_BITS), s & ((1 << LOW_BITS) - 1)) for p, found in enumerate(count)
                for e, n in enumerate(found) if n for i, s in enumerate(total[p][e])]
        if rows:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names="part entry axis n upper lower".split())

    sums = trees.select("trees").mapInArrow(run, "part int, entry int, axis int, n long, upper decimal(38,0), lower long").groupBy(
        "part", "entry", "axis").agg(F.sum("n"), F.sum("upper"), F.sum("lower"))
    after = [[list(e) for e in book] for book in books]
    for p, e, i, n, upper, lower in sums.collect():  # at most one row for each number of the codebooks
        after[p][e][i] = ((int(upper) << LOW_BITS) + lower) // n
    return after


def _coded(trees: DataFrame, kept: list[str], books: list) -> DataFrame:
    fields = [trees.schema[c] for c in kept]
    types = ", ".join(f"`{f.name}` {f.dataType.elementType.simpleString()}" for f in fields)

    def run(batches):
        for row, parts in _trees(batches):
            codes = np.empty((len(parts[0].place), len(parts)), np.uint8)
            error = np.zeros(len(codes), np.int64)
            for p, (tree, book) in enumerate(zip(parts, books)):
                low, high, entry = walk(tree, book).ended()
                code = np.empty(len(tree.points), int)
                code[stretches(low, high - low)] = np.repeat(entry, high - low)
                chosen = np.array(book, object)[code]
                small = tree.exact.dtype != object and max((abs(v) for e in book for v in e), default=0) < SMALL
                off = ((tree.exact - (chosen.astype(np.int64) if small else chosen)) ** 2).sum(1)
                codes[:, p] = code[tree.place]
                error = error + off[tree.place]
            digits = codes.tobytes().hex()
            n = 2 * len(parts)
            yield pa.RecordBatch.from_arrays([
                *[row.column(i).flatten() for i in range(len(kept))], pa.array([digits[i:i + n] for i in range(0, len(digits), n)]),
                pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())], names=[*kept, "code", "error"])

    return trees.mapInArrow(run, f"{types}, code string, error long")


@dataclass(frozen=True)
class Codes:
    """``rows``: the kept columns, code and error of each vector. ``books``: by part, entry and component."""

    rows: DataFrame
    books: list

    def digest(self) -> str:
        numbers = (str(v) for book in self.books for entry in book for v in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def vector_codes(vectors: DataFrame, keep: tuple[str, ...] = (), parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
                 vec_id: str = "vec_id", vector: str = "embedding") -> Codes:
    """Codes of vectors cut into ``parts`` equal parts, each the index of the nearest of ``entries`` (at most 256) codebook entries.

    A component x counts as floor(scale * x), a power of two. The codebooks start from the vectors with the smallest ids (fewer
    vectors: fewer entries) and are replaced ``rounds`` times by floored means. Results don't depend on how rows are
    dealt over tasks, nor on the trees. Vectors that are null, empty, hold a null, a NaN, an infinity or a number from 2**128
    on, or have a length that ``parts`` doesn't divide, are left out; of several lengths, that of the smallest id counts.
    Rows may share an id, a null id comes last; columns beside ``keep`` are not read. Without vectors there
    are no rows and no books. An error beyond 63 bits is null. The codebooks, parts x entries x components numbers, pass the driver.
    """
    if entries > 256:
        raise ValueError("a code has two digits: at most 256 entries")
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0 ** 128)))
    whole_parts = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & fine)
    first = [r[0] for r in whole_parts.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()]
    length = len(first[0]) if first else parts
    same = whole_parts.where(F.size(x) == length)
    if any(len(v) != length for v in first):
        first = [r[0] for r in same.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()]
    kept, w = [vec_id, *keep], length // parts
    books = [[[int(np.floor(float(c) * scale)) for c in v[p * w:(p + 1) * w]] for v in first] for p in range(parts)]
    trees = _planted(same.select(*kept, vector), kept, parts, scale)
    for _ in range(rounds if first else 0):
        books = _replaced(trees.df, books)
    rows = Stored(_coded(trees.df, kept, books), "vector-codes").df
    trees.discard()
    return Codes(rows, books if first else [])


#: Most rows of a table that is broadcast to stand beside vectors.
FEW_LABELS = 100_000


def with_label_errors(codes: Codes, label: str = "label") -> DataFrame:
    """Adds ``label_error``, the errors of all vectors with the same label, nulls together, and the books' digest.

    Errors are added up inside the tasks first. Up to FEW_LABELS sums, which are counted, are broadcast; more are joined.
    """
    sums = Stored(codes.rows.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors").df
    beside = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return codes.rows.join(beside, F.col(label).eqNullSafe(F.col("__label"))).drop("__label").withColumn(
        "codebooks_sha256", F.lit(codes.digest()))
