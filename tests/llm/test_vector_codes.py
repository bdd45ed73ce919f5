import hashlib
import math

import numpy as np
import pytest

from tabproof.llm.queries import QUERIES
from tabproof.llm.vector_codes import plant, vector_codes, walk, with_label_errors
from tests.conftest import SF_DIR


def brute_force(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector, label) in the order of ids. All comparisons, Python's integers."""
    cut = []
    for _, v, _ in rows:
        x, w = [math.floor(float(c) * scale) for c in v], len(v) // parts
        cut.append([x[p * w:(p + 1) * w] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assigned(p):
        return [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for c in cut]

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for c, (_, k) in zip(cut, assigned(p)):
                held.setdefault(k, []).append(c[p])
            books[p] = [[sum(x) // len(x) for x in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])]
    final = list(zip(*[assigned(p) for p in range(parts)]))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for r, f in zip(rows, final)]
    labels = {}
    for r, o in zip(rows, out):
        labels[r[2]] = labels.get(r[2], 0) + o[2]
    return sorted((*o, labels[r[2]], digest) for r, o in zip(rows, out))


COLUMNS = "vec_id code error label_error codebooks_sha256".split()


def coded(df, **options):
    return sorted(map(tuple, with_label_errors(vector_codes(df, keep=("label",), **options)).select(COLUMNS).collect()))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding", "label").collect()
    assert sorted(map(tuple, QUERIES["op11_vector_codes"](spark, SF_DIR).collect())) == brute_force(list(map(tuple, rows)))


@pytest.mark.parametrize("partitions", [1, 5])
def test_copies_ties_and_layouts(spark, partitions):
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, (60, 8)) / 4
    rows = [(i, (base[i % 60] if i % 3 else base[0]).tolist(), [None, 1, 2][i % 3]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(partitions)
    assert coded(df, parts=4, entries=16, rounds=3) == brute_force(rows, 4, 16, 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.5, -0.001, 1.0, 2.0], 1), (5, [0.5, -0.001, 1.0, 2.0], None), (5, [9.0, 8.0, -7.0, 0.0], None),
            (8, [3e38, -3e38, 1e20, 0.25], 2), (9, [3e38, -3.1e38, 1e20, 70000.5], 2)]
    bad = [(0, None, 1), (1, [], 1), (2, [1.0, None, 0.0, 0.0], 1), (4, [nan, 0.0, 0.0, 0.0], 1), (6, [0.0, 0.0, -inf, 0.0], 1),
           (7, [1.0, 2.0], 1), (10, [1.0, 2.0, 3.0], 1)]
    schema = "vec_id long, embedding array<float>, label int, code string, error string, trees int, n int"
    df = spark.createDataFrame([(*r, "clash", "clash", 1, 1) for r in good + bad + [(None, [1.0, 1.0, 1.0, 1.0], 1)]], schema).repartition(3)
    real = [(i, np.array(v, np.float32).tolist(), k) for i, v, k in good]
    got = with_label_errors(vector_codes(df, keep=("label",), parts=2, entries=3)).select(COLUMNS).collect()
    expected = brute_force([*real, (None, [1.0] * 4, 1)][:5], 2, 3)  # without the null id, which comes last and moves means
    assert len(got) == 6 and {r.vec_id for r in got} == {3, 5, 8, 9, None} and len(expected) == 5
    small = [x for x in real if x[0] < 8]
    assert coded(df.where("vec_id < 8"), parts=2, entries=3) == brute_force(small, 2, 3)
    assert vector_codes(df.where("false"), keep=("label",)).rows.collect() == []
    assert with_label_errors(vector_codes(df.where("false"), keep=("label",))).collect() == []
    assert len(vector_codes(df.where("vec_id = 1")).books) == 0
    with pytest.raises(ValueError):
        vector_codes(df, entries=257)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(np.float32(10.0 ** e * s)), 0.5], 0) for i, (e, s) in enumerate([(30, 1), (30, -1), (30, 1.5), (0, 1), (20, 3), (20, -3), (0, 2)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(2)
    codes = vector_codes(df, parts=1, entries=2)
    expected = {r[0]: r[1:3] for r in brute_force(rows, 1, 2)}
    assert {r.vec_id: (r.code, r.error) for r in codes.rows.collect()} == {
        i: (c, e if e < 1 << 63 else None) for i, (c, e) in expected.items()}
    assert codes.digest() == brute_force(rows, 1, 2)[0][4]


def test_cover_tree():
    rng = np.random.default_rng(0)
    rows = np.floor(rng.normal(size=(3000, 4)) * 40)
    rows[::3] = rows[0]
    tree = plant(rows)
    assert (tree.points[tree.place] == rows).all() and tree.counted[-1] == len(rows)
    assert (tree.upto[-1] == rows.sum(0)).all()
    x = tree.points.astype(float)
    for a, b, c, r, f, n in zip(tree.low, tree.high, tree.center, tree.radius, tree.first, tree.children):
        assert np.sqrt(((x[a:b] - x[c]) ** 2).sum(1)).max() <= r  # all within the radius
        if n:
            kids = range(f, f + n)
            assert tree.low[f] == a and tree.high[f + n - 1] == b and all(tree.high[k] == tree.low[k + 1] for k in kids[:-1])
            assert c in tree.center[kids]  # a center is the center of one of the children as well
            centers = x[tree.center[kids]]
            apart = np.sqrt(((centers[:, None] - centers) ** 2).sum(2))[~np.eye(n, dtype=bool)]
            assert tree.radius[kids].max() <= r / 2 and (n == 1 or apart.min() > r / 2)
    # Clusters far apart are assigned by whole subtrees, almost without exact comparisons.
    centers = rng.integers(-5000, 5000, (16, 4))
    groups = plant((centers[rng.integers(0, 16, 3000)] + rng.integers(-9, 10, (3000, 4))).astype(float))
    done = walk(groups, centers.tolist())
    low, high, _ = done.ended()
    assert len(low) < 100 and done.compared < 100 and (high - low).sum() == len(groups.points)
