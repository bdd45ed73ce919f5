"""Differences found through an invertible lookup table against the signed pass."""

import random

import pytest
from pyspark.sql import functions as F

from tabproof.operators.multiset import multiset_diff_rows
from tabproof.operators.reconcile import cells, hashed_sides, peel, reconcile
from tabproof.operators.sides import SchemaMismatch

from .conftest import shuffled_rows


def as_bag(df):
    return sorted(map(str, df.collect()))


def same(baseline, candidate, peeled=True, **options):
    found = reconcile(baseline, candidate, **options)
    assert found.peeled is peeled
    assert as_bag(found.rows) == as_bag(multiset_diff_rows(baseline, candidate))
    return found


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_signed_pass(spark, seed):
    rng = random.Random(seed)
    draw = lambda n: [(rng.choice([None, *range(40)]), rng.choice([None, 0.0, -0.0, 1.5, float("nan"), 1e300]), rng.choice(["", "a", None]),
                       {"k": rng.choice("xy")}) for _ in range(n)]
    rows = draw(150)
    left = rows + draw(12) + rows[:3] * 4
    right = rows[4:] + draw(9) + rows[20:24] * 3
    frame = lambda data: spark.createDataFrame(data, "i int, x double, s string, m map<string,string>").repartition(3)
    same(frame(left), frame(right))


def test_small_differences_within_the_tolerance_cancel_out(views):
    found = same(views.orders, views.orders_drift)
    assert found.different == 0 and found.rows.collect() == []


def test_more_differences_than_cells(views):
    same(views.orders, views.orders.where("false"), peeled=False, differences=1)
    assert same(views.orders, views.orders_cand, differences=5000).different > 20


def test_empty_and_unlike_tables(spark, views):
    nothing = views.orders.where("false")
    same(nothing, nothing)
    same(views.orders.limit(50), nothing)
    same(spark.range(3).selectExpr("1 AS a"), spark.range(5).selectExpr("1 AS a"))
    with pytest.raises(SchemaMismatch):
        reconcile(views.orders, views.orders_shape)


def test_what_is_shuffled_depends_on_the_difference_only(spark):
    """Twenty times the rows, the same difference: the same cells leave the tasks, and far fewer rows than there are."""
    moved = []
    for rows in (40_000, 800_000):
        base = spark.range(0, rows, numPartitions=4).select("id", (F.col("id") * 7).alias("x"))
        other = base.where("id <> 17").withColumn("x", F.expr("if(id = 23, -1L, x)"))
        found = cells(hashed_sides(base, other, 1e-6), 100)
        moved.append(shuffled_rows(found))
        assert sorted(abs(n) for n in peel(found.collect(), 100).values()) == [1, 1, 1]
    assert moved[0] == moved[1] <= 8 * 300


def test_copies_and_mixed_cells():
    """Cells that hold several rows, also with a count of one, are not taken for a row."""
    rng = random.Random(5)
    size, rows = 64, {}
    for _ in range(60):
        h1, h2 = rng.getrandbits(64) - 2 ** 63, rng.getrandbits(64) - 2 ** 63
        rows[h1, h2] = rng.choice([-3, -2, -1, 1, 2, 5])
    table = {}
    half = 2 ** 31 - 1
    for (h1, h2), n in rows.items():
        for at in (h1 % size, size + h2 % size, 2 * size + (h1 ^ (h2 >> 17)) % size):
            own = table.setdefault(at, [0, 0, 0, 0])
            for i, x in enumerate((n, n * h1, n * h2, n * (h1 & half) * (h2 & half))):
                own[i] += x
    listed = [{"cell": at, "n": own[0], **{f"h{k}_{i}": (own[k] if i == 0 else 0) for k in (1, 2, 3) for i in range(3)}} for at, own in table.items()]
    assert peel(listed, size) == rows
