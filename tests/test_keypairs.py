"""Rows of duplicated keys paired one by one, against a plain loop."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabproof.operators.keypairs import close_numbers, key_pairs, key_surplus, paired_rows, stretched
from tabproof.operators.sides import SIDE, SchemaMismatch

SCHEMA = "k string, e string, x double, y double"


def brute_force(left, right, epsilon):
    """Equal rows first, then in the order of x and y the earliest waiting row of the other side that is close."""
    b, c = Counter(left), Counter(right)
    same = b & c
    out = Counter()
    for row, n in same.items():
        out[row, "baseline", "paired"] += n
        out[row, "candidate", "paired"] += n
    kind = lambda v: 1 if v is None else 2 if v != v else 3 if v == float("inf") else 4 if v == -float("inf") else 0
    groups = {}
    for side, rows in ((0, b - same), (1, c - same)):
        for row, n in rows.items():
            groups.setdefault((row[0], row[1], kind(row[2]), kind(row[3])), []).extend([(row, side)] * n)
    for rows in groups.values():
        order = lambda r: (r[0][2] if kind(r[0][2]) == 0 else 0, r[0][3] if kind(r[0][3]) == 0 else 0, r[1])
        waiting = ([], [])
        for row, side in sorted(rows, key=order):
            other = next((i for i, o in enumerate(waiting[1 - side])
                          if close_numbers(o[2], row[2], epsilon) and close_numbers(o[3], row[3], epsilon)), None)
            if other is None:
                waiting[side].append(row)
            else:
                out[row, ("baseline", "candidate")[side], "paired"] += 1
                out[waiting[1 - side].pop(other), ("candidate", "baseline")[side], "paired"] += 1
        for side, name in ((0, "baseline"), (1, "candidate")):
            for row in waiting[side]:
                out[row, name, "surplus"] += 1
    return Counter({(repr(k[0]), *k[1:]): n for k, n in out.items()})


def found(df):
    out = Counter()
    for r in df.collect():
        for what in ("paired", "surplus"):
            if r[what]:
                out[repr((r.k, r.e, r.x, r.y)), r.side, what] += r[what]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_equals_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    inf, nan = float("inf"), float("nan")
    nans = [nan]  # one object, so that equal rows are equal in the loop

    def draw(n):
        return [(rng.choice(["a", "a", "b", None]), rng.choice(["p", "q"]), rng.choice([None, inf, -inf, nans[0], *[i / 4 for i in range(12)]]),
                 rng.choice([None, 0.0, 0.25, 0.5, 5.0])) for _ in range(n)]

    both = draw(15)
    left, right = both + draw(30), both + draw(30)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(paired_rows(frame(left), frame(right), ["k"], 0.25)) == brute_force(left, right, 0.25)


@pytest.mark.parametrize("together", [0, 4, 100])
def test_small_groups_are_not_range_sorted(spark, together):
    """Groups sorted in one task and range-sorted ones are paired alike; while none is large, nothing is range-sorted."""
    rng = random.Random(together)
    draw = lambda n: [(rng.choice(["a", "b", None]), "p", rng.choice([None, float("inf"), *[i / 4 for i in range(12)]]), 0.0) for _ in range(n)]
    left, right = draw(25), draw(25)
    rows = paired_rows(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"], 0.25, together=together)
    assert found(rows) == brute_force(left, right, 0.25)
    assert ("rangepartitioning" in rows._jdf.queryExecution().executedPlan().toString()) == (together < 100)


def test_rows_of_several_batches(spark):
    """Waiting rows outlive their batch, whatever the types of the exact columns."""
    make = lambda shift: spark.range(500, numPartitions=3).selectExpr(
        "id % 7 AS k", "if(id % 3 = 0, NULL, date'2024-01-01') AS d", "timestamp'2024-01-01 10:00:00' AS t", "cast(id % 2 AS decimal(9,2)) AS m",
        "if(id % 2 = 0, float('nan'), NULL) AS f", "array(named_struct('n', int(id % 2), 'x', double('nan'))) AS l", "binary('q') AS b",
        f"id * 10 + {shift}D AS x")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 2)
    try:
        rows = paired_rows(make(0), make(0.1).where("x < 4900"), ["k", "f"], 0.25).where("side = 'baseline'")
        assert rows.groupBy().sum("paired", "surplus").collect() == [(490, 10)]
    finally:
        spark.conf.set(batch, before)


def test_summary_and_surplus(spark):
    left = [("a", "p", 1.0, 0.0), ("a", "p", 1.0, 0.0), ("a", "p", 5.0, 0.0), ("b", "p", 1.0, 0.0), (None, "p", 1.0, 0.0)]
    right = [("a", "p", 1.0 + 1e-9, 0.0), ("a", "p", 5.0, 0.0), ("a", "p", 6.0, 0.0), ("b", "p", 2.0, 0.0), (None, "p", 1.0, 0.0), (None, "p", 1.0, 0.0)]
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (left, right))
    assert {r.k: tuple(r)[1:] for r in key_pairs(a, b, ["k"]).collect()} == {"a": (3, 3, 2, 1, 1), None: (1, 2, 1, 0, 1)}
    assert sorted((str(r.k), r.x, r.side, r.surplus) for r in key_surplus(a, b, ["k"]).collect()) == [
        ("None", 1.0, "candidate", 1), ("a", 1.0, "baseline", 1), ("a", 6.0, "candidate", 1), ("b", 1.0, "baseline", 1), ("b", 2.0, "candidate", 1)]
    assert key_pairs(a.where("false"), b.where("false"), ["k"]).collect() == []
    exact = {r.k: r.paired for r in key_pairs(a, b, ["k"], epsilon=0.0).collect()}
    assert exact == {"a": 1, None: 1}
    with pytest.raises(SchemaMismatch, match="key column not found: z"):
        key_pairs(a, b, ["z"])


def test_a_hot_key_spreads(spark):
    """A third of the rows under one key: its rows are sorted over all partitions, and no window or group gathers them."""
    rows = spark.range(0, 30_000, numPartitions=4).selectExpr(
        "if(id % 3 = 0, 'hot', string(id)) AS k", f"id % 2 AS {SIDE}", "double(id) AS x", "1L AS __n", "0L AS __equal")
    ranged = stretched(rows, ["k"], ["x"], 1e-6)
    held = {r.part: r.n for r in ranged.where("k = 'hot'").groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}
    total = ranged.rdd.getNumPartitions()
    assert sum(held.values()) == 10_000 and (len(held) >= 2 or total == 1)
    assert max(held.values()) < 9_000 or total == 1
