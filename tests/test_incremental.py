"""Aggregates under deletions and updates against full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from tabproof.plans import incremental
from tabproof.plans.incremental import aggregate_with_copies, apply_changes, signed

MEASURES = {"x": "x", "d": "cast(y AS decimal(18,2))"}
SCHEMA = "k string, j int, x long, y double"


def rows_of(df):
    return sorted(map(str, df.collect()))


def random_rows(rng, n):
    return [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([1, None]), rng.choice([None, *range(6)]), rng.choice([None, 0.5, 1.25, -3.0]))
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_full_recomputation(spark, seed):
    rng = random.Random(seed)
    before = random_rows(rng, 60)
    gone = sorted(rng.sample(range(60), 35))
    kept = [r for i, r in enumerate(before) if i not in gone]
    added = random_rows(rng, 8)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).repartition(3)
    stored = aggregate_with_copies(frame(before), ["k", "j"], MEASURES)
    now = frame(kept + added)
    # An update is a deletion and an addition; a row that comes and goes changes nothing.
    changes = signed(frame(added + added[:2]), frame([before[i] for i in gone] + added[:2]))
    after = apply_changes(stored, changes, ["k", "j"], MEASURES, now)
    assert after.dtypes == stored.dtypes
    assert rows_of(after) == rows_of(aggregate_with_copies(now, ["k", "j"], MEASURES))


def test_plain_values(spark):
    df = spark.createDataFrame([("a", 1, 5, 1.0), ("a", 1, 5, 2.0), ("a", 1, 7, None), ("b", 1, None, None)], SCHEMA)
    found = {r.k: r.asDict() for r in aggregate_with_copies(df, ["k"], {"x": "x"}).collect()}
    assert found["a"] == dict(k="a", rows=3, x_count=3, x_sum=17, x_min=5, x_min_copies=2, x_max=7, x_max_copies=1)
    assert found["b"] == dict(k="b", rows=1, x_count=0, x_sum=None, x_min=None, x_min_copies=None, x_max=None, x_max_copies=None)
    assert aggregate_with_copies(df.where("false"), ["k"], {"x": "x"}).collect() == []
    assert [tuple(r) for r in aggregate_with_copies(df, ["k"], {}).orderBy("k").collect()] == [("a", 3), ("b", 1)]


def test_only_groups_that_lost_an_extreme_are_read_again(spark, monkeypatch):
    df = spark.range(0, 1000).selectExpr("id % 10 AS k", "id AS x")
    stored = aggregate_with_copies(df, ["k"], {"x": "x"})
    read = []
    real = incremental.aggregate_with_copies
    monkeypatch.setattr(incremental, "aggregate_with_copies", lambda rows, *a: (read.append(sorted({r.k for r in rows.collect()})), real(rows, *a))[1])
    # 993 is the largest of group 3, 4 the smallest of group 4; group 5 loses its largest and gets a larger one.
    gone = df.where("x IN (993, 4, 500, 995)")
    more = spark.createDataFrame([(5, 5000), (6, 1)], "k long, x long")
    now = df.where("x NOT IN (993, 4, 500, 995)").unionByName(more)
    after = apply_changes(stored, signed(more, gone), ["k"], {"x": "x"}, now)
    assert rows_of(after) == rows_of(real(now, ["k"], {"x": "x"}))
    assert read == [[3, 4]]


def test_groups_that_empty_and_rows_that_never_were(spark):
    df = spark.createDataFrame([("a", 1, 5, 1.0), ("b", 1, 6, 1.0)], SCHEMA)
    stored = aggregate_with_copies(df, ["k"], {"x": "x"})
    left = apply_changes(stored, signed(deleted=df.where("k = 'a'")), ["k"], {"x": "x"}, df.where("k = 'b'"))
    assert [r.k for r in left.collect()] == ["b"]
    with pytest.raises(ValueError, match="more rows deleted"):
        apply_changes(stored, signed(deleted=df.unionByName(df)), ["k"], {"x": "x"}, df)


def test_a_hot_key_is_combined_in_the_tasks(spark):
    df = spark.range(0, 20_000, numPartitions=4).select(F.lit("hot").alias("k"), (F.col("id") % 7).alias("x"))
    plan = aggregate_with_copies(df, ["k"], {"x": "x"})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Window" not in plan and "Join" not in plan and "collect_list" not in plan
