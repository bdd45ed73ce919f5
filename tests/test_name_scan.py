"""Many names in many texts, against Spark's own contains and regular expressions."""

import random

import pytest
from pyspark.sql import functions as F

from tabproof.operators import salting
from tabproof.operators.name_scan import rows_naming
from tabproof.operators.statements import bounded, pairs_by_table

LETTERS = ["a", "b", "_", "1", " ", ".", "-", "é", "́", "中", "‍", "(", "Ⓐ"]


def found(df):
    return sorted({(r.id, r.key) for r in df.collect()})


@pytest.mark.parametrize("whole_word", [False, True])
@pytest.mark.parametrize("most", [4_000_000, 60])
def test_equals_the_nested_loop(spark, whole_word, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, n)))
    texts = spark.createDataFrame([(i, word(30)) for i in range(300)] + [(-1, None), (-2, "")], "id int, text string").repartition(3)
    names = spark.createDataFrame([(n, f"k{i}") for i, n in enumerate(["a", "ab", "", None, "a", "é", "́", *[word(3) for _ in range(40)]])], "name string, key string")
    hit = F.rlike("text", bounded(F.col("name"))) if whole_word else F.contains("text", F.col("name"))
    expected = texts.crossJoin(names.where("name <> ''")).where(hit)
    assert found(rows_naming(texts, "text", names, "name", "key", whole_word, most)) == found(expected)


def test_letters_beyond_two_bytes(spark):
    """A letter of two UTF-16 units is a letter here, where a Java look-behind sees but its half."""
    texts = spark.createDataFrame([(1, "𝒳a"), (2, "a𝒳"), (3, "😀a😀")], "id int, text string")
    names = spark.createDataFrame([("a", "k")], "name string, key string")
    assert found(rows_naming(texts, "text", names, "name", "key", True)) == [(3, "k")]


def test_other_columns_stay_beside_the_names(spark):
    rows = spark.createDataFrame([(1, "x y", [1, 2], {"a": 1}), (2, "z", None, None)], "id int, text string, l array<int>, m map<string,int>")
    names = spark.createDataFrame([("x", "X"), ("y", "Y")], "name string, key string")
    out = rows_naming(rows, "text", names, "name", "key")
    assert out.columns == ["id", "l", "m", "key"]
    assert sorted((r.id, r.l, r.m, r.key) for r in out.collect()) == [(1, [1, 2], {"a": 1}, "X"), (1, [1, 2], {"a": 1}, "Y")]
    assert rows_naming(rows, "text", names.where("false"), "name", "key").collect() == []
    assert rows_naming(rows.where("false"), "text", names, "name", "key").collect() == []


def test_a_text_is_read_once_and_nothing_is_exploded(spark, views):
    tables = views.write_history.select("table_name").distinct()
    plan = pairs_by_table(views.statement_log, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


def test_hot_keys_by_one_pass(spark):
    rows = spark.range(0, 40_000, numPartitions=4).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 10 = 1 THEN 'warm' WHEN id % 50 = 2 THEN NULL ELSE string(id) END AS k", "id")
    exact = {r.k: r.n for r in rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where("n >= 400").collect()}
    hot, least = salting.hot_key_rows(rows, "k", 0.01, 1)
    assert least == 400 and set(hot) == set(exact) == {"hot", "warm"}
    assert all(exact[k] <= n <= exact[k] + 40_000 * 3.5 / 3200 for k, n in hot.items())
    assert salting.hot_salts(rows, "k", 0.01, 1) == {"hot": -(-hot["hot"] // 400), "warm": -(-hot["warm"] // 400)}
    assert salting.hot_keys(rows.where("false"), "k") == []
    # A key at the threshold is counted exactly, one that the sketch has no room for falls back to a group of all keys.
    edge = spark.range(0, 1000).selectExpr("if(id < 100, 7L, id) AS k")
    assert salting.hot_key_rows(edge, "k", 0.1, 1)[0] == {7: 100} and salting.hot_key_rows(edge, "k", 0.101, 1)[0] == {}
    assert salting.hot_key_rows(edge, "k", 0.0005, 50)[0] == {7: 100}


def test_salts_by_size(spark):
    fact = spark.range(0, 3000, numPartitions=3).selectExpr("if(id % 3 = 0, 1, if(id % 10 = 1, 2, id)) AS k", "id AS v")
    dim = spark.range(0, 3000).selectExpr("id AS k", "id * 2 AS w")
    joined = salting.spread_join(fact, dim, "k", {1: 7, 2: 3})
    assert joined.count() == fact.count() and joined.where("w <> k * 2").count() == 0
    assert sorted(map(tuple, joined.select("k", "v").collect())) == sorted(map(tuple, fact.collect()))
