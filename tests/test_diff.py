"""Comparison operators on small frames: one test per point where naive checks go wrong."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabproof import (changes_by_column, compare_fingerprints, contract_diff, fingerprint_diff, key_classes, key_diff,
                      key_diff_summary, multiset_diff, multiset_diff_rows, partition_count_diff, require_contract,
                      row_counts, schema_diff)
from tabproof.functions.floats import digits_for, normalise_floats, rounded, tier_epsilon
from tabproof.operators.fingerprint import row_checksums
from tabproof.operators.sides import SchemaMismatch

NAN, INF = float("nan"), float("inf")


def surplus(a, b, **options):
    r = multiset_diff(a, b, **options).first()
    return r.baseline_only, r.candidate_only


def test_counts_copies(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, None)], "k int, s string")
    assert surplus(a, b) == (1, 2)
    rows = {(r.k, r.surplus_side, r.surplus_rows) for r in multiset_diff_rows(a, b).collect()}
    assert rows == {(1, "baseline", 1), (2, "candidate", 1), (3, "candidate", 1)}


def test_equal_under_layout_and_column_order(spark, views):
    a = views.lineitem
    b = a.select(*reversed(a.columns)).repartition(7).orderBy(F.rand(1))
    assert surplus(a, b) == (0, 0)
    assert fingerprint_diff(a, b).count() == 0
    assert fingerprint_diff(a, b, epsilon=0.0).count() == 0


@pytest.mark.parametrize("change, expected", [
    (lambda df: df.withColumn("o_totalprice", F.expr("if(o_orderkey = 7, o_totalprice + 1, o_totalprice)")), (1, 1)),
    (lambda df: df.where("o_orderkey <> 7"), (1, 0)),
    (lambda df: df.unionAll(df.where("o_orderkey = 7")), (0, 1)),
    (lambda df: df.withColumn("o_orderstatus", F.expr("if(o_orderkey = 7, NULL, o_orderstatus)")), (1, 1)),
])
def test_each_edit_is_counted(views, change, expected):
    assert surplus(views.orders, change(views.orders)) == expected
    assert fingerprint_diff(views.orders, change(views.orders), distinct=None).count() > 0


def test_values_that_moved_between_rows_show_in_the_row_checksum(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    b = spark.createDataFrame([(1, 20), (2, 10)], "k int, v int")
    off = [(r["column"], r.metric) for r in fingerprint_diff(a, b).collect()]
    assert off == [("*", "content")]


def test_nulls_in_other_columns_are_told_apart(spark):
    a = spark.createDataFrame([("x", None)], "p string, q string")
    b = spark.createDataFrame([(None, "x")], "p string, q string")
    assert ("*", "content") in {(r["column"], r.metric) for r in fingerprint_diff(a, b).collect()}


def test_passes_over_some_columns_give_the_same_fingerprint(views):
    a, b = views.orders, views.orders_cand
    one = {(r["column"], r.metric): tuple(r)[2:] for r in compare_fingerprints(a, b).collect()}
    many = {(r["column"], r.metric): tuple(r)[2:] for r in compare_fingerprints(a, b, columns_per_pass=2).collect()}
    assert many == one
    assert one[("*", "content")][0] is not None
    wide = a.select("*", *[F.col("o_totalprice").alias(f"p{i}") for i in range(40)])
    passes = {(r["column"], r.metric): tuple(r)[2:] for r in compare_fingerprints(wide, wide.limit(9)).collect()}
    whole = {(r["column"], r.metric): tuple(r)[2:] for r in compare_fingerprints(wide, wide.limit(9), columns_per_pass=99).collect()}
    assert passes == whole


def test_row_checksums(spark, views):
    a = views.lineitem
    assert row_checksums(a, a.repartition(5)).first().same
    assert row_checksums(a, a.select(*reversed(a.columns)), 0.0).first().same
    off = a.withColumn("l_tax", F.expr("if(l_orderkey = 5 AND l_linenumber = 1, NULL, l_tax)"))
    assert not row_checksums(a, a.limit(5)).first().same
    assert row_checksums(a, off).first().same == (a.exceptAll(off).count() == 0)
    empty = row_checksums(a.limit(0), a.limit(0)).first()
    assert empty.same and empty.baseline_rows == empty.candidate_rows == 0
    p = spark.createDataFrame([("x", None), (None, "y")], "p string, q string")
    q = spark.createDataFrame([(None, "x"), ("y", None)], "p string, q string")
    assert not row_checksums(p, q).first().same


def test_nan_and_negative_zero_are_values(spark):
    a = spark.createDataFrame([(NAN, -0.0), (INF, 1.0)], "x double, y double")
    b = spark.createDataFrame([(NAN, 0.0), (INF, 1.0)], "x double, y double")
    for epsilon in (0.0, 1e-6):
        assert surplus(a, b, epsilon=epsilon) == (0, 0)
        assert fingerprint_diff(a, b, epsilon=epsilon).count() == 0


def test_sum_near_zero_does_not_depend_on_order(spark):
    rows = [(1e15,), (0.1,), (-1e15,), (0.2,), (3e14,), (-3e14,)] * 50
    a = spark.createDataFrame(rows, "x double").repartition(1)
    b = spark.createDataFrame(rows[::-1], "x double").repartition(7)
    assert fingerprint_diff(a, b).count() == 0


def test_integer_sum_beyond_64_bits(spark):
    big = 2**63 - 1
    a = spark.createDataFrame([(big,), (big,), (-5,), (None,)], "x bigint")
    total = {r.metric: r.baseline for r in compare_fingerprints(a, a).where("`column` = 'x'").collect()}
    assert total["sum"] == float(2 * big - 5) and total["nulls"] == 1
    b = spark.createDataFrame([(big,), (big,), (-4,), (None,)], "x bigint")
    assert "sum" in {r.metric for r in fingerprint_diff(a, b).collect()}
    assert compare_fingerprints(a.where("x < 0"), a.where("x < 0")).where("metric = 'sum'").first().baseline == -5.0


def test_columns_of_every_kind(spark):
    df = spark.sql("""
        SELECT map('b', 2, 'a', 1) AS m, array(1, 2) AS l, INTERVAL 3 DAYS AS i, named_struct('p', 1, 'q', map('k', 1)) AS s,
               cast(1.25 AS decimal(10,2)) AS d, binary('ab') AS b, DATE'2024-01-01' AS day, cast(1.5 AS float) AS f
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
    other = spark.sql("""
        SELECT map('a', 1, 'b', 2) AS m, array(1, 2) AS l, INTERVAL 72 HOURS AS i, named_struct('p', 1, 'q', map('k', 1)) AS s,
               cast(1.25 AS decimal(10,2)) AS d, binary('ab') AS b, DATE'2024-01-01' AS day, cast(1.5 AS float) AS f
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""")
    other = other.withColumn("i", F.col("i").cast(df.schema["i"].dataType))
    assert surplus(df, other) == (0, 0)
    assert fingerprint_diff(df, other).count() == 0
    changed = other.withColumn("m", F.expr("if(m IS NULL, m, map('a', 1, 'b', 3))"))
    assert surplus(df, changed) == (1, 1)
    assert {(r["column"], r.metric) for r in fingerprint_diff(df, changed).collect()} == {("*", "content"), ("m", "content")}
    keyed, keyed_changed = (x.withColumn("k", F.expr("day IS NULL")) for x in (df, changed))
    assert [r.changed_columns for r in key_diff(keyed, keyed_changed, ["k"]).collect()] == [["m"]]


def test_types_are_compared_unless_told_otherwise(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1,)], "x bigint")
    with pytest.raises(SchemaMismatch, match="type of x"):
        multiset_diff(a, b)
    assert surplus(a, b, strict_types=False) == (0, 0)
    with pytest.raises(SchemaMismatch, match="only in candidate: y"):
        multiset_diff(a, a.withColumn("y", F.lit(1)))


def test_names_with_dots_and_ticks(spark):
    a = spark.createDataFrame([(1, 2.0, 3)], ["a.b", "c`d", "it's \\ x"])
    assert surplus(a, a) == (0, 0)
    assert compare_fingerprints(a, a).where("NOT same").count() == 0
    assert {r["column"] for r in schema_diff(a, a).collect()} == set(a.columns)
    assert key_diff_summary(a, a, ["a.b"]).first().same == 1
    b = a.withColumn("it's \\ x", F.lit(4).cast("bigint"))
    assert key_diff(a, b, ["a.b"]).first().changed_columns == ["it's \\ x"]


def test_empty_sides(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, x double")
    assert surplus(a, a.limit(0)) == (1, 0)
    assert row_counts(a.limit(0), a).first().asDict() == {"baseline_rows": 0, "candidate_rows": 1, "passed": False}
    assert compare_fingerprints(a.limit(0), a.limit(0)).where("NOT same").count() == 0
    off = {(r["column"], r.metric) for r in fingerprint_diff(a, a.limit(0)).collect()}
    assert ("*", "rows") in off and ("k", "min") in off


def test_null_partition_value_counts(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "p string, k int")
    assert partition_count_diff(a, a, ["p"]).count() == 0
    b = a.where("k <> 2")
    assert [tuple(r) for r in partition_count_diff(a, b, ["p"]).collect()] == [(None, 2, 1)]
    only_there = b.unionAll(spark.createDataFrame([("y", 9)], "p string, k int"))
    assert ("y", 0, 1) in {tuple(r) for r in partition_count_diff(a, only_there, ["p"]).collect()}


def test_rounding_is_not_tolerance(spark):
    a = spark.createDataFrame([(1, 4.9999e-7)], "k int, x double")
    b = spark.createDataFrame([(1, 5.0001e-7)], "k int, x double")
    assert surplus(a, b) == (1, 1)
    assert key_diff(a, b, ["k"]).count() == 0


def test_epsilon_and_digits():
    assert [digits_for(e) for e in (0.0, 1e-6, 3e-6, 1.0, 10.0)] == [12, 6, 6, 0, 0]
    assert tier_epsilon("zero_risk") == 0.0 and tier_epsilon("semantics_preserving") == 1e-6
    assert tier_epsilon("semantics_preserving", 1e-9) == 1e-9
    for bad in (lambda: tier_epsilon("zero_risk", 1e-6), lambda: tier_epsilon("none"),
                lambda: tier_epsilon("refresh_change", NAN), lambda: tier_epsilon("refresh_change", -1.0)):
        with pytest.raises(ValueError):
            bad()


def test_rounding_shortcut_equals_rounding(spark):
    df = spark.range(200_000).selectExpr(
        """CASE int(id % 6) WHEN 0 THEN rand(1) WHEN 1 THEN round(rand(2) * 1e6, 6) WHEN 2 THEN round(rand(3) * 1e10, 6)
           WHEN 3 THEN rand(4) * 1e13 WHEN 4 THEN (bigint(rand(5) * 1e12) + 0.5D) / 1e6 ELSE -round(rand(6) * 1e9, 2) + 1e-9 END AS x""")
    x = df.schema["x"].dataType
    for epsilon in (1e-2, 1e-6, 1e-12):
        assert df.where(f"NOT ({rounded('x', x, epsilon)} <=> round(x, {digits_for(epsilon)}))").count() == 0


def test_normalise_leaves_other_types(spark):
    df = spark.createDataFrame([(1.23456789, Decimal("1.5"), 7, "s")], "x double, d decimal(10,2), k int, s string")
    out = normalise_floats(df, 1e-2)
    assert out.first() == (1.23, Decimal("1.50"), 7, "s")
    assert out.schema["d"].dataType == df.schema["d"].dataType
    assert normalise_floats(df, 0.0).first() == df.first()


def test_key_classes(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0), (3, "z", NAN), (4, "d", 0.0), (4, "d", 0.0), (None, "n", 1.0),
                               (6, None, 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.0 + 1e-7), (2, "Y", 2.0), (3, "z", NAN), (4, "d", 0.0), (5, "new", 1.0),
                               (None, "n", 1.0), (6, "six", 1.0)], "k int, s string, v double")
    found = {r.k: (r.change, r.changed_columns, r.baseline_rows, r.candidate_rows)
             for r in key_classes(a, b, ["k"]).collect()}
    assert found == {
        1: ("same", [], 1, 1), 2: ("changed", ["s", "v"], 1, 1), 3: ("same", [], 1, 1),
        4: ("duplicated", [], 2, 1), 5: ("added", [], 0, 1), None: ("same", [], 1, 1), 6: ("changed", ["s"], 1, 1)}
    assert {r["column"]: r.changed_keys for r in changes_by_column(a, b, ["k"]).collect()} == {"s": 2, "v": 1}
    with pytest.raises(SchemaMismatch, match="key columns not found"):
        key_diff(a, b, ["nope"])


def test_all_columns_are_keys(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert key_diff_summary(a, b, ["k"]).first().asDict() == {
        "added": 1, "removed": 1, "changed": 0, "same": 1, "duplicated": 0}


def test_hot_key_does_not_multiply(spark):
    a = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id AS v")
    summary = key_diff_summary(a, a, ["k"]).first()
    assert (summary.duplicated, summary.same) == (1, 2000)


def test_schema_diff_sees_nulls_in_the_data(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(1, None)], "k bigint, s string")
    assert {r["column"]: r.status for r in schema_diff(a, b).collect()} == {"k": "type_changed", "s": "nulls_appeared"}


def detail(spark, rows):
    return spark.createDataFrame(rows, "table_name string, side string, reader int, writer int, features array<string>")


def test_contract(spark):
    rows = [("same", "baseline", 1, 2, ["a"]), ("same", "candidate", 1, 2, ["a"]),
            ("lower", "baseline", 3, 7, ["a", "b"]), ("lower", "candidate", None, 2, None),
            ("reader", "baseline", None, None, None), ("reader", "candidate", 2, 1, None),
            ("writer", "baseline", 1, 2, []), ("writer", "candidate", 1, 7, []),
            ("feature", "baseline", 1, 2, ["a"]), ("feature", "candidate", 1, 2, ["c", "a", "b"]),
            ("split", "baseline", 1, 2, ["a"]), ("split", "baseline", 1, 1, ["b"]), ("split", "candidate", 1, 2, ["a", "b"]),
            ("new", "candidate", 3, 7, ["x"]), ("gone", "baseline", 1, 1, None)]
    found = {r.table_name: (r.passed, r.added_features, r.reason) for r in contract_diff(detail(spark, rows)).collect()}
    assert {t for t, (ok, *_) in found.items() if ok} == {"same", "lower", "split"}
    assert found["feature"][1] == ["b", "c"]
    assert found["new"][2] == "no baseline row" and found["gone"][2] == "no candidate row"
    allowed = {r.table_name: r.passed for r in contract_diff(detail(spark, rows), allow_new=True).collect()}
    assert allowed["new"] and not allowed["gone"] and not allowed["reader"]
    require_contract(detail(spark, rows[:4]))
    with pytest.raises(ValueError, match="writer"):
        require_contract(detail(spark, rows))


def test_bucketed_tables_are_compared_without_moving_rows(spark, views):
    names = ["diff_bucketed_a", "diff_bucketed_b"]
    try:
        for name, df in zip(names, (views.orders, views.orders_cand)):
            df.write.mode("overwrite").bucketBy(4, "o_orderkey").saveAsTable(name)
        diff = multiset_diff(spark.table(names[0]), spark.table(names[1]))
        plan = diff._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange SinglePartition") == 1
        assert tuple(diff.first()) == tuple(multiset_diff(views.orders, views.orders_cand).first())
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_timestamps(spark):
    t = datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, t)], "k int, t timestamp")
    b = spark.createDataFrame([(1, t + timedelta(microseconds=1))], "k int, t timestamp")
    assert surplus(a, b) == (1, 1)


def test_keys_are_grouped_without_sorting_whole_rows(views):
    """Counts and hashes go through hash aggregates; whole rows are fetched for keys whose sides disagree."""
    plan = key_diff(views.orders, views.orders_cand, ["o_orderkey"])._jdf.queryExecution().sparkPlan().toString()
    first = plan[:plan.index("any_value")] if "any_value" in plan else plan
    assert "HashAggregate(keys=[o_orderkey" in plan and "LeftSemi" in plan
    assert "xxhash64" in first
