"""Properties that must hold for any input."""

import math
import time

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from tabproof import compare_fingerprints, key_classes, multiset_diff
from tabproof.operators.asof import resolve_versions
from tabproof.operators.dag import IN_ONE_TASK, dag_order
from tabproof.operators.fingerprint import row_checksums
from tabproof.operators.running import exact_median, ordered_position, running_max, running_sum, value_counts

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

value = st.one_of(st.none(), st.sampled_from([0.0, -0.0, float("nan"), float("inf"), 1.5, 2.25, -3.125]))
row = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from(["a", "b", ""])), value)
table = st.lists(row, max_size=12)
SCHEMA = "k int, s string, x double"


def plain(r):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else (v + 0.0 if isinstance(v, float) else v) for v in r)


@SLOW
@given(a=table, b=table)
def test_signed_pass_equals_except_all(spark, a, b):
    con = duckdb.connect()
    for name, rows in (("a", a), ("b", b)):
        con.execute(f"CREATE TABLE {name} (k INTEGER, s VARCHAR, x DOUBLE)")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?, ?)", [[k, s, None if x is None else x + 0.0] for k, s, x in rows])
    expected = tuple(con.execute(f"SELECT count(*) FROM (SELECT * FROM {p} EXCEPT ALL SELECT * FROM {q})").fetchone()[0]
                     for p, q in (("a", "b"), ("b", "a")))
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    found = multiset_diff(left, right).first()
    assert (found.baseline_only, found.candidate_only) == expected
    assert row_checksums(left, right).first().same == (expected == (0, 0))
    if expected == (0, 0):
        assert compare_fingerprints(left, right).where("NOT same").count() == 0


@SLOW
@given(a=table, b=table)
def test_key_classes_count_every_key_once(spark, a, b):
    found = key_classes(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["k", "s"]).collect()
    left, right = {}, {}
    for rows, seen in ((a, left), (b, right)):
        for r in rows:
            seen.setdefault(r[:2], []).append(plain(r)[2])
    assert {(r.k, r.s) for r in found} == set(left) | set(right) and len(found) == len(set(left) | set(right))
    for r in found:
        p, q = left.get((r.k, r.s), []), right.get((r.k, r.s), [])
        want = ("duplicated" if max(len(p), len(q)) > 1 else "added" if not p else "removed" if not q
                else "same" if p == q else "changed")
        assert r.change == want


edges = st.lists(st.tuples(st.sampled_from("xy"), st.integers(0, 6), st.integers(0, 8)), max_size=14)


def waves_of(tasks, deps):
    """Order by repeatedly releasing what waits for nothing; the rest at once when nothing is ready."""
    left, out, at, wave = set(tasks), {}, 0, 0
    while left:
        ready = sorted(t for t in left if not (deps.get(t, set()) & left)) or sorted(left)
        for t in ready:
            out[t] = (wave, at)
            at += 1
        left -= set(ready)
        wave += 1
    return out


@pytest.mark.parametrize("in_one_task", [IN_ONE_TASK, 10, 0])
@SLOW
@given(edges=edges)
def test_dag_order(spark, in_one_task, edges):
    tasks = [(j, f"t{k}") for j in "xy" for k in range(7)]
    listed = [(j, f"t{k}", f"t{d}") for j, k, d in edges]
    found = dag_order(spark.createDataFrame(tasks, "job_id string, task_key string"),
                      spark.createDataFrame(listed, "job_id string, task_key string, depends_on string"), in_one_task).collect()
    assert len(found) == len(tasks)
    for j in "xy":
        deps = {}
        for job, t, d in listed:
            if job == j:
                deps.setdefault(t, set()).add(d)
        assert {r.task_key: (r.wave, r.dag_order) for r in found if r.job_id == j} == waves_of(
            [t for job, t in tasks if job == j], deps)


@pytest.mark.parametrize("in_one_task", [IN_ONE_TASK, 0])
def test_dag_order_of_a_long_chain(spark, in_one_task):
    """Rounds follow the logarithm of a chain's length."""
    tasks = spark.range(1000).selectExpr("'j' AS job_id", "concat('t', lpad(id, 5, '0')) AS task_key")
    links = spark.range(1, 1000).selectExpr("'j' AS job_id", "concat('t', lpad(id, 5, '0')) AS task_key",
                                            "concat('t', lpad(id - 1, 5, '0')) AS depends_on")
    began = time.monotonic()
    found = dag_order(tasks, links, in_one_task).collect()
    assert time.monotonic() - began < 30
    assert {(r.task_key, r.wave, r.dag_order) for r in found} == {(f"t{k:05d}", k, k) for k in range(1000)}


@pytest.mark.parametrize("cycle", [False, True])
def test_dag_order_keeps_sizes_known(spark, cycle):
    """What Spark takes the result's size for does not grow with every round: the driver has to hold and multiply these numbers."""
    tasks = spark.range(300).selectExpr("'j' AS job_id", "concat('t', lpad(id, 5, '0')) AS task_key")
    links = spark.range(1, 300).selectExpr("'j' AS job_id", "concat('t', lpad(id, 5, '0')) AS task_key", "concat('t', lpad(id - 1, 5, '0')) AS depends_on")
    if cycle:
        links = links.union(spark.sql("SELECT 'j', 't00000', 't00290'"))
    found = dag_order(tasks, links, 0)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 512
    assert found.count() == 300


@pytest.fixture(scope="module")
def crowded(spark):
    """One group with most rows, one of nulls, many small ones; more partitions than one."""
    return spark.range(4000).selectExpr(
        "CASE WHEN id % 3 <> 2 THEN 'hot' WHEN id % 30 = 2 THEN NULL ELSE concat('g', id % 50) END AS g",
        "id", "int(id * 7919 % 1013) AS v").repartition(9)


def test_running_aggregates_equal_windows(crowded):
    w = Window.partitionBy("g").orderBy("v", "id")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    expected = crowded.select("id", (F.row_number().over(w) - 1).alias("p"), F.sum("id").over(rows).alias("s"),
                              F.max("id").over(rows).alias("m"))
    found = (
        ordered_position(crowded, ["g"], ["v", "id"], "p").select("id", "p")
        .join(running_sum(crowded, ["g"], ["v", "id"], F.col("id"), "s").select("id", "s"), "id")
        .join(running_max(crowded, ["g"], ["v", "id"], F.col("id"), "m").select("id", "m"), "id"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_median_equals_percentile(crowded):
    found = {r.g: (r.n, r.median, r.least, r.greatest) for r in exact_median(value_counts(crowded, ["g"], "v"), ["g"], "v").collect()}
    expected = {r.g: tuple(r)[1:] for r in crowded.groupBy("g").agg(
        F.count("v"), F.percentile("v", F.lit(0.5)), F.min("v"), F.max("v")).collect()}
    assert found == expected


moments = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 20), st.integers(0, 5)), max_size=15)
asked = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(-1, 22)),
                           st.one_of(st.none(), st.integers(0, 3))), min_size=1, max_size=10)


@SLOW
@given(history=moments, pins=asked)
def test_asof_equals_brute_force(spark, history, pins):
    base = pd.Timestamp("2024-01-01")
    at = lambda d: None if d is None else (base + pd.Timedelta(hours=d)).to_pydatetime()
    h = spark.createDataFrame([(t, v, at(d)) for t, d, v in history], "table_name string, version bigint, ts timestamp")
    p = spark.createDataFrame([(t, at(d), v) for t, d, v in dict.fromkeys(pins)],
                              "table_name string, pin_ts timestamp, pin_version bigint")
    found = {(r.table_name, r.pin_ts, r.pin_version): r.version for r in resolve_versions(h, p).collect()}
    expected = {}
    for t, d, v in pins:
        best = max((hv for ht, hd, hv in history if ht == t and d is not None and hd <= d), default=None)
        expected[(t, at(d), v)] = v if v is not None else best
    assert found == expected
