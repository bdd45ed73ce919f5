"""The ladder: order of rungs, early stop, refusals."""

import pytest
from pyspark.sql import functions as F

from tabproof import NotEquivalent, compare, require_equivalent
from tabproof.plans.registered import compare_registered, perf_gate_registered, registry_row


def rungs(verdict):
    return [(r.check, r.passed) for r in verdict.rungs]


def test_equal_tables_climb_to_the_top(spark, views):
    views.orders.createOrReplaceTempView("orders_by_name")
    verdict = require_equivalent(spark, "orders_by_name", views.orders_drift, partition_cols=["o_orderstatus"])
    assert rungs(verdict) == [("schema", True), ("partition_count", True), ("row_count", True), ("fingerprint", True),
                              ("multiset", True)]
    assert verdict.passed and verdict.failed_at is None


def test_exact_tier_rejects_drift(spark, views):
    verdict = compare(spark, views.orders, views.orders_drift, tier="zero_risk")
    assert verdict.failed_at == "fingerprint" and "o_totalprice" in verdict.reason


@pytest.mark.parametrize("change, at", [
    (lambda df: df.drop("o_custkey"), "schema"),
    (lambda df: df.withColumn("o_custkey", F.col("o_custkey").cast("int")), "schema"),
    (lambda df: df.limit(10), "row_count"),
    (lambda df: df.withColumn("o_custkey", F.col("o_custkey") + 1), "fingerprint"),
])
def test_stops_at_the_first_divergence(spark, views, change, at):
    with pytest.raises(NotEquivalent, match=f"not equivalent at {at}") as caught:
        require_equivalent(spark, views.orders, change(views.orders), target="orders")
    assert caught.value.verdict.rungs[-1].check == at


def test_partition_counts_come_before_the_scan(spark, views):
    moved = views.orders.withColumn("o_orderstatus", F.expr("if(o_orderkey = 7, 'Z', o_orderstatus)"))
    verdict = compare(spark, views.orders, moved, partition_cols=["o_orderstatus"])
    assert rungs(verdict) == [("schema", True), ("partition_count", False)]


def test_incremental_results_need_a_recomputed_baseline(spark, views):
    with pytest.raises(ValueError, match="baseline_is_full_recompute"):
        compare(spark, views.orders, views.orders, tier="refresh_change")
    assert compare(spark, views.orders, views.orders, tier="refresh_change", baseline_is_full_recompute=True).passed


def test_tolerance_cannot_be_loosened(spark, views):
    with pytest.raises(ValueError, match="looser"):
        compare(spark, views.orders, views.orders, epsilon=1e-3)
    with pytest.raises(ValueError, match="unknown risk tier"):
        compare(spark, views.orders, views.orders, tier="harmless")


def test_contract_rung(spark, views):
    details = spark.createDataFrame(
        [("t", "baseline", 1, 2, ["a"]), ("t", "candidate", 1, 2, ["a", "b"])],
        "table_name string, side string, reader int, writer int, features array<string>")
    verdict = compare(spark, views.orders, views.orders, details=details)
    assert rungs(verdict) == [("contract", False)]


def test_distinct_counts_on_request(spark, views):
    assert compare(spark, views.orders, views.orders_drift, distinct="approx").passed
    assert compare(spark, views.orders, views.orders_drift, distinct="exact").passed


def test_proof_without_prefilter(spark, views):
    verdict = compare(spark, views.orders, views.orders_drift, prefilter=False)
    assert [c for c, _ in rungs(verdict)] == ["schema", "row_count", "multiset"] and verdict.passed
    swapped = views.orders.withColumn("o_custkey", F.expr("o_custkey + 1"))
    assert compare(spark, views.orders, swapped, prefilter=False).failed_at == "multiset"


def registry(spark, **values):
    row = {"job_name": "j", "notebook_path": "n", "epsilon": 1e-6, "min_gain": 0.2, "benchmark_runs": 2,
           "equivalence_keys": ["o_orderkey"], "nondeterministic": False} | values
    return spark.createDataFrame([tuple(row.values())], "job_name string, notebook_path string, epsilon double, min_gain double, "
                                 "benchmark_runs int, equivalence_keys array<string>, nondeterministic boolean")


def test_settings_come_from_the_registry(spark, views):
    row = registry_row(registry(spark), "j", "n")
    assert compare_registered(spark, row, views.orders, views.orders_drift).passed
    tight = registry_row(registry(spark, epsilon=0.0, nondeterministic=True), "j", "n")
    verdict = compare_registered(spark, tight, views.orders, views.orders_drift)
    assert verdict.failed_at == "fingerprint" and [r.check for r in verdict.rungs][-2:] == ["key_diff", "nondeterministic"]
    assert f"{views.orders.count()} changed" in verdict.rungs[-2].reason
    loose = registry_row(registry(spark, epsilon=1.0, equivalence_keys=[]), "j", "n")
    off = views.orders.withColumn("o_totalprice", F.expr("o_totalprice + 0.01D"))
    verdict = compare_registered(spark, loose, views.orders, off)
    assert verdict.epsilon == 1e-6 and verdict.rungs[-1].check == "fingerprint"
    with pytest.raises(ValueError, match="no registry row"):
        registry_row(registry(spark), "j", "other")


def test_gain_under_the_registered_minimum(spark):
    rows = [("j", "n", v, i, s) for v, times in (("baseline", (9.0, 10.0, 10.0, 1.0)), ("candidate", (9.0, 7.0, 8.0))) for i, s in enumerate(times)]
    timings = spark.createDataFrame(rows, "job_name string, notebook_path string, variant string, run_no int, seconds double")
    lenient = perf_gate_registered(timings, registry(spark)).first()
    assert (lenient.before_s, lenient.after_s, lenient.passed) == (10.0, 7.5, True)
    assert not perf_gate_registered(timings, registry(spark, min_gain=0.3)).first().passed
