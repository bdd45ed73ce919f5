"""Versions, pins, samples, and the comparison of whole flows."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabproof import AuditLog, SnapshotStore, compare_flows, flow_rollup, sample_by_key, validate_flow, validate_replay
from tabproof.functions.names import sandbox_name, short_name
from tabproof.operators.asof import latest_versions, require_resolved, resolve_versions
from tabproof.plans.flow import failed_targets
from tabproof.session import shared_dir
from tabproof.sources import snapshots
from tabproof.sources.snapshots import prepare_pair, read_version, write_versions
from workload.queries import revenue_flow, revenue_flow_salted

DAY = [datetime(2024, 1, d) for d in range(1, 9)]


@pytest.fixture
def store(spark, folder):
    made = SnapshotStore(spark, folder)
    for i in (0, 2, 4):
        made.commit("a", spark.range(i + 1), DAY[i])
    made.commit("b", spark.range(10), DAY[1])
    return made


def test_versions_are_numbered_and_pinned(store):
    assert store.pin_latest(["a", "b"]) == {"a": 2, "b": 0}
    assert store.resolve({"a": DAY[3], "b": DAY[1]}) == {"a": 1, "b": 0}
    assert store.resolve({"a": 0, "b": datetime(2030, 1, 1)}) == {"a": 0, "b": 0}
    with pytest.raises(ValueError, match="b at 2024-01-01"):
        store.resolve({"a": DAY[0], "b": DAY[0]})
    with pytest.raises(ValueError, match="c at"):
        store.pin_latest(["c"])
    many = {f"t{i}": DAY[0] for i in range(120)}
    with pytest.raises(ValueError, match="t7 at"):
        store.resolve({"a": DAY[3], **many})


def test_inputs_at_a_moment(store, folder):
    frames = store.inputs_at(["a", "b"], DAY[3], {"a": 0})
    assert {t: df.count() for t, df in frames.items()} == {"a": 1, "b": 10}
    copied = store.inputs_at(["a"], DAY[7], {"a": DAY[2]}, copy_to=folder + "-copy")
    assert copied["a"].count() == 3 and all(folder + "-copy" in f for f in copied["a"].inputFiles())


def test_pinned_read_opens_one_version(spark, folder):
    write_versions(spark.range(100).withColumn("version", F.col("id") % 4), folder)
    df = read_version(spark, folder, 3)
    assert df.columns == ["id"] and df.count() == 25
    assert "PartitionFilters: [isnotnull(version" in df._jdf.queryExecution().executedPlan().toString()


def test_relations_of_pins(spark):
    history = spark.createDataFrame([("a", 0, DAY[0]), ("a", 1, DAY[1])], "table_name string, version bigint, ts timestamp")
    listed = spark.createDataFrame([("a",), ("z",)], "table_name string")
    assert latest_versions(history).first().version == 1
    with pytest.raises(Exception, match="z: no version"):
        latest_versions(history, listed).collect()
    pins = spark.createDataFrame([("a", datetime(2023, 1, 1), None)], "table_name string, pin_ts timestamp, pin_version bigint")
    resolved = resolve_versions(history, pins)
    assert not resolved.first().resolved
    with pytest.raises(Exception, match="no version at or before"):
        require_resolved(resolved).collect()


def test_sample_does_not_depend_on_layout(views):
    one = sample_by_key(views.orders, ["o_orderkey"], 20).select("o_orderkey")
    other = sample_by_key(views.orders.repartition(13), ["o_orderkey"], 20).select("o_orderkey")
    assert sorted(one.collect()) == sorted(other.collect()) and 200 < one.count() < 400
    smaller = sample_by_key(views.orders, ["o_orderkey"], 5).select("o_orderkey")
    assert smaller.exceptAll(one).count() == 0
    assert sample_by_key(views.orders, ["o_orderkey"], 100).count() == views.orders.count()
    lines = sample_by_key(views.lineitem, ["l_orderkey"], 20).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    assert lines.join(one, "o_orderkey", "left_anti").join(views.orders, "o_orderkey", "left_semi").count() == 0
    with pytest.raises(ValueError):
        sample_by_key(views.orders, ["o_orderkey"], 0)


def test_sample_tells_key_tuples_apart(spark):
    df = spark.createDataFrame([("a", "b|c"), ("a|b", "c"), (None, "x"), ("x", None)], "p string, q string")
    from tabproof.functions.hashing import sample_slot
    assert df.select(sample_slot([F.col("p"), F.col("q")], 42)).distinct().count() == 4


def test_pair_says_what_was_sampled(spark, views):
    inputs = {"orders": views.orders, "lineitem": views.lineitem}
    left, right, how = prepare_pair(spark, inputs, 30, {"orders": ["o_orderkey"]})
    assert how == {"orders": "sampled 30%", "lineitem": "full"}
    assert left["orders"].exceptAll(right["orders"]).count() == 0
    assert prepare_pair(spark, inputs, 30)[2] == {"orders": "full", "lineitem": "full"}
    with pytest.raises(ValueError, match="unknown tables"):
        prepare_pair(spark, inputs, 30, {"nope": ["k"]})


def test_names(spark):
    df = spark.createDataFrame([("c.s.t",), ("`c`.`s`.`t`",), ("s.t",), ("c..t",)], "n string")
    assert [r[0] for r in df.select(sandbox_name(F.col("n"), "box", "_v1")).collect()] == ["c.box.s__t_v1"] * 2 + [None] * 2
    assert [r[0] for r in df.select(short_name(F.col("n"))).collect()] == ["t"] * 4


def test_flow_keeps_every_failure(spark, views):
    base = {"same": views.orders, "less": views.orders, "only": views.orders}
    cand = {"same": views.orders_drift, "less": views.orders.where("o_orderkey <> 7"), "more": views.orders}
    verdict = compare_flows(spark, base, cand)
    assert not verdict.passed and verdict.failed_targets == ["less", "more", "only"]
    rows = verdict.to_frame(spark).withColumn("flow", F.lit("f"))
    assert flow_rollup(rows).first().asDict() == {"flow": "f", "targets": 4, "failed": 3, "passed": False}
    assert failed_targets(rows).count() == 3
    assert compare_flows(spark, base, base, targets=["same"], tier="refresh_change", baseline_is_full_recompute=True).passed
    refused = compare_flows(spark, base, base, targets=["same"], tier="refresh_change")
    assert not refused.passed and "baseline_is_full_recompute" in refused.verdicts[0].reason


def test_flow_is_recorded(spark, views, folder):
    log = AuditLog(spark, folder)
    inputs = {"orders": views.orders, "lineitem": views.lineitem}
    verdict = validate_flow(spark, "j", revenue_flow, revenue_flow_salted, inputs, audit=log,
                            sample_percent=50, sample_keys={"orders": ["o_orderkey"]})
    assert verdict.failed_targets == ["by_status"]
    by_status = {r.status: r for r in log.read().collect()}
    assert set(by_status) == {"started", "failed"} and "orders sampled 50%, lineitem full" in by_status["started"].insight
    assert by_status["failed"].equivalence == {"by_customer": "pass", "by_status": "FAIL"}

    def broken(tables):
        raise RuntimeError("no such column")

    with pytest.raises(RuntimeError):
        validate_flow(spark, "j", revenue_flow, broken, inputs, audit=log)
    assert "no such column" in " ".join(r.insight for r in log.read().where("status = 'failed'").collect())


def test_the_step_that_targets_share_runs_once(spark, folder):
    """Targets read the stored step, not the lines again."""
    spark.createDataFrame([(1, 7, "F"), (2, 7, "O")], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{folder}/orders")
    spark.createDataFrame([(1, 10.0, 0.5), (1, 1.0, 0.0), (2, 2.0, 0.0)], "l_orderkey long, l_extendedprice double, l_discount double").write.parquet(
        f"{folder}/lineitem")
    tables = {t: spark.read.parquet(f"{folder}/{t}") for t in ("orders", "lineitem")}
    for run in (revenue_flow, revenue_flow_salted):
        found = run(tables)
        assert [tuple(map(str, r)) for r in found["by_customer"].collect()] == [("7", "8.0000")]
        assert sorted(tuple(map(str, r)) for r in found["by_status"].collect()) == [("F", "6.0000", "1"), ("O", "2.0000", "1")]
        assert not [f for df in found.values() for f in df.inputFiles() if "/lineitem/" in f]


def test_replay(spark, views, folder):
    store = SnapshotStore(spark, folder)
    for i, cut in enumerate((1997, 2100)):
        store.commit("orders", views.orders.where(f"year(o_orderdate) < {cut}"), DAY[2 * i])
        store.commit("lineitem", views.lineitem, DAY[2 * i])
        for target, df in revenue_flow(store.inputs_at(["orders", "lineitem"], DAY[2 * i])).items():
            store.commit(target, df, DAY[2 * i + 1])
    options = {"tables": ["orders", "lineitem"], "targets": ["by_customer", "by_status"]}
    same = validate_replay(spark, "j", revenue_flow, store, anchor_before=DAY[0], anchor_after=DAY[1], **options)
    assert same.passed
    faulty = validate_replay(spark, "j", revenue_flow_salted, store, anchor_before=DAY[0], anchor_after=DAY[1], **options)
    assert faulty.failed_targets == ["by_status"]
    wrong_inputs = validate_replay(spark, "j", revenue_flow, store, anchor_before=DAY[0], anchor_after=DAY[1],
                                   table_pins={"orders": 1}, **options)
    assert not wrong_inputs.passed
    assert validate_replay(spark, "j", revenue_flow, store, anchor_before=DAY[0], anchor_after=DAY[1],
                           table_pins={"orders": 1}, target_pins={"by_customer": 1, "by_status": DAY[7]}, **options).passed


def test_clusters_must_name_their_shared_folder(spark):
    class Context:
        def __init__(self, master, named=None):
            self.master, self.named, self.dir = master, named, None

        def getConf(self):
            return {"spark.checkpoint.dir": self.named}

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, place):
            self.dir = place

    def session(context):
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(Context("yarn")))
    named = Context("yarn", "hdfs:///shared")
    assert shared_dir(session(named)) == "hdfs:///shared" and named.dir == "hdfs:///shared"


def test_both_flows_start_from_the_same_rows(spark):
    """An input that reads differently each time is written once."""
    rows = spark.range(50).selectExpr("id", "current_timestamp() AS seen", "uuid() AS tag")
    same = lambda tables: {"out": tables["rows"]}
    assert validate_flow(spark, "job", same, same, {"rows": rows}).passed


def test_a_source_that_changes_between_the_runs(spark, folder):
    place = f"{folder}/source"
    spark.range(5).write.parquet(place)

    def first(tables):
        spark.range(9).write.mode("overwrite").parquet(place)
        return {"out": tables["rows"]}

    assert validate_flow(spark, "job", first, lambda t: {"out": t["rows"]}, {"rows": spark.read.parquet(place)}).passed


def test_a_second_writer_of_a_version_fails(spark, folder):
    store = SnapshotStore(spark, folder)
    spark.range(3).write.parquet(f"{folder}/t/version=0")
    with pytest.raises(Exception, match="exists"):
        store.commit("t", spark.range(8), datetime(2024, 1, 1))
    assert spark.read.parquet(f"{folder}/t/version=0").count() == 3


def test_few_and_many_pins_resolve_alike(spark, folder, monkeypatch):
    store = SnapshotStore(spark, folder)
    for i in range(3):
        for t in "ab":
            store.commit(t, spark.range(i), datetime(2024, 1, 1 + i))
    pins = {"a": datetime(2024, 1, 2, 5), "b": datetime(2025, 1, 1)}
    few = store.resolve(pins)
    monkeypatch.setattr(snapshots, "LITERAL_PINS", 1)
    assert store.resolve(pins) == few == {"a": 1, "b": 2}


def test_each_target_has_its_own_contract(spark):
    details = spark.createDataFrame(
        [("x", s, 1, 1, None) for s in ("baseline", "candidate")] + [("y", "baseline", 1, 1, None), ("y", "candidate", 2, 1, None)],
        "table_name string, side string, reader int, writer int, features array<string>")
    frames = {t: spark.range(4) for t in "xyz"}
    found = compare_flows(spark, frames, frames, details=details)
    assert found.failed_targets == ["y", "z"]
