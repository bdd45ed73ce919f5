"""Audit log, its readers, and the promotion gate."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabproof import AuditLog, PromotionBlocked, missing_steps, promotion_gate, promotion_outcome, require_promotable, scorecard
from tabproof.functions import maps
from tabproof.plans.promotion import REQUIRED_STEPS
from tabproof.sources.audit import AUDIT_SCHEMA, audit_trail, guard_events, latest_events, open_steps, run_activity

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    """Rows of (minute, notebook, step, status[, equivalence[, perf]])."""
    full = [(f"a{i}", T0 + timedelta(minutes=r[0]), "u", "job", r[1], r[2], r[3], None,
             r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else None, None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, AUDIT_SCHEMA)


def registry(spark, rows):
    return spark.createDataFrame([("job", n, s) for n, s in rows], "job_name string, notebook_path string, status string")


def test_empty_log_reads_as_empty(spark, folder):
    assert AuditLog(spark, folder).read().count() == 0


def test_events_are_conformed(spark, folder):
    log = AuditLog(spark, folder)
    log.record(job="1", notebook="n", step="s", status="succeeded", change_type=" broadcast, ,salting,",
               equivalence={"passed": True, "rows": 3}, perf={"gain_pct": 0.4, "result": "Pass"})
    log.record(job="2", notebook="n", step="s", status="started", change_type=["a ", " "], equivalence={})
    rows = {r.job: r for r in log.read().collect()}
    assert rows["1"].change_type == ["broadcast", "salting"]
    assert rows["1"].equivalence == {"passed": "True", "rows": "3", "result": "passed"}
    assert rows["1"].perf == {"gain_pct": "0.4", "result": "Pass", "gain": "0.4", "passed": "True"}
    assert rows["2"].change_type == ["a"] and rows["2"].equivalence is None and rows["2"].perf is None
    assert all(r.audit_id and r.event_ts and r.user for r in rows.values())
    assert rows["1"].audit_id != rows["2"].audit_id
    assert log.read().schema == AUDIT_SCHEMA


def test_unknown_status_and_columns_are_refused(spark, folder):
    log = AuditLog(spark, folder)
    with pytest.raises(Exception, match="unknown status"):
        log.record(job="1", notebook="n", step="s", status="done")
    with pytest.raises(ValueError, match="columns not in the schema"):
        log.append(spark.createDataFrame([("1", 2)], "job string, mood int"))


def test_batch_is_written_as_few_files(spark, folder):
    log = AuditLog(spark, folder)
    log.append(spark.range(500).repartition(8).selectExpr("string(id % 2) AS job", "'n' AS notebook", "'s' AS step",
                                                          "'started' AS status"))
    assert log.read().count() == 500 and len(log.read().inputFiles()) <= 4


def test_step_records_both_ends(spark, folder):
    log = AuditLog(spark, folder)
    with log.step("j", "n", "sandbox_setup", insight="done"):
        pass
    with pytest.raises(KeyError):
        with log.step("j", "n", "equivalence"):
            raise KeyError("x" * 900)
    trail = [(r.step, r.status) for r in audit_trail(log.read(), "j", "n").collect()]
    assert trail == [("sandbox_setup", "started"), ("sandbox_setup", "succeeded"), ("equivalence", "started"),
                     ("equivalence", "failed")]
    failed = guard_events(log.read()).first()
    assert failed.step == "equivalence" and len(failed.insight) == 500
    assert open_steps(log.read()).count() == 0


def test_readers_order_and_filter(spark):
    log = events(spark, [(2, "n", "b", "failed"), (1, "n", "a", "started"), (3, "m", "a", "succeeded")])
    assert [r.audit_id for r in audit_trail(log).collect()] == ["a1", "a0", "a2"]
    assert [r.audit_id for r in audit_trail(log, "job", "n").collect()] == ["a1", "a0"]
    assert [r.audit_id for r in run_activity(log).collect()] == ["a2", "a0", "a1"]
    assert [r.audit_id for r in guard_events(log).collect()] == ["a0"]


def test_open_steps(spark):
    log = events(spark, [(1, "n", "a", "started"), (2, "n", "a", "failed"), (3, "n", "a", "started"),
                         (1, "n", "b", "started"), (2, "n", "b", "succeeded"), (1, "n", "c", "succeeded")])
    assert [r.step for r in open_steps(log).collect()] == ["a"]


def test_latest_events_break_ties_by_id(spark):
    log = events(spark, [(1, "n", "a", "failed"), (1, "n", "a", "succeeded"), (0, "n", "a", "started")])
    assert latest_events(log).first().status == "succeeded"
    again = log.unionAll(events(spark, [(5, "n", "a", "started")]).withColumn("audit_id", F.lit("z")))
    assert latest_events(again).first().status == "started"
    assert latest_events(again, terminal_only=True).first().status == "succeeded"


def test_scorecard(spark):
    log = events(spark, [
        (1, "n", "equivalence", "succeeded", {"result": "passed"}), (2, "n", "perf_benchmark", "succeeded", None, {"gain_pct": "0.3", "result": "ok"}),
        (3, "m", "equivalence", "succeeded", {"passed": "True"}), (4, "m", "equivalence", "started")])
    rows = registry(spark, [("n", "pending"), ("m", "blocked"), ("none", "skipped")])
    card = {r.notebook: r for r in scorecard(rows, log).collect()}
    assert (card["n"].equivalence_result, card["n"].perf_gain, card["n"].perf_passed) == ("passed", "0.3", "ok")
    assert card["n"].last_event_ts == T0 + timedelta(minutes=2)
    assert card["m"].equivalence_result is None
    assert card["none"].last_event_ts == datetime(1970, 1, 1) and card["none"].config_status == "skipped"
    assert {r.notebook: r.equivalence_result for r in scorecard(rows, log, terminal_only=True).collect()}["m"] == "True"


def full_trail(notebook, last="succeeded"):
    return [(i, notebook, s, "succeeded") for i, s in enumerate(REQUIRED_STEPS)] + [(99, notebook, REQUIRED_STEPS[-1], last)]


def test_promotion_gate(spark):
    log = events(spark, full_trail("ok") + full_trail("skip") + full_trail("later", "failed") + full_trail("lost")
                 + [(1, "part", "equivalence", "succeeded"), (2, "part", "perf_profile", "failed")])
    rows = registry(spark, [("ok", "pending"), ("skip", "skipped"), ("later", "pending"), ("part", "pending"), ("idle", "pending")])
    targets = log.select("job", "notebook").union(rows.select("job_name", "notebook_path"))
    gate = {r.notebook: r for r in promotion_gate(targets, rows, log).collect()}
    assert gate["ok"].passed and gate["ok"].events == 8 and gate["ok"].steps_recorded == sorted(REQUIRED_STEPS)
    assert gate["later"].passed
    assert gate["lost"].block_reason == "no registry row"
    assert gate["skip"].block_reason.startswith("skipped")
    assert "detect_tables, perf_profile" in gate["part"].block_reason and "equivalence" not in gate["part"].block_reason
    assert gate["idle"].events == 0 and not gate["idle"].passed
    strict = {r.notebook: r.passed for r in promotion_gate(targets, rows, log, latest=True).collect()}
    assert strict["ok"] and not strict["later"]

    assert {r.step for r in missing_steps(targets.where("notebook = 'part'"), log).collect()} == set(REQUIRED_STEPS) - {"equivalence"}
    assert require_promotable(spark, "job", "ok", rows, log)["events"] == 8
    with pytest.raises(PromotionBlocked, match="skipped"):
        require_promotable(spark, "job", "skip", rows, log)

    flows = spark.createDataFrame([("job", True)], "flow string, passed boolean")
    outcome = {r.notebook_path: r.status for r in promotion_outcome(promotion_gate(targets, rows, log), flows).collect()}
    assert outcome == {"ok": "promoted", "later": "promoted", "skip": "blocked", "part": "blocked", "idle": "blocked"}
    none = promotion_outcome(promotion_gate(targets, rows, log), flows.where("passed = false"))
    assert {r.status for r in none.collect()} == {"blocked"}


def test_maps_and_texts(spark):
    df = spark.createDataFrame([({"passed": "yes", "result": "failed"},), ({"passed": "no"},), ({"x": "1"},), ({},), (None,)],
                               "m map<string,string>")
    out = [r[0] for r in df.select(maps.canonical_equivalence(F.col("m"))).collect()]
    assert out == [{"passed": "yes", "result": "failed"}, {"passed": "no", "result": "failed"}, {"x": "1"}, {}, None]
    assert [r[0] for r in df.select(maps.stringify(F.col("m"))).collect()][3:] == [None, None]
    words = spark.createDataFrame([(" TRUE ",), ("Pass",), ("0",), (None,)], "w string")
    assert [r[0] for r in words.select(maps.truthy(F.col("w"))).collect()] == [True, True, False, False]
    assert [r[0] for r in words.select(maps.truthy(F.col("w") == " TRUE ")).collect()] == [True, False, False, False]
    counts = spark.createDataFrame([({"a": "", "b": "3.5", "c": "7"},), ({"b": None},), (None,)], "m map<string,string>")
    assert [r[0] for r in counts.select(maps.first_int(F.col("m"), "a", "b", "c")).collect()] == [7, 0, 0]
    lists = spark.createDataFrame([(["a ", " ", "b"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in lists.select(maps.change_types(F.col("l"), is_list=True)).collect()] == [["a", "b"], None, None]
    entry = spark.range(1).select(
        maps.equivalence_entry(F.lit(True), F.lit("zero_risk"), rows=F.lit(3)).alias("e"),
        maps.perf_entry(F.lit(0.25), F.lit("no"), after_s=F.lit(3.0)).alias("p")).first()
    assert entry.e == {"result": "passed", "risk_tier": "zero_risk", "rows": "3"}
    assert entry.p == {"gain": "0.25", "passed": "False", "after_s": "3.0"}
