"""Runtime, timings, statements, writes and their diagnosis."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabproof.operators import diagnosis, runtime, statements
from tabproof.operators.writes import write_signals
from tabproof.sources import telemetry as shapes

NOW = datetime(2024, 2, 1, 12)


def timeline(spark, rows):
    return spark.createDataFrame(rows, shapes.TIMELINE)


def test_runtime_counts_runs_and_skips_open_periods(spark):
    t = datetime(2024, 1, 20)
    rows = [("1", "a", "r1", t, datetime(2024, 1, 20, 0, 1)), ("1", "a", "r1", t, datetime(2024, 1, 20, 0, 0, 30)),
            ("1", "a", "r2", t, None), ("1", "b", "r3", datetime(2023, 1, 1), datetime(2023, 1, 2))]
    assert [tuple(r) for r in runtime.task_runtime(timeline(spark, rows), NOW).collect()] == [("1", "a", 1, 90)]


def test_hotspots(spark):
    t, e = datetime(2024, 1, 20), datetime(2024, 1, 20, 0, 1)
    rows = timeline(spark, [("1", "a", "r", t, e), ("1", "b", "r", t, e), ("1", "unlisted", "r", t, e), ("1", "unlisted", "s", t, e)])
    listed = spark.createDataFrame([("1", "b", "/b", 0), ("1", "a", "/a", 1), ("1", "idle", "/i", 2), ("2", "x", "/x", 0)],
                                   "job_id string, task_key string, notebook_path string, dag_order int")
    ranked = runtime.rank_hotspots(listed, rows, NOW).collect()
    assert [r.notebook_path for r in ranked] == ["/b", "/a", "/i", "/x"]
    assert [r.cost_share for r in ranked] == [0.25, 0.25, 0.0, 0.0]
    assert [r.recommended for r in ranked] == [True, False, False, False]
    assert [r.ranked for r in ranked] == [True, True, True, False]
    empty = runtime.rank_hotspots(listed, shapes.telemetry(None, shapes.TIMELINE), NOW).collect()
    assert len(empty) == 4 and not any(r.ranked or r.recommended for r in empty)


def test_hotspots_join_no_periods(spark):
    """Jobs are chosen from the sums of tasks: joined by job, all periods of one would meet in one task."""
    t, e = datetime(2024, 1, 20), datetime(2024, 1, 20, 0, 1)
    rows = timeline(spark, [("1", "a", "r", t, e), ("2", "a", "r", t, e)]).repartition(2)
    listed = spark.createDataFrame([("1", "a", "/a", 0)], "job_id string, task_key string, notebook_path string, dag_order int").hint("merge")
    ranked = runtime.rank_hotspots(listed, rows, NOW)
    assert [(r.notebook_path, r.total_runtime_s, r.cost_share) for r in ranked.collect()] == [("/a", 60, 1.0)]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("run_id")


def test_timings_and_gate(spark):
    rows = [("baseline", 0, 99.0), ("baseline", 1, 10.0), ("baseline", 2, 12.0), ("baseline", 3, 11.0), ("baseline", 4, 500.0),
            ("candidate", 0, 50.0), ("candidate", 1, 8.0), ("candidate", 2, 9.6)]
    timings = spark.createDataFrame(rows, "variant string, run_no int, seconds double")
    found = {r.variant: tuple(r)[1:] for r in runtime.timing_summary(timings, runs=3).collect()}
    assert found == {"baseline": (3, 11.0, 10.0, 12.0), "candidate": (2, 8.8, 8.0, 9.6)}
    gate = runtime.perf_gate(runtime.timing_summary(timings, runs=3)).first()
    assert gate.gain == pytest.approx(0.2) and gate.passed == (gate.gain >= 0.2)
    kept = {r.variant: r.runs for r in runtime.timing_summary(timings, warmup=False).collect()}
    assert kept == {"baseline": 5, "candidate": 3}


def test_gate_edges(spark):
    def gate(before, after, **options):
        rows = [("baseline", before), ("candidate", after)]
        return runtime.perf_gate(spark.createDataFrame(rows, "variant string, median_s double"), **options).first()

    assert gate(10.0, 8.0).passed and not gate(10.0, 8.1).passed
    assert gate(0.0, 5.0).gain == 0.0 and not gate(0.0, 5.0).passed and gate(0.0, 5.0, min_gain=0.0).passed
    assert gate(10.0, 12.0).gain == pytest.approx(-0.2)


def log(spark, rows):
    """Rows of (id, text, ms, spilled, read_bytes, read_rows, produced_rows)."""
    full = [(i, t, "u", datetime(2024, 1, 30), "FINISHED", ms, None, None, None, rr, pr, rb, sp) for i, t, ms, sp, rb, rr, pr in rows]
    return spark.createDataFrame(full, shapes.STATEMENTS)


STATEMENT_ROWS = [
    ("1", "INSERT INTO lake.gold.T_1 SELECT 1", 100, 0, 10, 10, 10),
    ("2", "merge into `lake`.`gold`.`t_10` x", 300, 1234567, 2000000, 100, 450),
    ("3", "select txy from lake.gold.tX1", 900, 0, 0, 0, 0),
    ("4", "insert into t_1 select * from t_10, t_1", 300, 5, 0, 0, 7),
]


def test_mentions_are_literal(spark):
    rows = log(spark, STATEMENT_ROWS)
    ids = lambda df: sorted(r.statement_id for r in df.collect())
    assert ids(statements.statements_touching(rows, ["lake.gold.`t_1`"])) == ["1", "2", "4"]
    assert ids(statements.statements_touching(rows, ["t_1"], whole_word=True)) == ["1", "4"]
    assert ids(statements.statements_touching(rows, [])) == []
    targets = spark.createDataFrame([("lake.gold.t_1",), ("lake.gold.T_10",), ("lake.gold.none",)], "table_name string")
    pairs = lambda **o: sorted((r.statement_id, r.table_name) for r in statements.statements_by_table(rows, targets, **o).collect())
    assert pairs() == [("1", "lake.gold.t_1"), ("2", "lake.gold.T_10"), ("2", "lake.gold.t_1"), ("4", "lake.gold.T_10"), ("4", "lake.gold.t_1")]
    assert pairs(whole_word=True) == [("1", "lake.gold.t_1"), ("2", "lake.gold.T_10"), ("4", "lake.gold.T_10"), ("4", "lake.gold.t_1")]
    odd = spark.createDataFrame([("1", "from A-B, x", 1), ("2", "from a-bc", 1), ("3", "in `Größe`", 1), ("4", "a -- b", 1), ("5", "GRÖSSE", 1)],
                                "statement_id string, statement_text string, total_duration_ms long")
    names = spark.createDataFrame([("lake.gold.`a-b`",), ("größe",), ("--",), ("größ",), (r"\\E",)], "table_name string")
    found = lambda **o: sorted((r.statement_id, r.table_name) for r in statements.statements_by_table(odd, names, **o).collect())
    assert found() == [("1", "lake.gold.`a-b`"), ("2", "lake.gold.`a-b`"), ("3", "größ"), ("3", "größe"), ("4", "--")]
    assert found(whole_word=True) == [("1", "lake.gold.`a-b`"), ("3", "größe"), ("4", "--")]
    assert ids(statements.statements_touching(odd, ["a-b", "größe"], whole_word=True)) == ["1", "3"]


def test_a_long_word_takes_linear_time(spark):
    """50,000 characters without a break, names at its ends and across the pieces that it is searched in."""
    word = "t_1" + "x" * 251 + "t_22" + "y" * 50_000 + "t_333"
    rows = spark.createDataFrame([("1", word, 5)], "statement_id string, statement_text string, total_duration_ms long")
    targets = spark.createDataFrame([("t_1",), ("t_22",), ("t_333",), ("t_4",)], "table_name string")
    find = lambda: {r.table_name for r in statements.statements_by_table(rows, targets).collect()}
    find()
    began = time.monotonic()
    assert find() == {"t_1", "t_22", "t_333"}
    assert time.monotonic() - began < 15


def test_worst_statements(spark):
    rows = log(spark, STATEMENT_ROWS).unionByName(log(spark, [("0", "t_1", 9999, 0, 1, 1, 1)]).withColumn("execution_status", F.lit("FAILED")))
    rows = rows.unionByName(log(spark, [("9", "t_1", 9999, 0, 1, 1, 1)]).withColumn("start_time", F.lit(datetime(2024, 1, 24, 23))))
    worst = statements.worst_statements(rows, ["c.s.t_1"], NOW).collect()
    assert [r.statement_id for r in worst] == ["2", "4", "1"]
    assert (worst[0].spill_pct, worst[0].row_amplification) == (61.7, 4.5)
    assert (worst[1].spill_pct, worst[1].row_amplification) == (0.0, None)
    assert [r.statement_id for r in statements.worst_statements(rows, ["t_1"], NOW, limit=1).collect()] == ["2"]
    assert [r.statement_id for r in statements.worst_statements(rows, ["t_1"], NOW, min_duration_ms=300).collect()] == ["2", "4"]
    assert statements.worst_statements(rows, ["t_1"], NOW, lookback_days=8).first().statement_id == "9"


def test_signals_in_one_row(spark):
    rows = log(spark, STATEMENT_ROWS)
    found = statements.statement_signals(rows, ["t_1"], NOW).first()
    assert (found.available, found.matched_statements, found.statement_id, found.spill_pct) == (True, 3, "2", 61.7)
    none = statements.statement_signals(rows, ["absent"], NOW).first()
    assert (none.available, none.matched_statements, none.statement_id) == (False, 0, None)


def test_stopwatch(spark):
    timings = runtime.time_variants(spark, lambda: spark.range(10), lambda: spark.range(20), runs=2)
    assert {r.variant: r.runs for r in runtime.timing_summary(timings).collect()} == {"baseline": 2, "candidate": 2}


def writes(spark, rows):
    full = [(t, v, datetime(2024, 1, 1), op, m) for t, v, op, m in rows]
    return spark.createDataFrame(full, shapes.WRITES)


WRITE_ROWS = [
    ("a", 0, "WRITE", {"numFiles": "3"}), ("a", 1, "merge", {"numTargetFilesAdded": "", "numFiles": "4", "numRemovedFiles": "4", "numOutputRows": "12"}),
    ("a", 2, "OPTIMIZE", {"numFiles": "9"}), ("a", 3, None, None),
    ("b", 0, "WRITE", {"numFiles": "3"}), *[("b", i, "OPTIMIZE", None) for i in range(1, 6)],
    ("c", 0, "DELETE", {"numRemovedFiles": "2"}),
]


def test_write_signals(spark):
    found = {r.table_name: r for r in write_signals(writes(spark, WRITE_ROWS)).collect()}
    a = found["a"]
    assert (a.available, a.operation, a.version, a.files_added, a.files_removed, a.output_rows, a.rewrite_ratio, a.scan_time_ms) == (
        True, "merge", 1, 4, 4, 12, 1.0, 0)
    assert not found["b"].available and found["b"].files_added is None
    assert found["c"].rewrite_ratio is None and found["c"].files_removed == 2
    assert {r.table_name: r.available for r in write_signals(writes(spark, WRITE_ROWS), depth=6).collect()}["b"]


def test_profiles(spark):
    notebooks = spark.createDataFrame([("j", "/n", ["lake.gold.t_10", "a", "c"]), ("j", "/quiet", ["b"]), ("j", "/none", [])],
                                      "job_name string, notebook_path string, target_tables array<string>")
    found = diagnosis.notebook_profiles(notebooks, log(spark, STATEMENT_ROWS), writes(spark, WRITE_ROWS), NOW, whole_word=True)
    rows = {r.notebook_path: r for r in found.withColumn("perf", diagnosis.profile_entry(found)).collect()}
    n = rows["/n"]
    assert n.statement_id == "2" and n.flags == [
        "SPILL: 1,234,567 bytes (61.7% of read)", "ROW AMPLIFICATION: produced/read = 4.5x (exploding join?)",
        diagnosis.SHUFFLE_FLAG, "FULL-REWRITE pattern on merge (removed 4 / added 4 files)"]
    assert n.suggested_techniques == [*diagnosis.SPILL_TECHNIQUES, diagnosis.AMPLIFICATION_TECHNIQUE, diagnosis.REWRITE_TECHNIQUE]
    assert n.insight == "; ".join(n.flags[:4]) and n.perf["flags"] == " | ".join(n.flags) and n.perf["spill_pct"] == "61.7"
    none = rows["/none"]
    assert not none.statement_available and none.flags == [diagnosis.NO_SIGNAL_FLAG] and none.suggested_techniques == []
    assert none.perf == {"shuffle": diagnosis.SHUFFLE_NOTE, "flags": diagnosis.NO_SIGNAL_FLAG}


def test_missing_telemetry_reads_as_empty(spark):
    assert shapes.telemetry("no_such_table", shapes.STATEMENTS).count() == 0
    part = spark.createDataFrame([("a", 1, "x")], "table_name string, version int, extra string")
    assert shapes.telemetry(part, shapes.WRITES).first().operation is None


def test_ranking_is_one_lazy_plan(views):
    """Nothing is checkpointed, and only the registry's jobs are added up."""
    plan = runtime.rank_hotspots(views.registry, views.run_timeline, NOW)._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert "LeftSemi" in plan
