"""Input relations of the registered queries, derived on Spark from the given tables.

Each relation has the shape an operator works on: an edited copy, a run
timeline, a statement log, a write history, an audit log, a registry. Their
twins in ANSI SQL are in ``duck.py``.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabproof.plans.promotion import REQUIRED_STEPS
from tabproof.sources.telemetry import STATEMENTS, telemetry

# Moments at which the telemetry windows end; literals, so that results repeat.
RUNS_AS_OF, RUNS_DAYS = datetime(2001, 1, 1), 1500
STATEMENTS_AS_OF, STATEMENT_DAYS = datetime(2024, 1, 31), 20

STEPS = (*REQUIRED_STEPS, "promote")
JOBS = (0, 1, 2)
REFERENCE, CLONE = "prod.gold.t1", "prod.sandbox.gold__t1"


class Views:
    """Tables of one folder and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    # Tables to compare -------------------------------------------------------------------------

    @cached_property
    def orders_cand(self) -> DataFrame:
        """Rows dropped, rows doubled, prices changed, prices drifted within tolerance."""
        edited = self.orders.where("o_orderkey % 97 <> 0").withColumn("o_totalprice", F.expr(
            "CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 0.5D "
            "WHEN o_orderkey % 2 = 1 THEN o_totalprice + 1e-9D ELSE o_totalprice END"))
        return edited.unionByName(self.orders.where("o_orderkey % 89 = 0"))

    @cached_property
    def orders_drift(self) -> DataFrame:
        """Every price off by less than the tolerance."""
        return self.orders.withColumn("o_totalprice", F.expr("o_totalprice + 1e-9D"))

    @cached_property
    def orders_moved(self) -> DataFrame:
        """As many rows, some with another price."""
        return self.orders.withColumn("o_totalprice", F.expr("if(o_orderkey % 83 = 0, o_totalprice + 0.5D, o_totalprice)"))

    @cached_property
    def orders_shape(self) -> DataFrame:
        """A renamed column, a changed type, and nulls where there were none."""
        return (
            self.orders.withColumnRenamed("o_orderpriority", "o_priority")
            .withColumn("o_custkey", F.expr("cast(o_custkey AS decimal(20,0))"))
            .withColumn("o_orderstatus", F.expr("if(o_orderkey % 83 = 0, NULL, o_orderstatus)")))

    @cached_property
    def orders_touched(self) -> DataFrame:
        """As many differences whatever the size: some rows dropped, some doubled, some prices changed, the rest drifted."""
        edited = self.orders.where("o_orderkey NOT BETWEEN 300 AND 320").withColumn("o_totalprice", F.expr(
            "if(o_orderkey <= 200, o_totalprice + 0.5D, o_totalprice + 1e-9D)"))
        return edited.unionByName(self.orders.where("o_orderkey BETWEEN 330 AND 335"))

    @cached_property
    def lineitem_now(self) -> DataFrame:
        """Lines after deletions (whole suppliers among them), updates and additions."""
        kept = self.lineitem.where("NOT (l_orderkey % 7 = 0 OR l_suppkey % 10 = 3)").withColumn(
            "l_extendedprice", F.expr("if(l_orderkey % 11 = 0, l_extendedprice * 2, l_extendedprice)"))
        return kept.unionByName(self.lineitem_added)

    @cached_property
    def lineitem_added(self) -> DataFrame:
        return self.lineitem.where("l_orderkey % 13 = 0 AND l_suppkey % 10 <> 3").withColumn(
            "l_extendedprice", F.expr("l_extendedprice + 100000"))

    @cached_property
    def lineitem_cand(self) -> DataFrame:
        return self.lineitem.where("l_orderkey % 97 <> 0").unionByName(
            self.lineitem.where("l_orderkey % 89 = 0"))

    @cached_property
    def table_detail(self) -> DataFrame:
        part = self.table("part")
        name = "concat('part_', p_partkey) AS table_name"
        # Some tables lack the row of a side, some have two rows with different features.
        before = part.where("p_partkey % 11 <> 0").selectExpr(
            name, "'baseline' AS side", "1 + p_size % 3 AS reader", "2 + p_size % 5 AS writer",
            "explode(if(p_partkey % 5 = 0, array(array(p_type), array('zz')), array(array(p_type)))) AS features")
        after = part.selectExpr(name, "'candidate' AS side", "1 + p_size % 2 AS reader", "2 + p_size % 4 AS writer",
                                "if(p_size % 3 = 0, array(p_type, p_brand), array(p_type)) AS features").where(
            "int(substring(table_name, 6)) % 13 <> 0")
        return before.unionByName(after)

    # Telemetry ---------------------------------------------------------------------------------

    @cached_property
    def run_timeline(self) -> DataFrame:
        return self.lineitem.selectExpr(
            "string(l_suppkey % 10) AS job_id", "concat('task_', l_partkey % 20) AS task_key",
            "string(l_orderkey) AS run_id", "l_shipdate AS period_start_time",
            "if(l_linenumber = 7, NULL, timestampadd(MINUTE, int(l_quantity), l_shipdate)) AS period_end_time")

    @cached_property
    def timings(self) -> DataFrame:
        return self.lineitem.groupBy(
            F.expr("concat('job_', l_suppkey % 10) AS job"),
            F.expr("if(l_linenumber % 2 = 0, 'candidate', 'baseline') AS variant"),
            F.expr("l_orderkey AS run_no"),
        ).agg(F.expr("sum(if(l_linenumber % 2 = 0, floor(l_quantity / 2), l_quantity)) AS seconds"))

    @cached_property
    def statement_log(self) -> DataFrame:
        rows = self.events.selectExpr(
            "string(event_id) AS statement_id",
            "concat('INSERT INTO lake.gold.T_', user_id % 30, ' SELECT * FROM src, lake.gold.`Größe-', user_id % 4, '`') AS statement_text",
            "ts AS start_time", "if(event_type = 'error', 'FAILED', 'FINISHED') AS execution_status",
            "bigint(floor(value * 1000)) AS total_duration_ms", "bigint(floor(value * 800)) AS execution_duration_ms",
            "event_id % 100 AS compilation_duration_ms", "1 + event_id % 1000 AS read_rows",
            "(1 + event_id % 1000) * if(event_id % 7 = 0, 15000000, user_id % 5) AS produced_rows", "(1 + event_id % 1000) * 100 AS read_bytes",
            "if(event_type = 'purchase', user_id * 1000, 0L) AS spilled_local_bytes")
        return telemetry(rows, STATEMENTS)

    @cached_property
    def write_history(self) -> DataFrame:
        return self.orders.selectExpr(
            "concat('lake.gold.t_', o_custkey % 50) AS table_name",
            "datediff(o_orderdate, date'1992-01-01') * 1099511627776 + o_orderkey AS version",
            "o_orderdate AS ts",
            "CASE o_orderstatus WHEN 'F' THEN 'MERGE' WHEN 'O' THEN 'write' ELSE 'OPTIMIZE' END AS operation",
            "map('numTargetFilesAdded', string(o_orderkey % 7), 'numTargetFilesRemoved', "
            "if(o_orderkey % 11 = 0, '', string(o_orderkey % 5)), 'numRemovedFiles', string(o_orderkey % 3), "
            "'numOutputRows', if(o_orderkey % 13 = 0, '3.5', string(o_orderkey)), "
            "'numTargetRowsInserted', '9', 'scanTimeMs', string(o_orderkey % 900), 'rewriteTimeMs', "
            "if(o_orderkey % 4 = 0, 'n/a', string(o_orderkey % 500)), 'executionTimeMs', string(o_orderkey % 2000)) AS operationMetrics")

    @cached_property
    def pins(self) -> DataFrame:
        return self.table("part").selectExpr(
            "concat('lake.gold.t_', p_partkey % 60) AS table_name",
            "timestampadd(DAY, int(p_partkey % 400) * 7, timestamp_ntz'1994-12-01') AS pin_ts",
            "if(p_partkey % 10 = 0, bigint(p_size), NULL) AS pin_version").distinct()

    # Audit log and registry ----------------------------------------------------------------------

    @cached_property
    def audit(self) -> DataFrame:
        steps = ", ".join(f"'{s}'" for s in STEPS)
        return self.events.selectExpr("*", f"element_at(array({steps}), int(event_id % 8) + 1) AS step").selectExpr(
            "concat('a', event_id) AS audit_id", "ts AS event_ts", "concat('u', user_id % 7) AS user",
            "concat('job_', user_id % 10) AS job", "concat('nb_', user_id) AS notebook", "step",
            "CASE WHEN event_id % 10 = 0 THEN 'started' WHEN event_id % 10 IN (1, 2) "
            "OR (user_id % 3 = 0 AND step = 'security_review') THEN 'failed' ELSE 'succeeded' END AS status",
            "concat('\\tbroadcast\\n, ', event_type, '\\r\\n,, \\t') AS raw_change_type",
            "CASE WHEN step = 'equivalence' THEN map(if(event_id % 3 = 0, 'passed', 'result'), "
            "if(event_id % 10 IN (1, 2), 'failed', 'passed')) END AS equivalence",
            "CASE WHEN step = 'perf_benchmark' THEN map(if(event_id % 2 = 0, 'gain', 'gain_pct'), "
            "string(user_id % 100), 'result', if(event_id % 10 IN (1, 2), 'failed', 'Passed')) END AS perf",
            "concat('/jobs/nb_', user_id) AS notebook_path", "concat('note ', event_id) AS insight")

    @cached_property
    def audit_events(self) -> DataFrame:
        """The audit log under its own schema."""
        return self.audit.withColumn("change_type", F.expr(
            "filter(transform(split(raw_change_type, ','), p -> regexp_replace(p, '^\\\\s+|\\\\s+$', '')), p -> p <> '')")).drop("raw_change_type")

    @cached_property
    def registry(self) -> DataFrame:
        return self.events.select("user_id").distinct().selectExpr(
            "concat('job_', user_id % 10) AS job_name", "string(user_id % 10) AS job_id",
            "concat('nb_', user_id) AS notebook_path", "concat('task_', user_id % 20) AS task_key",
            "int(floor(user_id / 10)) AS dag_order", "string(NULL) AS operation",
            "array(concat('lake.silver.s_', user_id % 30)) AS source_tables",
            "array(concat('lake.gold.t_', user_id % 30), concat('lake.gold.t_', user_id % 7)) AS target_tables",
            "array('id') AS equivalence_keys", "'sandbox' AS sandbox_schema",
            "concat('optimized/job_', user_id % 10) AS optimized_folder",
            "1e-6D AS epsilon", "0.2D AS min_gain", "3 AS benchmark_runs",
            "string(NULL) AS compute_cluster_id", "user_id % 5 = 0 AS nondeterministic",
            "element_at(array('pending', 'promoted', 'skipped', 'blocked'), int(user_id % 4) + 1) AS status")

    # Jobs and their tasks ------------------------------------------------------------------------

    @cached_property
    def tasks(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey", f"explode(array({', '.join(str(j) for j in JOBS)})) AS j").selectExpr(
            "concat('job_', j) AS job_name", "string(j) AS job_id", "concat('t', lpad(p_partkey, 12, '0')) AS task_key",
            "if(p_partkey % 4 = 0, NULL, concat('/jobs/nb_', p_partkey)) AS notebook_path", "p_partkey")

    @cached_property
    def task_edges(self) -> DataFrame:
        """A task depends on two smaller ones, in a way that differs from job to job."""
        return self.tasks.where("p_partkey >= 1").selectExpr(
            "job_id", "task_key",
            "explode(array(p_partkey div (2 + int(job_id)), p_partkey div 3)) AS d").selectExpr(
            "job_id", "task_key", "concat('t', lpad(d, 12, '0')) AS depends_on").distinct()

    @cached_property
    def task_edges_cyclic(self) -> DataFrame:
        """The same with one more dependency per job that closes a cycle."""
        back = self.tasks.where("p_partkey = 1").selectExpr(
            "job_id", "task_key", "concat('t', lpad(if(job_id = '0', 2, 3), 12, '0')) AS depends_on")
        return self.task_edges.unionByName(back)

    # Scripts -------------------------------------------------------------------------------------

    @cached_property
    def scripts(self) -> DataFrame:
        calls = "element_at(array(' SELECT rand(), 1', ' SELECT current_timestamp', ' collect_list(x)', ' first (y)', ''), int(doc_id % 5) + 1)"
        return self.table("documents").selectExpr(
            "doc_id AS script_id",
            f"concat(text, {calls}, ' {REFERENCE} x.{REFERENCE} {REFERENCE}0') AS source")

    @cached_property
    def notebooks(self) -> DataFrame:
        """Scripts with calls and references in comments, in strings and in code."""
        calls = "element_at(array(' rand()', ' current_timestamp', ' collect_list(x)', ' first (y)', ''), int(doc_id % 5) + 1)"
        inside = "element_at(array(' now() ', ' uuid() ', ' last(x) '), int(doc_id % 3) + 1)"
        return self.table("documents").selectExpr(
            "doc_id AS script_id",
            f"concat('/* ', replace(text, '*/', '* /'), {inside}, ' {REFERENCE} */ SELECT \"{REFERENCE} ', {inside}, '\"', {calls}, "
            f"' -- {REFERENCE}', {inside}, '\\n FROM {REFERENCE} AS `a -- b`') AS source")
