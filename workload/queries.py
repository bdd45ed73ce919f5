"""The registered queries and, where SQL can say the same, their twins.

Maps, lists and moments leave as text, so that both engines' results compare
value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabproof import (AuditLog, Registry, SnapshotStore, changes_by_column, compare, compare_fingerprints, contract_diff, flow_rollup,
                      key_diff, key_diff_summary, missing_steps, multiset_diff, multiset_diff_rows,
                      partition_count_diff, promotion_gate, promotion_outcome, row_counts, sample_by_key,
                      schema_diff, scorecard, select_notebooks, validate_flow, validate_replay)
from tabproof.functions import maps, names
from tabproof.functions.floats import normalise_floats
from tabproof.functions.scripts import nondeterminism_flags, remap_references
from tabproof.operators import asof, dag, diagnosis, runtime, statements, writes
from tabproof.plans import flow, recipes, registered
from tabproof.session import new_folder, stored
from tabproof.sources import audit as log, registry as reg, snapshots, storage

from . import duck
from .views import CLONE, REFERENCE, RUNS_AS_OF, RUNS_DAYS, STATEMENT_DAYS, STATEMENTS_AS_OF, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, **extra: str):
    """Registers a function of :class:`Views` under its name, with its SQL twin if there is one."""
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[fn.__name__] = duck.query(sql, **extra)
        return fn
    return register


def moment(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name.split(".")[-1])


def _moment(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S.%f') AS {name.split('.')[-1]}"


def joined(name: str) -> Column:
    return F.array_join(name, "|").alias(name)


# Table comparison ----------------------------------------------------------------------------------

@query("""
    SELECT (SELECT count(*) FROM orders) AS baseline_rows, (SELECT count(*) FROM orders_cand) AS candidate_rows,
           (SELECT count(*) FROM orders) = (SELECT count(*) FROM orders_cand) AS passed""")
def row_count_check(v: Views) -> DataFrame:
    return row_counts(v.orders, v.orders_cand)


@query("""
    SELECT coalesce(a.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
           coalesce(a.n, 0) AS baseline_rows, coalesce(b.n, 0) AS candidate_rows
    FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT o_orderstatus, count(*) AS n FROM orders_cand GROUP BY 1) b
      ON a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus
    WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def partition_count_diff_(v: Views) -> DataFrame:
    return partition_count_diff(v.orders, v.orders_cand, ["o_orderstatus"])


ORDER_COLUMNS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
                 "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_normal = "SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM "


def _metric_rows() -> str:
    """One SELECT per column and metric over the normalised sides ``a`` and ``b``."""
    out = ["SELECT '*' AS col, 'rows' AS metric, (SELECT count(*) FROM a)::DOUBLE AS x, (SELECT count(*) FROM b)::DOUBLE AS y"]
    for name, dtype in ORDER_COLUMNS.items():
        wanted = {"nulls": f"count(*) - count({name})", "distinct": f"count(DISTINCT {name})"}
        if dtype in ("bigint", "double"):
            wanted |= {m: f"{m}({name})" for m in ("sum", "min", "max")}
        out += [f"SELECT '{name}', '{m}', (SELECT {e} FROM a)::DOUBLE, (SELECT {e} FROM b)::DOUBLE"
                for m, e in wanted.items()]
    return " UNION ALL ".join(out)


SIDES = {"a": _normal + "orders", "b": _normal + "orders_cand"}
_same = "abs(x - y) <= greatest(1e-9 * greatest(abs(x), abs(y)), 1e-6)"


@query('SELECT col AS "column", metric, round(x, 2) AS baseline, round(y, 2) AS candidate FROM m',
       **SIDES, m=_metric_rows())
def fingerprint(v: Views) -> DataFrame:
    return (
        compare_fingerprints(v.orders, v.orders_cand, distinct="exact").where("metric <> 'content'")
        .selectExpr("`column`", "metric", "round(baseline, 2) AS baseline", "round(candidate, 2) AS candidate"))


_off = "EXISTS (SELECT {n} FROM a EXCEPT ALL SELECT {n} FROM b) OR EXISTS (SELECT {n} FROM b EXCEPT ALL SELECT {n} FROM a)"
_content = " UNION ALL ".join(f"SELECT '{n}' AS col, 'content' AS metric, {_off.format(n=n)} AS off" for n in ("*", *ORDER_COLUMNS))


@query(f"""SELECT col AS "column", metric FROM m WHERE NOT ({_same}) UNION ALL SELECT col, metric FROM ({_content}) WHERE off""",
       **SIDES, m=_metric_rows())
def fingerprint_diff(v: Views) -> DataFrame:
    return (
        compare_fingerprints(v.orders, v.orders_cand, distinct="exact").where("NOT same").select("column", "metric"))


LINE_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
                "l_linestatus l_shipdate").split()


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", 'distinct' AS metric, (SELECT count(DISTINCT {n}) FROM lineitem)::DOUBLE AS baseline, "
    f"(SELECT count(DISTINCT {n}) FROM lineitem_cand)::DOUBLE AS candidate, true AS within" for n in LINE_COLUMNS))
def fingerprint_approx(v: Views) -> DataFrame:
    """Exact numbers of distinct values; the estimates lie within three of their standard deviations, which are 5 %."""
    exact, guess = ({how: compare_fingerprints(v.lineitem, v.lineitem_cand, distinct=how).where("metric = 'distinct'")
                     for how in ("exact", "approx")}[how].alias(how) for how in ("exact", "approx"))
    return exact.join(guess, "column").selectExpr("`column`", "'distinct' AS metric", "exact.baseline", "exact.candidate", " AND ".join(
        f"abs(approx.{s} - exact.{s}) <= 0.15D * exact.{s} + 1" for s in ("baseline", "candidate")) + " AS within")


MULTISET = {
    "base_only": f"SELECT * FROM ({_normal} orders) EXCEPT ALL SELECT * FROM ({_normal} orders_cand)",
    "cand_only": f"SELECT * FROM ({_normal} orders_cand) EXCEPT ALL SELECT * FROM ({_normal} orders)",
}


@query("""
    SELECT (SELECT count(*) FROM base_only) AS baseline_only, (SELECT count(*) FROM cand_only) AS candidate_only,
           (SELECT count(*) FROM base_only) + (SELECT count(*) FROM cand_only) = 0 AS passed""", **MULTISET)
def multiset_diff_(v: Views) -> DataFrame:
    return multiset_diff(v.orders, v.orders_cand)


@query("""
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority,
           'baseline' AS surplus_side, count(*) AS surplus_rows
    FROM base_only GROUP BY ALL
    UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2), o_orderpriority, 'candidate', count(*)
    FROM cand_only GROUP BY ALL""", **MULTISET)
def multiset_diff_rows_(v: Views) -> DataFrame:
    return multiset_diff_rows(v.orders, v.orders_cand).selectExpr(
        "o_orderkey", "o_custkey", "o_orderstatus", "round(o_totalprice, 2) AS o_totalprice", "o_orderpriority",
        "surplus_side", "surplus_rows")


@query("""
    SELECT 'o_custkey' AS "column", 'bigint' AS baseline_type, 'decimal(20,0)' AS candidate_type,
           (SELECT count(*) - count(o_custkey) FROM orders) AS baseline_nulls,
           (SELECT count(*) - count(o_custkey) FROM orders) AS candidate_nulls, 'type_changed' AS status
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz',
           (SELECT count(*) - count(o_orderdate) FROM orders), (SELECT count(*) - count(o_orderdate) FROM orders), 'same'
    UNION ALL SELECT 'o_orderkey', 'bigint', 'bigint',
           (SELECT count(*) - count(o_orderkey) FROM orders), (SELECT count(*) - count(o_orderkey) FROM orders), 'same'
    UNION ALL SELECT 'o_orderpriority', 'string', NULL,
           (SELECT count(*) - count(o_orderpriority) FROM orders), NULL, 'only_baseline'
    UNION ALL SELECT 'o_orderstatus', 'string', 'string',
           (SELECT count(*) - count(o_orderstatus) FROM orders),
           (SELECT count(*) FROM orders WHERE o_orderkey % 83 = 0 OR o_orderstatus IS NULL), 'nulls_appeared'
    UNION ALL SELECT 'o_priority', NULL, 'string', NULL,
           (SELECT count(*) - count(o_orderpriority) FROM orders), 'only_candidate'
    UNION ALL SELECT 'o_totalprice', 'double', 'double',
           (SELECT count(*) - count(o_totalprice) FROM orders), (SELECT count(*) - count(o_totalprice) FROM orders), 'same'""")
def schema_diff_(v: Views) -> DataFrame:
    return schema_diff(v.orders, v.orders_shape)


@query("""
    SELECT 'part_' || p_partkey AS table_name, CASE WHEN b THEN 1 + p_size % 3 ELSE 1 END AS baseline_reader,
           CASE WHEN k THEN 1 + p_size % 2 ELSE 1 END AS candidate_reader, CASE WHEN b THEN 2 + p_size % 5 ELSE 1 END AS baseline_writer,
           CASE WHEN k THEN 2 + p_size % 4 ELSE 1 END AS candidate_writer,
           CASE WHEN NOT k THEN '' WHEN b AND p_size % 3 = 0 AND p_brand <> p_type THEN p_brand
                WHEN b THEN '' WHEN p_size % 3 = 0 AND p_brand < p_type THEN p_brand || '|' || p_type
                WHEN p_size % 3 = 0 AND p_brand > p_type THEN p_type || '|' || p_brand ELSE p_type END AS added_features,
           CASE WHEN NOT k THEN 'no candidate row' WHEN NOT b THEN 'no baseline row'
                WHEN p_size % 2 > p_size % 3 OR p_size % 4 > p_size % 5 OR (p_size % 3 = 0 AND p_brand <> p_type)
                THEN 'needs a newer reader, writer or feature' END AS reason, reason IS NULL AS passed
    FROM (SELECT *, p_partkey % 11 <> 0 AS b, p_partkey % 13 <> 0 AS k FROM part) WHERE b OR k""")
def contract_diff_(v: Views) -> DataFrame:
    return contract_diff(v.table_detail).withColumn("added_features", joined("added_features"))


@query("""
    SELECT l_orderkey, l_linenumber, round(l_extendedprice + 1e-9, 6) AS l_extendedprice,
           round(l_discount + 1e-9, 6) AS l_discount, round(l_tax + 1e-9, 6) AS l_tax FROM lineitem""")
def normalize_floats(v: Views) -> DataFrame:
    drifted = v.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", *[f"{n} + 1e-9D AS {n}" for n in ("l_extendedprice", "l_discount", "l_tax")])
    return normalise_floats(drifted, 1e-6)


KEYS = {"k": """
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.n, 0) AS baseline_rows, coalesce(b.n, 0) AS candidate_rows,
           CASE WHEN coalesce(a.n, 0) > 1 OR coalesce(b.n, 0) > 1 THEN 'duplicated'
                WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed'
                WHEN abs(a.price - b.price) > 1e-6 THEN 'changed' ELSE 'same' END AS change
    FROM (SELECT o_orderkey, count(*) AS n, max(o_totalprice) AS price FROM orders GROUP BY 1) a
    FULL JOIN (SELECT o_orderkey, count(*) AS n, max(o_totalprice) AS price FROM orders_cand GROUP BY 1) b
      ON a.o_orderkey = b.o_orderkey"""}


@query("""
    SELECT o_orderkey, change, CASE change WHEN 'changed' THEN 'o_totalprice' ELSE '' END AS changed_columns,
           baseline_rows, candidate_rows
    FROM k WHERE change <> 'same'""", **KEYS)
def key_diff_(v: Views) -> DataFrame:
    return key_diff(v.orders, v.orders_cand, ["o_orderkey"]).withColumn("changed_columns", joined("changed_columns"))


@query("""SELECT 'o_totalprice' AS "column", count(*) AS changed_keys FROM k WHERE change = 'changed'""", **KEYS)
def changes_by_column_(v: Views) -> DataFrame:
    return changes_by_column(v.orders, v.orders_cand, ["o_orderkey"])


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE change = '{n}') AS {n}" for n in (
    "added", "removed", "changed", "same", "duplicated")) + " FROM k", **KEYS)
def key_diff_summary_(v: Views) -> DataFrame:
    return key_diff_summary(v.orders, v.orders_cand, ["o_orderkey"])


LADDER_COLUMNS = ["target", "check", "passed", "baseline", "candidate", "reason"]


@query("""
    SELECT 'orders' AS target, 'schema' AS "check", true AS passed, 6::BIGINT AS baseline, 6::BIGINT AS candidate,
           NULL::VARCHAR AS reason
    UNION ALL
    SELECT 'orders', 'row_count', a.n = b.n, a.n, b.n, CASE WHEN a.n <> b.n THEN a.n || ' rows became ' || b.n END
    FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM orders_cand) b""")
def equivalence_ladder(v: Views) -> DataFrame:
    return compare(v.spark, v.orders, v.orders_cand, target="orders").to_frame(v.spark)


@query("""
    SELECT 'orders' AS target, c AS "check", true AS passed, n AS baseline, n AS candidate, NULL::VARCHAR AS reason
    FROM (SELECT 'schema' AS c, 6::BIGINT AS n
          UNION ALL SELECT 'partition_count', (
              SELECT count(*) FROM (SELECT o_orderstatus, count(*) FROM orders GROUP BY 1
                                    EXCEPT SELECT o_orderstatus, count(*) FROM orders_drift GROUP BY 1))
          UNION ALL SELECT 'row_count', (SELECT count(*) FROM orders_drift)
          UNION ALL SELECT 'fingerprint', 0
          UNION ALL SELECT 'multiset', (
              SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)))""",
       a=_normal + "orders", b=_normal + "orders_drift")
def equivalence_ladder_tolerant(v: Views) -> DataFrame:
    return compare(v.spark, v.orders, v.orders_drift, target="orders", partition_cols=["o_orderstatus"]).to_frame(v.spark)


_same_rows = "NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM b)"


@query(f"""
    SELECT 'schema' AS "check", true AS passed UNION ALL SELECT 'row_count', count(*) = count(*) FROM orders
    UNION ALL SELECT 'fingerprint', {_same_rows}""",
       a=_normal + "orders", b=_normal + "orders_moved")
def equivalence_ladder_fingerprint(v: Views) -> DataFrame:
    """As many rows, other values: the checksums stop the ladder."""
    return compare(v.spark, v.orders, v.orders_moved, target="orders").to_frame(v.spark).select("check", "passed")


@query(f"""
    SELECT 'schema' AS "check", true AS passed, 6::BIGINT AS baseline, 6::BIGINT AS candidate
    UNION ALL SELECT 'row_count', true, count(*), count(*) FROM orders
    UNION ALL SELECT 'multiset', {_same_rows}, (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)),
                     (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""",
       a=_normal + "orders", b=_normal + "orders_moved")
def equivalence_ladder_multiset(v: Views) -> DataFrame:
    """The same without the checksums: the exact difference stops it."""
    return compare(v.spark, v.orders, v.orders_moved, target="orders", prefilter=False).to_frame(v.spark).select(
        "check", "passed", "baseline", "candidate")


# Names, maps and texts -----------------------------------------------------------------------------

@query("""
    SELECT DISTINCT table_name, 'lake.sandbox.gold__' || split_part(table_name, '.', 3) || '_v1' AS sandbox
    FROM write_history""")
def sandbox_names(v: Views) -> DataFrame:
    ticked = v.write_history.select("table_name").distinct().withColumn(
        "ticked", F.expr("concat('`', replace(table_name, '.', '`.`'), '`')"))
    return ticked.select("table_name", names.sandbox_name(F.col("ticked"), suffix="_v1").alias("sandbox"))


@query("SELECT DISTINCT table_name, split_part(table_name, '.', 3) AS short FROM write_history")
def short_names(v: Views) -> DataFrame:
    return v.write_history.select("table_name").distinct().select(
        "table_name", names.short_name(F.concat(F.lit("`"), "table_name", F.lit("`"))).alias("short"))


@query("SELECT audit_id, 'broadcast|' || event_type AS change_type FROM audit")
def norm_change_type(v: Views) -> DataFrame:
    return v.audit.select("audit_id", maps.change_types(F.col("raw_change_type")).alias("change_type")).withColumn(
        "change_type", joined("change_type"))


@query("""
    SELECT event_id, 'event=' || event_id || ', user=' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END AS texts
    FROM events""")
def stringify_map(v: Views) -> DataFrame:
    values = F.create_map(F.lit("user"), F.expr("if(event_id % 5 = 0, NULL, user_id)"), F.lit("event"), F.col("event_id"))
    return v.events.select("event_id", maps.readable(maps.stringify(values)).alias("texts"))


_words = ("'\\n True'", "'passed\\n'", "'PASS'", "'1\\r\\n'", "'\\tyes'", "'no'", "'failed'", "''", "NULL")


@query(f"""
    SELECT event_id, event_id % 9 <= 4 AS yes FROM events""")
def truthy(v: Views) -> DataFrame:
    word = F.expr(f"element_at(array({', '.join(_words)}), int(event_id % 9) + 1)")
    return v.events.select("event_id", maps.truthy(word).alias("yes"))


@query("""
    SELECT audit_id, CASE WHEN eq_key = 'passed' THEN 'passed=' || eq_value || ', result=' || eq_value
                          ELSE 'result=' || eq_value END AS equivalence
    FROM audit WHERE step = 'equivalence'""")
def canonical_equivalence(v: Views) -> DataFrame:
    return v.audit.where("equivalence IS NOT NULL").select(
        "audit_id", maps.readable(maps.canonical_equivalence(F.col("equivalence"))).alias("equivalence"))


@query("""
    SELECT audit_id, 'gain=' || pf_value || CASE WHEN pf_key = 'gain_pct' THEN ', gain_pct=' || pf_value ELSE '' END
           || ', passed=' || CASE WHEN pf_result = 'Passed' THEN 'True' ELSE 'False' END
           || ', result=' || pf_result AS perf
    FROM audit WHERE step = 'perf_benchmark'""")
def canonical_perf(v: Views) -> DataFrame:
    return v.audit.where("perf IS NOT NULL").select(
        "audit_id", maps.readable(maps.canonical_perf(F.col("perf"))).alias("perf"))


@query("SELECT table_name, version, files_added, files_removed, output_rows FROM write_counts")
def metric_first_int(v: Views) -> DataFrame:
    read = {n: maps.first_int(F.col("operationMetrics"), *writes.METRIC_NAMES[n]).alias(n)
            for n in ("files_added", "files_removed", "output_rows")}
    return v.write_history.select("table_name", "version", *read.values())


def _remapped(v: Views) -> DataFrame:
    return remap_references(v.scripts, {REFERENCE: CLONE})


@query(f"""
    SELECT script_id, md5(text || CASE script_id % 5 WHEN 0 THEN ' SELECT rand(), 1' WHEN 1 THEN ' SELECT current_timestamp'
           WHEN 2 THEN ' collect_list(x)' WHEN 3 THEN ' first (y)' ELSE '' END
           || ' {CLONE} x.{REFERENCE} {REFERENCE}0') AS digest
    FROM (SELECT doc_id AS script_id, text FROM documents)""")
def remap_refs(v: Views) -> DataFrame:
    return _remapped(v).select("script_id", F.md5("source").alias("digest"))


@query(f"""
    SELECT script_id, 1::BIGINT AS replaced, '' AS residual, true AS safe FROM scripts
    WHERE regexp_matches(source, '(^|[^\\w.])prod\\.gold\\.t1(\\W|$)')""")
def remap_ref_counts(v: Views) -> DataFrame:
    return _remapped(v).select(
        "script_id", F.col("replacements")[REFERENCE].cast("bigint").alias("replaced"), joined("residual"), "safe")


SEVERAL = {"prod.gold.t1": "lab.g.one", "prod.gold.t2": "prod.gold.t1", "prod.gold.t3": "lab.g.$3"}
_several = [("1", "Prod.GOLD.T1", "lab.g.one"), ("2", "`prod`.`gold`.`t2`", "prod.gold.t1"), ("3", "prod . gold.`t3`", "lab.g.$3")]


@query("SELECT doc_id AS script_id, " + " || ' ' || ".join(
    f"CASE WHEN doc_id % {k} = 0 THEN '{new}' ELSE 'none' END" for k, _, new in _several) + """ AS source,
    concat_ws(', ', 'prod.gold.t1=1', 'prod.gold.t2=' || CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END,
              'prod.gold.t3=' || CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS replaced,
    CASE WHEN doc_id % 2 = 0 THEN 'prod.gold.t1' ELSE '' END AS residual, doc_id % 2 <> 0 AS safe FROM documents""")
def remap_several(v: Views) -> DataFrame:
    """Several tables at once, in backticks and in any letter case; a new name that is itself mapped stays as a residual."""
    text = ", ' ', ".join(f"if(doc_id % {k} = 0, '{old}', 'none')" for k, old, _ in _several)
    scripts = v.table("documents").selectExpr("doc_id AS script_id", f"concat({text}) AS source")
    return remap_references(scripts, SEVERAL).select(
        "script_id", "source", maps.readable(maps.stringify(F.col("replacements"))).alias("replaced"), joined("residual"), "safe")


@query(r"""
    SELECT script_id, concat_ws('|',
        CASE WHEN regexp_matches(source, '(?i)\b(current_timestamp|current_date|localtimestamp|now|getdate|unix_timestamp\(\s*\))') THEN 'clock' END,
        CASE WHEN regexp_matches(source, '(?i)\b(rand|randn|random|uuid|shuffle|monotonically_increasing_id)\s*\(') THEN 'random' END,
        CASE WHEN regexp_matches(source, '(?i)\b(collect_list|collect_set|array_agg|first|first_value|last|last_value|any_value)\s*\(') THEN 'unordered' END) AS flags
    FROM scripts""")
def nondeterminism_flags_(v: Views) -> DataFrame:
    return v.scripts.select("script_id", F.array_join(nondeterminism_flags(F.col("source")), "|").alias("flags"))


# Telemetry -----------------------------------------------------------------------------------------

@query("SELECT job_id, task_key, runs, total_s FROM task_runtime")
def task_runtime(v: Views) -> DataFrame:
    return runtime.task_runtime(v.run_timeline, RUNS_AS_OF, RUNS_DAYS)


COSTED = {"costed": """
    SELECT r.job_name, r.notebook_path, r.dag_order, coalesce(t.runs, 0) AS runs, coalesce(t.total_s, 0) AS total_runtime_s,
           CASE WHEN j.s > 0 THEN round(coalesce(t.total_s, 0)::DOUBLE / j.s, 9) ELSE 0 END AS cost_share,
           coalesce(j.s > 0, false) AS ranked,
           row_number() OVER (PARTITION BY r.job_id ORDER BY coalesce(t.total_s, 0) DESC, r.dag_order, r.notebook_path) AS place
    FROM registry r LEFT JOIN task_runtime t ON t.job_id = r.job_id AND t.task_key = r.task_key
    LEFT JOIN (SELECT job_id, sum(total_s) AS s FROM task_runtime GROUP BY 1) j ON j.job_id = r.job_id"""}


@query("""
    SELECT job_name, notebook_path, dag_order, runs, total_runtime_s, cost_share, ranked,
           place = 1 AND total_runtime_s > 0 AS recommended FROM costed""", **COSTED)
def rank_hotspots(v: Views) -> DataFrame:
    return runtime.rank_hotspots(v.registry, v.run_timeline, RUNS_AS_OF, RUNS_DAYS).select(
        "job_name", "notebook_path", "dag_order", "runs", "total_runtime_s",
        F.round("cost_share", 9).alias("cost_share"), "ranked", "recommended")


@query("""
    SELECT job_name, notebook_path, 0::BIGINT AS runs, 0::BIGINT AS total_runtime_s, false AS ranked, false AS recommended
    FROM registry""")
def hotspots_without_telemetry(v: Views) -> DataFrame:
    """A timeline that does not exist leaves every job unranked."""
    return runtime.rank_hotspots(v.registry, "no_such_timeline", RUNS_AS_OF, RUNS_DAYS).select(
        "job_name", "notebook_path", "runs", "total_runtime_s", "ranked", "recommended")


@query("SELECT job, variant, runs, median_s, min_s, max_s FROM timing_summary")
def timing_summary(v: Views) -> DataFrame:
    return runtime.timing_summary(v.timings, by=["job"])


@query("""
    SELECT job, before_s, after_s, round(CASE WHEN before_s = 0 THEN 0 ELSE (before_s - after_s) / before_s END, 9) AS gain,
           0.2::DOUBLE AS min_gain, CASE WHEN before_s = 0 THEN 0 ELSE (before_s - after_s) / before_s END >= 0.2 AS passed
    FROM (SELECT job, max(median_s) FILTER (WHERE variant = 'baseline') AS before_s,
                 max(median_s) FILTER (WHERE variant = 'candidate') AS after_s FROM timing_summary GROUP BY job)""")
def perf_gate(v: Views) -> DataFrame:
    summary = runtime.timing_summary(v.timings, by=["job"])
    return runtime.perf_gate(summary, by=["job"]).withColumn("gain", F.round("gain", 9))


_timed = """
    SELECT 'job_' || (l_suppkey % 10) AS job_name, 'nb_' || l_suppkey AS notebook_path,
           CASE WHEN l_linenumber % 2 = 0 THEN 'candidate' ELSE 'baseline' END AS variant,
           l_linenumber // 2 AS run_no, sum(l_quantity) AS seconds
    FROM lineitem GROUP BY 1, 2, 3, 4"""


@query("""
    SELECT job_name, notebook_path, before_s, after_s, round(g, 9) AS gain, g >= 0.2 AS passed FROM (
        SELECT *, CASE WHEN coalesce(before_s, 0) = 0 THEN 0 ELSE (before_s - after_s) / before_s END AS g FROM (
            SELECT t.job_name, t.notebook_path, median(seconds) FILTER (WHERE variant = 'baseline') AS before_s,
                   median(seconds) FILTER (WHERE variant = 'candidate') AS after_s
            FROM (SELECT *, min(run_no) OVER (PARTITION BY job_name, notebook_path, variant) AS first_run FROM timed) t
            JOIN registry r ON r.job_name = t.job_name AND r.notebook_path = t.notebook_path
            WHERE run_no > first_run AND run_no <= first_run + 3 GROUP BY 1, 2))""", timed=_timed)
def perf_gate_registered(v: Views) -> DataFrame:
    timings = v.lineitem.groupBy(
        F.expr("concat('job_', l_suppkey % 10) AS job_name"), F.expr("concat('nb_', l_suppkey) AS notebook_path"),
        F.expr("if(l_linenumber % 2 = 0, 'candidate', 'baseline') AS variant"),
        F.expr("l_linenumber div 2 AS run_no")).agg(F.sum("l_quantity").alias("seconds"))
    return registered.perf_gate_registered(timings, v.registry).select(
        "job_name", "notebook_path", "before_s", "after_s", F.round("gain", 9).alias("gain"), "passed")


TARGETS = ["lake.gold.t_1", "lake.gold.`t_20`"]
#: Names with letters beyond ASCII and with a dash, beside those of the write history.
ODD_TARGETS = ["lake.gold.`größe-1`", "lake.gold.größe", "lake.gold.`-3`"]


@query("""
    SELECT statement_id, total_duration_ms FROM statement_log
    WHERE contains(lower(statement_text), 't_1') OR contains(lower(statement_text), 't_20')""")
def statements_touching(v: Views) -> DataFrame:
    return statements.statements_touching(v.statement_log, TARGETS).select("statement_id", "total_duration_ms")


@query("""
    SELECT statement_id, total_duration_ms, read_rows, spilled_local_bytes, spill_pct, row_amplification
    FROM recent_statements
    WHERE contains(lower(statement_text), 't_1') OR contains(lower(statement_text), 't_20')
    ORDER BY total_duration_ms DESC, statement_id LIMIT 50""")
def worst_statements(v: Views) -> DataFrame:
    return statements.worst_statements(v.statement_log, TARGETS, STATEMENTS_AS_OF, STATEMENT_DAYS).select(
        "statement_id", "total_duration_ms", "read_rows", "spilled_local_bytes", "spill_pct", "row_amplification")


@query("""
    SELECT count(*) > 0 AS available, count(*) AS matched_statements, first(statement_id ORDER BY total_duration_ms DESC, statement_id) AS statement_id,
           max(total_duration_ms) AS total_duration_ms
    FROM (SELECT * FROM recent_statements
          WHERE contains(lower(statement_text), 't_1') OR contains(lower(statement_text), 't_20')
          ORDER BY total_duration_ms DESC, statement_id LIMIT 50)""")
def statement_signals(v: Views) -> DataFrame:
    return statements.statement_signals(v.statement_log, TARGETS, STATEMENTS_AS_OF, STATEMENT_DAYS).select(
        "available", "matched_statements", "statement_id", "total_duration_ms")


@query("""
    SELECT table_name, place, statement_id, total_duration_ms, spill_pct, row_amplification FROM (
        SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY total_duration_ms DESC, statement_id) AS place
        FROM recent_statements s JOIN (SELECT DISTINCT table_name FROM write_history
                                       UNION ALL SELECT unnest(['lake.gold.`größe-1`', 'lake.gold.größe', 'lake.gold.`-3`'])) t
          ON contains(lower(statement_text), lower(replace(split_part(table_name, '.', 3), '`', ''))))
    WHERE place <= 50""")
def worst_statements_by_table(v: Views) -> DataFrame:
    odd = v.spark.createDataFrame([(n,) for n in ODD_TARGETS], "table_name string")
    tables = v.write_history.select("table_name").distinct().unionByName(odd)
    return statements.worst_by_table(v.statement_log, tables, STATEMENTS_AS_OF, STATEMENT_DAYS).selectExpr(
        "table_name", "bigint(place) AS place", "statement_id", "total_duration_ms", "spill_pct", "row_amplification")


@query("""
    SELECT table_name, available, operation, version, files_added, files_removed, output_rows, scan_time_ms, rewrite_time_ms,
           execution_time_ms, rewrite_ratio
    FROM latest_writes""")
def write_signals(v: Views) -> DataFrame:
    return writes.write_signals(v.write_history).select(
        "table_name", "available", "operation", "version", "files_added", "files_removed", "output_rows",
        "scan_time_ms", "rewrite_time_ms", "execution_time_ms", "rewrite_ratio")


PROFILES = {
    "targets": """
        SELECT job_name, notebook_path, 0 AS nth, 'lake.gold.t_' || (user_id % 30) AS table_name FROM registry
        UNION ALL SELECT job_name, notebook_path, 1, 'lake.gold.t_' || (user_id % 7) FROM registry""",
    "worst": """
        SELECT * FROM (
            SELECT t.job_name, t.notebook_path, s.*,
                   least(count(DISTINCT statement_id) OVER (PARTITION BY t.job_name, t.notebook_path), 50) AS matched,
                   row_number() OVER (PARTITION BY t.job_name, t.notebook_path ORDER BY total_duration_ms DESC, statement_id) AS place
            FROM targets t JOIN recent_statements s ON contains(lower(statement_text), split_part(t.table_name, '.', 3)))
        WHERE place = 1""",
    "rewrites": """
        SELECT t.job_name, t.notebook_path,
               string_agg('FULL-REWRITE pattern on ' || w.operation || ' (removed ' || w.files_removed || ' / added '
                          || w.files_added || ' files)', '; ' ORDER BY t.nth) AS text
        FROM targets t JOIN latest_writes w ON w.table_name = t.table_name
        WHERE w.rewrite_ratio >= 0.8 AND w.files_removed > 0 GROUP BY 1, 2""",
    "judged": """
        SELECT r.job_name, r.notebook_path, w.statement_id, w.total_duration_ms, w.execution_duration_ms,
               w.compilation_duration_ms, w.matched, w.read_bytes, w.spilled_local_bytes,
               w.spill_pct, w.row_amplification, coalesce(w.spilled_local_bytes, 0) > 0 AS spills,
               coalesce(w.row_amplification >= 3, false) AS amplifies, f.text AS rewrite_text
        FROM registry r LEFT JOIN worst w ON w.job_name = r.job_name AND w.notebook_path = r.notebook_path
        LEFT JOIN rewrites f ON f.job_name = r.job_name AND f.notebook_path = r.notebook_path""",
    "flagged": f"""
        SELECT *, concat_ws('; ',
            CASE WHEN spills THEN 'SPILL: ' || format('{{:,}}', spilled_local_bytes) || ' bytes (' || spill_pct || '% of read)' END,
            CASE WHEN amplifies THEN 'ROW AMPLIFICATION: produced/read = ' || row_amplification || 'x (exploding join?)' END,
            CASE WHEN spills OR amplifies THEN '{diagnosis.SHUFFLE_FLAG}' END, rewrite_text) AS flags
        FROM judged""",
}
_flags = f"CASE WHEN flags = '' THEN '{diagnosis.NO_SIGNAL_FLAG}' ELSE flags END"


def _profiles(v: Views) -> DataFrame:
    return diagnosis.notebook_profiles(v.registry, v.statement_log, v.write_history, STATEMENTS_AS_OF, STATEMENT_DAYS)


@query("""
    SELECT job_name, notebook_path, statement_id IS NOT NULL AS statement_available, coalesce(matched, 0) AS matched_statements,
           statement_id, total_duration_ms, execution_duration_ms, compilation_duration_ms,
           spilled_local_bytes, spill_pct, row_amplification FROM judged""", **PROFILES)
def notebook_profile(v: Views) -> DataFrame:
    return _profiles(v).select("job_name", "notebook_path", "statement_available", "matched_statements", "statement_id",
                               "total_duration_ms", "execution_duration_ms", "compilation_duration_ms", "spilled_local_bytes", "spill_pct", "row_amplification")


@query(f"""
    SELECT job_name, notebook_path, {_flags} AS flags,
           concat_ws('|', CASE WHEN spills THEN '{'|'.join(diagnosis.SPILL_TECHNIQUES)}' END,
                     CASE WHEN amplifies THEN '{diagnosis.AMPLIFICATION_TECHNIQUE}' END,
                     CASE WHEN rewrite_text IS NOT NULL THEN '{diagnosis.REWRITE_TECHNIQUE}' END) AS suggested_techniques,
           array_to_string(string_split({_flags}, '; ')[1:4], '; ') AS insight
    FROM flagged""", **PROFILES)
def diagnose(v: Views) -> DataFrame:
    return _profiles(v).select("job_name", "notebook_path", F.array_join("flags", "; ").alias("flags"),
                               joined("suggested_techniques"), "insight")


@query(f"""
    SELECT job_name, notebook_path, concat_ws(', ', 'flags=' || replace({_flags}, '; ', ' | '), 'read_bytes=' || read_bytes,
           'row_amplification=' || row_amplification, 'shuffle={diagnosis.SHUFFLE_NOTE}', 'spill_pct=' || spill_pct,
           'spilled_local_bytes=' || spilled_local_bytes, 'total_duration_ms=' || total_duration_ms) AS perf
    FROM flagged""", **PROFILES)
def profile_map(v: Views) -> DataFrame:
    profiles = _profiles(v)
    return profiles.select("job_name", "notebook_path", maps.readable(diagnosis.profile_entry(profiles)).alias("perf"))


# Audit log -----------------------------------------------------------------------------------------

@query("""
    SELECT audit_id, job, notebook, step, status, 'broadcast|' || event_type AS change_type,
           CASE WHEN eq_key = 'passed' THEN 'passed=' || eq_value || ', result=' || eq_value
                WHEN eq_key = 'result' THEN 'result=' || eq_value END AS equivalence, insight
    FROM audit""")
def audit_append(v: Views) -> DataFrame:
    events = AuditLog(v.spark, new_folder(v.spark, "audit"))
    started = F.col("status") == "started"
    events.append(v.audit_events.where(started))
    events.append(v.audit_events.where(~started))
    return events.read().select("audit_id", "job", "notebook", "step", "status", joined("change_type"),
                                maps.readable(F.col("equivalence")).alias("equivalence"), "insight")


@query(f"SELECT audit_id, job, notebook, step, status, {_moment('event_ts')}, insight FROM audit")
def audit_trail(v: Views) -> DataFrame:
    return log.audit_trail(v.audit_events).withColumn("event_ts", moment("event_ts"))


@query(f"""
    SELECT audit_id, {_moment('event_ts')}, "user", job, notebook, step, status, 'broadcast|' || event_type AS change_type,
           CASE WHEN eq_key IS NOT NULL THEN eq_key || '=' || eq_value END AS equivalence,
           CASE WHEN pf_key IS NOT NULL THEN pf_key || '=' || pf_value || ', result=' || pf_result END AS perf, insight
    FROM audit""")
def run_activity(v: Views) -> DataFrame:
    rows = log.run_activity(v.audit_events)
    return rows.select("audit_id", moment("event_ts"), "user", "job", "notebook", "step", "status",
                       joined("change_type"), maps.readable(F.col("equivalence")).alias("equivalence"),
                       maps.readable(F.col("perf")).alias("perf"), "insight")


@query(f"SELECT audit_id, {_moment('event_ts')}, job, notebook, step, insight FROM audit WHERE status = 'failed'")
def guard_events(v: Views) -> DataFrame:
    return log.guard_events(v.audit_events).select("audit_id", moment("event_ts"), "job", "notebook", "step", "insight")


@query(f"SELECT job, notebook, step, audit_id, {_moment('event_ts')}, status FROM latest")
def latest_event(v: Views) -> DataFrame:
    return log.latest_events(v.audit_events).select("job", "notebook", "step", "audit_id", moment("event_ts"), "status")


@query("""
    SELECT job, notebook, step, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS started_ts, strftime(e, '%Y-%m-%d %H:%M:%S.%f') AS last_end_ts
    FROM (SELECT job, notebook, step, max(event_ts) FILTER (WHERE status = 'started') AS s,
                 max(event_ts) FILTER (WHERE status <> 'started') AS e FROM audit GROUP BY 1, 2, 3)
    WHERE s IS NOT NULL AND (e IS NULL OR e < s)""")
def open_steps(v: Views) -> DataFrame:
    return log.open_steps(v.audit_events).select("job", "notebook", "step", moment("started_ts"), moment("last_end_ts"))


@query("""
    SELECT c.job_name AS job, c.notebook_path AS notebook, c.status AS config_status, e.eq_value AS equivalence_result,
           p.pf_value AS perf_gain, p.pf_result AS perf_passed,
           strftime(greatest(coalesce(e.event_ts, TIMESTAMP '1970-01-01'), coalesce(p.event_ts, TIMESTAMP '1970-01-01')),
                    '%Y-%m-%d %H:%M:%S.%f') AS last_event_ts
    FROM registry c
    LEFT JOIN latest e ON e.step = 'equivalence' AND e.job = c.job_name AND e.notebook = c.notebook_path
    LEFT JOIN latest p ON p.step = 'perf_benchmark' AND p.job = c.job_name AND p.notebook = c.notebook_path""")
def scorecard_(v: Views) -> DataFrame:
    return scorecard(v.registry, v.audit_events).withColumn("last_event_ts", moment("last_event_ts"))


@query("""
    SELECT c.config_status, count(*) AS notebooks, count(e.eq_value) AS judged, (SELECT count(*) FROM audit WHERE status = 'failed') AS stopped,
           (SELECT count(*) FROM audit) AS activity
    FROM (SELECT job_name, notebook_path, status AS config_status FROM registry) c
    LEFT JOIN latest e ON e.step = 'equivalence' AND e.job = c.job_name AND e.notebook = c.notebook_path
    GROUP BY c.config_status""")
def governance_views(v: Views) -> DataFrame:
    log.register_views(v.registry, v.audit_events)
    return v.spark.sql("""
        SELECT config_status, count(*) AS notebooks, count(equivalence_result) AS judged,
               (SELECT count(*) FROM v_guard_events) AS stopped, (SELECT count(*) FROM v_run_activity) AS activity
        FROM v_optimization_scorecard GROUP BY config_status""")


@query("SELECT job, notebook, step FROM missing")
def missing_steps_(v: Views) -> DataFrame:
    return missing_steps(v.audit_events, v.audit_events)


GATE = {
    "gate": """
        SELECT t.job, t.notebook, c.status AS config_status, e.n AS events,
               CASE WHEN c.status IS NULL THEN 'no registry row'
                    WHEN c.status = 'skipped' THEN 'skipped: not selected for this run'
                    WHEN m.steps IS NOT NULL THEN 'no success on record: ' || m.steps END AS block_reason
        FROM (SELECT DISTINCT job, notebook FROM audit) t
        LEFT JOIN (SELECT * FROM registry WHERE user_id % 11 <> 0) c ON c.job_name = t.job AND c.notebook_path = t.notebook
        LEFT JOIN (SELECT job, notebook, count(*) AS n FROM audit GROUP BY 1, 2) e ON e.job = t.job AND e.notebook = t.notebook
        LEFT JOIN (SELECT job, notebook, string_agg(step, ', ' ORDER BY list_position(
                       ['detect_tables', 'perf_profile', 'generate_v2', 'sandbox_setup', 'equivalence', 'perf_benchmark', 'security_review'], step)) AS steps
                   FROM missing GROUP BY 1, 2) m ON m.job = t.job AND m.notebook = t.notebook""",
    "flows": """
        SELECT flow, count(*) AS targets, count(*) FILTER (WHERE NOT passed) AS failed, bool_and(passed) AS passed
        FROM (SELECT flow, target, passed OR flow <> 'job_3' AS passed FROM flow_verdicts) GROUP BY flow""",
}


def _gate(v: Views) -> DataFrame:
    known = v.registry.where("int(substring(notebook_path, 4)) % 11 <> 0")
    return promotion_gate(v.audit_events, known, v.audit_events)


def _verdicts(v: Views) -> DataFrame:
    return v.audit_events.groupBy("job", "notebook").agg(
        F.expr("bool_and(NOT (status = 'failed' AND step = 'security_review'))").alias("passed")).select(
        F.col("job").alias("flow"), F.col("notebook").alias("target"), "passed")


@query("""
    SELECT g.job, g.notebook, config_status, coalesce(steps, '') AS steps_recorded, events, block_reason, block_reason IS NULL AS passed
    FROM gate g LEFT JOIN (SELECT job, notebook, string_agg(step, '|' ORDER BY step) AS steps
                           FROM ok_steps WHERE step IN (SELECT step FROM required_steps) GROUP BY 1, 2) s
      ON s.job = g.job AND s.notebook = g.notebook""", **GATE)
def promotion_gate_(v: Views) -> DataFrame:
    return _gate(v).withColumn("steps_recorded", joined("steps_recorded"))


@query("""
    SELECT g.job AS job_name, g.notebook AS notebook_path,
           CASE WHEN g.block_reason IS NULL AND f.passed THEN 'promoted' ELSE 'blocked' END AS status
    FROM gate g JOIN flows f ON f.flow = g.job WHERE g.config_status IS NOT NULL""", **GATE)
def promotion_outcome_(v: Views) -> DataFrame:
    lenient = _verdicts(v).withColumn("passed", F.expr("passed OR flow <> 'job_3'"))
    return promotion_outcome(_gate(v), flow_rollup(lenient))


@query("""
    SELECT flow, count(*) AS targets, count(*) FILTER (WHERE NOT passed) AS failed, bool_and(passed) AS passed
    FROM flow_verdicts GROUP BY flow""")
def flow_rollup_(v: Views) -> DataFrame:
    return flow_rollup(_verdicts(v))


@query("SELECT DISTINCT flow, target FROM flow_verdicts WHERE NOT passed")
def failed_targets(v: Views) -> DataFrame:
    return flow.failed_targets(_verdicts(v))


@query("""
    SELECT audit_id, 'result=' || CASE WHEN status = 'succeeded' THEN 'passed' ELSE 'failed' END || ', risk_tier=zero_risk, step=' || step AS equivalence,
           'after_s=' || (event_id % 40) || ', before_s=' || (event_id % 50) || ', gain=' || (event_id % 60) || ', passed='
           || CASE WHEN status = 'succeeded' THEN 'True' ELSE 'False' END AS perf
    FROM audit""")
def audit_entries(v: Views) -> DataFrame:
    """Maps of a verdict as the log stores them."""
    passed, number = F.col("status") == "succeeded", F.expr("bigint(substring(audit_id, 2))")
    return v.audit.select(
        "audit_id", maps.readable(maps.equivalence_entry(passed, F.lit("zero_risk"), step=F.col("step"))).alias("equivalence"),
        maps.readable(maps.perf_entry(number % 60, passed, number % 50, number % 40)).alias("perf"))


# Registry and DAG ----------------------------------------------------------------------------------

@query("SELECT job_id, task_key, CAST(wave AS INTEGER) AS wave, dag_order FROM ordered_tasks")
def dag_order(v: Views) -> DataFrame:
    return dag.dag_order(v.tasks, v.task_edges)


@query("""
    SELECT job_id, task_key, CAST(row_number() OVER w - 1 AS INTEGER) AS wave, row_number() OVER w - 1 AS dag_order
    FROM tasks WINDOW w AS (PARTITION BY job_id ORDER BY task_key)""")
def dag_order_chain(v: Views) -> DataFrame:
    """Every task of a job depends on the one before it."""
    links = v.tasks.where("p_partkey >= 1").selectExpr(
        "job_id", "task_key", "concat('t', lpad(p_partkey - 1, 12, '0')) AS depends_on")
    return dag.dag_order(v.tasks, links)


@query("""
    SELECT job_id, task_key, CAST(wave AS INTEGER) AS wave,
           row_number() OVER (PARTITION BY job_id ORDER BY wave, task_key) - 1 AS dag_order
    FROM (SELECT w.job_id, w.task_key, w.wave FROM free_waves w
          UNION ALL
          SELECT s.job_id, s.task_key, coalesce(m.wave + 1, 0) FROM stuck s
          LEFT JOIN (SELECT job_id, max(wave) AS wave FROM free_waves GROUP BY 1) m ON m.job_id = s.job_id)""",
       edges="""
           SELECT * FROM task_edges
           UNION SELECT job_id, task_key, 't' || lpad(CASE job_id WHEN '0' THEN '2' ELSE '3' END, 12, '0')
           FROM tasks WHERE p_partkey = 1""",
       stuck="""
           SELECT job_id, task_key FROM tasks WHERE p_partkey = 1
           UNION SELECT e.job_id, e.task_key FROM stuck s JOIN edges e ON e.job_id = s.job_id AND e.depends_on = s.task_key""",
       free_levels="""
           SELECT t.job_id, t.task_key, 0 AS level FROM tasks t ANTI JOIN stuck s ON s.job_id = t.job_id AND s.task_key = t.task_key
           UNION
           SELECT e.job_id, e.task_key, l.level + 1 FROM free_levels l
           JOIN edges e ON e.job_id = l.job_id AND e.depends_on = l.task_key
           ANTI JOIN stuck s ON s.job_id = e.job_id AND s.task_key = e.task_key""",
       free_waves="SELECT job_id, task_key, max(level) AS wave FROM free_levels GROUP BY 1, 2")
def dag_order_cycle(v: Views) -> DataFrame:
    return dag.dag_order(v.tasks, v.task_edges_cyclic)


@query("""
    SELECT t.job_name, t.job_id, t.notebook_path, t.task_key, CAST(o.dag_order AS INTEGER) AS dag_order, 'sandbox' AS sandbox_schema,
           'optimized/' || t.job_name AS optimized_folder, 0.2::DOUBLE AS min_gain, 3 AS benchmark_runs,
           CASE t.p_partkey % 5 WHEN 1 THEN 'promoted' WHEN 2 THEN 'blocked' ELSE 'pending' END AS status
    FROM tasks t JOIN ordered_tasks o ON o.job_id = t.job_id AND o.task_key = t.task_key
    WHERE t.notebook_path IS NOT NULL""")
def registry_seed(v: Views) -> DataFrame:
    prior = v.tasks.where("notebook_path IS NOT NULL").selectExpr(
        "job_name", "notebook_path",
        "element_at(array('pending', 'promoted', 'blocked', 'skipped', 'validated'), int(p_partkey % 5) + 1) AS status")
    return reg.seed(v.tasks, v.task_edges, prior).select(
        "job_name", "job_id", "notebook_path", "task_key", "dag_order", "sandbox_schema", "optimized_folder",
        "min_gain", "benchmark_runs", "status")


@query("""
    SELECT job_name, notebook_path, CASE WHEN status IN ('promoted', 'blocked') THEN status ELSE 'pending' END AS status
    FROM registry""")
def carry_forward_status(v: Views) -> DataFrame:
    seeded = v.registry.withColumn("status", F.lit("pending"))
    return reg.carry_forward(seeded, v.registry).select("job_name", "notebook_path", "status")


def _registry(v: Views, rows: DataFrame | None = None) -> Registry:
    registry = Registry(v.spark, new_folder(v.spark, "registry"))
    registry.sync(v.registry if rows is None else rows)
    return registry


@query("""
    SELECT job_name, notebook_path, task_key, dag_order, CASE WHEN job_id IN ('2', '4') THEN 'validated' ELSE status END AS status
    FROM registry WHERE job_id NOT IN ('2', '4') OR user_id % 3 <> 0""")
def registry_sync(v: Views) -> DataFrame:
    registry = _registry(v)
    again = v.registry.where("job_id IN ('2', '4') AND int(substring(notebook_path, 4)) % 3 <> 0")
    registry.sync(again.withColumn("status", F.lit("validated")))
    return registry.read().select("job_name", "notebook_path", "task_key", "dag_order", "status")


@query("""
    SELECT job_name, notebook_path, CASE WHEN user_id % 6 = 1 THEN 'approved' ELSE status END AS status FROM registry""")
def registry_set_status(v: Views) -> DataFrame:
    registry = _registry(v)
    registry.set_status(v.registry.where("int(substring(notebook_path, 4)) % 6 = 1").select(
        "job_name", "notebook_path", F.lit("approved").alias("status")))
    return registry.read().select("job_name", "notebook_path", "status")


@query("""
    SELECT job_name, notebook_path, dag_order, CASE WHEN job_name <> 'job_1' OR status IN ('promoted', 'blocked') THEN status
           WHEN dag_order = 3 OR contains(notebook_path, 'nb_1') THEN 'pending' ELSE 'skipped' END AS status
    FROM registry""")
def registry_select(v: Views) -> DataFrame:
    return select_notebooks(v.registry, [3, "nb_1", True], job="job_1").select(
        "job_name", "notebook_path", "dag_order", "status")


@query("SELECT job_name, notebook_path, dag_order FROM registry WHERE status = 'pending'")
def registry_pending(v: Views) -> DataFrame:
    return reg.pending(v.registry).select("job_name", "notebook_path", "dag_order")


@query("SELECT job_name, notebook_path, task_key, dag_order, status FROM registry")
def registry_load(v: Views) -> DataFrame:
    return reg.in_order(v.registry).select("job_name", "notebook_path", "task_key", "dag_order", "status")


@query("""
    SELECT row_number() OVER (ORDER BY dag_order) - 1 AS place, job_name, notebook_path, dag_order,
           'lake.silver.s_' || (user_id % 30) AS source_tables, 0.2::DOUBLE AS min_gain,
           user_id % 5 = 0 AS nondeterministic, status FROM registry WHERE job_name = 'job_4'""")
def get_config_tvf(v: Views) -> DataFrame:
    reg.register_lookup(v.spark, v.registry)
    found = v.spark.sql("""
        SELECT job_name, notebook_path, dag_order, array_join(source_tables, '|') AS source_tables, min_gain, nondeterministic, status
        FROM get_opt_config('job_4')""").coalesce(1)
    return found.selectExpr("monotonically_increasing_id() AS place", "*")


@query("SELECT job_name, notebook_path, dag_order, NULL::VARCHAR AS compute_cluster_id, status FROM registry")
def schema_evolve(v: Views) -> DataFrame:
    older = v.registry.drop("compute_cluster_id", "nondeterministic")
    return storage.evolve(older, reg.REGISTRY_SCHEMA).select(
        "job_name", "notebook_path", "dag_order", "compute_cluster_id", "status")


# Snapshots and flows -------------------------------------------------------------------------------

@query("SELECT table_name, max(version) AS version FROM write_history GROUP BY table_name")
def pin_latest(v: Views) -> DataFrame:
    return asof.latest_versions(v.write_history)


@query("""
    SELECT p.table_name, strftime(p.pin_ts, '%Y-%m-%d %H:%M:%S.%f') AS pin_ts, p.pin_version,
           coalesce(p.pin_version, max(h.version)) AS version, coalesce(p.pin_version, max(h.version)) IS NOT NULL AS resolved
    FROM pins p LEFT JOIN write_history h ON h.table_name = p.table_name AND h.ts <= p.pin_ts
    GROUP BY p.table_name, p.pin_ts, p.pin_version""")
def resolve_asof(v: Views) -> DataFrame:
    return asof.resolve_versions(v.write_history, v.pins).withColumn("pin_ts", moment("pin_ts"))


@query("""
    SELECT table_name, max(version) AS version FROM write_history GROUP BY 1""")
def resolve_required(v: Views) -> DataFrame:
    """A moment after the last commit gives the last version of every table; one without would stop the job."""
    late = v.write_history.select("table_name").distinct().selectExpr(
        "table_name", "timestamp_ntz'2100-01-01' AS pin_ts", "bigint(NULL) AS pin_version")
    return asof.require_resolved(asof.resolve_versions(v.write_history, late)).select("table_name", "version")


_version = "CAST(floor((year(o_orderdate) - 1992) / 2) AS INTEGER)"


@query(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE {_version} = 3")
def snapshot_read(v: Views) -> DataFrame:
    path = new_folder(v.spark, "versions")
    snapshots.write_versions(v.orders.withColumn("version", F.expr(_version)), path)
    return snapshots.read_version(v.spark, path, 3).select("o_orderkey", "o_custkey", "o_totalprice")


SAMPLED = _slot = "('0x' || substr(md5('42|' || length(CAST({k} AS VARCHAR)) || ':' || {k}), 1, 8))::BIGINT < 1073741824"


@query(f"""
    SELECT 'orders' AS side, o_orderkey AS k, count(*) AS n FROM orders WHERE {_slot.format(k='o_orderkey')} GROUP BY 2
    UNION ALL
    SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE {_slot.format(k='l_orderkey')} GROUP BY 2""")
def sample_by_key_(v: Views) -> DataFrame:
    left = sample_by_key(v.orders, ["o_orderkey"], 25).selectExpr("'orders' AS side", "o_orderkey AS k")
    right = sample_by_key(v.lineitem, ["l_orderkey"], 25).selectExpr("'lineitem' AS side", "l_orderkey AS k")
    return left.unionByName(right).groupBy("side", "k").agg(F.count(F.lit(1)).alias("n"))


COMMITS = (datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2024, 1, 3))


def _store(v: Views) -> SnapshotStore:
    """Orders and lines as three growing versions each, committed a day apart; the last one holds all rows."""
    store = SnapshotStore(v.spark, new_folder(v.spark, "store"))
    for i, ts in enumerate(COMMITS):
        cut = "true" if ts == COMMITS[-1] else f"year({{}}) <= {1996 + 2 * i}"
        store.commit("orders", v.orders.where(cut.format("o_orderdate")), ts)
        store.commit("lineitem", v.lineitem.where(cut.format("l_shipdate")), ts)
    return store


@query("""
    SELECT 'orders' AS table_name, o_orderkey AS k, count(*) AS n FROM orders WHERE year(o_orderdate) <= 1998 GROUP BY 2
    UNION ALL
    SELECT 'lineitem', l_orderkey, count(*) FROM lineitem GROUP BY 2""")
def replay_inputs(v: Views) -> DataFrame:
    """Orders as of a moment between two versions, lines pinned to the last one."""
    frames = _store(v).inputs_at(["orders", "lineitem"], datetime(2024, 1, 2, 12), {"lineitem": 2})
    keyed = [df.selectExpr(f"'{t}' AS table_name", f"{t[0]}_orderkey AS k") for t, df in frames.items()]
    return keyed[0].unionByName(keyed[1]).groupBy("table_name", "k").agg(F.count(F.lit(1)).alias("n"))


def _order_revenue(tables: dict[str, DataFrame]) -> DataFrame:
    """The step that both targets share: orders with the revenue of their lines, computed once a flow."""
    money = "cast(round(l_extendedprice * (1 - l_discount), 4) AS decimal(18,4))"
    lines = tables["lineitem"].groupBy("l_orderkey").agg(F.expr(f"sum({money})").alias("revenue"))
    joined_lines = tables["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return stored(joined_lines.select("o_orderkey", "o_custkey", "o_orderstatus", "revenue"), "order-revenue")


def revenue_flow(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two steps: revenue per order, then per customer and per status."""
    joined_lines = _order_revenue(tables)
    return {
        "by_customer": joined_lines.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue")),
        "by_status": joined_lines.groupBy("o_orderstatus").agg(
            F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders")),
    }


def revenue_flow_salted(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same with a salted aggregate, and with a fault: one target loses rows."""
    joined_lines = _order_revenue(tables)
    kept = joined_lines.where("o_orderkey % 97 <> 0").select("o_orderkey", "o_orderstatus", "revenue")
    return {
        "by_customer": joined_lines.groupBy("o_custkey").agg(F.sum("revenue").alias("revenue")),
        "by_status": recipes.salted_aggregate(
            kept, ["o_orderstatus"], {"revenue": ("sum", "revenue"), "orders": ("count", "o_orderkey")}),
    }


def _flow_sql(orders: str, lines: str, prefix: str, kept: str = "true") -> dict[str, str]:
    """The outputs of the flow over the given rows, as relations with a prefix."""
    money = "CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))"
    rows = (f"SELECT o_orderkey, o_custkey, o_orderstatus, revenue FROM ({orders}) JOIN "
            f"(SELECT l_orderkey, sum({money}) AS revenue FROM ({lines}) GROUP BY 1) ON o_orderkey = l_orderkey")
    return {
        f"{prefix}_rows": rows,
        f"{prefix}_customer": f"SELECT o_custkey, sum(revenue) AS revenue FROM {prefix}_rows GROUP BY 1",
        f"{prefix}_status": f"SELECT o_orderstatus, sum(revenue) AS revenue, count(*) AS orders FROM {prefix}_rows WHERE {kept} GROUP BY 1",
    }


_matching = " UNION ALL ".join(
    f"""SELECT 'by_{t}' AS target, (SELECT count(*) FROM (SELECT * FROM x_{t} EXCEPT ALL SELECT * FROM y_{t}))
        + (SELECT count(*) FROM (SELECT * FROM y_{t} EXCEPT ALL SELECT * FROM x_{t})) = 0 AS passed"""
    for t in ("customer", "status"))


def _passed(verdict, v: Views) -> DataFrame:
    return verdict.to_frame(v.spark).groupBy("target").agg(F.bool_and("passed").alias("passed"))


@query(_matching, **_flow_sql("SELECT * FROM orders", "SELECT * FROM lineitem", "x"),
       **_flow_sql("SELECT * FROM orders", "SELECT * FROM lineitem", "y", "o_orderkey % 97 <> 0"))
def flow_compare(v: Views) -> DataFrame:
    inputs = {"orders": v.orders, "lineitem": v.lineitem}
    return _passed(validate_flow(v.spark, "revenue", revenue_flow, revenue_flow_salted, inputs,
                                 audit=AuditLog(v.spark, new_folder(v.spark, "audit"))), v)


@query(_matching,
       **_flow_sql("SELECT * FROM orders", "SELECT * FROM lineitem", "x"),
       **_flow_sql("SELECT * FROM orders", "SELECT * FROM lineitem", "y", "o_orderkey % 97 <> 0"))
def replay_compare(v: Views) -> DataFrame:
    store = _store(v)
    past = store.inputs_at(["orders", "lineitem"], COMMITS[2])
    for target, df in revenue_flow(past).items():
        store.commit(target, df, datetime(2024, 1, 3, 6))
    return _passed(validate_replay(
        v.spark, "revenue", revenue_flow_salted, store, tables=["orders", "lineitem"],
        targets=["by_customer", "by_status"], anchor_before=datetime(2024, 1, 3, 1),
        anchor_after=datetime(2024, 1, 3, 7)), v)


# Recipes -------------------------------------------------------------------------------------------

@query("""
    SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def recipe_broadcast(v: Views) -> DataFrame:
    nation = v.table("nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return recipes.broadcast_join(v.table("customer"), nation, ["c_nationkey"]).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""
    SELECT l_returnflag, count(l_orderkey) AS n, sum(l_quantity) AS quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most
    FROM lineitem GROUP BY l_returnflag""")
def recipe_salted_agg(v: Views) -> DataFrame:
    return recipes.salted_aggregate(v.lineitem, ["l_returnflag"], {
        "n": ("count", "l_orderkey"), "quantity": ("sum", "l_quantity"),
        "least": ("min", "l_extendedprice"), "most": ("max", "l_extendedprice")})


HOT = "CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END"


@query(f"""
    SELECT s_name, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity
    FROM lineitem JOIN supplier ON s_suppkey = {HOT} GROUP BY 1, 2""")
def recipe_salted_join(v: Views) -> DataFrame:
    fact = v.lineitem.withColumn("s_suppkey", F.expr(HOT)).select("s_suppkey", "l_linenumber", "l_quantity")
    return recipes.salted_join(fact, v.table("supplier"), "s_suppkey").groupBy("s_name", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def recipe_zorder_layout(v: Views) -> DataFrame:
    path = new_folder(v.spark, "zorder")
    recipes.write_zordered(v.orders, ["o_custkey", "o_orderdate"], path, files=8)
    return v.spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT event_id, user_id, event_type, value FROM events")
def recipe_compact(v: Views) -> DataFrame:
    scattered, packed = new_folder(v.spark, "scattered"), new_folder(v.spark, "packed")
    v.events.repartition(32).write.parquet(scattered)
    recipes.compact(v.spark, scattered, packed)
    return v.spark.read.parquet(packed).select("event_id", "user_id", "event_type", "value")


def price_band(df: DataFrame) -> DataFrame:
    """Net price and its band, in built-in expressions."""
    return df.withColumn("net", F.expr("l_extendedprice * (1 - l_discount)")).withColumn(
        "band", F.expr("CASE WHEN net < 10000 THEN 'low' WHEN net < 40000 THEN 'mid' ELSE 'high' END"))


def price_band_udf(df: DataFrame) -> DataFrame:
    """The same row by row in Python: the baseline that the recipe replaces."""
    net = F.udf(lambda price, discount: price * (1 - discount), "double")
    band = F.udf(lambda x: "low" if x < 10000 else "mid" if x < 40000 else "high", "string")
    return df.withColumn("net", net("l_extendedprice", "l_discount")).withColumn("band", band("net"))


@query("""
    SELECT CASE WHEN l_extendedprice * (1 - l_discount) < 10000 THEN 'low'
                WHEN l_extendedprice * (1 - l_discount) < 40000 THEN 'mid' ELSE 'high' END AS band,
           count(*) AS n, max(l_linenumber) AS lines
    FROM lineitem GROUP BY 1""")
def recipe_deudf(v: Views) -> DataFrame:
    return price_band(v.lineitem).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("lines"))


PRICE = {"price": "cast(round(l_extendedprice, 2) AS decimal(18,2))", "quantity": "bigint(l_quantity)"}


@query("""
    SELECT l_suppkey, count(*) AS "rows", round(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)))::DOUBLE, 2) AS price_sum,
           min(l_extendedprice) AS price_min, max(l_extendedprice) AS price_max, CAST(sum(l_quantity) AS BIGINT) AS quantity_sum
    FROM lineitem GROUP BY l_suppkey""")
def recipe_incremental_agg(v: Views) -> DataFrame:
    old, new = v.lineitem.where("year(l_shipdate) < 2000"), v.lineitem.where("year(l_shipdate) >= 2000")
    path = new_folder(v.spark, "stored")
    recipes.aggregate(old, ["l_suppkey"], PRICE).write.parquet(path)
    merged = recipes.merge_aggregates(v.spark.read.parquet(path), recipes.aggregate(new, ["l_suppkey"], PRICE),
                                      ["l_suppkey"])
    return merged.selectExpr("l_suppkey", "`rows`", "round(double(price_sum), 2) AS price_sum",
                             "double(price_min) AS price_min", "double(price_max) AS price_max", "quantity_sum")


@query("""
    SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
    FROM orders""")
def recipe_partition_reload(v: Views) -> DataFrame:
    path = new_folder(v.spark, "reload")
    rows = v.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    recipes.reload_partitions(rows, path, "o_orderstatus")
    changed = rows.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.expr("o_totalprice * 2"))
    recipes.reload_partitions(changed, path, "o_orderstatus")
    return v.spark.read.schema(rows.schema).parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders
    UNION ALL
    SELECT -1 - o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 7 = 0""")
def recipe_merge_upsert(v: Views) -> DataFrame:
    target = v.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    changed = target.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = target.where("o_orderkey % 7 = 0").selectExpr("-1 - o_orderkey AS o_orderkey", "o_custkey",
                                                         "'N' AS o_orderstatus")
    return recipes.merge_upsert(target, changed.unionByName(added), ["o_orderkey"])


@query("""
    SELECT (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM g)) AS baseline_only,
           (SELECT count(*) FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM g)) AS candidate_only, true AS passed""",
       g="SELECT l_suppkey, max(l_shipdate) AS last, count(*) AS n FROM lineitem GROUP BY 1")
def repeatability_check(v: Views) -> DataFrame:
    return recipes.repeatability_check(
        lambda rows: rows.groupBy("l_suppkey").agg(F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("n")),
        v.lineitem)


@query("""
    SELECT count(*) FILTER (WHERE l_suppkey % 7 = 0) AS baseline_only, count(*) FILTER (WHERE l_suppkey % 7 = 0) AS candidate_only,
           false AS passed FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def repeatability_broken(v: Views) -> DataFrame:
    """A step whose result depends on how often it ran, for a known part of the rows."""
    runs = iter(range(2))
    return recipes.repeatability_check(
        lambda rows: rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "run", F.expr(f"if(l_suppkey % 7 = 0, {next(runs)}, 0)")), v.lineitem)


def named(entries: dict) -> dict:
    """Names as callers see them: functions that would hide an import end in an underscore here."""
    return {name.rstrip("_"): value for name, value in entries.items()}
