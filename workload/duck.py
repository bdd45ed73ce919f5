"""The relations of ``views.py`` as ANSI SQL, and the way they are put before a query."""

from __future__ import annotations

import re

from .views import JOBS, REFERENCE, STEPS

_STEP = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STEPS)) + " END"

VIEWS = {
    "orders_cand": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 0.5
                    WHEN o_orderkey % 2 = 1 THEN o_totalprice + 1e-9 ELSE o_totalprice END AS o_totalprice,
               o_orderdate, o_orderpriority
        FROM orders WHERE o_orderkey % 97 <> 0
        UNION ALL SELECT * FROM orders WHERE o_orderkey % 89 = 0""",
    "orders_drift": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1e-9 AS o_totalprice, o_orderdate, o_orderpriority
        FROM orders""",
    "orders_moved": """
        SELECT * REPLACE (CASE WHEN o_orderkey % 83 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS o_totalprice) FROM orders""",
    "lineitem_cand": """
        SELECT * FROM lineitem WHERE l_orderkey % 97 <> 0
        UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 89 = 0""",
    "run_timeline": """
        SELECT CAST(l_suppkey % 10 AS VARCHAR) AS job_id, 'task_' || (l_partkey % 20) AS task_key,
               l_orderkey AS run_id, l_shipdate AS period_start_time,
               CASE WHEN l_linenumber = 7 THEN NULL
                    ELSE l_shipdate + to_minutes(CAST(floor(l_quantity) AS INTEGER)) END AS period_end_time
        FROM lineitem""",
    "task_runtime": """
        SELECT job_id, task_key, count(DISTINCT run_id) AS runs,
               CAST(sum(CAST(floor(epoch(period_end_time)) AS BIGINT) - CAST(floor(epoch(period_start_time)) AS BIGINT)) AS BIGINT) AS total_s
        FROM run_timeline
        WHERE period_start_time >= TIMESTAMP '2001-01-01' - INTERVAL 1500 DAY AND period_end_time IS NOT NULL
        GROUP BY job_id, task_key""",
    "timings": """
        SELECT 'job_' || (l_suppkey % 10) AS job,
               CASE WHEN l_linenumber % 2 = 0 THEN 'candidate' ELSE 'baseline' END AS variant,
               l_orderkey AS run_no,
               sum(CASE WHEN l_linenumber % 2 = 0 THEN floor(l_quantity / 2) ELSE l_quantity END) AS seconds
        FROM lineitem GROUP BY 1, 2, 3""",
    "timing_summary": """
        SELECT job, variant, count(*) AS runs, median(seconds) AS median_s, min(seconds) AS min_s, max(seconds) AS max_s
        FROM (SELECT *, min(run_no) OVER (PARTITION BY job, variant) AS first_run FROM timings)
        WHERE run_no > first_run GROUP BY job, variant""",
    "statement_log": """
        SELECT CAST(event_id AS VARCHAR) AS statement_id,
               'INSERT INTO lake.gold.T_' || (user_id % 30) || ' SELECT * FROM src, lake.gold.`Größe-' || (user_id % 4) || '`' AS statement_text,
               ts AS start_time, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'FINISHED' END AS execution_status,
               CAST(floor(value * 1000) AS BIGINT) AS total_duration_ms, CAST(floor(value * 800) AS BIGINT) AS execution_duration_ms,
               event_id % 100 AS compilation_duration_ms, 1 + event_id % 1000 AS read_rows,
               (1 + event_id % 1000) * CASE WHEN event_id % 7 = 0 THEN 15000000 ELSE user_id % 5 END AS produced_rows, (1 + event_id % 1000) * 100 AS read_bytes,
               CASE WHEN event_type = 'purchase' THEN user_id * 1000 ELSE 0 END AS spilled_local_bytes
        FROM events""",
    "recent_statements": """
        SELECT *, CASE WHEN read_bytes > 0 THEN round_even(spilled_local_bytes * 100.0::DOUBLE / read_bytes, 1) ELSE 0 END AS spill_pct,
               CASE WHEN read_rows > 0 THEN round_even(produced_rows::DOUBLE / read_rows, 2) END AS row_amplification
        FROM statement_log
        WHERE start_time >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND execution_status = 'FINISHED'""",
    "write_history": """
        SELECT 'lake.gold.t_' || (o_custkey % 50) AS table_name,
               date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 1099511627776 + o_orderkey AS version,
               o_orderdate AS ts,
               CASE o_orderstatus WHEN 'F' THEN 'MERGE' WHEN 'O' THEN 'write' ELSE 'OPTIMIZE' END AS operation,
               CAST(o_orderkey % 7 AS VARCHAR) AS m_added,
               CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS m_removed,
               CAST(o_orderkey % 3 AS VARCHAR) AS m_removed2,
               CASE WHEN o_orderkey % 13 = 0 THEN '3.5' ELSE CAST(o_orderkey AS VARCHAR) END AS m_rows, '9' AS m_rows2,
               CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 500 ELSE 0 END AS rewrite_time_ms, o_orderkey % 900 AS scan_time_ms,
               o_orderkey % 2000 AS execution_time_ms
        FROM orders""",
    "write_counts": """
        SELECT *, CAST(m_added AS BIGINT) AS files_added,
               CASE WHEN m_removed = '' THEN CAST(m_removed2 AS BIGINT) ELSE CAST(m_removed AS BIGINT) END AS files_removed,
               CASE WHEN m_rows = '3.5' THEN CAST(m_rows2 AS BIGINT) ELSE CAST(m_rows AS BIGINT) END AS output_rows
        FROM write_history""",
    "latest_writes": """
        SELECT t.table_name, w.version IS NOT NULL AS available, w.operation, w.version, w.files_added, w.files_removed,
               w.output_rows, w.scan_time_ms, w.rewrite_time_ms, w.execution_time_ms, CASE WHEN w.files_added > 0 THEN round_even(w.files_removed::DOUBLE / w.files_added, 2) END AS rewrite_ratio
        FROM (SELECT DISTINCT table_name FROM write_history) t
        LEFT JOIN (
            SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY version DESC) AS nth
            FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY version DESC) AS place FROM write_counts)
            WHERE place <= 5 AND upper(operation) IN ('WRITE', 'MERGE', 'DELETE', 'UPDATE',
                'CREATE OR REPLACE TABLE AS SELECT', 'CREATE TABLE AS SELECT', 'TRUNCATE', 'REPLACE TABLE AS SELECT')
        ) w ON w.table_name = t.table_name AND w.nth = 1""",
    "pins": """
        SELECT DISTINCT 'lake.gold.t_' || (p_partkey % 60) AS table_name,
               TIMESTAMP '1994-12-01' + to_days(CAST((p_partkey % 400) * 7 AS INTEGER)) AS pin_ts,
               CASE WHEN p_partkey % 10 = 0 THEN CAST(p_size AS BIGINT) END AS pin_version
        FROM part""",
    "audit": f"""
        SELECT 'a' || event_id AS audit_id, ts AS event_ts, 'u' || (user_id % 7) AS "user",
               'job_' || (user_id % 10) AS job, 'nb_' || user_id AS notebook, step,
               CASE WHEN event_id % 10 = 0 THEN 'started'
                    WHEN event_id % 10 IN (1, 2) OR (user_id % 3 = 0 AND step = 'security_review') THEN 'failed'
                    ELSE 'succeeded' END AS status,
               event_type, event_id, user_id,
               CASE WHEN step = 'equivalence' THEN CASE WHEN event_id % 3 = 0 THEN 'passed' ELSE 'result' END END AS eq_key,
               CASE WHEN step = 'equivalence' THEN CASE WHEN event_id % 10 IN (1, 2) THEN 'failed' ELSE 'passed' END END AS eq_value,
               CASE WHEN step = 'perf_benchmark' THEN CASE WHEN event_id % 2 = 0 THEN 'gain' ELSE 'gain_pct' END END AS pf_key,
               CASE WHEN step = 'perf_benchmark' THEN CAST(user_id % 100 AS VARCHAR) END AS pf_value,
               CASE WHEN step = 'perf_benchmark' THEN CASE WHEN event_id % 10 IN (1, 2) THEN 'failed' ELSE 'Passed' END END AS pf_result,
               'note ' || event_id AS insight
        FROM (SELECT *, {_STEP} AS step FROM events)""",
    "registry": """
        SELECT 'job_' || (user_id % 10) AS job_name, CAST(user_id % 10 AS VARCHAR) AS job_id,
               'nb_' || user_id AS notebook_path, 'task_' || (user_id % 20) AS task_key,
               CAST(floor(user_id / 10) AS INTEGER) AS dag_order, user_id,
               CASE user_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'promoted' WHEN 2 THEN 'skipped' ELSE 'blocked' END AS status
        FROM (SELECT DISTINCT user_id FROM events)""",
    "latest": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job, notebook, step ORDER BY event_ts DESC, audit_id DESC) AS rn FROM audit)
        WHERE rn = 1""",
    "ok_steps": """
        SELECT DISTINCT job, notebook, step FROM audit WHERE status = 'succeeded' AND step <> 'promote'""",
    "required_steps": " UNION ALL ".join(f"SELECT '{s}' AS step" for s in STEPS[:-1]),
    "missing": """
        SELECT t.job, t.notebook, r.step FROM (SELECT DISTINCT job, notebook FROM audit) t CROSS JOIN required_steps r
        WHERE NOT EXISTS (SELECT 1 FROM ok_steps o WHERE o.job = t.job AND o.notebook = t.notebook AND o.step = r.step)""",
    "flow_verdicts": """
        SELECT job AS flow, notebook AS target, bool_and(NOT (status = 'failed' AND step = 'security_review')) AS passed
        FROM audit GROUP BY job, notebook""",
    "tasks": " UNION ALL ".join(
        f"SELECT 'job_{j}' AS job_name, '{j}' AS job_id, 't' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS task_key, "
        f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '/jobs/nb_' || p_partkey END AS notebook_path, p_partkey FROM part"
        for j in JOBS),
    "task_edges": " UNION ".join(
        f"SELECT '{j}' AS job_id, 't' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS task_key, "
        f"'t' || lpad(CAST(p_partkey // {d} AS VARCHAR), 12, '0') AS depends_on FROM part WHERE p_partkey >= 1"
        for j in JOBS for d in (2 + j, 3)),
    "task_levels": """
        SELECT t.job_id, t.task_key, 0 AS level FROM tasks t
        UNION
        SELECT e.job_id, e.task_key, l.level + 1 FROM task_levels l
        JOIN task_edges e ON e.job_id = l.job_id AND e.depends_on = l.task_key""",
    "ordered_tasks": """
        SELECT job_id, task_key, wave,
               row_number() OVER (PARTITION BY job_id ORDER BY wave, task_key) - 1 AS dag_order
        FROM (SELECT job_id, task_key, max(level) AS wave FROM task_levels GROUP BY job_id, task_key)""",
    "scripts": f"""
        SELECT doc_id AS script_id, text || CASE doc_id % 5 WHEN 0 THEN ' SELECT rand(), 1' WHEN 1 THEN ' SELECT current_timestamp'
               WHEN 2 THEN ' collect_list(x)' WHEN 3 THEN ' first (y)' ELSE '' END
               || ' {REFERENCE} x.{REFERENCE} {REFERENCE}0' AS source
        FROM documents""",
}

def _mentioned(sql: str) -> list[str]:
    return [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def _needed(sql: str, found: dict[str, None], within: tuple[str, ...] = ()) -> dict[str, None]:
    """Views used by the text, each after those it uses itself."""
    for name in _mentioned(sql):
        if name not in found and name not in within:
            _needed(VIEWS[name], found, (*within, name))
            found[name] = None
    return found


def query(body: str, **extra: str) -> str:
    """The query with the views it uses, directly or not, in front of it.

    ``extra`` adds further relations, after the views.
    """
    used = _needed(" ".join([*extra.values(), body]), {})
    named = {**{n: VIEWS[n] for n in used}, **extra}
    if not named:
        return body.strip()
    recursive = "RECURSIVE " if any(re.search(rf"\bFROM {n}\b", s) for n, s in named.items()) else ""
    listed = ",\n".join(f'{n} AS ({s.strip()})' for n, s in named.items())
    return f"WITH {recursive}{listed}\n{body.strip()}"

