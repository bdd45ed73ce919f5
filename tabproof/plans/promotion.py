"""The promotion gate: nothing is promoted whose steps are not all on record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The steps that must have succeeded.
REQUIRED_STEPS = (
    "detect_tables", "perf_profile", "generate_v2", "sandbox_setup", "equivalence", "perf_benchmark",
    "security_review",
)
ROW = ["job", "notebook"]


class PromotionBlocked(ValueError):
    """A notebook may not be promoted."""


def recorded_steps(events: DataFrame, required: tuple[str, ...] = REQUIRED_STEPS,
                   latest: bool = False) -> DataFrame:
    """``(job, notebook, events, steps)``: number of events, and the required steps that succeeded.

    A step counts when it ever succeeded; with ``latest``, when its newest
    finished event did. The log is read once and summed up per step first, so
    ``steps`` is gathered from one row per step and is no longer than ``required``.
    """
    succeeded = F.col("status") == "succeeded"
    finished = F.when(F.col("status") != "started", F.struct("event_ts", "audit_id"))
    ok = F.max_by(succeeded, finished) if latest else F.bool_or(succeeded)
    per_step = events.groupBy(*ROW, "step").agg(F.count(F.lit(1)).alias("n"), ok.alias("ok"))
    return per_step.groupBy(*ROW).agg(
        F.sum("n").alias("events"),
        F.array_sort(F.collect_set(F.when(F.col("ok") & F.col("step").isin(*required), F.col("step")))).alias("steps"))


def _missing(required: tuple[str, ...]):
    return F.array_except(F.array(*[F.lit(s) for s in required]),
                          F.coalesce("steps", F.array().cast("array<string>")))


def missing_steps(targets: DataFrame, events: DataFrame, required: tuple[str, ...] = REQUIRED_STEPS,
                  latest: bool = False) -> DataFrame:
    """``(job, notebook, step)`` for each required step of a target that has not succeeded."""
    return (
        targets.select(*ROW).distinct().join(recorded_steps(events, required, latest), ROW, "left")
        .select(*ROW, F.explode(_missing(required)).alias("step"))
    )


def promotion_gate(targets: DataFrame, registry: DataFrame, events: DataFrame,
                   required: tuple[str, ...] = REQUIRED_STEPS, latest: bool = False) -> DataFrame:
    """One row per notebook of ``targets(job, notebook)``: ``passed`` or the ``block_reason``.

    Blocked are notebooks without a registry row, those marked ``skipped``, and
    those with a required step missing, in this order.
    """
    rows = registry.select(F.col("job_name").alias("job"), F.col("notebook_path").alias("notebook"),
                           F.col("status").alias("config_status"), F.lit(True).alias("registered"))
    judged = (
        targets.select(*ROW).distinct().join(rows, ROW, "left")
        .join(recorded_steps(events, required, latest), ROW, "left")
        .withColumn("missing", _missing(required))
    )
    reason = (
        F.when(F.col("registered").isNull(), "no registry row")
        .when(F.col("config_status") == "skipped", "skipped: not selected for this run")
        .when(F.size("missing") > 0, F.concat(F.lit("no success on record: "), F.array_join("missing", ", ")))
    )
    return judged.select(
        *ROW, "config_status", F.coalesce("steps", F.array().cast("array<string>")).alias("steps_recorded"),
        F.coalesce("events", F.lit(0)).alias("events"), reason.alias("block_reason"),
        reason.isNull().alias("passed"))


def require_promotable(spark, job: str, notebook: str, registry: DataFrame, events: DataFrame,
                       required: tuple[str, ...] = REQUIRED_STEPS, latest: bool = False) -> dict:
    """The gate for one notebook: its row as a dict, or :class:`PromotionBlocked`."""
    target = spark.createDataFrame([(job, notebook)], "job string, notebook string")
    mine = (F.col("job") == job) & (F.col("notebook") == notebook)
    row = promotion_gate(target, registry, events.where(mine), required, latest).first()
    if not row.passed:
        raise PromotionBlocked(f"{job}/{notebook}: {row.block_reason}")
    return row.asDict()


def promotion_outcome(gate: DataFrame, flows: DataFrame) -> DataFrame:
    """Status updates that follow: ``promoted`` where gate and flow passed, else ``blocked``.

    ``flows`` is ``(flow, passed)`` with the job's name as flow; a job without a
    flow verdict does not pass. Notebooks without a registry row get none.
    """
    verdict = flows.select(F.col("flow").alias("job"), F.col("passed").alias("flow_passed"))
    ok = F.col("passed") & F.coalesce("flow_passed", F.lit(False))
    return gate.where("config_status IS NOT NULL").join(verdict, "job", "left").select(
        F.col("job").alias("job_name"), F.col("notebook").alias("notebook_path"),
        F.when(ok, "promoted").otherwise("blocked").alias("status"))
