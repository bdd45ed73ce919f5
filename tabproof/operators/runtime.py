"""Where the time goes: runtime per task, hotspots, timing summaries and the gain gate."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.telemetry import TIMELINE, telemetry
from .running import exact_median, value_counts

# Defaults of the telemetry window and the gain gate.
RUN_LOOKBACK_DAYS = 30
MIN_GAIN = 0.20


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, as the difference of two epoch seconds."""
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def within_days(ts: Column, as_of: datetime, days: int) -> Column:
    """At most ``days`` before ``as_of``; a literal bound, so it reaches the scan."""
    return ts >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def task_runtime(timeline: DataFrame, as_of: datetime, lookback_days: int = RUN_LOOKBACK_DAYS) -> DataFrame:
    """``(job_id, task_key, runs, total_s)`` over finished runs in the window.

    ``timeline`` is ``(job_id, task_key, run_id, period_start_time,
    period_end_time)``; a run may have several periods.
    """
    return (
        telemetry(timeline, TIMELINE).where(within_days(F.col("period_start_time"), as_of, lookback_days)
                       & F.col("period_end_time").isNotNull())
        .groupBy("job_id", "task_key")
        .agg(F.count_distinct("run_id").alias("runs"),
             F.sum(seconds_between(F.col("period_start_time"), F.col("period_end_time"))).alias("total_s"))
    )


def rank_hotspots(registry: DataFrame, timeline: DataFrame | str | None, as_of: datetime,
                  lookback_days: int = RUN_LOOKBACK_DAYS) -> DataFrame:
    """Registry rows with their task's runtime, dearest first in each job.

    Adds ``runs``, ``total_runtime_s``, ``job_runtime_s`` (of all the job's tasks,
    listed or not), ``cost_share`` of it, ``ranked`` (the job has telemetry) and ``recommended`` (the
    dearest notebook, by DAG order on ties, when it ran at all).
    """
    jobs = registry.select("job_id").distinct()
    # Periods are added up before the registry's jobs are chosen: a join of periods would bring each job's into one task.
    whole = Window.partitionBy("job_id")
    runtime = task_runtime(telemetry(timeline, TIMELINE), as_of, lookback_days).join(jobs, "job_id", "left_semi").withColumn(
        "job_total_s", F.sum("total_s").over(whole))
    cheapest_last = F.struct((-F.col("total_s")).alias("cost"), "dag_order", "notebook_path")
    return (
        registry.withColumn("listed", F.lit(True)).join(runtime, ["job_id", "task_key"], "full")
        .withColumns({
            "job_total_s": F.max("job_total_s").over(whole),
            "pick": F.min(F.when(F.col("listed") & (F.col("total_s") > 0), cheapest_last)).over(whole)["notebook_path"],
        })
        .where("listed")
        .withColumns({
            "runs": F.coalesce("runs", F.lit(0)),
            "total_runtime_s": F.coalesce("total_s", F.lit(0)),
            "cost_share": F.when(F.col("job_total_s") > 0,
                                 F.coalesce("total_s", F.lit(0)) / F.col("job_total_s")).otherwise(F.lit(0.0)),
            "job_runtime_s": F.coalesce("job_total_s", F.lit(0)),
            "ranked": F.coalesce(F.col("job_total_s") > 0, F.lit(False)),
            "recommended": F.coalesce(F.col("notebook_path") == F.col("pick"), F.lit(False)),
        })
        .drop("total_s", "job_total_s", "pick", "listed")
        .orderBy("job_id", F.desc("total_runtime_s"), "dag_order", "notebook_path")
    )


def timing_summary(timings: DataFrame, runs: int | None = None, warmup: bool = True,
                   by: list[str] | None = None) -> DataFrame:
    """Median, least and greatest seconds of each variant, its warm-up run left out.

    ``timings`` is ``(variant, run_no, seconds)`` plus any ``by`` columns, one
    row per run. The warm-up is the lowest run number; ``runs`` keeps that many
    runs after it.
    """
    keys = [*(by or []), "variant"]
    if runs is not None:
        kept = earliest_runs(timings, keys, runs + int(warmup)).where(F.col("nth") > int(warmup))
        counts = value_counts(kept, keys, "seconds")
    else:
        counts = value_counts(timings, keys, "seconds")
        if warmup:
            # The warm-up is taken out of the counts, which spares a join of all runs with their first.
            first = timings.groupBy(*keys).agg(F.min_by("seconds", "run_no").alias("seconds"))
            counts = counts.unionByName(first.withColumn("n", F.lit(-1).cast("bigint"))).groupBy(
                *keys, "seconds").agg(F.sum("n").alias("n")).where("n > 0")
    return exact_median(counts, keys, "seconds").select(
        *keys, F.col("n").alias("runs"), F.col("median").alias("median_s"), F.col("least").alias("min_s"),
        F.col("greatest").alias("max_s"))


def earliest_runs(timings: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first ``limit`` runs of every variant with their place ``nth``; limited inside the tasks first."""
    order = Window.partitionBy(*keys).orderBy("run_no")
    return timings.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def gain(before: Column, after: Column) -> Column:
    """Share of the time saved; 0 when there was none to save."""
    return F.when(F.coalesce(before, F.lit(0.0)) == 0, F.lit(0.0)).otherwise((before - after) / before)


def perf_gate(summary: DataFrame, min_gain: float | Column = MIN_GAIN, by: list[str] | None = None) -> DataFrame:
    """``before_s, after_s, gain, min_gain, passed`` from the medians of both variants."""
    grouped = summary.groupBy(*(by or [])).agg(
        F.max(F.when(F.col("variant") == "baseline", F.col("median_s"))).alias("before_s"),
        F.max(F.when(F.col("variant") == "candidate", F.col("median_s"))).alias("after_s"))
    bound = min_gain if isinstance(min_gain, Column) else F.lit(float(min_gain))
    return (
        grouped.withColumn("gain", gain(F.col("before_s"), F.col("after_s"))).withColumn("min_gain", bound)
        .withColumn("passed", F.coalesce(F.col("gain") >= F.col("min_gain"), F.lit(False)))
    )


def time_variants(spark: SparkSession, baseline: Callable[[], DataFrame], candidate: Callable[[], DataFrame],
                  runs: int = 3) -> DataFrame:
    """``(variant, run_no, seconds)`` of both, baseline first, in this session; run 0 is the warm-up.

    Every run computes all rows and columns of the frame and drops them.
    """
    rows = []
    for variant, make in (("baseline", baseline), ("candidate", candidate)):
        for run in range(runs + 1):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            rows.append((variant, run, time.perf_counter() - began))
    return spark.createDataFrame(rows, "variant string, run_no int, seconds double")
