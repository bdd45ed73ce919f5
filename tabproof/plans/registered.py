"""Gates that take their settings from the registry row instead of from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.floats import TIER_EPSILON
from ..operators.keydiff import key_diff_summary
from ..operators.runtime import MIN_GAIN, earliest_runs, gain, timing_summary
from ..sources.registry import DEFAULTS, ROW
from .ladder import Rung, Verdict, compare


def registry_row(registry: DataFrame, job: str, notebook: str) -> Row:
    """The one row of a notebook; none is an error."""
    rows = registry.where((F.col("job_name") == job) & (F.col("notebook_path") == notebook)).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{'no' if not rows else 'more than one'} registry row for {job}/{notebook}")
    return rows[0]


def compare_registered(spark: SparkSession, row: Row, baseline: str | DataFrame, candidate: str | DataFrame, *,
                       tier: str = "semantics_preserving", **options) -> Verdict:
    """The ladder with the tolerance of the notebook's row, and its business key for what failed.

    The row's epsilon tightens the tier's and never loosens it. After a failed
    count, fingerprint or difference, a row-level comparison on the row's
    ``equivalence_keys`` says how many keys were added, removed, changed or
    duplicated. A notebook marked nondeterministic is compared like any other,
    with the mark in the reason of its failure.
    """
    stored = TIER_EPSILON.get(tier, 0.0) if row.epsilon is None else min(row.epsilon, TIER_EPSILON.get(tier, 0.0))
    verdict = compare(spark, baseline, candidate, tier=tier, epsilon=stored, **options)
    if verdict.passed:
        return verdict
    if row.equivalence_keys and verdict.failed_at in ("partition_count", "row_count", "fingerprint", "multiset"):
        frames = [spark.table(x) if isinstance(x, str) else x for x in (baseline, candidate)]
        found = key_diff_summary(*frames, list(row.equivalence_keys), verdict.epsilon,
                                 options.get("strict_types", True)).first()
        text = ", ".join(f"{found[name]} {name}" for name in ("added", "removed", "changed", "duplicated"))
        verdict.rungs.append(Rung("key_diff", False, None, None, f"keys {text}"))
    if row.nondeterministic:
        verdict.rungs.append(Rung("nondeterministic", False, None, None, "the notebook is marked nondeterministic"))
    return verdict


def perf_gate_registered(timings: DataFrame, registry: DataFrame) -> DataFrame:
    """The gain gate of every notebook, under its own ``min_gain`` and number of runs.

    ``timings`` is ``(job_name, notebook_path, variant, run_no, seconds)``; the
    lowest run of each variant is the warm-up.
    """
    wanted = registry.select(*ROW, F.coalesce("min_gain", F.lit(MIN_GAIN)).alias("min_gain"),
                             F.coalesce("benchmark_runs", F.lit(DEFAULTS["benchmark_runs"])).alias("benchmark_runs"))
    most = registry.agg(F.max("benchmark_runs")).first()[0] or DEFAULTS["benchmark_runs"]
    counted = (
        earliest_runs(timings, [*ROW, "variant"], most + 1).join(wanted, ROW)
        .where((F.col("nth") > 1) & (F.col("nth") <= F.col("benchmark_runs") + 1))
    )
    medians = timing_summary(counted.select(*timings.columns), by=ROW, warmup=False)
    pair = medians.groupBy(*ROW).agg(
        F.max(F.when(F.col("variant") == "baseline", F.col("median_s"))).alias("before_s"),
        F.max(F.when(F.col("variant") == "candidate", F.col("median_s"))).alias("after_s"))
    return (
        pair.join(wanted.drop("benchmark_runs"), ROW)
        .withColumn("gain", gain(F.col("before_s"), F.col("after_s")))
        .withColumn("passed", F.coalesce(F.col("gain") >= F.col("min_gain"), F.lit(False)))
    )
