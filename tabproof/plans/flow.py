"""Equivalence of whole flows: every final table of two runs, or of a run and a recorded past.

A flow is a function from named input tables to named output tables. Its
outputs are written once before they are compared, so that no check runs the
flow again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import concurrently
from ..sources.audit import AuditLog
from ..sources.snapshots import SnapshotStore, materialise, prepare_pair
from .ladder import VERDICT_SCHEMA, Rung, Verdict, compare

Flow = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]

# Fixed value: the step under which flow verdicts are recorded.
FLOW_STEP = "flow_equivalence"
WHOLE_FLOW = "<flow>"


@dataclass
class FlowVerdict:
    """One verdict per target; the flow passes when every target does."""

    verdicts: list[Verdict] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return bool(self.verdicts) and all(v.passed for v in self.verdicts)

    @property
    def failed_targets(self) -> list[str]:
        return [v.target for v in self.verdicts if not v.passed]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """All rungs of all targets."""
        return spark.createDataFrame([row for v in self.verdicts for row in v.rows()], VERDICT_SCHEMA)


def compare_flows(spark: SparkSession, baseline: dict[str, DataFrame | str], candidate: dict[str, DataFrame | str],
                  *, targets: list[str] | None = None, partition_cols: dict[str, list[str]] | None = None,
                  tier: str = "semantics_preserving", parallel: int = 4, details: DataFrame | None = None,
                  **options) -> FlowVerdict:
    """Compares every target and keeps every failure: a divergence does not end the comparison.

    Each target is held against its own rows of ``details``. An error on one target, a missing table for instance, is that target's
    failure. ``options`` go to :func:`tabproof.plans.ladder.compare`.
    """
    def one(target: str) -> Verdict:
        try:
            return compare(spark, baseline[target], candidate[target], tier=tier, target=target,
                           details=None if details is None else details.where(F.col("table_name") == target),
                           partition_cols=(partition_cols or {}).get(target), **options)
        except Exception as error:
            text = f"missing table: {error}" if isinstance(error, KeyError) else str(error)
            return Verdict(target, tier, 0.0, [Rung("run", False, None, None, text)])

    wanted = targets or sorted(set(baseline) | set(candidate))
    return FlowVerdict(concurrently(spark, [partial(one, t) for t in wanted], parallel))


def flow_rollup(verdicts: DataFrame) -> DataFrame:
    """``(flow, targets, failed, passed)`` from rows of ``(flow, target, passed)``."""
    per_target = verdicts.groupBy("flow", "target").agg(F.bool_and("passed").alias("passed"))
    return per_target.groupBy("flow").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(~F.col("passed")).alias("failed"),
        F.bool_and("passed").alias("passed"))


def failed_targets(verdicts: DataFrame) -> DataFrame:
    """Every ``(flow, target)`` with a failed check."""
    return verdicts.where(~F.col("passed")).select("flow", "target").distinct()


def _recorded(audit: AuditLog | None, job: str, opening: str, subject: str,
              run: Callable[[], FlowVerdict]) -> FlowVerdict:
    """Runs the comparison and records its ``started`` and its final event in one write."""
    def event(status: str, **more) -> dict:
        return {"event_ts": datetime.now(timezone.utc), "job": job, "notebook": WHOLE_FLOW, "step": FLOW_STEP, "status": status, **more}

    events = [event("started", insight=opening)]
    try:
        verdict = run()
        events.append(event(
            "succeeded" if verdict.passed else "failed",
            equivalence={v.target: "pass" if v.passed else "FAIL" for v in verdict.verdicts},
            insight=f"{subject}: all {len(verdict.verdicts)} final tables match" if verdict.passed
            else f"{subject}: no match on {', '.join(verdict.failed_targets)}"))
    except Exception as error:
        events.append(event("failed", insight=f"{subject} stopped with an error: {error}"))
        raise
    finally:
        if audit is not None:
            audit.record(*events)
    return verdict


def validate_flow(spark: SparkSession, job: str, baseline: Flow, candidate: Flow, inputs: dict[str, DataFrame], *,
                  targets: list[str] | None = None, audit: AuditLog | None = None,
                  sample_percent: float | None = None, sample_keys: dict[str, list[str]] | None = None,
                  seed: int = 42, stored: bool = False, **options) -> FlowVerdict:
    """Runs both flows on identical inputs and compares their final tables.

    The inputs are written once before either flow runs, so that a source that
    changes meanwhile changes neither; ``stored=True`` says that they cannot
    change, a store's versions for instance, and spares the copy. Returns the verdict, pass or fail; raises only when a flow itself fails.
    """
    left, right, how = prepare_pair(spark, inputs, sample_percent, sample_keys, seed, stored)
    described = ", ".join(f"{t} {h}" for t, h in how.items())

    def run() -> FlowVerdict:
        before = materialise(spark, _outputs(baseline(left), targets), label="baseline")
        after = materialise(spark, _outputs(candidate(right), targets), label="candidate")
        return compare_flows(spark, before, after, targets=targets, **options)

    return _recorded(audit, job, f"both flows from the same inputs: {described}; seed {seed}",
                     "Flow comparison", run)


def validate_replay(spark: SparkSession, job: str, candidate: Flow, store: SnapshotStore, *, tables: list[str],
                    targets: list[str], anchor_before: datetime, anchor_after: datetime,
                    table_pins: dict | None = None, target_pins: dict | None = None,
                    audit: AuditLog | None = None, **options) -> FlowVerdict:
    """Runs the flow on the inputs of a past run and compares with what that run left behind.

    Inputs are read as of ``anchor_before``, the recorded results as of
    ``anchor_after``; single tables may be pinned otherwise, by version number
    or by moment.
    """
    def run() -> FlowVerdict:
        inputs = store.inputs_at(tables, anchor_before, table_pins)
        result = materialise(spark, _outputs(candidate(inputs), targets), label="replay")
        truth = store.inputs_at(targets, anchor_after, target_pins)
        return compare_flows(spark, truth, result, targets=targets, **options)

    return _recorded(audit, job, f"replay of inputs at {anchor_before} against results at {anchor_after}",
                     "Replay", run)


def _outputs(frames: dict[str, DataFrame], targets: list[str] | None) -> dict[str, DataFrame]:
    return frames if targets is None else {t: frames[t] for t in targets if t in frames}
