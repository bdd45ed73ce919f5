"""The equivalence ladder: cheapest check first, stop at the first divergence.

Rungs: contract (optional), schema, row counts per partition (optional, reads
only the partition columns), counts and checksums of whole rows (one pass over
both tables, with the per-column fingerprint only where they differ), and the
exact multiset difference, which alone is proof. A failed rung makes the later,
dearer ones unnecessary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.floats import tier_epsilon
from ..operators.counts import partition_count_diff, row_counts
from ..operators.fingerprint import compare_fingerprints, row_checksums
from ..operators.multiset import multiset_diff
from ..operators.schema import contract_diff
from ..operators.sides import as_frame, schema_problems

VERDICT_SCHEMA = ("target string, check string, passed boolean, baseline bigint, candidate bigint, "
                  "reason string")


class NotEquivalent(ValueError):
    """The candidate differs from the baseline; ``verdict`` tells at which rung and how."""

    def __init__(self, verdict: "Verdict"):
        self.verdict = verdict
        super().__init__(f"{verdict.target}: not equivalent at {verdict.failed_at} "
                         f"[{verdict.tier}]: {verdict.reason}")


@dataclass
class Rung:
    check: str
    passed: bool
    baseline: int | None = None
    candidate: int | None = None
    reason: str | None = None


@dataclass
class Verdict:
    """Outcome of one comparison: one entry per rung that ran."""

    target: str
    tier: str
    epsilon: float
    rungs: list[Rung] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return bool(self.rungs) and all(r.passed for r in self.rungs)

    @property
    def failed_at(self) -> str | None:
        return next((r.check for r in self.rungs if not r.passed), None)

    @property
    def reason(self) -> str | None:
        return next((r.reason for r in self.rungs if not r.passed), None)

    def rows(self) -> list[tuple]:
        return [(self.target, r.check, r.passed, r.baseline, r.candidate, r.reason) for r in self.rungs]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), VERDICT_SCHEMA)


def compare(spark: SparkSession, baseline: str | DataFrame, candidate: str | DataFrame, *,
            tier: str = "semantics_preserving", epsilon: float | None = None,
            partition_cols: list[str] | None = None, baseline_is_full_recompute: bool = False,
            strict_types: bool = True, details: DataFrame | None = None,
            distinct: str | None = None, prefilter: bool = True, target: str = "table") -> Verdict:
    """Climb the ladder and return the verdict; raises only on unusable arguments.

    Tier ``refresh_change`` compares an incremental result, which proves
    something only against a full recompute, so it is refused without
    ``baseline_is_full_recompute``. ``details`` adds the contract rung.
    ``distinct`` adds distinct counts, ``approx`` or ``exact``, to the
    fingerprint that explains a difference. Where equality is the expected
    outcome, ``prefilter=False`` leaves checksums and fingerprint out, so that
    both tables are read once for the proof; only rows are counted before.
    """
    tolerance = tier_epsilon(tier, epsilon)
    if tier == "refresh_change" and not baseline_is_full_recompute:
        raise ValueError("tier 'refresh_change' needs baseline_is_full_recompute=True: compare the "
                         "incremental result with a full recompute of the same inputs")
    a, b = as_frame(spark, baseline), as_frame(spark, candidate)
    verdict = Verdict(target, tier, tolerance)

    for climb in (
        lambda: _contract(details),
        lambda: _schema(a, b, strict_types),
        lambda: _partitions(a, b, partition_cols),
        lambda: _profile(a, b, tolerance, distinct) if prefilter else _rows(a, b),
        lambda: _multiset(a, b, tolerance, strict_types),
    ):
        verdict.rungs += climb()
        if not all(r.passed for r in verdict.rungs):
            break
    return verdict


def require_equivalent(spark: SparkSession, baseline: str | DataFrame, candidate: str | DataFrame,
                       **options) -> Verdict:
    """Like :func:`compare`, but a divergence raises :class:`NotEquivalent`."""
    verdict = compare(spark, baseline, candidate, **options)
    if not verdict.passed:
        raise NotEquivalent(verdict)
    return verdict


def _contract(details: DataFrame | None) -> list[Rung]:
    if details is None:
        return []
    by_reason = {r["reason"]: r["n"] for r in contract_diff(details).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    broken = "; ".join(f"{n} table(s): {reason}" for reason, n in sorted((x for x in by_reason.items() if x[0]), key=str))
    reason = broken or (None if by_reason else "no row of the table's contract")
    return [Rung("contract", reason is None, None, None, reason)]


def _schema(a: DataFrame, b: DataFrame, strict_types: bool) -> list[Rung]:
    problems = schema_problems(a, b, strict_types)
    return [Rung("schema", not problems, len(a.columns), len(b.columns), "; ".join(problems) or None)]


def _row_count(left: int, right: int) -> Rung:
    return Rung("row_count", left == right, left, right,
                None if left == right else f"{left} rows became {right}")


def _rows(a: DataFrame, b: DataFrame) -> list[Rung]:
    found = row_counts(a, b).first()
    return [_row_count(found["baseline_rows"], found["candidate_rows"])]


def _profile(a: DataFrame, b: DataFrame, epsilon: float, distinct: str | None) -> list[Rung]:
    """Rows and checksums of whole rows first; columns are looked at one by one only when these differ."""
    found = row_checksums(a, b, epsilon).first()
    counts = _row_count(found["baseline_rows"], found["candidate_rows"])
    if not counts.passed:
        return [counts]
    if found["same"]:
        return [counts, Rung("fingerprint", True, 0, 0)]
    # A few rows per column, whatever the size of the tables.
    off = compare_fingerprints(a, b, epsilon, distinct).where("NOT same").collect()
    text = "; ".join(f"{m['column']}.{m['metric']}: {m['baseline']} became {m['candidate']}" for m in off)
    return [counts, Rung("fingerprint", False, len(off), len(off), text or "checksums of whole rows differ")]


def _partitions(a: DataFrame, b: DataFrame, partition_cols: list[str] | None) -> list[Rung]:
    if not partition_cols:
        return []
    off = partition_count_diff(a, b, partition_cols).count()
    return [Rung("partition_count", off == 0, off, off,
                 None if off == 0 else f"{off} partition value(s) differ in row count")]


def _multiset(a: DataFrame, b: DataFrame, epsilon: float, strict_types: bool) -> list[Rung]:
    found = multiset_diff(a, b, epsilon, strict_types).first()
    return [Rung("multiset", found["passed"], found["baseline_only"], found["candidate_only"],
                 None if found["passed"] else f"{found['baseline_only']} row(s) only in baseline, "
                                              f"{found['candidate_only']} only in candidate")]
