"""Row counts, in total and per partition value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.names import quoted
from .sides import BASELINE, CANDIDATE, both_sides, rows_of


def row_counts(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: ``baseline_rows, candidate_rows, passed``. Reads no column."""
    return (
        both_sides(baseline, candidate, [])
        .agg(F.expr(f"coalesce({rows_of(BASELINE)}, 0L) AS baseline_rows"),
             F.expr(f"coalesce({rows_of(CANDIDATE)}, 0L) AS candidate_rows"))
        .selectExpr("*", "baseline_rows = candidate_rows AS passed")
    )


def partition_counts(baseline: DataFrame, candidate: DataFrame, partition_cols: list[str]) -> DataFrame:
    """Rows of each side for every value of the partition columns, null included.

    Tasks count locally before the shuffle, so one value that holds most rows
    crosses it as one row per task.
    """
    return (
        both_sides(baseline, candidate, partition_cols)
        .groupBy(*[quoted(p) for p in partition_cols])
        .agg(F.expr(f"{rows_of(BASELINE)} AS baseline_rows"), F.expr(f"{rows_of(CANDIDATE)} AS candidate_rows"))
    )


def partition_count_diff(baseline: DataFrame, candidate: DataFrame, partition_cols: list[str]) -> DataFrame:
    """Partition values whose row counts differ."""
    return partition_counts(baseline, candidate, partition_cols).where("baseline_rows <> candidate_rows")
