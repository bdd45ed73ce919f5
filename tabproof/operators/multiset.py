"""Exact multiset difference in one signed pass.

A baseline row weighs +1, a candidate row -1; rows are grouped on all their
columns and a group whose weights do not cancel is a surplus on one side. Both
``EXCEPT ALL`` answers come out of a single shuffle. Copies of a row are
combined inside each task first, so a row repeated any number of times never
gathers in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.floats import rounded
from ..functions.names import quoted
from .sides import BASELINE, SIDE, SchemaMismatch, both_sides, schema_problems, shared_fields

SURPLUS = "__surplus"


def signed_groups(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6,
                  strict_types: bool = True) -> DataFrame:
    """Distinct normalised rows whose copies differ in number, with the signed surplus."""
    problems = schema_problems(baseline, candidate, strict_types)
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return net_rows(both_sides(baseline, candidate, [f.name for f in shared_fields(baseline, candidate)]), epsilon)


def net_rows(sides: DataFrame, epsilon: float) -> DataFrame:
    """The same of rows that already stand together under a side flag."""
    names = [n for n in sides.columns if n != SIDE]
    rows = sides.selectExpr(
        f"if({SIDE} = {BASELINE}, 1L, -1L) AS {SURPLUS}",
        *[f"{rounded(f.name, f.dataType, epsilon)} AS {quoted(f.name)}"
          for f in sides.schema.fields if f.name != SIDE])
    return (
        rows.groupBy(*[quoted(n) for n in names])
        .agg(F.expr(f"sum({SURPLUS}) AS {SURPLUS}"))
        .where(f"{SURPLUS} <> 0")
    )


def multiset_diff(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6,
                  strict_types: bool = True) -> DataFrame:
    """One row: ``baseline_only, candidate_only, passed``, counted with copies."""
    return (
        signed_groups(baseline, candidate, epsilon, strict_types)
        .agg(F.expr(f"coalesce(sum(greatest({SURPLUS}, 0L)), 0L) AS baseline_only"),
             F.expr(f"coalesce(sum(greatest(-{SURPLUS}, 0L)), 0L) AS candidate_only"))
        .selectExpr("*", "baseline_only = 0 AND candidate_only = 0 AS passed")
    )


def multiset_diff_rows(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6,
                       strict_types: bool = True) -> DataFrame:
    """The surplus rows themselves: their columns, ``surplus_side`` and ``surplus_rows``."""
    return surplus_rows(signed_groups(baseline, candidate, epsilon, strict_types))


def surplus_rows(groups: DataFrame) -> DataFrame:
    """Signed groups as rows of one side with their number."""
    return groups.selectExpr(
        *[quoted(n) for n in groups.columns if n != SURPLUS],
        f"if({SURPLUS} > 0, 'baseline', 'candidate') AS surplus_side",
        f"abs({SURPLUS}) AS surplus_rows")
