"""Row-level difference by business key, with true float tolerance.

Both tables are grouped once on the key. A key that occurs once per side brings
its two rows together; a key that occurs more often is reported apart with its
counts, since its rows have no defined partner. Tasks combine rows of a key
before the shuffle, so a key with a third of all rows does not gather anywhere,
and no key multiplies as it would in a join.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log10
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..functions.floats import close, is_tolerant
from ..functions.hashing import has_map, ordered_maps, row_hash
from ..functions.names import c, literal, quoted
from .sides import BASELINE, CANDIDATE, SIDE, SchemaMismatch, both_sides, of_side, rows_of, schema_problems, shared_fields

# The classes of a key.
CLASSES = ("added", "removed", "changed", "same", "duplicated")


def key_classes(baseline: DataFrame, candidate: DataFrame, keys: list[str], epsilon: float = 1e-6,
                strict_types: bool = True) -> DataFrame:
    """Every key with its ``change`` class, ``changed_columns`` and row count per side."""
    problems = schema_problems(baseline, candidate, strict_types)
    missing = [k for k in keys if k not in baseline.columns]
    if missing:
        problems.append(f"key columns not found: {', '.join(missing)}")
    if problems:
        raise SchemaMismatch("; ".join(problems))
    names = [f.name for f in shared_fields(baseline, candidate)]
    sides = both_sides(baseline, candidate, names)
    rest = [f for f in sides.schema.fields if f.name in names and f.name not in keys]
    for f in rest:
        if has_map(f.dataType):
            sides = sides.withColumn(f.name, ordered_maps(c(f.name), f.dataType))

    names_of_keys = [quoted(k) for k in keys]
    counts = [F.expr(f"{rows_of(flag)} AS {name}") for name, flag in (("baseline_rows", BASELINE), ("candidate_rows", CANDIDATE))]
    # First counts and 128 bits of hashes, which need no sorting; values that round alike are within the tolerance.
    digits = max(0, ceil(-log10(epsilon) - 1e-9)) if epsilon > 0 else None
    values = [f"xxhash64(round({quoted(f.name)}, {digits}))" if digits is not None and is_tolerant(f) else f"xxhash64({quoted(f.name)})"
              for f in rest]
    hashed = sides.selectExpr(SIDE, *names_of_keys, f"{row_hash(values + ['1'])} AS __h1", f"{row_hash(values + ['2'])} AS __h2")
    agree = " AND ".join(f"max({of_side(BASELINE, h)}) = max({of_side(CANDIDATE, h)})" for h in ("__h1", "__h2"))
    grouped = hashed.groupBy(*names_of_keys).agg(*counts, F.expr(f"{agree} AS __same"))
    open_ = "baseline_rows = 1 AND candidate_rows = 1 AND NOT __same"
    none = "cast(array() AS array<string>)"
    settled = grouped.where(f"NOT ({open_})").selectExpr(
        *names_of_keys,
        """CASE WHEN baseline_rows > 1 OR candidate_rows > 1 THEN 'duplicated'
                WHEN baseline_rows = 0 THEN 'added' WHEN candidate_rows = 0 THEN 'removed' ELSE 'same' END AS change""",
        f"{none} AS changed_columns", "baseline_rows", "candidate_rows")

    # Whole rows are brought together for the other keys only, one row a side.
    suspects = grouped.where(open_).select(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same_key = reduce(and_, [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    packed = ", ".join(["'here', 1", *[f"'v{i}', {quoted(f.name)}" for i, f in enumerate(rest)]])
    paired = sides.join(suspects, same_key, "left_semi").groupBy(*names_of_keys).agg(
        *[F.expr(f"any_value({of_side(flag, f'named_struct({packed})')}, true) AS {name}")
          for name, flag in (("__b", BASELINE), ("__k", CANDIDATE))])

    def differs(i: int, f) -> str:
        b, k = f"__b.v{i}", f"__k.v{i}"
        return f"NOT {close(b, k, epsilon)}" if is_tolerant(f) else f"NOT ({b} <=> {k})"

    flags = ", ".join(f"if({differs(i, f)}, {literal(f.name)}, NULL)" for i, f in enumerate(rest))
    changed = f"array_compact(array({flags}))" if rest else none
    compared = paired.selectExpr(*names_of_keys, f"{changed} AS changed_columns").selectExpr(
        *names_of_keys, "if(size(changed_columns) > 0, 'changed', 'same') AS change", "changed_columns",
        "1L AS baseline_rows", "1L AS candidate_rows")
    return settled.unionByName(compared)


def key_diff(baseline: DataFrame, candidate: DataFrame, keys: list[str], epsilon: float = 1e-6,
             strict_types: bool = True) -> DataFrame:
    """Keys that are added, removed, changed or duplicated."""
    return key_classes(baseline, candidate, keys, epsilon, strict_types).where("change <> 'same'")


def key_diff_summary(baseline: DataFrame, candidate: DataFrame, keys: list[str], epsilon: float = 1e-6,
                     strict_types: bool = True) -> DataFrame:
    """Number of keys in each class, zeros included: one row, one column per class."""
    classes = key_classes(baseline, candidate, keys, epsilon, strict_types)
    return classes.agg(*[F.expr(f"count_if(change = '{name}') AS {name}") for name in CLASSES])


def changes_by_column(baseline: DataFrame, candidate: DataFrame, keys: list[str],
                      epsilon: float = 1e-6) -> DataFrame:
    """How many keys changed in each column."""
    return (
        key_classes(baseline, candidate, keys, epsilon).where("change = 'changed'")
        .selectExpr("explode(changed_columns) AS `column`")
        .groupBy("column").agg(F.count(F.lit(1)).alias("changed_keys"))
    )
