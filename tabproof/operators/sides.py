"""Two tables as one relation with a side flag.

Most checks group this relation once, so each side is read once and equal
values of both sides meet in one shuffle; grouping also treats nulls, NaN and
negative zero as values, where a join would lose them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.names import quoted

SIDE = "__side"
BASELINE, CANDIDATE = 0, 1


class SchemaMismatch(ValueError):
    """The two tables cannot be compared column by column."""


def as_frame(spark: SparkSession, table: str | DataFrame) -> DataFrame:
    """A table name or a DataFrame, as a DataFrame."""
    return spark.table(table) if isinstance(table, str) else table


def schema_problems(baseline: DataFrame, candidate: DataFrame, strict_types: bool = True) -> list[str]:
    """Why the columns of the two tables do not line up; empty when they do."""
    left = {f.name: f.dataType for f in baseline.schema.fields}
    right = {f.name: f.dataType for f in candidate.schema.fields}
    problems = [f"only in baseline: {n}" for n in sorted(left.keys() - right.keys())]
    problems += [f"only in candidate: {n}" for n in sorted(right.keys() - left.keys())]
    if strict_types:
        problems += [
            f"type of {n}: {left[n].simpleString()} became {right[n].simpleString()}"
            for n in sorted(left.keys() & right.keys()) if not same_type(left[n], right[n])
        ]
    return problems


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equal types, nullability aside."""
    return a.simpleString() == b.simpleString()


def shared_fields(baseline: DataFrame, candidate: DataFrame) -> list[T.StructField]:
    """Columns both tables have, by name."""
    right = set(candidate.columns)
    return sorted((f for f in baseline.schema.fields if f.name in right), key=lambda f: f.name)


def both_sides(baseline: DataFrame, candidate: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both tables, cut to ``columns``, with :data:`SIDE` telling them apart."""
    def side(df: DataFrame, flag: int) -> DataFrame:
        return df.selectExpr(f"{flag} AS {SIDE}", *[quoted(n) for n in columns])

    return side(baseline, BASELINE).unionByName(side(candidate, CANDIDATE))


def of_side(flag: int, value: str) -> str:
    """SQL text: the value on one side, null on the other."""
    return f"if({SIDE} = {flag}, {value}, NULL)"


def rows_of(flag: int) -> str:
    """SQL text: number of rows of one side."""
    return f"sum(if({SIDE} = {flag}, 1L, 0L))"
