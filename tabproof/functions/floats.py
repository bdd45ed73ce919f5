"""Float tolerance: risk tiers, rounding and closeness.

Two notions are kept apart. Rounding puts values in buckets, so that whole rows
can be grouped; closeness compares two values directly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, types as T

from .names import quoted

# Tolerance of each risk tier and the relative tolerance of aggregate sums.
TIER_EPSILON = {"zero_risk": 0.0, "semantics_preserving": 1e-6, "refresh_change": 1e-6}
RELATIVE_TOLERANCE = 1e-9
EXACT_DIGITS = 12

FLOATING = (T.FloatType, T.DoubleType)
TOLERANT = (T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def tier_epsilon(tier: str, epsilon: float | None = None) -> float:
    """Tolerance of a tier. A stated epsilon may tighten the tier, never loosen it."""
    if tier not in TIER_EPSILON:
        raise ValueError(f"unknown risk tier {tier!r}; known: {sorted(TIER_EPSILON)}")
    allowed = TIER_EPSILON[tier]
    if epsilon is None:
        return allowed
    if not 0 <= epsilon < math.inf:
        raise ValueError(f"epsilon must be a finite number of at least 0, got {epsilon}")
    if epsilon > allowed:
        raise ValueError(f"epsilon {epsilon} is looser than tier {tier!r} allows ({allowed})")
    return epsilon


def digits_for(epsilon: float) -> int:
    """Decimal places that stand for a tolerance."""
    if not epsilon or epsilon <= 0:
        return EXACT_DIGITS
    return max(0, round(-math.log10(epsilon)))


def is_tolerant(field: T.StructField) -> bool:
    return isinstance(field.dataType, TOLERANT)


def rounded(name: str, dtype: T.DataType, epsilon: float) -> str:
    """SQL text of a column as it is compared: rounded when tolerated and of a float or decimal type.

    A decimal that has no more places than the rounding keeps is left alone. So
    is a double that already is the closest one to a number of that many places,
    which arithmetic on doubles tells at a fraction of the cost of rounding.
    """
    column = quoted(name)
    if epsilon == 0 or not isinstance(dtype, TOLERANT):
        return column
    places = digits_for(epsilon)
    if isinstance(dtype, T.DecimalType) and dtype.scale <= places:
        return column
    if isinstance(dtype, T.DoubleType) and places <= EXACT_DIGITS:
        unit = f"1e{places}D"
        return f"if({column} = rint({column} * {unit}) / {unit}, {column}, round({column}, {places}))"
    return f"round({column}, {places})"


def normalise_floats(df: DataFrame, epsilon: float) -> DataFrame:
    """All columns, floats and decimals rounded to the places of ``epsilon``."""
    return df.selectExpr(*[f"{rounded(f.name, f.dataType, epsilon)} AS {quoted(f.name)}"
                           for f in df.schema.fields])


def close(a: str, b: str, epsilon: float) -> str:
    """SQL text: equal within an absolute tolerance. Null equals null, NaN equals NaN."""
    if epsilon == 0:
        return f"({a} <=> {b})"
    return f"({a} <=> {b} OR coalesce(abs({a} - {b}) <= {epsilon!r}D, false))"


def close_sums(a: str, b: str, scale: str, epsilon: float) -> str:
    """SQL text: equal sums of doubles.

    The slack grows with ``scale``, the sum of magnitudes, because it is the
    magnitudes and not the total that bound what another order of addition can
    change; a total near zero would otherwise reject equal tables.
    """
    slack = f"greatest({RELATIVE_TOLERANCE!r}D * {scale}, {epsilon!r}D)"
    return f"({a} <=> {b} OR coalesce(abs({a} - {b}) <= {slack}, false))"
