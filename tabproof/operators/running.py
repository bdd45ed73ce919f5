"""Running aggregates and positions inside groups of any size.

A window sends a whole group to one task. Here the rows are range-sorted by
group and order, so a large group spreads over many sorted partitions. Each
partition aggregates its own rows, and what the group has in earlier partitions
is carried in; only those summaries, one row per group and partition it
touches, go through a window over the group.

The sorted rows are checkpointed, because a partition that is computed again
after a loss must hold the same rows as before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import c, quoted
from ..session import checkpoint

PART, LINE = "__part", "__line"


def _running(df: DataFrame, groups: list[str], order: list[str], value: Column, fold, combine,
             name: str, total: str | None = None, upto: int = 0) -> DataFrame:
    """The running aggregate as ``name`` and, if asked for, the whole group's as ``total``. ``upto``: 0 up to and including
    the row, -1 up to the one before."""
    placed = (
        checkpoint(df.withColumn("__value", value).orderBy(*[quoted(k) for k in [*groups, *order]]))
        .withColumns({PART: F.spark_partition_id(), LINE: F.monotonically_increasing_id()})
    )
    keys = [quoted(g) for g in groups]
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.groupBy(*keys, PART).agg(fold("__value").alias("__total"))
        .select(*[c(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(PART).alias("__p"),
                fold("__total").over(earlier).alias("__before"), fold("__total").over(whole).alias("__all"))
    )
    inside = Window.partitionBy(*keys, PART).orderBy(LINE).rowsBetween(Window.unboundedPreceding, upto)
    same_run = reduce(lambda a, b: a & b,
                      [c(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)],
                      F.col(PART) == F.col("__p"))
    return (
        placed.withColumn("__here", fold("__value").over(inside)).join(carried, same_run)
        .select(*[c(n) for n in df.columns], combine(F.col("__before"), F.col("__here")).alias(name),
                *([F.col("__all").alias(total)] if total else []))
    )


def running_sum(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str,
                total: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the group's rows up to and including this one, and over all as ``total``."""
    return _running(df, groups, order, value, F.sum,
                    lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)), name, total)


def running_max(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the greatest ``value`` over the group's rows up to and including this one."""
    return _running(df, groups, order, value, F.max, F.greatest, name)


def greatest_before(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the greatest ``value`` over the group's earlier rows; null on its first row."""
    return _running(df, groups, order, value, F.max, F.greatest, name, upto=-1)


def ordered_position(df: DataFrame, groups: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds the row's position in its group, from 0. ``order`` must be unique inside a group."""
    return running_sum(df, groups, order, F.lit(1).cast("bigint"), name).withColumn(name, c(name) - 1)


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups``, ``value`` and the number ``n`` of rows with it; nulls are left out."""
    return df.where(c(value).isNotNull()).groupBy(*[quoted(x) for x in [*groups, value]]).agg(
        F.count(F.lit(1)).alias("n"))


def exact_median(counts: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``groups`` with ``n, median, least, greatest`` of ``value``; an even group's median is a mean of two.

    Takes the result of :func:`value_counts`. Equal values are one row of it, and
    the counts are added up along the values, so no group has to fit into one task.
    """
    along = running_sum(counts, groups, [value], F.col("n"), "__upto", "__size")
    lower, upper = F.floor((F.col("__size") + 1) / 2), F.floor((F.col("__size") + 2) / 2)
    middle = [F.max(F.when((F.col("__upto") - F.col("n") < m) & (m <= F.col("__upto")), c(value)))
              for m in (lower, upper)]
    return along.groupBy(*[quoted(g) for g in groups]).agg(
        F.max("__size").alias("n"), ((middle[0] + middle[1]) / 2).alias("median"),
        F.min(c(value)).alias("least"), F.max(c(value)).alias("greatest"))
