"""Joins in which the rows of hot keys are spread over several tasks."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import hashable
from ..functions.names import c, quoted

BUCKETS = 16
HOT_SHARE = 0.01
# A key with fewer rows is never hot: spreading it costs more than it saves.
HOT_ROWS = 10_000


# Counters of the sketch for each key that the share allows: its error is then a small part of the share.
COUNTERS = 32
# Most keys that the sketch gives, and most salts of a key.
MOST_KEYS, MOST_SALTS = 1000, 1024
SKETCHED = (T.StringType, T.IntegralType, T.DoubleType, T.FloatType, T.DateType, T.TimestampType, T.DecimalType)


def hot_key_rows(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> tuple[dict, int]:
    """Keys that hold at least ``share`` of the rows, and at least ``rows``, with their numbers of rows; and that threshold.

    One pass: rows are counted beside a frequent-items sketch, whose counts are too high by a known bound at most.
    Only keys that lie within that bound of the threshold are counted exactly, over their own rows; the others keep the
    sketch's count. Types and shares that the sketch does not take are counted by a group of all keys.
    """
    most = ceil(1 / share)
    value = c(key)
    if most > MOST_KEYS or not isinstance(df.schema[key].dataType, SKETCHED):
        least = max(rows, ceil(df.count() * share))
        counts = df.where(value.isNotNull()).groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return {r["k"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}, least
    counters = 1 << ceil(log2(max(64, most * COUNTERS)))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.expr(
        f"approx_top_k({quoted(key)}, {most}, {counters}) FILTER (WHERE {quoted(key)} IS NOT NULL) AS top")).first()
    least = max(rows, ceil(found["n"] * share))
    slack = ceil(found["n"] * 3.5 / counters)  # the sketch's own bound
    listed = {r["item"]: r["count"] for r in found["top"] or [] if r["count"] >= least}
    hot = {k: n for k, n in listed.items() if n - slack >= least}
    near = [k for k in listed if k not in hot]
    if near:
        counts = df.where(value.isin(*near)).groupBy(value.alias("k")).agg(F.count(F.lit(1)).alias("n"))
        hot |= {r["k"]: r["n"] for r in counts.where(F.col("n") >= least).collect()}
    return hot, least


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> list:
    """Keys that hold at least ``share`` of the rows, and at least ``rows``: never more than ``1 / share`` of them."""
    return list(hot_key_rows(df, key, share, rows)[0])


def hot_salts(df: DataFrame, key: str, share: float = HOT_SHARE, rows: int = HOT_ROWS) -> dict:
    """Salts of each hot key in proportion to its rows: about one for every threshold's worth."""
    hot, least = hot_key_rows(df, key, share, rows)
    return {k: min(MOST_SALTS, max(2, -(-n // least))) for k, n in hot.items()}


def row_salt(df: DataFrame, buckets: int = BUCKETS) -> Column:
    """A bucket from the row and the partition that holds it.

    Copies of one row in different partitions get different buckets, and a task
    that runs again gives the same ones.
    """
    return F.pmod(F.xxhash64(F.spark_partition_id(), *hashable(df)), F.lit(buckets)).cast("int")


def spread_join(fact: DataFrame, dim: DataFrame, key: str, hot: list | dict, how: str = "inner",
                buckets: int = BUCKETS) -> DataFrame:
    """Joins on ``key`` (``inner`` or ``left``), the ``hot`` keys' rows of ``fact`` spread over ``buckets``, or over as many as
    a dictionary of hot keys says.

    Only the hot keys' rows of ``dim`` are repeated. Hot keys are few by
    definition and enter the plan as literals.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"only inner and left joins can be spread, got {how!r}")
    if not hot:
        return fact.join(dim, key, how)
    is_hot = c(key).isin(*hot)
    if isinstance(hot, dict):
        by_size: dict[int, list] = {}
        for k, n in hot.items():
            by_size.setdefault(n, []).append(k)
        sizes = F.coalesce(*[F.when(c(key).isin(*ks), F.lit(n)) for n, ks in by_size.items()])
    else:
        sizes = F.lit(buckets)
    every = F.sequence(F.lit(0), sizes - 1)
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable(fact)), sizes.cast("bigint")).cast("int")
    salted = fact.withColumn("__salt", F.when(is_hot, salt).otherwise(F.lit(0)))
    repeated = dim.withColumn("__salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")
