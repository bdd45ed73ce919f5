"""Optimisation recipes: rewrites of a step that the equivalence ladder can prove equal.

Each recipe is the candidate of a pair; the baseline is the plain form of the
same computation.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, log2
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import hashable
from ..functions.names import c, quoted
from ..operators.multiset import multiset_diff
from ..operators.salting import BUCKETS, HOT_SHARE, hot_keys, hot_salts, row_salt, spread_join
from ..sources.storage import refuse_rows, replace_partitions, total_bytes

# Tier each recipe is checked under.
TIERS = {
    "broadcast": "zero_risk", "zorder": "zero_risk", "compact": "zero_risk",
    "salting": "semantics_preserving", "deudf": "semantics_preserving",
    "incremental": "refresh_change", "reload": "zero_risk", "merge": "zero_risk",
}

BROADCAST_BYTES = 64 << 20
FILE_BYTES = 128 << 20
# Cells of the curve for each file that is written along it.
CELLS = 16
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


# Broadcast -------------------------------------------------------------------------------------

def measured_bytes(df: DataFrame) -> int:
    """Size of a frame's values, counted over its rows: 8 bytes a fixed value, texts by length."""
    def size(f: T.StructField) -> str:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return f"coalesce(octet_length({quoted(f.name)}), 0) + 8"
        if isinstance(f.dataType, FIXED_WIDTH):
            return "16" if isinstance(f.dataType, T.DecimalType) else "8"
        return f"octet_length(to_json(named_struct('x', {quoted(f.name)}))) + 8"

    per_row = " + ".join(["8", *[size(f) for f in df.schema.fields]])
    return int(df.agg(F.expr(f"coalesce(sum(bigint({per_row})), 0L) AS n")).first()["n"])


def broadcast_join(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner",
                   max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Joins without moving ``fact`` when ``dim`` is measured to be small; an ordinary join beyond."""
    side = F.broadcast(dim) if measured_bytes(dim) <= max_bytes else dim
    return fact.join(side, on, how)


# Salting ---------------------------------------------------------------------------------------

def salted_join(fact: DataFrame, dim: DataFrame, key: str, buckets: int | None = None,
                share: float = HOT_SHARE) -> DataFrame:
    """Inner join on ``key`` in which the rows of keys with at least ``share`` of all rows are spread: over ``buckets``, or by
    their number of rows. One pass over ``fact`` finds them."""
    if buckets is None:
        return spread_join(fact, dim, key, hot_salts(fact, key, share), "inner")
    return spread_join(fact, dim, key, hot_keys(fact, key, share), "inner", buckets)


# How each kind of aggregate is taken over rows and over partial results.
MERGE = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


def salted_aggregate(df: DataFrame, keys: list[str], aggregates: dict[str, tuple[str, str]],
                     buckets: int = BUCKETS) -> DataFrame:
    """Group aggregate in two shuffles, the first of which spreads every key over ``buckets``.

    ``aggregates`` maps output names to ``(kind, column)``; kinds are those of
    :data:`MERGE`.
    """
    names = [quoted(k) for k in keys]
    partial = df.withColumn("__salt", row_salt(df, buckets)).groupBy(*names, "__salt").agg(
        *[F.expr(f"{kind}({quoted(col)}) AS {quoted(out)}") for out, (kind, col) in aggregates.items()])
    return partial.groupBy(*names).agg(
        *[F.expr(f"{MERGE[kind]}({quoted(out)}) AS {quoted(out)}") for out, (kind, _) in aggregates.items()])


# Layout ----------------------------------------------------------------------------------------

def _as_number(name: str, dtype: T.DataType) -> str:
    if isinstance(dtype, T.TimestampNTZType):
        return f"double(unix_micros(cast({quoted(name)} AS timestamp)))"
    if isinstance(dtype, T.TimestampType):
        return f"double(unix_micros({quoted(name)}))"
    if isinstance(dtype, T.DateType):
        return f"double(unix_date({quoted(name)}))"
    if isinstance(dtype, T.NumericType):
        return f"double({quoted(name)})"
    raise TypeError(f"cannot order {name} of type {dtype.simpleString()} along the curve")


def zorder_bits(files: int, columns: int) -> int:
    """Bits a column, so that the curve has at least CELLS cells for each file."""
    return max(1, min(62 // columns, ceil(log2(max(1, files) * CELLS) / columns)))


def with_zorder(df: DataFrame, columns: list[str], bits: int = 5, name: str = "__z") -> DataFrame:
    """Adds the position along a Z-shaped curve through range buckets of the columns.

    Bucket bounds are quantiles of the data, so each bucket holds about as many
    rows; bits of the bucket numbers are interleaved, the first column's first.
    """
    if bits * len(columns) > 62:
        raise ValueError("bits times columns must not exceed 62")
    types = {f.name: f.dataType for f in df.schema.fields}
    numbers = {n: _as_number(n, types[n]) for n in columns}
    steps = 1 << bits
    shares = ", ".join(f"{i / steps}D" for i in range(1, steps))
    bounds = df.agg(*[F.expr(f"approx_percentile({numbers[n]}, array({shares}), {max(1000, 8 * steps)}) AS q{i}")
                      for i, n in enumerate(columns)]).first()
    curve = F.lit(0).cast("bigint")
    for i, n in enumerate(columns):
        edges = [float(e) for e in sorted(set(bounds[f"q{i}"] or []))]
        bucket = _bucket(edges, F.expr(numbers[n]))
        for b in range(bits):
            bit = F.shiftright(bucket, b).bitwiseAND(F.lit(1)).cast("bigint")
            curve = curve.bitwiseOR(F.shiftleft(bit, b * len(columns) + len(columns) - 1 - i))
    return df.withColumn(name, curve)


def _bucket(edges: list[float], number: Column) -> Column:
    """Number of edges at or below the value; 0 for null. Halves the sorted edges a fixed number of times."""
    if not edges:
        return F.lit(0)
    listed = F.array(*[F.lit(e) for e in edges])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(edges).bit_length()))])
    # A step is taken if the edge that closes it is passed; beyond the last edge there is none to pass.
    low = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
        F.coalesce(number >= F.get(listed, at + step - 1), F.lit(False)), step).otherwise(0))
    return F.when(number.isNotNull(), low).otherwise(F.lit(0))


def write_zordered(df: DataFrame, columns: list[str], path: str, files: int, bits: int | None = None) -> None:
    """Writes the rows along the curve, so that each file spans narrow ranges of all ``columns``.

    The curve is as fine as the number of files asks for. Ties on it are ordered by the columns and by a hash of the
    row, which lets one crowded stretch of the curve be split over several files.
    """
    curve = with_zorder(df, columns, bits or zorder_bits(files, len(columns))).withColumn("__tie", F.xxhash64(*hashable(df)))
    order = ["__z", *[quoted(n) for n in columns], "__tie"]
    (curve.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("__z", "__tie")
     .write.mode("overwrite").parquet(path))


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = FILE_BYTES) -> int:
    """Rewrites a table into files of about ``file_bytes``; returns their number.

    A scan already packs small files together, so its partitions are merged
    where they are instead of being shuffled.
    """
    files = max(1, ceil(total_bytes(spark, source) / file_bytes))
    spark.read.parquet(source).coalesce(files).write.mode("overwrite").parquet(target)
    return files


# Incremental refresh, reload, merge --------------------------------------------------------------

def aggregate(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """Stored form of an aggregate: ``rows`` and, per measure, what can be merged later.

    ``measures`` maps output prefixes to SQL expressions; decimals give sums
    that do not depend on the order of addition.
    """
    return df.groupBy(*[quoted(k) for k in keys]).agg(
        F.expr("count(1) AS `rows`"),
        *[F.expr(f"{kind}({expr}) AS {quoted(f'{out}_{kind}')}")
          for out, expr in measures.items() for kind in ("sum", "min", "max")])


def merge_aggregates(stored: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """The stored aggregate brought up to date with the aggregate of the added rows."""
    measures = [n for n in stored.columns if n not in keys]
    types = {f.name: f.dataType.simpleString() for f in stored.schema.fields}

    def merged(name: str) -> Column:
        kind = "sum" if name == "rows" or name.endswith("_sum") else name[-3:]
        return F.expr(f"cast({kind}({quoted(name)}) AS {types[name]}) AS {quoted(name)}")

    return stored.unionByName(delta).groupBy(*[quoted(k) for k in keys]).agg(*[merged(n) for n in measures])


def reload_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces just the partitions that ``rows`` touches, never the whole table."""
    replace_partitions(rows, path, partition)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put in place of those with the same key, new ones added.

    Two source rows for one key are an error. A null key equals none.
    """
    known = source
    for k in keys:
        known = known.where(c(k).isNotNull())
    refuse_rows(known.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("__n"))
                .where("__n > 1").drop("__n"), "several source rows for one key")
    unmatched = reduce(or_, [c(k).isNull() for k in keys])
    kept = target.where(~unmatched).join(known.select(*[quoted(k) for k in keys]), keys, "left_anti").select(
        *[quoted(n) for n in target.columns])
    # Rows without a key match nothing; they stay where they are instead of meeting in one task.
    return kept.unionByName(target.where(unmatched)).unionByName(source)


# Repeatability -----------------------------------------------------------------------------------

def repeatability_check(step: Callable[[DataFrame], DataFrame], rows: DataFrame, partitions: tuple[int, int] = (3, 7),
                        epsilon: float = 0.0) -> DataFrame:
    """Runs a step on the same rows in two layouts and counts the rows that differ."""
    first, second = (step(rows.repartition(n)) for n in partitions)
    return multiset_diff(first, second, epsilon)
