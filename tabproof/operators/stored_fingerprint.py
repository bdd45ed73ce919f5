"""A table's fingerprint kept up to date: one mergeable state a partition, of which only changed ones are computed again.

A state holds what can be put together later without the rows: counts, checksums and exact sums to be added, extremes,
and a sketch of the distinct values of each column to be united. Which partitions changed is told by their files' names,
lengths and times, without opening any.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.floats import FLOATING, INTEGRAL, rounded
from ..functions.hashing import SUM_MASK, has_map, hash_totals, ordered_maps, row_hash
from ..functions.names import c, literal, quoted
from ..sources.commits import EMPTY, CommittedTable
from .fingerprint import WHOLE_ROW, exact_sum

#: Partitions up to this number enter the scan's filter as literals; more are joined.
LISTED = 10_000
#: Folders of the stored states: a refresh rewrites those of the changed partitions.
BUCKETS = 32
#: Registers of a sketch, as a power of two; its relative standard deviation is 0.8 / sqrt(registers).
SKETCH_BITS = 12
# Doubles are added up as decimals of so many places where all of them fit, so that sums don't depend on order.
_EXACT = "decimal(38,6)"


def _fields(df: DataFrame, parts: list[str]) -> list[T.StructField]:
    return sorted(df.schema.fields, key=lambda f: f.name)


def partition_states(df: DataFrame, parts: list[str], epsilon: float = 1e-6) -> DataFrame:
    """One row a partition: ``parts``, ``rows``, the checksum of whole rows and each column's state.

    Column i of the sorted names has nulls (``n``), checksum (``h``), sketch (``d``), and, if it is a number, exact sum
    (``s``), plain sum (``z``), the number of values that only the latter holds (``k``), least and greatest (``lo``, ``hi``).
    """
    fields = _fields(df, parts)
    plain = df
    for f in fields:
        if has_map(f.dataType):
            plain = plain.withColumn(f.name, ordered_maps(c(f.name), f.dataType))
    values = plain.select(*[c(p).alias(f"__p{i}") for i, p in enumerate(parts)],
                          *[F.expr(f"{rounded(f.name, f.dataType, epsilon)} AS v{i}") for i, f in enumerate(fields)])
    # A null hashes to a constant, so every hash is a number and nulls weigh in too.
    hashed = values.selectExpr("*", *[f"xxhash64(v{i}) AS x{i}" for i in range(len(fields))])
    whole = row_hash([f"x{i}" for i in range(len(fields))])
    aggregates = ["count(1) AS `rows`", f"array({', '.join(hash_totals(whole))}) AS w"]
    for i, f in enumerate(fields):
        aggregates += [f"count_if(v{i} IS NULL) AS n{i}", f"array({', '.join(hash_totals(f'x{i}'))}) AS h{i}",
                       f"hll_sketch_agg(if(v{i} IS NULL, NULL, x{i}), {SKETCH_BITS}) AS d{i}"]
        if isinstance(f.dataType, INTEGRAL):
            aggregates.append(f"{exact_sum(f'v{i}')} AS s{i}")
        elif isinstance(f.dataType, FLOATING):
            exact = f"try_cast(v{i} AS {_EXACT})"
            aggregates += [f"try_sum({exact}) AS s{i}", f"sum(double(v{i})) AS z{i}", f"count_if(v{i} IS NOT NULL AND {exact} IS NULL) AS k{i}"]
        elif isinstance(f.dataType, T.DecimalType):
            aggregates.append(f"try_sum({f'v{i}'}) AS s{i}")
        if _is_number(f):
            aggregates += [f"min(v{i}) AS lo{i}", f"max(v{i}) AS hi{i}"]
    grouped = hashed.groupBy(*[f"__p{i}" for i in range(len(parts))]).agg(*[F.expr(a) for a in aggregates])
    return grouped.withColumnsRenamed({f"__p{i}": p for i, p in enumerate(parts)})


def _is_number(f: T.StructField) -> bool:
    return isinstance(f.dataType, (*INTEGRAL, *FLOATING, T.DecimalType))


def merged_metrics(states: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Rows ``(column, metric, value)`` of the whole table, whatever the states were cut into.

    Metrics: ``rows`` and ``content`` (under column ``*``), ``nulls``, ``content``, ``distinct`` (an estimate), and for numbers ``sum``,
    ``min`` and ``max``; values are shown as doubles. Of no states: 0 rows.
    """
    def added(name: str) -> str:
        return f"array({', '.join(f'coalesce(sum({name}[{j}]), 0L)' for j in range(3))}) AS {name}"

    aggregates = ["coalesce(sum(`rows`), 0L) AS `rows`", added("w")]
    listed = [(WHOLE_ROW, "rows", "double(`rows`)"), (WHOLE_ROW, "content", "double(w[0])")]
    for i, f in enumerate(fields):
        aggregates += [f"coalesce(sum(n{i}), 0L) AS n{i}", added(f"h{i}"), f"hll_sketch_estimate(hll_union_agg(d{i})) AS d{i}"]
        listed += [(f.name, "nulls", f"double(n{i})"), (f.name, "content", f"double(h{i}[0])"), (f.name, "distinct", f"double(coalesce(d{i}, 0L))")]
        if _is_number(f):
            total = f"double(s{i})"
            aggregates += [f"try_sum(s{i}) AS s{i}", f"min(lo{i}) AS lo{i}", f"max(hi{i}) AS hi{i}"]
            if isinstance(f.dataType, FLOATING):
                aggregates += [f"sum(z{i}) AS z{i}", f"coalesce(sum(k{i}), 0L) AS k{i}"]
                total = f"if(k{i} = 0, coalesce(double(s{i}), z{i}), z{i})"
            listed += [(f.name, "sum", total), (f.name, "min", f"double(lo{i})"), (f.name, "max", f"double(hi{i})")]
    rows = ", ".join(f"named_struct('column', {literal(col)}, 'metric', {literal(metric)}, 'value', {value})" for col, metric, value in listed)
    return states.agg(*[F.expr(a) for a in aggregates]).selectExpr(f"inline(array({rows}))")


class StoredFingerprint:
    """Fingerprint of the Parquet table under ``table``, partitioned by ``parts``, with its states kept under ``root``."""

    def __init__(self, spark: SparkSession, table: str, parts: list[str], root: str, epsilon: float = 1e-6):
        self.spark, self.table, self.parts, self.epsilon = spark, table, parts, epsilon
        self.fields = _fields(self.rows(), parts)
        empty = self._signed(partition_states(self.rows().where("false"), parts, epsilon), self.signatures())
        self.states = CommittedTable(spark, root, empty.schema, "bucket")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.table)

    def signatures(self) -> DataFrame:
        """``parts``, number of files and a sum over their names, lengths and times: a listing, no file is opened."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.table)
        mark = f"xxhash64(path, length, modificationTime) & {(SUM_MASK << 20) | SUM_MASK}L"
        return files.groupBy(*[quoted(p) for p in self.parts]).agg(F.count(F.lit(1)).alias("files"), F.expr(f"sum({mark}) AS mark"))

    def _same(self, other: str) -> Column:
        return reduce(and_, [c(p).eqNullSafe(F.col(f"{other}.{quoted(p)}")) for p in self.parts])

    def _signed(self, states: DataFrame, now: DataFrame) -> DataFrame:
        marks = now.select(*[c(p).alias(f"__k{i}") for i, p in enumerate(self.parts)], "files", "mark")
        same = reduce(and_, [c(p).eqNullSafe(F.col(f"__k{i}")) for i, p in enumerate(self.parts)])
        bucket = F.pmod(F.xxhash64(*[c(p) for p in self.parts]), F.lit(BUCKETS)).cast("int").alias("bucket")
        return states.join(marks, same).select(*states.columns, "files", "mark", bucket)

    def refresh(self) -> int:
        """Brings the states up to the table's files; returns how many partitions were read.

        The files are listed before they are read, so that a partition that changes meanwhile is read again next time.
        """
        manifest = self.states.manifest()
        keys = [quoted(p) for p in self.parts]
        now = self.spark.createDataFrame(self.signatures().collect(), self.signatures().schema)  # one row a partition
        known = self.states.rows(manifest).select(*keys, "files", "mark")
        marked = [c(n).alias(f"__k{i}") for i, n in enumerate([*self.parts, "files", "mark"])]
        same = [c(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate([*self.parts, "files", "mark"])]
        changed = now.join(known.select(*marked), reduce(and_, same), "left_anti").select(*keys)
        gone = known.select(*keys).join(now.select(*marked), reduce(and_, same[:len(self.parts)]), "left_anti")
        values = changed.limit(LISTED + 1).collect()
        lost = gone.limit(1).collect()
        if not values and not lost and manifest is not EMPTY:
            return 0
        rows = self.rows()
        if len(values) <= LISTED:
            wanted = [reduce(and_, [c(p).eqNullSafe(F.lit(v[p])) for p in self.parts]) for v in values]
            if len(self.parts) == 1 and not any(v[0] is None for v in values):
                wanted = [c(self.parts[0]).isin([v[0] for v in values])] if values else []
            rows = rows.where(reduce(or_, wanted, F.lit(False)))
            count = len(values)
        else:
            listed = changed.select(*[c(p).alias(f"__k{i}") for i, p in enumerate(self.parts)])
            rows = rows.join(listed, reduce(and_, same[:len(self.parts)]), "left_semi")
            count = changed.count()
        fresh = self._signed(partition_states(rows, self.parts, self.epsilon), now)

        def brought_up(states: DataFrame) -> DataFrame:
            stale = changed.unionByName(gone).select(*[c(p).alias(f"__k{i}") for i, p in enumerate(self.parts)])
            kept = states.join(stale, reduce(and_, same[:len(self.parts)]), "left_anti")
            after = kept.select(*self.states.schema.names).unionByName(fresh.select(*self.states.schema.names))
            buckets = changed.unionByName(gone).select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
            return after.join(buckets, "bucket", "left_semi").select(*self.states.schema.names)

        emptied = {f"bucket={r[0]}" for r in gone.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).distinct().collect()}
        done = self.states.change(brought_up, "refresh")
        # A bucket whose last partition went has no rows to replace it.
        emptied = {b for b in emptied if done.parts.get(b) == manifest.parts.get(b)}
        if emptied:
            self.states.drop(emptied)
        return count

    def metrics(self) -> DataFrame:
        """Rows ``(column, metric, value)`` as of the last refresh; the table itself is not read."""
        return merged_metrics(self.states.read(), self.fields)
