"""Choosing the files of a Parquet table before the scan, by a small table about them.

The index has a row for each file: least and greatest value of some columns, and for others two bitmaps of hashes, a
small Bloom filter, which rule a value out. A file that the index does not know as it is now is always read, so
an index that is behind costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import c, quoted
from .commits import CommittedTable

#: Bits of a bitmap, as Spark's own bitmap functions make them.
BITS = 32_768
SEEDS = (1, 2)


def _bit(value: str, seed: int) -> str:
    return f"pmod(xxhash64({value}, {seed}L), {BITS}L)"


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, changed) of a table's files, without opening them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file"), "length", F.col("modificationTime").alias("changed"))


def file_index(spark: SparkSession, path: str, ranges: list[str], values: list[str] = (), files: DataFrame | None = None) -> DataFrame:
    """A row for each file: file, length, changed, rows; ``lo``, ``hi`` and ``nulls`` of each column of ``ranges``, two bitmaps of each
    column of ``values``. ``files`` limits it to some of the files."""
    known = (listed_files(spark, path) if files is None else files).select("file", "length", "changed")
    rows = spark.read.parquet(path)
    if files is not None:
        chosen = [r["file"] for r in files.select("file").collect()]
        rows = spark.read.schema(rows.schema).option("basePath", path).parquet(*chosen) if chosen else rows.where("false")
    rows = rows.select("*", F.col("_metadata.file_path").alias("__file"))
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, n in enumerate(ranges):
        aggregates += [F.min(c(n)).alias(f"lo{i}"), F.max(c(n)).alias(f"hi{i}"), F.expr(f"count_if({quoted(n)} IS NULL) AS nulls{i}")]
    for i, n in enumerate(values):
        aggregates += [F.expr(f"bitmap_construct_agg({_bit(quoted(n), s)}) FILTER (WHERE {quoted(n)} IS NOT NULL) AS bits{i}_{s}") for s in SEEDS]
    by_file = rows.groupBy("__file").agg(*aggregates)
    # Listing and metadata write a local path's scheme in different ways.
    return known.join(by_file, _bare("file") == _bare("__file")).drop("__file")


def _bare(name: str) -> Column:
    return F.regexp_replace(F.col(name), "^file:/+", "/")


def _may_hold(i: int, value: Column) -> Column:
    """Whether both bitmaps of column ``i`` have the bit of the value."""
    def bit(seed: int) -> Column:
        at = F.pmod(F.xxhash64(value, F.lit(seed).cast("bigint")), F.lit(BITS))
        byte = F.conv(F.hex(F.substring(F.col(f"bits{i}_{seed}"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1

    return reduce(and_, [bit(s) for s in SEEDS])


class SkippingTable:
    """A Parquet table under ``path`` with its index under ``index``, over ranges of some columns and values of others."""

    def __init__(self, spark: SparkSession, path: str, index: str, ranges: list[str], values: list[str] = ()):
        self.spark, self.path, self.ranges, self.values = spark, path, list(ranges), list(values)
        self.schema = spark.read.parquet(path).schema
        self.index = CommittedTable(spark, index, file_index(spark, path, self.ranges, self.values).schema)

    def refresh(self) -> int:
        """Brings the index up to the table's files; returns how many files were read."""
        now, read = listed_files(self.spark, self.path), []

        def brought_up(known: DataFrame) -> DataFrame:
            same = ["file", "length", "changed"]
            fresh = now.join(known.select(same), same, "left_anti")
            read.append(fresh.count())
            return known.join(now, same, "left_semi").select(self.index.schema.names).unionByName(
                file_index(self.spark, self.path, self.ranges, self.values, fresh))

        self.index.change(brought_up, "refresh")
        return read[-1]

    def files(self, box: Mapping[str, tuple] = {}, equal: Mapping[str, object] = {}) -> DataFrame:
        """(file, chosen): which files may hold a row whose columns lie in ``box`` (two bounds, either may be None) and ``equal`` values."""
        tests = []
        for n, (low, high) in box.items():
            i = self.ranges.index(n)
            tests += [F.col(f"hi{i}") >= F.lit(low)] * (low is not None) + [F.col(f"lo{i}") <= F.lit(high)] * (high is not None)
        for n, value in equal.items():
            if n in self.ranges:
                i = self.ranges.index(n)
                tests += [F.col(f"lo{i}") <= F.lit(value), F.col(f"hi{i}") >= F.lit(value)]
            if n in self.values:
                tests.append(_may_hold(self.values.index(n), F.lit(value).cast(self.schema[n].dataType)))
        known = self.index.read().withColumn("__known", F.lit(True))
        passes = F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))
        return listed_files(self.spark, self.path).join(known, ["file", "length", "changed"], "left").select(
            "file", (F.col("__known").isNull() | passes).alias("chosen"))

    def read(self, box: Mapping[str, tuple] = {}, equal: Mapping[str, object] = {}) -> DataFrame:
        """The rows in ``box`` with ``equal`` values. Only the names of the chosen files pass the driver; the others are not opened."""
        chosen = [r["file"] for r in self.files(box, equal).where("chosen").select("file").collect()]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*chosen)
        tests = [c(n) >= F.lit(low) for n, (low, _) in box.items() if low is not None]
        tests += [c(n) <= F.lit(high) for n, (_, high) in box.items() if high is not None]
        tests += [c(n) == F.lit(value) for n, value in equal.items()]
        return rows.where(reduce(and_, tests, F.lit(True)))
