"""Parquet tables: schema-true reads, appends, and replacement of whole partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.names import c


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows under ``schema``: columns it has and the frame lacks are added as null."""
    empty = df.sparkSession.createDataFrame([], schema)
    unknown = [n for n in df.columns if n not in empty.columns]
    if unknown:
        raise ValueError(f"columns not in the schema: {unknown}")
    present = [f for f in schema.fields if f.name in df.columns]
    return empty.unionByName(
        df.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in present]), allowMissingColumns=True)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows stored under ``path``, read with ``schema``; no rows when nothing was written yet.

    Files written before a column existed give null for it.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*[c(f.name) for f in schema.fields])


def append(df: DataFrame, path: str, partition: str) -> None:
    """Adds rows. Rebalancing gathers a partition's rows into few files and splits a large one."""
    df.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replaces exactly the partitions that occur in ``df``; all others stay.

    The mode is an option of this write, not a setting of the session.
    """
    (
        df.hint("rebalance", partition).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    )


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes stored under a path, as its file system reports them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def refuse_rows(df: DataFrame, what: str) -> None:
    """Raises with the number of offending rows, and up to 20 of them, when the frame is not empty."""
    bad = df.limit(20).collect()
    if bad:
        raise ValueError(f"{what}: {df.count()} row(s), among them " + ", ".join("/".join(str(v) for v in row) for row in bad))

