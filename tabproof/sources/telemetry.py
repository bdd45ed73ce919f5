"""Shapes of the telemetry relations that callers bring, and what a missing one reads as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.names import c

# The columns read from each relation.
STATEMENTS = T.StructType([
    T.StructField("statement_id", T.StringType()),
    T.StructField("statement_text", T.StringType()),
    T.StructField("executed_by", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("execution_status", T.StringType()),
    T.StructField("total_duration_ms", T.LongType()),
    T.StructField("execution_duration_ms", T.LongType()),
    T.StructField("compilation_duration_ms", T.LongType()),
    T.StructField("result_fetch_duration_ms", T.LongType()),
    T.StructField("read_rows", T.LongType()),
    T.StructField("produced_rows", T.LongType()),
    T.StructField("read_bytes", T.LongType()),
    T.StructField("spilled_local_bytes", T.LongType()),
])
TIMELINE = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("task_key", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("period_start_time", T.TimestampType()),
    T.StructField("period_end_time", T.TimestampType()),
])
WRITES = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("operation", T.StringType()),
    T.StructField("operationMetrics", T.MapType(T.StringType(), T.StringType())),
])
TABLE_DETAIL = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("reader", T.IntegerType()),
    T.StructField("writer", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.StringType())),
])


def telemetry(source: DataFrame | str | None, schema: T.StructType) -> DataFrame:
    """A telemetry relation under its schema, from a frame or a table name.

    Columns it lacks read as null and further ones are dropped; a relation that
    is absent, or a name that does not exist, reads as empty, so that what is
    built on it reports no signal instead of failing. A moment keeps its kind,
    with a zone or without, so that bounds on it still reach the scan.
    """
    spark = SparkSession.active()
    if isinstance(source, str):
        source = spark.table(source) if spark.catalog.tableExists(source) else None
    if source is None:
        return spark.createDataFrame([], schema)
    own = {f.name: f.dataType for f in source.schema.fields}

    def column(f: T.StructField) -> Column:
        if f.name not in own:
            return F.lit(None).cast(f.dataType).alias(f.name)
        moment = isinstance(f.dataType, T.TimestampType) and isinstance(own[f.name], T.TimestampNTZType)
        return c(f.name) if moment or own[f.name] == f.dataType else c(f.name).cast(f.dataType).alias(f.name)

    return source.select(*[column(f) for f in schema.fields])
