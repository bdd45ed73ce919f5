"""What the latest write of a table did to its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.maps import first_int
from ..sources.telemetry import WRITES, telemetry

# Operations that write data, and how many entries of a history are looked at.
WRITE_OPERATIONS = (
    "WRITE", "MERGE", "DELETE", "UPDATE", "CREATE OR REPLACE TABLE AS SELECT",
    "CREATE TABLE AS SELECT", "TRUNCATE", "REPLACE TABLE AS SELECT",
)
HISTORY_DEPTH = 5

# Names of the same count under different operations, in order of preference.
METRIC_NAMES = {
    "files_added": ("numTargetFilesAdded", "numFiles", "numAddedFiles"),
    "files_removed": ("numTargetFilesRemoved", "numRemovedFiles", "numDeletedFiles"),
    "output_rows": ("numOutputRows", "numTargetRowsInserted"),
    "scan_time_ms": ("scanTimeMs",),
    "rewrite_time_ms": ("rewriteTimeMs",),
    "execution_time_ms": ("executionTimeMs",),
}


def write_signals(history: DataFrame, depth: int = HISTORY_DEPTH) -> DataFrame:
    """Per table, its latest write among the newest ``depth`` entries: files, rows, times, ratio.

    ``history`` is ``(table_name, version, operation, operationMetrics)``. Every
    table has a row; ``available`` is false when none of the entries is a write.
    Only ``depth`` entries per table and task reach the shuffle.
    """
    newest = Window.partitionBy("table_name").orderBy(F.desc("version"))
    recent = (
        telemetry(history, WRITES).select("table_name", "version", "operation", "operationMetrics")
        .withColumn("place", F.row_number().over(newest)).where(F.col("place") <= depth)
    )
    is_write = F.upper("operation").isin(*WRITE_OPERATIONS)
    latest = recent.groupBy("table_name").agg(
        F.max_by(F.when(is_write, F.struct("operation", "version", "operationMetrics")),
                 F.when(is_write, F.col("version"))).alias("w"))
    counts = latest.select(
        "table_name", F.col("w").isNotNull().alias("available"), F.col("w.operation").alias("operation"),
        F.col("w.version").alias("version"),
        *[F.when(F.col("w").isNotNull(), first_int(F.col("w.operationMetrics"), *names)).alias(out)
          for out, names in METRIC_NAMES.items()])
    ratio = F.when(F.col("files_added") > 0,
                   F.bround(F.col("files_removed").cast("double") / F.col("files_added"), 2))
    return counts.withColumn("rewrite_ratio", ratio)
