"""As-of resolution: the last version at or before a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .running import running_max


def latest_versions(history: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """``(table_name, version)``: the newest version of each table, or of the listed ``tables`` only.

    A listed table without history is an error at run time, not a missing row.
    """
    newest = history.groupBy("table_name").agg(F.max("version").alias("version"))
    if tables is None:
        return newest
    found = tables.select("table_name").distinct().join(newest, "table_name", "left")
    return found.withColumn("version", F.coalesce("version", F.raise_error(
        F.concat(F.col("table_name"), F.lit(": no version"))).cast("bigint")))


def resolve_versions(history: DataFrame, pins: DataFrame) -> DataFrame:
    """``(table_name, pin_ts, pin_version, version, resolved)`` for every pin.

    ``history`` is ``(table_name, version, ts)``; ``pins`` is ``(table_name,
    pin_ts, pin_version)``. A given ``pin_version`` stands as it is; otherwise
    the version is the highest committed at or before ``pin_ts``, so a moment
    after the last commit yields the latest. A pin before the first commit is
    reported with ``resolved`` false.

    Commits and pins of a table are merged along time and the highest version
    so far is carried along, instead of pairing every pin with every commit.
    Only commits of pinned tables up to the last pin take part.
    """
    asked = pins.where("pin_ts IS NOT NULL").select(
        "table_name", F.col("pin_ts").alias("ts"), F.lit(1).alias("is_pin"),
        F.lit(None).cast("bigint").alias("version")).distinct()
    last = asked.groupBy("table_name").agg(F.max("ts").alias("last"))
    commits = history.select("table_name", "ts", F.lit(0).alias("is_pin"), F.col("version").cast("bigint").alias("version")).join(
        last, "table_name").where("ts <= last").drop("last")
    # At equal times commits sort first: "at or before".
    merged = running_max(commits.unionByName(asked), ["table_name"], ["ts", "is_pin", "version"],
                         F.col("version"), "found")
    answers = merged.where("is_pin = 1").select("table_name", F.col("ts").alias("pin_ts"), "found")
    return pins.join(answers, ["table_name", "pin_ts"], "left").select(
        "table_name", "pin_ts", "pin_version",
        F.coalesce(F.col("pin_version").cast("bigint"), F.col("found")).alias("version"),
    ).withColumn("resolved", F.col("version").isNotNull())


def require_resolved(resolved: DataFrame) -> DataFrame:
    """The same pins, failing the job at the first one without a version."""
    return resolved.withColumn("version", F.coalesce("version", F.raise_error(
        F.concat(F.col("table_name"), F.lit(": no version at or before "),
                 F.col("pin_ts").cast("string"))).cast("bigint")))
