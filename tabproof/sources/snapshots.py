"""Versioned tables as Parquet folders: commit, history, pinned reads, samples, replay inputs."""

from __future__ import annotations

from datetime import datetime
from functools import partial, reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.hashing import in_sample
from ..functions.names import c
from ..operators.asof import resolve_versions
from ..session import concurrently, new_folder
from .commits import ATTEMPTS, CommitConflict, Files, Log

HISTORY_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("operation", T.StringType()),
])


# Pins up to this number enter a plan as literals; more are joined as a relation.
LITERAL_PINS = 100


def write_versions(df: DataFrame, path: str, version: str = "version") -> None:
    """Stores rows by version, one folder per value; a version with most rows is split over tasks."""
    df.hint("rebalance", version).write.mode("overwrite").partitionBy(version).parquet(path)


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """Rows of one version; the others are not opened."""
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")


def sample_by_key(df: DataFrame, keys: list[str], percent: float, seed: int = 42) -> DataFrame:
    """The rows whose key falls into the sample: the same keys for any layout and in any table."""
    return df.where(in_sample([c(k) for k in keys], percent, seed))


class SnapshotStore:
    """Tables under one folder, each version in a folder of its own, with a history.

    A writer first claims its version's number, so two writers never share one. The version becomes visible with
    its record in the history, put there as a whole after its data; a writer that was killed leaves a number that no
    version has.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def history(self) -> DataFrame:
        records = f"{self.root}/_history"
        if not Files(self.spark, records).names(records):
            return self.spark.createDataFrame([], HISTORY_SCHEMA)
        stored = self.spark.read.schema("table_name string, version long, micros long, operation string").option(
            "recursiveFileLookup", "true").json(records)
        return stored.select("table_name", "version", F.timestamp_micros("micros").alias("ts"), "operation")

    def commit(self, table: str, df: DataFrame, ts: datetime, operation: str = "WRITE") -> int:
        """Stores the rows as the table's next version and returns its number."""
        last = self.history().where(F.col("table_name") == table).agg(F.max("version")).first()[0]
        version = self._claim(table, 0 if last is None else last + 1)
        # Rows that somebody put there without claiming the number are not replaced: this fails.
        df.write.mode("errorifexists").parquet(f"{self.root}/{table}/version={version}")
        Log(self.spark, f"{self.root}/_history/{table}").put(version, {
            "table_name": table, "version": version, "micros": T.TimestampType().toInternal(ts), "operation": operation})
        return version

    def _claim(self, table: str, least: int) -> int:
        """The lowest number from ``least`` on, and above all claimed ones, that no other writer gets."""
        claims = Log(self.spark, f"{self.root}/_claims/{table}")
        for _ in range(ATTEMPTS):
            taken = claims.last()
            number = least if taken is None else max(least, taken + 1)
            if claims.put(number, {"table": table}):
                return number
        raise CommitConflict(f"{self.root}/{table}: {ATTEMPTS} numbers in a row were taken by others")

    def read(self, table: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/version={version}")

    def pin_latest(self, tables: list[str]) -> dict[str, int]:
        """Newest version of each table; a table without one is an error."""
        return self.resolve(dict.fromkeys(tables, datetime(9999, 1, 1)))

    def resolve(self, pins: dict[str, datetime | int]) -> dict[str, int]:
        """The version each pin stands for: a number itself, a moment the last version at or before it."""
        found = {t: p for t, p in pins.items() if isinstance(p, int)}
        moments = {t: p for t, p in pins.items() if t not in found}
        if len(moments) <= LITERAL_PINS:
            # Few pins: one filtered aggregate over the history, the moments as literals.
            early = [(F.col("table_name") == t) & (F.col("ts") <= F.lit(p)) for t, p in moments.items()]
            at = self.history().where(reduce(or_, early, F.lit(False))).groupBy("table_name").agg(
                F.max("version").alias("version"))
        else:
            asked = self.spark.createDataFrame(list(moments.items()), "table_name string, pin_ts timestamp")
            at = resolve_versions(self.history(), asked.withColumn("pin_version", F.lit(None).cast("bigint"))).where(
                "resolved")
        found |= {r.table_name: r.version for r in at.select("table_name", "version").collect()}
        missing = sorted(f"{t} at {p}" for t, p in pins.items() if t not in found)
        if missing:
            raise ValueError(f"no version at or before the moment asked for: {', '.join(missing)}")
        return found

    def inputs_at(self, tables: list[str], anchor: datetime, overrides: dict | None = None,
                  copy_to: str | None = None) -> dict[str, DataFrame]:
        """Each table as it was at ``anchor``, or at its own override.

        Nothing is copied unless ``copy_to`` names a folder to write them to.
        """
        pins = {t: (overrides or {}).get(t, anchor) for t in tables}
        frames = {t: self.read(t, v) for t, v in self.resolve(pins).items()}
        return frames if copy_to is None else materialise(self.spark, frames, copy_to)


def materialise(spark: SparkSession, frames: dict[str, DataFrame], folder: str | None = None,
                label: str = "run") -> dict[str, DataFrame]:
    """Writes every frame and reads it back, so that what follows does not compute it again."""
    place = (folder or new_folder(spark, label)).rstrip("/")
    paths = {name: f"{place}/{name.replace('.', '__')}" for name in frames}
    concurrently(spark, [partial(df.write.mode("overwrite").parquet, paths[n]) for n, df in frames.items()])
    return {n: spark.read.schema(df.schema).parquet(paths[n]) for n, df in frames.items()}


def prepare_pair(spark: SparkSession, inputs: dict[str, DataFrame], sample_percent: float | None = None,
                 sample_keys: dict[str, list[str]] | None = None, seed: int = 42, stored: bool = False,
                 ) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, str]]:
    """Identical inputs for both runs, and what each of them is: ``full`` or ``sampled n%``.

    They are written once and read from there, unless they are ``stored`` in a form that cannot change.
    Only tables with keys in ``sample_keys`` are sampled; the same keys are kept
    on both sides and in every table sampled by them.
    """
    keys = sample_keys or {}
    unknown = sorted(set(keys) - set(inputs))
    if unknown:
        raise ValueError(f"cannot sample unknown tables: {unknown}")
    sampled = {t: sample_percent is not None and t in keys for t in inputs}
    frames = {t: sample_by_key(df, keys[t], sample_percent, seed) if sampled[t] else df
              for t, df in inputs.items()}
    if not stored:
        frames = materialise(spark, frames, label="inputs")
    how = {t: f"sampled {sample_percent}%" if sampled[t] else "full" for t in inputs}
    return dict(frames), dict(frames), how
