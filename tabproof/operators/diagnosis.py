"""Performance profile of a notebook's tables: flags, techniques, short insight."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maps import drop_nulls
from .statements import STATEMENT_LOOKBACK_DAYS, TOP_STATEMENTS, worst_by_table
from .writes import write_signals

# Thresholds, texts and their parts, and the number of flags an insight keeps.
AMPLIFICATION_LIMIT = 3
REWRITE_LIMIT = 0.8
INSIGHT_FLAGS = 4
RATIOS = ("spill_pct", "row_amplification")
SHUFFLE_FLAG = "SHUFFLE/SKEW suspected — confirm in the query profile (not in system tables)"
NO_SIGNAL_FLAG = "no strong portable signal — inspect the query profile for shuffle/skew detail"
SHUFFLE_NOTE = "not-in-system-tables (see query profile)"
SPILL_START, SPILL_MIDDLE, SPILL_END = "SPILL: ", " bytes (", "% of read)"
AMPLIFICATION_START, AMPLIFICATION_END = "ROW AMPLIFICATION: produced/read = ", "x (exploding join?)"
REWRITE_START, REWRITE_REMOVED, REWRITE_ADDED, REWRITE_END = "FULL-REWRITE pattern on ", " (removed ", " / added ", " files)"
SPILL_TECHNIQUES = ("skew-salting/AQE", "broadcast-join (if a small side)")
AMPLIFICATION_TECHNIQUE = "review join keys / broadcast"
REWRITE_TECHNIQUE = "MERGE / dynamic-partition INSERT OVERWRITE instead of full rewrite"


def _grouped(number: Column) -> Column:
    return F.format_number(number, 0)


def plain(number: Column) -> Column:
    """A double of up to two places as text, never with an exponent."""
    return F.regexp_replace(number.cast("decimal(38,2)").cast("string"), r"(\.\d+?)0+$", "$1")


def statement_flags(spilled: Column, spill_pct: Column, amplification: Column) -> tuple[Column, Column]:
    """Flags and techniques from the worst statement, each an array with gaps."""
    spills = F.coalesce(spilled, F.lit(0)) > 0
    amplifies = F.coalesce(amplification >= AMPLIFICATION_LIMIT, F.lit(False))
    flags = F.array(
        F.when(spills, F.concat(F.lit(SPILL_START), _grouped(spilled), F.lit(SPILL_MIDDLE),
                                plain(spill_pct), F.lit(SPILL_END))),
        F.when(amplifies, F.concat(F.lit(AMPLIFICATION_START), plain(amplification), F.lit(AMPLIFICATION_END))),
        F.when(spills | amplifies, F.lit(SHUFFLE_FLAG)),
    )
    techniques = F.array(
        *[F.when(spills, F.lit(t)) for t in SPILL_TECHNIQUES],
        F.when(amplifies, F.lit(AMPLIFICATION_TECHNIQUE)),
    )
    return flags, techniques


def rewrite_flag(write: Column) -> Column:
    """The flag of one write signal, null when it did not rewrite most of the table."""
    rewrites = F.coalesce(write["rewrite_ratio"] >= REWRITE_LIMIT, F.lit(False)) & (write["files_removed"] > 0)
    return F.when(rewrites, F.concat(
        F.lit(REWRITE_START), write["operation"], F.lit(REWRITE_REMOVED), write["files_removed"].cast("string"),
        F.lit(REWRITE_ADDED), write["files_added"].cast("string"), F.lit(REWRITE_END)))


def diagnose(profile: DataFrame) -> DataFrame:
    """Adds ``flags``, ``suggested_techniques`` and ``insight``.

    ``profile`` has the worst statement's ``spilled_local_bytes, spill_pct,
    row_amplification`` (null without one) and ``writes``, the write signals of
    the notebook's tables in order.
    """
    flags, techniques = statement_flags(
        F.col("spilled_local_bytes"), F.col("spill_pct"), F.col("row_amplification"))
    rewrites = F.array_compact(F.transform(
        F.coalesce(F.col("writes"), F.array()), lambda w: F.when(w["available"], rewrite_flag(w))))
    found = F.concat(F.array_compact(flags), rewrites)
    suggested = F.concat(
        F.array_compact(techniques),
        F.when(F.size(rewrites) > 0, F.array(F.lit(REWRITE_TECHNIQUE))).otherwise(
            F.array().cast("array<string>")))
    return (
        profile
        .withColumn("flags", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_SIGNAL_FLAG))))
        .withColumn("suggested_techniques", F.array_distinct(suggested))
        .withColumn("insight", F.array_join(F.slice("flags", 1, INSIGHT_FLAGS), "; "))
    )


def notebook_profiles(notebooks: DataFrame, statements: DataFrame, history: DataFrame,
                      as_of: date | datetime, lookback_days: int = STATEMENT_LOOKBACK_DAYS,
                      whole_word: bool = False) -> DataFrame:
    """Profile and diagnosis of every notebook of ``notebooks(job_name, notebook_path, target_tables)``.

    A notebook's statement is the longest one that names any of its tables, of
    which ``matched_statements`` were found, up to TOP_STATEMENTS; its writes are the latest write of each of its tables, in the order listed.
    """
    key = ["job_name", "notebook_path"]
    targets = notebooks.select(*key, F.posexplode("target_tables").alias("nth", "table_name"))
    tables = targets.select("table_name").distinct()

    # A table's listing is cut where the count is, so a count below the bound is whole.
    worst = worst_by_table(statements, tables, as_of, lookback_days, limit=TOP_STATEMENTS, whole_word=whole_word)
    longest = F.struct(F.col("total_duration_ms").alias("ms"), F.col("statement_id").alias("id"))
    picked = F.struct("statement_id", "total_duration_ms", "execution_duration_ms", "compilation_duration_ms", "read_bytes", "read_rows", "produced_rows",
                      "spilled_local_bytes", "spill_pct", "row_amplification")
    # Of equally long statements the smallest id wins, as in the listing of the worst.
    by_notebook = targets.join(worst, "table_name").groupBy(*key).agg(
        F.min_by(picked, F.struct((-longest["ms"]).alias("ms"), longest["id"].alias("id"))).alias("s"),
        F.least(F.count_distinct("statement_id"), F.lit(TOP_STATEMENTS)).alias("matched_statements"))

    signals = write_signals(history)
    # A notebook lists its tables itself, so the list is as long as it was there.
    writes = targets.join(signals, "table_name", "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(
        "nth", "table_name", F.coalesce("available", F.lit(False)).alias("available"), "operation",
        "files_added", "files_removed", "rewrite_ratio"))).alias("writes"))

    profile = (
        notebooks.select(*key).distinct().join(by_notebook, key, "left").join(writes, key, "left")
        .select(*key, F.col("s").isNotNull().alias("statement_available"),
                F.coalesce("matched_statements", F.lit(0)).alias("matched_statements"), "s.*", "writes")
    )
    return diagnose(profile)


def profile_entry(profile: DataFrame) -> Column:
    """The profile as the text map that the audit log stores; entries without a value are left out."""
    return drop_nulls(F.create_map(
        *[part for name in ("spilled_local_bytes", "spill_pct", "read_bytes", "row_amplification",
                            "total_duration_ms")
          for part in (F.lit(name), plain(F.col(name)) if name in RATIOS else F.col(name).cast("string"))],
        F.lit("shuffle"), F.lit(SHUFFLE_NOTE),
        F.lit("flags"), F.array_join("flags", " | ")))
