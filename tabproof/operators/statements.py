"""Statements that mention tables, and the worst of them."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import short_name
from ..sources.telemetry import STATEMENTS, telemetry
from .name_scan import rows_naming

# Defaults of the statement window.
STATEMENT_LOOKBACK_DAYS = 7
TOP_STATEMENTS = 50


def mentions(text: Column, names: list[str], whole_word: bool = False) -> Column:
    """Whether the text names any of the tables. Letters in any case, ``_`` stands for itself.

    With ``whole_word``, no letter, digit or underscore may touch the name.
    """
    lowered = F.lower(text)
    if whole_word:
        return reduce(lambda a, b: a | b, [F.rlike(lowered, bounded(F.lit(n.lower()))) for n in names])
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(n.lower())) for n in names])


def bounded(name: Column) -> Column:
    """Regular expression of a name as it stands between other words."""
    return F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(name, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))


def statements_touching(statements: DataFrame, names: list[str], whole_word: bool = False) -> DataFrame:
    """Statements that name any of the given tables: a filter, no join."""
    if not names:
        return statements.limit(0)
    shorts = [n.replace("`", "").split(".")[-1] for n in names]
    return statements.where(mentions(F.col("statement_text"), shorts, whole_word))


def rows_by_table(statements: DataFrame, targets: DataFrame, whole_word: bool = False) -> DataFrame:
    """``statements``, without the text, beside every ``table_name`` of ``targets`` that the text names, at least once.

    For many tables at once, and names of any characters: each text is read once, in the task that has it.
    """
    names = targets.select("table_name", F.lower(short_name(F.col("table_name"))).alias("name"))
    lowered = statements.withColumn("statement_text", F.lower("statement_text"))
    return rows_naming(lowered, "statement_text", names, "name", "table_name", whole_word)


def pairs_by_table(statements: DataFrame, targets: DataFrame, whole_word: bool = False) -> DataFrame:
    """Distinct ``(statement_id, table_name)`` for every table of ``targets(table_name)`` that a statement's text names."""
    return rows_by_table(statements.select("statement_id", "statement_text"), targets, whole_word).distinct()


def statements_by_table(statements: DataFrame, targets: DataFrame, whole_word: bool = False) -> DataFrame:
    """Every statement, without its text, beside every table of ``targets(table_name)`` that the text names."""
    rest = statements.drop("statement_text").dropDuplicates(["statement_id"])
    return pairs_by_table(statements, targets, whole_word).join(rest, "statement_id").select(*rest.columns, "table_name")


def in_window(statements: DataFrame, as_of: date | datetime, lookback_days: int = STATEMENT_LOOKBACK_DAYS,
              min_duration_ms: int = 0) -> DataFrame:
    """Finished statements since midnight ``lookback_days`` before ``as_of``, not shorter than the minimum.

    The bounds are literals, so they reach the scan.
    """
    day = as_of.date() if isinstance(as_of, datetime) else as_of
    return telemetry(statements, STATEMENTS).where(
        (F.col("start_time") >= F.lit(day).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(lookback_days)} DAYS"))
        & (F.col("execution_status") == "FINISHED")
        & (F.col("total_duration_ms") >= int(min_duration_ms)))


def with_ratios(statements: DataFrame) -> DataFrame:
    """Adds ``spill_pct`` (0 without reads) and ``row_amplification`` (null without reads)."""
    def ratio(part: Column, whole: Column, places: int) -> Column:
        return F.when(whole > 0, F.bround(part.cast("double") / whole, places))

    return statements.withColumns({
        "spill_pct": F.coalesce(ratio(F.col("spilled_local_bytes") * F.lit(100.0), F.col("read_bytes"), 1),
                                F.lit(0.0)),
        "row_amplification": ratio(F.col("produced_rows"), F.col("read_rows"), 2),
    })


def worst_statements(statements: DataFrame, names: list[str], as_of: date | datetime,
                     lookback_days: int = STATEMENT_LOOKBACK_DAYS, min_duration_ms: int = 0,
                     limit: int = TOP_STATEMENTS, whole_word: bool = False) -> DataFrame:
    """The longest statements that name any of the tables, longest first, with ratios."""
    recent = in_window(statements, as_of, lookback_days, min_duration_ms)
    return with_ratios(
        statements_touching(recent, names, whole_word)
        .orderBy(F.desc("total_duration_ms"), "statement_id").limit(limit))


def statement_signals(statements: DataFrame, names: list[str], as_of: date | datetime,
                      lookback_days: int = STATEMENT_LOOKBACK_DAYS, min_duration_ms: int = 0,
                      limit: int = TOP_STATEMENTS, whole_word: bool = False) -> DataFrame:
    """One row: ``available``, ``matched_statements`` (up to ``limit``) and the longest one's columns."""
    worst = worst_statements(statements, names, as_of, lookback_days, min_duration_ms, limit, whole_word)
    columns = [n for n in worst.columns if n != "statement_text"]
    return worst.agg(
        F.count(F.lit(1)).alias("matched_statements"),
        F.min_by(F.struct(*columns), F.struct(-F.col("total_duration_ms"), "statement_id")).alias("w"),
    ).select((F.col("matched_statements") > 0).alias("available"), "matched_statements", "w.*")


def worst_by_table(statements: DataFrame, targets: DataFrame, as_of: date | datetime,
                   lookback_days: int = STATEMENT_LOOKBACK_DAYS, min_duration_ms: int = 0,
                   limit: int = TOP_STATEMENTS, whole_word: bool = False) -> DataFrame:
    """The longest statements of each table of ``targets``, with ``place`` from 1 and ratios.

    The limit per table is applied inside the tasks before the shuffle.
    """
    recent = in_window(statements, as_of, lookback_days, min_duration_ms)
    order = Window.partitionBy("table_name").orderBy(F.desc("total_duration_ms"), "statement_id")
    found = rows_by_table(recent.select("statement_id", "total_duration_ms", "statement_text"), targets, whole_word)
    top = found.groupBy("statement_id", "table_name").agg(F.max("total_duration_ms").alias("total_duration_ms")).withColumn(
        "place", F.row_number().over(order)).where(F.col("place") <= limit).select("statement_id", "table_name", "place")
    # The other columns are fetched for what is left only.
    kept = recent.drop("statement_text").join(top.select("statement_id").distinct(), "statement_id", "left_semi")
    return with_ratios(kept.dropDuplicates(["statement_id"]).join(top, "statement_id"))
