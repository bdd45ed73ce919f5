"""Table names and column names as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_SANDBOX = "sandbox"


def quoted(name: str) -> str:
    """A column name that ``F.col`` reads as one name, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string literal of SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def c(name: str) -> Column:
    return F.col(quoted(name))


def bare(name: Column) -> Column:
    """A table name without its backticks."""
    return F.replace(name, F.lit("`"))


def short_name(name: Column) -> Column:
    """Last part of a dotted table name."""
    return F.substring_index(bare(name), ".", -1)


def name_parts(name: Column) -> Column:
    """``[catalog, schema, table]``, or null when the name has not three parts."""
    parts = F.split(bare(name), r"\.")
    return F.when((F.size(parts) == 3) & ~F.exists(parts, lambda p: p == ""), parts)


def sandbox_name(name: Column, sandbox: str = DEFAULT_SANDBOX, suffix: str = "") -> Column:
    """Where the copy of a table lives: same catalog, one schema, original schema in the name."""
    parts = name_parts(name)
    return F.concat(parts[0], F.lit(f".{sandbox}."), parts[1], F.lit("__"), parts[2], F.lit(suffix))
