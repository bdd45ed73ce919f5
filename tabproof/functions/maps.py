"""Descriptive maps and lists of the audit log, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Texts that mean yes.
TRUE_WORDS = ("true", "passed", "pass", "1", "yes")


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truthy(value: Column) -> Column:
    """Whether a boolean or text means yes; null means no."""
    return F.coalesce(F.lower(stripped(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def change_types(value: Column, is_list: bool = False) -> Column:
    """A comma text or a list as an array of trimmed, non-empty texts; null when none is left."""
    parts = value if is_list else F.split(value, ",")
    kept = F.filter(F.transform(parts, lambda p: stripped(p.cast("string"))), lambda p: p != "")
    return F.when(F.size(kept) > 0, kept)


def stringify(values: Column) -> Column:
    """A map with every value as text, null values kept; an empty map becomes null."""
    texts = F.transform_values(values, lambda _, v: v.cast("string"))
    return F.when(F.size(values) > 0, texts)


def _with_default(values: Column, key: str, source: str, derive) -> Column:
    """The map plus ``key``, derived from ``source``, when it has the latter but not the former."""
    wanted = ~F.map_contains_key(values, key) & F.map_contains_key(values, source)
    extra = F.create_map(F.lit(key), derive(values[source]))
    return F.when(wanted, F.map_concat(values, extra)).otherwise(values)


def canonical_equivalence(values: Column) -> Column:
    """Guarantees ``result`` wherever ``passed`` is known."""
    return _with_default(values, "result", "passed",
                         lambda v: F.when(truthy(v), "passed").otherwise("failed"))


def canonical_perf(values: Column) -> Column:
    """Guarantees ``gain`` and ``passed`` wherever their other names are known."""
    with_gain = _with_default(values, "gain", "gain_pct", lambda v: v)
    return _with_default(with_gain, "passed", "result",
                         lambda v: F.when(truthy(v), "True").otherwise("False"))


def text_map(**entries: Column) -> Column:
    """A map of the given texts."""
    return F.create_map(*[part for key, value in entries.items()
                          for part in (F.lit(key), value.cast("string"))])


def equivalence_entry(passed: Column, risk_tier: Column | None = None, **detail: Column) -> Column:
    """Audit map of an equivalence verdict; always has ``result``."""
    entries = {"result": F.when(truthy(passed), "passed").otherwise("failed")}
    if risk_tier is not None:
        entries["risk_tier"] = risk_tier
    return text_map(**{**entries, **detail})


def perf_entry(gain: Column, passed: Column, before_s: Column | None = None, after_s: Column | None = None,
               **detail: Column) -> Column:
    """Audit map of a timing verdict; always has ``gain`` and ``passed``."""
    entries = {"gain": gain, "passed": F.when(truthy(passed), "True").otherwise("False")}
    entries |= {k: v for k, v in (("before_s", before_s), ("after_s", after_s)) if v is not None}
    return text_map(**{**entries, **detail})


def first_int(values: Column, *names: str) -> Column:
    """The first of the named entries that reads as a whole number, else 0."""
    reads = [values[n].try_cast("bigint") for n in names]
    return F.coalesce(*reads, F.lit(0).cast("bigint"))


def drop_nulls(values: Column) -> Column:
    return F.map_filter(values, lambda _, v: v.isNotNull())


def readable(values: Column) -> Column:
    """A map as one text with its keys in order, for reports."""
    entries = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ", ")
