"""Per-column fingerprint of two tables, and its comparison.

The fingerprint is a filter ahead of the exact difference, never proof. Every
metric is free of row order, so equal tables agree whatever their file layout:
counts and distinct estimates by nature, content as a sum of hashes of the
normalised values, integer totals as exact sums. Totals of doubles do depend on
the order of addition and are compared with slack (see ``close_sums``).

Expressions over all columns are written as SQL text, which stays quick to
build for tables with hundreds of columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.floats import FLOATING, INTEGRAL, close, close_sums, rounded
from ..functions.hashing import has_map, hash_total, hash_totals, ordered_maps, row_hash
from ..functions.names import c, literal
from .sides import BASELINE, CANDIDATE, SIDE, both_sides, shared_fields

LIMB_BITS = 22
COLUMNS_PER_PASS = 32
WHOLE_ROW = "*"
# The estimate counts distinct hashes, which are cheaper to feed to it than the values.
DISTINCT_SQL = {"approx": "approx_count_distinct(if({v} IS NULL, NULL, {h}))", "exact": None, None: None}


@dataclass
class Metric:
    """One aggregate: its column and name, SQL text, and how two values agree."""

    column: str
    name: str
    sql: str
    rule: str = "exact"      # exact | close | sum
    counted: bool = False    # an empty side counts as 0
    scale: str | None = None
    shown: str = "double({m})"


def exact_sum(value: str) -> str:
    """SQL text: sum of an integer column as ``decimal(38,0)``, at the speed of long addition.

    The value is added up in three parts of 22 bits, each of which stays within
    a long for 2**41 rows; only the three totals are widened.
    """
    wide, low = f"bigint({value})", (1 << LIMB_BITS) - 1
    parts = (f"{wide} & {low}L", f"shiftright({wide}, {LIMB_BITS}) & {low}L",
             f"shiftright({wide}, {2 * LIMB_BITS})")
    totals = [f"cast(sum({part}) AS decimal(19,0)) * cast({1 << (LIMB_BITS * i)} AS decimal(15,0))"
              for i, part in enumerate(parts)]
    return f"cast({' + '.join(totals)} AS decimal(38,0))"


def _metrics(name: str, dtype: T.DataType, v: str, h: str, distinct: str | None) -> list[Metric]:
    """Metrics of one column, given the names of its normalised value and of that value's hash."""
    out = [
        Metric(name, "nulls", f"count_if({v} IS NULL)", counted=True),
        Metric(name, "content", hash_total(h), counted=True),
    ]
    if DISTINCT_SQL[distinct]:
        out.append(Metric(name, "distinct", DISTINCT_SQL[distinct].format(v=v, h=h), counted=True))
    if isinstance(dtype, INTEGRAL):
        out += [Metric(name, "sum", exact_sum(v)), Metric(name, "min", f"min({v})"),
                Metric(name, "max", f"max({v})")]
    elif isinstance(dtype, FLOATING):
        out += [Metric(name, "sum", f"sum(double({v}))", "sum", scale=f"sum(abs(double({v})))"),
                Metric(name, "min", f"min({v})", "close"), Metric(name, "max", f"max({v})", "close")]
    elif isinstance(dtype, T.DecimalType):
        # A total beyond 38 digits reads as null on both sides; the checksum still tells them apart.
        out += [Metric(name, "sum", f"try_sum({v})"), Metric(name, "min", f"min({v})", "close"),
                Metric(name, "max", f"max({v})", "close")]
    return out


def _normalised(baseline: DataFrame, candidate: DataFrame, names: list[str], epsilon: float,
                ) -> tuple[DataFrame, list[T.StructField], list[str]]:
    """Both sides with columns ``v0, v1, ...`` holding the values as they are compared."""
    sides = both_sides(baseline, candidate, names)
    fields = [f for f in sides.schema.fields if f.name != SIDE]
    for f in fields:
        if has_map(f.dataType):
            sides = sides.withColumn(f.name, ordered_maps(c(f.name), f.dataType))
    values = [f"v{i}" for i in range(len(fields))]
    return sides.selectExpr(SIDE, *[f"{rounded(f.name, f.dataType, epsilon)} AS {v}"
                                    for f, v in zip(fields, values)]), fields, values


def row_checksums(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """One row: ``baseline_rows, candidate_rows, same`` (whether the checksums of all whole rows agree) and one of the
    checksums of each side.

    The cheapest look at every value: one hash and four sums per row, however
    many columns there are. Equal tables always agree; others do so by accident
    once in 2**60.
    """
    names = [f.name for f in shared_fields(baseline, candidate)]
    rows, _, values = _normalised(baseline, candidate, names, epsilon)
    # A null hashes to a constant, where hashing several columns at once would skip it.
    hashed = row_hash([f"xxhash64({v})" for v in values]) if values else "1L"
    per_side = rows.selectExpr(SIDE, f"{hashed} AS h").groupBy(SIDE).agg(
        F.expr("count(1) AS n"), F.expr(f"array({', '.join(hash_totals('h'))}) AS totals"))
    return per_side.agg(*[
        F.expr(f"max(if({SIDE} = {flag}, {name}, NULL)) AS {name}_{tag}")
        for name in ("n", "totals") for tag, flag in (("b", BASELINE), ("k", CANDIDATE))
    ]).selectExpr("coalesce(n_b, 0L) AS baseline_rows", "coalesce(n_k, 0L) AS candidate_rows",
                  "totals_b <=> totals_k AS same", "double(coalesce(totals_b[0], 0L)) AS baseline_content",
                  "double(coalesce(totals_k[0], 0L)) AS candidate_content")


def compare_fingerprints(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6,
                         distinct: str | None = "approx", whole_row: bool = True,
                         columns_per_pass: int = COLUMNS_PER_PASS) -> DataFrame:
    """Rows ``(column, metric, baseline, candidate, same)`` over the columns both tables have.

    ``distinct`` is ``approx`` (default), ``exact`` or ``None``. Metrics:
    ``rows`` (under column ``*``), ``nulls``, ``distinct``, ``sum``, ``min``,
    ``max`` and ``content``, an order-free checksum of the values; under ``*``
    the checksum covers whole rows, which also catches values that moved
    between rows. Values are shown as doubles; counts, checksums and integer
    totals are compared in full length.

    Tables with more than ``columns_per_pass`` columns are aggregated some
    columns at a time, each pass reading only its own: one aggregate over
    hundreds of columns outgrows what can be compiled and runs many times slower.
    The rows are the same for any width. Exact distinct counts take a pass per
    column, over its values grouped first, which spares repeating every row.
    """
    if distinct not in DISTINCT_SQL:
        raise ValueError(f"distinct must be 'approx', 'exact' or None, got {distinct!r}")
    names = [f.name for f in shared_fields(baseline, candidate)]
    exact = _exact_distinct(baseline, candidate, names, epsilon) if distinct == "exact" else []
    if len(names) <= columns_per_pass:
        return reduce(DataFrame.unionByName, exact, _fingerprint_pass(
            baseline, candidate, names, epsilon, distinct, True, whole_row))
    passes = [names[i:i + columns_per_pass] for i in range(0, len(names), columns_per_pass)]
    parts = [_fingerprint_pass(baseline, candidate, part, epsilon, distinct, False, False) for part in passes]
    checks = row_checksums(baseline, candidate, epsilon)
    listed = ["struct('rows' AS metric, double(baseline_rows) AS baseline, double(candidate_rows) AS candidate, "
              "baseline_rows = candidate_rows AS same)"]
    if whole_row:
        listed.append("struct('content' AS metric, baseline_content AS baseline, candidate_content AS candidate, same AS same)")
    whole = checks.selectExpr(f"'{WHOLE_ROW}' AS `column`", f"inline(array({', '.join(listed)}))")
    return reduce(DataFrame.unionByName, parts + exact, whole)


def _exact_distinct(baseline: DataFrame, candidate: DataFrame, names: list[str], epsilon: float) -> list[DataFrame]:
    """The ``distinct`` metric of each column."""
    rows, fields, values = _normalised(baseline, candidate, names, epsilon)
    counts = [F.expr(f"count_if({SIDE} = {flag} AND v IS NOT NULL)") for flag in (BASELINE, CANDIDATE)]
    return [
        rows.selectExpr(SIDE, f"{v} AS v").distinct().agg(counts[0].alias("b"), counts[1].alias("k")).selectExpr(
            f"{literal(f.name)} AS `column`", "'distinct' AS metric", "double(b) AS baseline", "double(k) AS candidate", "b = k AS same")
        for f, v in zip(fields, values)]


def _fingerprint_pass(baseline: DataFrame, candidate: DataFrame, names: list[str], epsilon: float,
                      distinct: str | None, count_rows: bool, whole_row: bool) -> DataFrame:
    """The fingerprint of some columns in one aggregate."""
    rows, fields, values = _normalised(baseline, candidate, names, epsilon)
    hashes = [f"h{i}" for i in range(len(values))]
    # A null hashes to a constant, so every hash is a number and nulls weigh in too.
    hashed = rows.selectExpr("*", *[f"xxhash64({v}) AS {h}" for v, h in zip(values, hashes)])

    metrics = [Metric(WHOLE_ROW, "rows", "count(1)", counted=True)] if count_rows else []
    if whole_row and fields:
        metrics.append(Metric(WHOLE_ROW, "content", f"array({', '.join(hash_totals(row_hash(hashes)))})", counted=True,
                              shown="double({m}[0])"))
    for f, v, h in zip(fields, values, hashes):
        metrics += _metrics(f.name, f.dataType, v, h, distinct)
    # Two rows at most leave this step, one per side: an empty side has none.
    per_side = hashed.groupBy(SIDE).agg(
        *[F.expr(f"{m.sql} AS m{i}") for i, m in enumerate(metrics)],
        *[F.expr(f"{m.scale} AS s{i}") for i, m in enumerate(metrics) if m.scale])

    listed = ", ".join(
        f"named_struct('id', {i}, 'column', {literal(m.column)}, 'metric', {literal(m.name)}, "
        f"'rule', {literal(m.rule)}, 'counted', {str(m.counted).lower()}, "
        f"'exact', {f'string(m{i})' if m.rule == 'exact' else 'string(NULL)'}, "
        f"'number', {m.shown.format(m=f'm{i}')}, 'scale', {f's{i}' if m.scale else 'double(NULL)'})"
        for i, m in enumerate(metrics))
    long = per_side.selectExpr(SIDE, f"inline(array({listed}))")

    paired = long.groupBy("id", "column", "metric", "rule", "counted").agg(*[
        F.expr(f"max(if({SIDE} = {flag}, {name}, NULL)) AS {name}_{tag}")
        for name in ("exact", "number", "scale") for tag, flag in (("b", BASELINE), ("k", CANDIDATE))])
    filled = paired.selectExpr(
        "id", "`column`", "metric", "rule", "scale_b", "scale_k",
        *[f"if(counted, coalesce(exact_{t}, '0'), exact_{t}) AS exact_{t}" for t in "bk"],
        *[f"if(counted, coalesce(number_{t}, 0D), number_{t}) AS number_{t}" for t in "bk"])
    same = (f"CASE rule WHEN 'sum' THEN {close_sums('number_b', 'number_k', 'greatest(scale_b, scale_k)', epsilon)} "
            f"WHEN 'close' THEN {close('number_b', 'number_k', epsilon)} ELSE exact_b <=> exact_k END")
    return filled.selectExpr("`column`", "metric", "number_b AS baseline", "number_k AS candidate",
                             f"{same} AS same")


def fingerprint_diff(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6,
                     distinct: str | None = "approx") -> DataFrame:
    """Only the metrics that disagree."""
    return compare_fingerprints(baseline, candidate, epsilon, distinct).where("NOT same")
