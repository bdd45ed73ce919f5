"""Differences between table shapes: columns, types, nulls, and the read/write contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import literal, quoted
from .sides import BASELINE, CANDIDATE, SIDE, of_side


def schema_diff(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Every column of either table: type and null count on each side, and a ``status``.

    Files declare every column nullable, so nullability is taken from the data:
    each side is read once, counting nulls. ``status`` is ``only_baseline``,
    ``only_candidate``, ``type_changed``, ``nulls_appeared`` or ``same``.
    """
    left = {f.name: f.dataType.simpleString() for f in baseline.schema.fields}
    right = {f.name: f.dataType.simpleString() for f in candidate.schema.fields}
    names = sorted(left.keys() | right.keys())

    def nulls(df: DataFrame, flag: int, types: dict[str, str]) -> DataFrame:
        return df.agg(F.expr(f"{flag} AS {SIDE}"), *[
            F.expr(f"{f'count_if({quoted(n)} IS NULL)' if n in types else 'bigint(NULL)'} AS n{i}")
            for i, n in enumerate(names)])

    both = nulls(baseline, BASELINE, left).unionByName(nulls(candidate, CANDIDATE, right))
    one = both.agg(*[
        F.expr(f"max({of_side(flag, f'n{i}')}) AS {tag}{i}")
        for i in range(len(names)) for tag, flag in (("b", BASELINE), ("k", CANDIDATE))])

    def status(i: int, name: str) -> str:
        if name not in right:
            return "'only_baseline'"
        if name not in left:
            return "'only_candidate'"
        if left[name] != right[name]:
            return "'type_changed'"
        return f"if(b{i} = 0 AND k{i} > 0, 'nulls_appeared', 'same')"

    def text(value: str | None) -> str:
        return "string(NULL)" if value is None else literal(value)

    listed = ", ".join(
        f"named_struct('column', {literal(n)}, 'baseline_type', {text(left.get(n))}, "
        f"'candidate_type', {text(right.get(n))}, 'baseline_nulls', b{i}, 'candidate_nulls', k{i}, "
        f"'status', {status(i, n)})"
        for i, n in enumerate(names))
    return one.selectExpr(f"inline(array({listed}))")


def contract_diff(details: DataFrame, allow_new: bool = False) -> DataFrame:
    """Whether a candidate asks more of its readers and writers than the baseline.

    ``details`` holds ``(table_name, side, reader, writer, features)`` with side
    ``baseline`` or ``candidate``. A missing version counts as 1, missing
    features as none; of several rows of a side, the highest versions and all
    features count. One row per table: both versions, ``added_features``,
    ``passed`` and ``reason``. A table that lacks the row of a side is blocked,
    as nothing is known of it; ``allow_new`` lets one without a baseline pass.
    """
    def of(side: str, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("side") == side, F.col(name))), F.lit(1))

    def features(side: str) -> Column:
        return F.array_distinct(F.flatten(F.collect_set(F.when(F.col("side") == side, F.col("features")))))

    wide = details.groupBy("table_name").agg(
        *[F.count_if(F.col("side") == side).alias(f"{side}s") for side in ("baseline", "candidate")],
        *[of(side, name).alias(f"{side}_{name}")
          for name in ("reader", "writer") for side in ("baseline", "candidate")],
        *[features(side).alias(f"{side}_features") for side in ("baseline", "candidate")],
    )
    added = F.array_sort(F.array_except("candidate_features", "baseline_features"))
    raised = (
        (F.col("candidate_reader") > F.col("baseline_reader"))
        | (F.col("candidate_writer") > F.col("baseline_writer"))
        | (F.size("added_features") > 0)
    )
    reason = (
        F.when(F.col("candidates") == 0, "no candidate row")
        .when((F.col("baselines") == 0) & F.lit(not allow_new), "no baseline row")
        .when((F.col("baselines") > 0) & raised, "needs a newer reader, writer or feature"))
    return wide.withColumn("added_features", added).withColumn("reason", reason).select(
        "table_name", "baseline_reader", "candidate_reader", "baseline_writer", "candidate_writer",
        "added_features", F.col("reason").isNull().alias("passed"), "reason")


def require_contract(details: DataFrame) -> None:
    """Stop when any candidate raises the contract, naming the tables."""
    broken = contract_diff(details).where(~F.col("passed"))
    count = broken.count()
    if count:
        names = [r.table_name for r in broken.select("table_name").orderBy("table_name").limit(20).collect()]
        raise ValueError(f"contract raised on {count} table(s), among them {names}")
