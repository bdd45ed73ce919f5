"""Aggregates kept up to date under additions, deletions and updates.

Changes are rows with a sign: an added row weighs +1, a deleted one -1, an update is its old row deleted and its new
one added. Counts and sums follow by arithmetic. A minimum and a maximum are stored with the number of rows that hold
them; only a group whose extreme lost its last row, with nothing beyond it added, is computed again from the table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import c, quoted
from ..session import checkpoint
from ..sources.storage import refuse_rows

SIGN = "__sign"
#: Groups up to this number, which are counted, go to every task when the table is read for them.
BROADCAST_GROUPS = 100_000


def signed(added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Changes as rows with a sign. At least one of the two frames is needed."""
    parts = [df.withColumn(SIGN, F.lit(weight).cast("bigint")) for df, weight in ((added, 1), (deleted, -1)) if df is not None]
    return reduce(DataFrame.unionByName, parts)


def _names(out: str) -> dict[str, str]:
    return {kind: quoted(f"{out}_{kind}") for kind in ("count", "sum", "min", "min_copies", "max", "max_copies")}


def aggregate_with_copies(df: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """The stored form: keys, ``rows`` and for each measure its count, sum, min, min_copies, max and max_copies.

    ``measures`` maps output prefixes to SQL expressions whose sums are exact (integers or decimals). Two levels of
    groups, values first, so that a key with most of the rows is combined inside the tasks.
    """
    changes = df.withColumn(SIGN, F.lit(1).cast("bigint"))
    return _brought_up(None, changes, keys, measures).drop("__lost")


def _brought_up(stored: DataFrame | None, changes: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """One row a group with ``__lost``: whether an extreme is no longer known.

    Values are netted first: by group, measure and value, the rows that came less those that went. The stored extremes
    take part with their copies, marked, so that what is left of them is a sum like any other and nothing is joined.
    """
    names = [quoted(k) for k in keys]
    outs = list(measures)
    # A long form with one column for each measure, so that every value keeps its type.
    values = changes.select(*names, SIGN, *[F.expr(e).alias(f"__v{i}") for i, e in enumerate(measures.values())])
    types = {f.name: f.dataType.simpleString() for f in values.schema.fields}

    def line(i: int, value: str, n: str, low: str, high: str) -> str:
        own = ", ".join(f"{value if i == j else f'cast(NULL AS {types[f'__v{j}']})'} AS __v{j}" for j in range(len(outs)))
        return f"struct({i} AS __m, {own}, {n} AS __n, {low} AS __low, {high} AS __high)"

    lines = ", ".join(line(i, f"__v{i}", SIGN, "false", "false") for i in range(len(outs)))
    long = values.select(*names, F.expr(f"inline(array({lines}))")) if outs else None
    counted = values.select(*names, F.col(SIGN).alias("__rows"))
    if stored is not None and outs:
        held = []
        for i, out in enumerate(outs):
            n = _names(out)
            held.append(line(i, n["min"], f"coalesce({n['min_copies']}, 0L)", "true", "false"))
            # A group of one value counts its rows once.
            held.append(line(i, n["max"], f"if({n['max']} <=> {n['min']}, 0L, coalesce({n['max_copies']}, 0L))", "false", "true"))
        long = long.unionByName(stored.select(*names, F.expr(f"inline(array({', '.join(held)}))")))
    nets = counted.groupBy(*names).agg(F.sum("__rows").alias("__rows"))
    parts = [nets]
    if stored is not None:
        parts.append(stored.select(*names, F.col("rows").alias("__rows"), *[
            F.expr(f"{_names(out)[kind]} AS __{kind}{i}") for i, out in enumerate(outs) for kind in ("count", "sum")]))
    if outs:
        columns = [f"__v{i}" for i in range(len(outs))]
        parts.append(long.groupBy(*names, "__m", *columns).agg(
            F.sum("__n").alias("__n"), F.sum(F.expr("if(__low OR __high, 0L, __n)")).alias("__change"),
            F.max("__low").alias("__low"), F.max("__high").alias("__high")))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for i in range(len(outs)) if stored is None else ():
        rows = rows.withColumns({f"__count{i}": F.lit(0).cast("bigint"), f"__sum{i}": F.lit(None).cast(types[f"__v{i}"])})
    aggregates = [F.expr("sum(__rows) AS `rows`")]
    for i, out in enumerate(outs):
        n, v, mine = _names(out), f"__v{i}", f"__m = {i} AND __v{i} IS NOT NULL"
        total = f"sum(if({mine}, __change * {v}, NULL))"
        aggregates += [F.expr(x) for x in (
            f"coalesce(sum(__count{i}), 0L) + coalesce(sum(if({mine}, __change, 0L)), 0L) AS {n['count']}",
            f"coalesce(sum(__sum{i}) + {total}, sum(__sum{i}), {total}) AS {n['sum']}",
            f"min(if({mine} AND __n > 0, struct({v} AS v, __n AS n), NULL)) AS __least{i}",
            f"max(if({mine} AND __n > 0, struct({v} AS v, __n AS n), NULL)) AS __most{i}",
            f"max(if({mine} AND __low, {v}, NULL)) AS __low{i}", f"max(if({mine} AND __high, {v}, NULL)) AS __high{i}")]
    grouped = rows.groupBy(*names).agg(*aggregates)
    kinds = {f"{out}_sum": (stored.schema[f"{out}_sum"].dataType.simpleString() if stored is not None else None) for out in outs}
    shown, lost = [], []
    for i, out in enumerate(outs):
        n = _names(out)
        total = n["sum"] if kinds[f"{out}_sum"] is None else f"cast({n['sum']} AS {kinds[f'{out}_sum']})"
        shown += [F.expr(x) for x in (
            n["count"], f"if({n['count']} = 0, NULL, {total}) AS {n['sum']}",
            f"__least{i}.v AS {n['min']}", f"__least{i}.n AS {n['min_copies']}",
            f"__most{i}.v AS {n['max']}", f"__most{i}.n AS {n['max_copies']}")]
        lost.append(f"({n['count']} > 0 AND (__low{i} IS NOT NULL AND coalesce(__least{i}.v > __low{i}, true) "
                    f"OR __high{i} IS NOT NULL AND coalesce(__most{i}.v < __high{i}, true)))")
    return grouped.select(*names, "rows", *shown, F.expr(" OR ".join(lost) or "false").alias("__lost"))


def same_keys(keys: list[str]) -> Column:
    return reduce(and_, [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])


def apply_changes(stored: DataFrame, changes: DataFrame, keys: list[str], measures: dict[str, str],
                  current: DataFrame) -> DataFrame:
    """The stored aggregate brought up to date; equal to :func:`aggregate_with_copies` over ``current``.

    ``changes`` has the table's columns and a sign (:func:`signed`); ``current`` is the table after them, read only
    for the groups that lost an extreme. A group without rows is left out. Deleting rows that were never there is an
    error where it shows: a group with less than no rows or values.
    """
    merged = checkpoint(_brought_up(stored, changes, keys, measures))
    counts = [quoted(f"{out}_count") for out in measures]
    refuse_rows(merged.where(" OR ".join(f"{n} < 0" for n in ["`rows`", *counts])).select(*[quoted(k) for k in keys], "rows"),
                "more rows deleted than there were")
    lost = merged.where("__lost").select(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    settled = merged.where("NOT __lost AND `rows` > 0").drop("__lost")
    n = lost.count()
    if not n:
        return settled
    side = F.broadcast(lost) if n <= BROADCAST_GROUPS else lost
    again = aggregate_with_copies(current.join(side, same_keys(keys), "left_semi"), keys, measures)
    return settled.unionByName(again)
