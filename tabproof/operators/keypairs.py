"""Rows of duplicated business keys, told apart one by one.

Where a key occurs several times, its rows have no partner by key alone. Equal rows of both sides are paired first,
whatever their order; of what remains, rows that agree in all exact columns are paired in the order of their numbers,
each with the earliest waiting row of the other side that is within the tolerance. The rest is the surplus.

Rows that agree in their exact columns go to one task by a hash and are streamed through in order. Where they are very
many they are sorted over many partitions instead: only a stretch of numbers each within the tolerance of the one before
stays together, and the task that has it streams through it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import isinf, isnan

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.floats import is_tolerant
from ..functions.hashing import has_map, ordered_maps
from ..functions.names import c, quoted
from ..session import checkpoint
from .running import greatest_before, running_max
from .sides import BASELINE, CANDIDATE, SIDE, SchemaMismatch, both_sides, rows_of, schema_problems, shared_fields

#: Open rows that agree in their exact columns which one task sorts; more are range-sorted over many.
TOGETHER = 100_000


def close_numbers(a, b, epsilon: float) -> bool:
    """Equal within the tolerance; null equals null, NaN equals NaN, an infinity itself."""
    if a is None or b is None:
        return a is b
    if isinstance(a, float) and (isnan(a) or isnan(b) or isinf(a) or isinf(b)):
        return a == b or isnan(a) and isnan(b)
    return abs(a - b) <= epsilon


def sweep(rows: Iterator[tuple], epsilon: float) -> Iterator[tuple[object, int, int]]:
    """Pairs rows ``(stretch, side, numbers, copies, row)`` that come in the order of stretch and numbers.

    Gives ``(row, paired, surplus)`` of every row. Waits hold only rows whose first number is within the tolerance of
    the present one.
    """
    waiting: dict[int, deque] = {0: deque(), 1: deque()}
    here = object()
    for stretch, side, numbers, copies, row in rows:
        if stretch != here:
            for queue in waiting.values():
                yield from ((r, p, n) for _, n, p, r in queue)
                queue.clear()
            here = stretch
        for queue in waiting.values():
            while queue and numbers[0] is not None and not close_numbers(queue[0][0][0], numbers[0], epsilon):
                _, n, p, r = queue.popleft()
                yield r, p, n
        left, done = copies, []
        for other in waiting[1 - side]:
            if not left:
                break
            if all(close_numbers(a, b, epsilon) for a, b in zip(other[0], numbers)):
                n = min(left, other[1])
                left, other[1], other[2] = left - n, other[1] - n, other[2] + n
                if not other[1]:
                    done.append(other)
        for other in done:
            waiting[1 - side].remove(other)
            yield other[3], other[2], 0
        if left:
            waiting[side].append([numbers, left, copies - left, row])
        else:
            yield row, copies, 0
    for queue in waiting.values():
        yield from ((r, p, n) for _, n, p, r in queue)


def stretched(open_rows: DataFrame, groups: list[str], numbers: list[str], epsilon: float) -> DataFrame:
    """Rows with ``__from``, the first number of the stretch that the row is in, range-sorted so that stretches stay together.

    Two range-sorted passes: the number before each row tells where a stretch starts, and the last start is carried along.
    """
    first = numbers[0]
    order = [*numbers, SIDE]
    before = greatest_before(open_rows, groups, order, c(first), "__previous")
    starts = F.when(F.col("__previous").isNull() | ~F.expr(f"coalesce({quoted(first)} - __previous <= {epsilon!r}D, false)"), c(first))
    marked = running_max(before.withColumn("__start", starts), groups, order, F.col("__start"), "__from")
    by = [*[quoted(g) for g in groups], "__from"]
    return marked.drop("__previous", "__start").repartitionByRange(*by).sortWithinPartitions(*by, *[quoted(n) for n in numbers], SIDE)


def paired_rows(baseline: DataFrame, candidate: DataFrame, keys: list[str], epsilon: float = 1e-6,
                strict_types: bool = True, together: int = TOGETHER) -> DataFrame:
    """Every distinct row of both sides: its columns, ``side``, ``paired`` and ``surplus`` copies.

    Exact columns must agree, float and decimal ones lie within ``epsilon``. Of several such columns, in alphabetic
    order, the first one leads. Maps come as sorted lists of their entries. Null keys are keys like others. More than
    ``together`` open rows with the same exact columns are range-sorted.
    """
    problems = schema_problems(baseline, candidate, strict_types)
    problems += [f"key column not found: {k}" for k in keys if k not in baseline.columns]
    if problems:
        raise SchemaMismatch("; ".join(problems))
    fields = shared_fields(baseline, candidate)
    sides = both_sides(baseline, candidate, [f.name for f in fields])
    for f in sides.schema.fields:
        if has_map(f.dataType):
            sides = sides.withColumn(f.name, ordered_maps(c(f.name), f.dataType))
    names = [f.name for f in fields]
    numbers = [f.name for f in fields if is_tolerant(f) and f.name not in keys] if epsilon else []
    counted = sides.groupBy(*[quoted(n) for n in names]).agg(
        *[F.expr(f"{rows_of(flag)} AS {n}") for flag, n in ((BASELINE, "__b"), (CANDIDATE, "__k"))])
    split = [f"struct({flag} AS {SIDE}, {n} AS __n, least(__b, __k) AS __equal)" for flag, n in ((BASELINE, "__b"), (CANDIDATE, "__k"))]
    each = checkpoint(counted.select(*[c(n) for n in names], F.expr(f"inline(array({', '.join(split)}))")).where("__n > 0"))
    shown = [*[c(n) for n in names], F.expr(f"if({SIDE} = {BASELINE}, 'baseline', 'candidate') AS side")]
    settled = each.where("__n = __equal" if numbers else "true").select(*shown, F.col("__equal").alias("paired"), (F.col("__n") - F.col("__equal")).alias("surplus"))
    if not numbers:
        return settled
    # Numbers without an order of their own agree exactly, as a part of the group.
    kinds = {f"__kind{i}": F.expr(f"CASE WHEN {quoted(n)} IS NULL THEN 1 WHEN isnan({quoted(n)}) THEN 2 WHEN abs({quoted(n)}) = double('inf') "
                                  f"THEN if({quoted(n)} > 0, 3, 4) ELSE 0 END" if not isinstance(sides.schema[n].dataType, T.DecimalType)
                                  else f"if({quoted(n)} IS NULL, 1, 0)") for i, n in enumerate(numbers)}
    groups = [n for n in names if n not in numbers] + list(kinds)
    same_group = F.xxhash64(*[c(g) for g in groups])  # groups of one hash only share a task
    open_rows = each.where("__n > __equal").withColumns(kinds).withColumn("__group", same_group)
    hot = checkpoint(open_rows.groupBy("__group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("__group"))
    few, many = open_rows, None
    if not hot.isEmpty():
        few = open_rows.join(hot, "__group", "left_anti")
        many = stretched(open_rows.join(hot, "__group", "left_semi").drop("__group"), groups, numbers, epsilon)
    ranged = few.repartition("__group").sortWithinPartitions(*[quoted(n) for n in [*groups, *numbers]], SIDE)
    out = T.StructType([*[sides.schema[n] for n in names], T.StructField("side", T.StringType()), T.StructField("paired", T.LongType()),
                        T.StructField("surplus", T.LongType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        held: dict[int, list] = {}  # batch, rows left, paired, surplus

        def rows():
            group, last = 0, None
            for b, batch in enumerate(batches):
                if not batch.num_rows:
                    continue
                at = {n: batch.column(n) for n in batch.schema.names}
                held[b] = [batch, batch.num_rows, [0] * batch.num_rows, [0] * batch.num_rows]
                ends = [[repr(at[g][i].as_py()) for g in groups] for i in (0, -1)]
                new = _changes([at[g] for g in groups])
                new[0] = ends[0] != last
                last = ends[1]
                value = list(zip(*(at[n].to_pylist() for n in numbers)))
                for i, (side, n, equal) in enumerate(zip(at[SIDE].to_pylist(), at["__n"].to_pylist(), at["__equal"].to_pylist())):
                    group += new[i]
                    yield group, side, value[i], n - equal, (b, i)

        for (b, i), paired, surplus in sweep(rows(), epsilon):
            waits = held[b]
            waits[1], waits[2][i], waits[3][i] = waits[1] - 1, paired, surplus
            if not waits[1]:
                batch, _, paired, surplus = held.pop(b)
                yield told(batch, paired, surplus)

    def told(batch, paired, surplus):
        side = pc.if_else(pc.equal(batch.column(SIDE), BASELINE), "baseline", "candidate")
        paired = pc.add(batch.column("__equal"), pa.array(paired, pa.int64()))
        columns = [*[batch.column(n) for n in names], side, paired, pa.array(surplus, pa.int64())]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    settled = settled.unionByName(ranged.mapInArrow(run, out))
    return settled if many is None else settled.unionByName(many.mapInArrow(run, out))


def _changes(columns: list[pa.Array]) -> list[bool]:
    """Whether each row differs from the one before in any of the columns; null equals null, NaN equals NaN."""
    n = len(columns[0])
    new = pa.array([False] * n)
    for x in columns:
        if pa.types.is_nested(x.type):
            text = [repr(v) for v in x.to_pylist()]
            other = pa.array([False, *[a != b for a, b in zip(text, text[1:])]])
        else:
            a, b = x.slice(0, n - 1), x.slice(1)
            other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
            if pa.types.is_floating(x.type):
                other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
            other = pa.concat_arrays([pa.array([False]), other])
        new = pc.or_(new, other)
    return new.to_pylist()


def key_pairs(baseline: DataFrame, candidate: DataFrame, keys: list[str], epsilon: float = 1e-6,
              strict_types: bool = True) -> DataFrame:
    """Every key that occurs several times on a side: rows of each side, ``paired`` rows and the surplus of each side."""
    rows = paired_rows(baseline, candidate, keys, epsilon, strict_types)
    total = lambda what, side: F.expr(f"sum(if(side = '{side}', {what}, 0L))")
    return rows.groupBy(*[quoted(k) for k in keys]).agg(
        total("paired + surplus", "baseline").alias("baseline_rows"), total("paired + surplus", "candidate").alias("candidate_rows"),
        total("paired", "baseline").alias("paired"), total("surplus", "baseline").alias("baseline_surplus"),
        total("surplus", "candidate").alias("candidate_surplus"),
    ).where("baseline_rows > 1 OR candidate_rows > 1")


def key_surplus(baseline: DataFrame, candidate: DataFrame, keys: list[str], epsilon: float = 1e-6,
                strict_types: bool = True) -> DataFrame:
    """The rows without a partner: their columns, ``side`` and ``surplus`` copies."""
    return paired_rows(baseline, candidate, keys, epsilon, strict_types).where("surplus > 0").drop("paired")
