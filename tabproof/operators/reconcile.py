"""Exact difference of two tables that differ little: what moves depends on the difference, not on the tables.

Every task adds its rows, +1 for the baseline and -1 for the candidate, into an invertible Bloom lookup table: three
cells a row, chosen by its hash, each a count and sums of hashes. Equal rows cancel out, wherever they are. The cells
that are left are peeled on the driver: a cell of one row names it, taking that row out of its other cells lays bare
more. Only the rows with the hashes found are then brought together and compared as whole rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.floats import rounded
from ..functions.hashing import has_map, ordered_maps, row_hash
from ..functions.names import c
from .multiset import multiset_diff_rows, net_rows, surplus_rows
from .sides import BASELINE, SIDE, SchemaMismatch, both_sides, schema_problems, shared_fields

#: Different rows that the cells are made for, and cells for each: three tables can be peeled up to a load of 0.81.
DIFFERENCES, ROOM = 10_000, 1.5
TABLES = 3
# A hash is added up in limbs, so that 2**41 rows stay within a long.
LIMB_BITS, LIMBS = 22, 3
_LOW, _HALF = (1 << LIMB_BITS) - 1, (1 << 31) - 1
_NAMES = ("h1", "h2", "h3")


def _limbs(value: str) -> list[str]:
    return [f"({value} & {_LOW}L)", f"(shiftright({value}, {LIMB_BITS}) & {_LOW}L)", f"shiftright({value}, {2 * LIMB_BITS})"]


def hashed_sides(baseline: DataFrame, candidate: DataFrame, epsilon: float) -> DataFrame:
    """Both sides with two hashes of the normalised row and their product, which tells sums of rows from rows."""
    fields = shared_fields(baseline, candidate)
    sides = both_sides(baseline, candidate, [f.name for f in fields])
    maps = {f.name: f"__map{i}" for i, f in enumerate(sides.schema.fields) if has_map(f.dataType)}
    plain = sides.withColumns({maps[f.name]: ordered_maps(c(f.name), f.dataType) for f in sides.schema.fields if f.name in maps})
    # A null hashes to a constant, where hashing several columns at once would skip it.
    values = [f"xxhash64({rounded(maps.get(f.name, f.name), f.dataType, epsilon)})" for f in sides.schema.fields if f.name != SIDE]
    hashes = plain.selectExpr("*", f"{row_hash([*values, '1L'])} AS __h1", f"{row_hash([*values, '2L'])} AS __h2")
    hashes = hashes.selectExpr("*", f"(__h1 & {_HALF}L) * (__h2 & {_HALF}L) AS __h3")
    return hashes


def cells(hashed: DataFrame, size: int) -> DataFrame:
    """(cell, n, and the limbs of three sums) of the lookup table with ``size`` cells in each of its parts, without those
    in which all is 0. A task passes on at most one row a cell, whatever it has read."""
    at = [f"pmod(__h1, {size}L)", f"{size}L + pmod(__h2, {size}L)", f"{2 * size}L + pmod(__h1 ^ shiftright(__h2, 17), {size}L)"]
    placed = hashed.selectExpr(f"if({SIDE} = {BASELINE}, 1L, -1L) AS w", "__h1", "__h2", "__h3", f"explode(array({', '.join(at)})) AS cell")
    sums = ["sum(w) AS n"] + [f"sum(w * {limb}) AS {name}_{i}" for name in _NAMES for i, limb in enumerate(_limbs(f"__{name}"))]
    grouped = placed.groupBy("cell").agg(*[F.expr(s) for s in sums])
    return grouped.where(" OR ".join(f"{n} <> 0" for n in grouped.columns[1:]))


def peel(rows: list, size: int) -> dict[tuple[int, int], int] | None:
    """The rows left in the cells, as pairs of hashes with the signed number of copies; None if they don't come apart."""
    held = {}
    for r in rows:
        limbs = [sum(r[f"{name}_{i}"] << (LIMB_BITS * i) for i in range(LIMBS)) for name in _NAMES]
        held[r["cell"]] = [r["n"], *limbs]

    def places(h1: int, h2: int) -> list[int]:
        return [h1 % size, size + h2 % size, 2 * size + (h1 ^ (h2 >> 17)) % size]

    found: dict[tuple[int, int], int] = {}
    waiting = list(held)
    while waiting:
        cell = waiting.pop()
        n, a, b, product = held.get(cell, (0, 0, 0, 0))
        if not n or a % n or b % n:
            continue
        h1, h2 = a // n, b // n
        # Sums of several rows pass for one row with a chance of 2**-60 or so.
        if product != n * (h1 & _HALF) * (h2 & _HALF) or cell not in places(h1, h2):
            continue
        found[h1, h2] = found.get((h1, h2), 0) + n
        for at in places(h1, h2):
            own = held.setdefault(at, [0, 0, 0, 0])
            for i, x in enumerate((n, n * h1, n * h2, product)):
                own[i] -= x
            if any(own):
                waiting.append(at)
            else:
                del held[at]
    return None if held else {k: n for k, n in found.items() if n}


@dataclass(frozen=True)
class Reconciled:
    """``rows`` as :func:`multiset_diff_rows` gives them; ``peeled``: whether the cells came apart; ``different``: how many hashes."""

    rows: DataFrame
    peeled: bool
    different: int | None


def reconcile(baseline: DataFrame, candidate: DataFrame, epsilon: float = 1e-6, differences: int = DIFFERENCES,
              strict_types: bool = True) -> Reconciled:
    """The surplus rows of both sides: their columns, ``surplus_side`` and ``surplus_rows``.

    Made for up to ``differences`` different rows, of which any number may be copies. Each table is read twice, but only
    the cells and the rows that differ are shuffled; the cells, a number set by ``differences``, pass the driver. With more
    differences the cells don't come apart, and the signed pass over all rows gives the same result. A difference is lost only
    where two different rows agree in 128 bits of hashes; :func:`multiset_diff` is the proof.
    """
    problems = schema_problems(baseline, candidate, strict_types)
    if problems:
        raise SchemaMismatch("; ".join(problems))
    size = max(64, int(differences * ROOM / TABLES))
    hashed = hashed_sides(baseline, candidate, epsilon)
    found = peel(cells(hashed, size).collect(), size)
    if found is None:
        return Reconciled(multiset_diff_rows(baseline, candidate, epsilon, strict_types), False, None)
    names = [f.name for f in shared_fields(baseline, candidate)]
    wanted = baseline.sparkSession.createDataFrame(sorted({(h,) for h, _ in found}), "__h long")
    rows = hashed.join(F.broadcast(wanted), F.col("__h1") == F.col("__h"), "left_semi").select(SIDE, *[c(n) for n in names])
    return Reconciled(surplus_rows(net_rows(rows, epsilon)), True, len(found))
