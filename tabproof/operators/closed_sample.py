"""Samples of several tables that hold together: every sampled row's parents are sampled too."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import in_sample
from ..functions.names import c
from ..session import checkpoint


@dataclass(frozen=True)
class Reference:
    """Columns of a child table that name a row of the parent table by its ``parent_columns``."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


def _rounds(tables: Mapping, references: list[Reference]) -> list[set[str]]:
    """Tables in an order in which children come before parents; those on a common cycle together."""
    above = {t: {r.parent for r in references if r.child == t} for t in tables}

    def reached(start: str) -> set[str]:
        seen, waiting = set(), [start]
        while waiting:
            for t in above[waiting.pop()] - seen:
                seen.add(t)
                waiting.append(t)
        return seen

    reach = {t: reached(t) for t in tables}
    groups = [{t, *(u for u in reach[t] if t in reach[u])} for t in tables]
    out: list[set[str]] = []
    while len(set().union(*out)) < len(tables):
        done = set().union(*out)
        # Next is a group that no other waiting table refers to.
        out.append(next(g for g in groups if not g & done and not any(reach[t] & g for t in tables if t not in done | g)))
    return out


def closed_sample(tables: Mapping[str, DataFrame], references: list[Reference], sampled: Mapping[str, list[str]], percent: float,
                  seed: int = 42) -> dict[str, DataFrame]:
    """Rows of each table: those whose key is in the sample, for the tables of ``sampled`` (their key columns), and all rows
    that a row taken refers to, until nothing is added.

    Tables are settled one after the other, children first, each by one semi-join for each reference to it; only tables
    on a cycle of references, or one that refers to itself, take rounds, as many as its longest chain. Keys that rows
    refer to are made distinct first, so a parent that most rows share crosses the shuffle once a task. A reference with a null
    column names nothing; one without its parent in the table stays as it is. Rows that are equal stay as many as they are.
    """
    unknown = sorted({t for r in references for t in (r.child, r.parent)} | set(sampled) - set(tables))
    unknown = [t for t in unknown if t not in tables]
    if unknown:
        raise ValueError(f"unknown tables: {unknown}")
    taken: dict[str, DataFrame] = {}
    for group in _rounds(tables, references):
        here = [r for r in references if r.child in group and r.parent in group]
        for t in group:
            wanted = [_named(taken[r.child], r) for r in references if r.parent == t and r.child not in group]
            own = in_sample([c(k) for k in sampled[t]], percent, seed) if t in sampled else F.lit(False)
            taken[t] = _marked(tables[t], own, wanted, [r for r in references if r.parent == t and r.child not in group])
            if here:
                taken[t] = checkpoint(taken[t])
        while here:
            counts = {t: taken[t].count() for t in group}
            for t in group:
                inside = [r for r in here if r.parent == t]
                if inside:
                    more = [_named(taken[r.child], r) for r in inside] + [_whole(taken[t])]
                    taken[t] = checkpoint(_marked(tables[t], F.lit(False), more, [*inside, None]))
            if counts == {t: taken[t].count() for t in group}:
                break
    return taken


def _named(rows: DataFrame, r: Reference) -> DataFrame:
    """The keys that rows refer to."""
    keys = rows.select(*[c(n).alias(f"__k{i}") for i, n in enumerate(r.columns)])
    return keys.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in keys.columns])).distinct()


def _whole(rows: DataFrame) -> DataFrame:
    return rows.select(*[c(n).alias(f"__k{i}") for i, n in enumerate(rows.columns)]).distinct()


def _marked(table: DataFrame, own: Column, wanted: list[DataFrame], references: list) -> DataFrame:
    """Rows of a table for which ``own`` holds or whose key is in one of the frames."""
    rows, marks = table, [F.coalesce(own, F.lit(False))]
    for j, (keys, r) in enumerate(zip(wanted, references)):
        columns = table.columns if r is None else r.parent_columns
        keys = keys.withColumnsRenamed({f"__k{i}": f"__w{j}_{i}" for i in range(len(columns))}).withColumn(f"__m{j}", F.lit(True))
        same = reduce(lambda a, b: a & b, [(c(n).eqNullSafe(F.col(f"__w{j}_{i}")) if r is None else c(n) == F.col(f"__w{j}_{i}"))
                                           for i, n in enumerate(columns)])
        rows = rows.join(keys, same, "left")
        marks.append(F.col(f"__m{j}").isNotNull())
    return rows.where(reduce(or_, marks)).select(*[c(n) for n in table.columns])
