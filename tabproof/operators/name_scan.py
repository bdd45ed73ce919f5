"""Many names looked for in many texts: one pass over each text, whatever the number of names.

Every task builds an Aho-Corasick automaton of the names and runs the texts of its Arrow batches through it. Neither
words nor parts of them leave the task, only the names found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.names import c, quoted

#: Characters of names and of what they stand for that one automaton holds; a longer list is looked for in parts.
AUTOMATON = 4_000_000
#: Texts of a batch that become Python objects together.
TEXTS = 256

_WORD = r"(?U)\w"


@lru_cache(maxsize=2)
def automaton(names: tuple[str, ...]) -> ahocorasick.Automaton:
    """Kept by a Python worker for its next task with the same names."""
    built = ahocorasick.Automaton()
    for i, name in enumerate(names):
        built.add_word(name, (i, len(name)))
    built.make_automaton()
    return built


def _plain(char: str) -> bool:
    """Sure not to belong to a word; characters beyond ASCII are left to the JVM."""
    return not char or (char.isascii() and not (char.isalnum() or char == "_"))


def found_in(text: str, names: ahocorasick.Automaton, whole_word: bool) -> Iterator[tuple[int, str, str]]:
    """Each name's number, with the different pairs of characters around it if ``whole_word`` leaves them open."""
    if not whole_word:
        yield from ((i, "", "") for i in {i for _, (i, _) in names.iter(text)})
        return
    around: dict[int, set | None] = {}  # None: stands alone somewhere
    for end, (i, length) in names.iter(text):
        if around.get(i, ...) is None:
            continue
        before, after = text[max(0, end - length):end - length + 1], text[end + 1:end + 2]
        if _plain(before) and _plain(after):
            around[i] = None
        elif not (before.isascii() and not _plain(before) or after.isascii() and not _plain(after)):
            around.setdefault(i, set()).add((before, after))
    for i, pairs in around.items():
        yield from ((i, *p) for p in pairs or [("", "")])


def _scan(rows: DataFrame, text: str, names: list[tuple[str, str]], key: str, whole_word: bool) -> DataFrame:
    """``names``: pairs of a name and what it stands for."""
    wanted: dict[str, list[str]] = {}
    for name, stands_for in names:
        wanted.setdefault(name, []).append(stands_for)
    listed, values = tuple(wanted), list(wanted.values())
    if not listed:
        return rows.drop(text).withColumn(key, F.lit(None).cast("string")).where("false")
    kept = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept] + [f"{quoted(key)} string", "__before string", "__after string"])

    def run(batches):
        names = automaton(listed)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part in (batch.slice(i, TEXTS) for i in range(0, batch.num_rows, TEXTS)):
                line, found = [], []
                for i, t in enumerate(part.column(at).to_pylist()):
                    for n, before, after in found_in(t, names, whole_word) if t else ():
                        for value in values[n]:
                            line.append(i)
                            found.append((value, before, after))
                if line:
                    columns = [part.column(f.name).take(pa.array(line)) for f in kept]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.string()) for x in zip(*found)],
                                                     names=[f.name for f in kept] + [key, "__before", "__after"])

    scanned = rows.mapInArrow(run, schema)
    if whole_word:
        scanned = scanned.where(~F.rlike("__before", F.lit(_WORD)) & ~F.rlike("__after", F.lit(_WORD)))
    return scanned.drop("__before", "__after")


def rows_naming(rows: DataFrame, text: str, names: DataFrame, name: str, key: str, whole_word: bool = False,
                most: int = AUTOMATON) -> DataFrame:
    """``rows`` without ``text``, beside ``key`` of every row of ``names`` whose ``name`` the text contains.

    Letters count as they are, so both sides should be lowered. With ``whole_word``, no letter, digit, mark or underscore may
    touch the name; a row then comes once for each different surrounding, so callers that need each pair once take
    distinct rows. Null texts and empty or null names have no match. The list of names passes the driver in parts of
    some ``most`` characters, and the texts are read once a part.
    """
    listed = names.select(c(name).alias("name"), c(key).cast("string").alias("key")).where("name <> ''").distinct()
    size = listed.agg(F.coalesce(F.sum(F.length("name") + F.length("key")), F.lit(0))).first()[0]
    parts = -(-size // most)
    if parts <= 1:
        return _scan(rows, text, [tuple(r) for r in listed.collect()], key, whole_word)
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    return reduce(DataFrame.unionByName, [
        _scan(rows, text, [tuple(r) for r in listed.where(part == i).collect()], key, whole_word) for i in range(parts)])
