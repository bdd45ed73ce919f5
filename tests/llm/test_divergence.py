import re
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import pytest

from tabproof.llm import divergence
from tabproof.llm.divergence import PerfectHash, Shard, shares, source_divergence, together
from tabproof.llm.queries import QUERIES
from tests.conftest import SF_DIR

from .conftest import EDGES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, least=10, top=10):
    """rows: (lang, source, text), nulls as None."""
    rows = [tuple(x or "" for x in r) for r in rows]
    used = [(lang, source, re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(LOWER))) for lang, source, t in rows]
    found, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in used:
        sources[lang].add(source)
        found[lang].update(set(words))
        count[lang, source].update(words)
    out = []
    for lang, own in sources.items():
        kept = sorted((w for w, n in found[lang].items() if n >= least), key=str.encode)

        def share(n, kept=kept):
            total = sum(n[w] for w in kept)
            return {w: 1 + 10 ** 9 * (n[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: share(count[lang, s]) for s in own}
        q = share(sum((count[lang, s] for s in own), Counter()))
        for s in own:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o.encode(), o) for o in own if o != s]
            term = [(-((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])), w.encode(), w) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, values, most in (("pair", pair, None), ("term", term, top)):
                out.extend((lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(sorted(values)[:most], 1))
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    assert found(QUERIES["op12_source_divergence"](spark, SF_DIR)) == brute_force(rows)


def test_bounds_change_nothing(spark, monkeypatch):
    """Many small shards, broadcasts, blocks and arrays that are passed on early."""
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    for name, value in (("HELD", 50), ("HELD_SLOTS", 60), ("BLOCK", 7)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence.shards, "__defaults__", (20,))
    monkeypatch.setattr(divergence.recount, "__defaults__", (3000,))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(5)
    assert found(source_divergence(docs, least=3, top=2)) == brute_force(rows, 3, 2)


def test_edges(spark, edges, nothing):
    rows = [(lang, "s", t) for _, t, lang in EDGES]
    assert found(source_divergence(edges, least=2)) == brute_force(rows, 2)
    assert source_divergence(nothing).collect() == []
    more = [("en", "a", "Äb äb AB ab\x00cd é1é"), ("en", None, "ab é"), (None, "a", None), (None, "b", ""), (None, "", "x"), ("de", "a", "x ab")] * 2
    more += [("en", "a", "zz yy xx ww " * 4000)] * 2
    df = spark.createDataFrame([(*r, 1, "clash") for r in more], "lang string, source string, text string, slot int, item string").repartition(3)
    assert found(source_divergence(df, least=2, top=2)) == brute_force(more, 2, 2)
    assert [r for r in brute_force(more, 2, 2) if r[0] == "" and r[2] == "pair"]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 5000])
def test_perfect_hash(n):
    keys = sorted({f"w{i * 7919 % 100003}é{i}".encode() for i in range(n)})
    h = PerfectHash(keys)
    ends = np.array([0, *accumulate(map(len, keys))], np.int32)
    shard = Shard(h.salt, h.displaced.tobytes(), h.rank.tobytes(), b"".join(keys), ends.tobytes())
    assert [shard.find(k) for k in keys] == list(range(n))  # minimal, and in the order of the keys
    assert sorted(h.rank.tolist()) == list(range(n))
    assert all(shard.find(k) is None for k in [b"", b"x", *[k + b"x" for k in keys], *[k[:-1] for k in keys[:5]]] if k not in set(keys))


def test_shares_are_exact():
    n = np.array([0, 1, 5, 2 * 10 ** 10])
    assert shares(n, int(n.sum()), 3).tolist() == [1 + 10 ** 9 * (int(x) + 2) // (int(n.sum()) + 6) for x in n]
    assert list(together([5, 5, 5, 20, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]
