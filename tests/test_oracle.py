"""Every registered query against its SQL twin."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TYPES, bag

from .conftest import SF_DIR

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    result = duck.execute(ORACLES[name])
    types = {d[0]: str(d[1]) for d in result.description}
    assert {n: TYPES[t] for n, t in df.dtypes} == types
    assert rows
    assert bag(df.columns, rows) == bag(list(types), result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).columns == ["target", "check", "passed", "baseline", "candidate", "reason"]
