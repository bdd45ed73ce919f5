import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check import TABLES  # noqa: E402
from tabproof.session import local_session, new_folder  # noqa: E402
from workload.views import Views  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    return Views(spark, SF_DIR)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return connection


@pytest.fixture
def folder(spark):
    return new_folder(spark, "test")


def shuffled_rows(df) -> int:
    """Rows that left the tasks through shuffles while ``df`` was computed, as its plan counted them."""
    df.collect()

    def of(plan):
        name = plan.nodeName()
        inner = [plan.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [plan.plan()] if name.endswith("QueryStage") else []
        children = plan.children()
        own = plan.metrics().get("shuffleRecordsWritten")
        return (own.get().value() if own.isDefined() else 0) + sum(of(children.apply(i)) for i in range(children.size())) + sum(map(of, inner))

    return of(df._jdf.queryExecution().executedPlan())
