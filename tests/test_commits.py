"""Writers that meet, and writers that die."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from tabproof import Registry, SnapshotStore
from tabproof.sources import commits
from tabproof.sources.commits import CommitConflict, CommittedTable, Log
from tabproof.sources.registry import REGISTRY_SCHEMA
from tabproof.sources.storage import evolve

SCHEMA = T.StructType([T.StructField("p", T.StringType()), T.StructField("x", T.LongType())])


def together(jobs):
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def found(df):
    return sorted((str(r.p), r.x) for r in df.collect())


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMA)


def test_a_number_is_given_once(spark, folder):
    log = Log(spark, folder)
    assert log.last() is None
    won = together([lambda i=i: log.put(0, {"writer": i}) for i in range(8)])
    assert sum(won) == 1 and log.get(0) == {"writer": won.index(True)}
    assert log.last() == 0 and not [n for n in log.files.names(folder) if n.startswith(".") and not n.endswith(".crc")]


def test_versions_stay_readable(spark, folder):
    table = CommittedTable(spark, folder, SCHEMA, "p")
    assert table.read().collect() == [] and table.read().schema == SCHEMA
    table.append(rows(spark, ("a", 1), ("b", 2), (None, 3)))
    before = table.read()
    table.append(rows(spark, ("a", 4)))
    table.replace(rows(spark, ("b", 5), (None, 6)))
    table.drop({"p=a"})
    assert found(before) == found(table.read(0)) == [("None", 3), ("a", 1), ("b", 2)]
    assert found(table.read(1)) == [("None", 3), ("a", 1), ("a", 4), ("b", 2)]
    assert found(table.read(2)) == [("None", 6), ("a", 1), ("a", 4), ("b", 5)]
    assert found(table.read()) == [("None", 6), ("b", 5)]
    assert [m.operation for m in table.history()] == ["append", "append", "replace", "drop"]
    assert table.expire() == 2 and found(table.read()) == [("None", 6), ("b", 5)]


def test_a_table_without_partitions(spark, folder):
    table = CommittedTable(spark, folder, SCHEMA)
    table.append(rows(spark, ("a", 1)))
    table.append(rows(spark, ("a", 2)))
    assert found(table.read()) == [("a", 1), ("a", 2)]
    table.change(lambda df: df.withColumn("x", F.col("x") * 10))
    table.replace(table.read().where("x > 10"))
    assert found(table.read()) == [("a", 20)]


def test_writers_at_once_lose_nothing(spark, folder):
    table = CommittedTable(spark, folder, SCHEMA, "p")
    table.append(rows(spark, ("a", 0), ("b", 0)))
    add = lambda n, p: lambda: table.change(lambda df: df.where(F.col("p") == p).withColumn("x", F.col("x") + n))
    together([add(1, "a"), add(10, "a"), add(100, "a"), add(1000, "b"), lambda: table.append(rows(spark, ("c", 7)))])
    assert found(table.read()) == [("a", 111), ("b", 1000), ("c", 7)]
    assert len(table.history()) == 6


def test_a_killed_writer_leaves_the_last_version(spark, folder, monkeypatch):
    table = CommittedTable(spark, folder, SCHEMA, "p")
    table.append(rows(spark, ("a", 1)))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(commits.Log, "put", killed)  # all data written, nothing claimed
        with pytest.raises(KeyboardInterrupt):
            table.replace(rows(spark, ("a", 2)))
    with monkeypatch.context() as patched:
        patched.setattr(commits.Files, "claim", killed)  # the manifest written, not yet under its name
        with pytest.raises(KeyboardInterrupt):
            table.append(rows(spark, ("a", 3)))
    with pytest.raises(Exception, match="Division|divide|DIVIDE"):
        table.replace(rows(spark, ("a", 2)).withColumn("x", F.expr("x div (x - 2)")))  # no data written
    assert found(table.read()) == [("a", 1)] and len(table.history()) == 1
    table.append(rows(spark, ("a", 4)))
    assert found(table.read()) == [("a", 1), ("a", 4)]


def test_giving_up(spark, folder, monkeypatch):
    table = CommittedTable(spark, folder, SCHEMA)
    table.append(rows(spark, ("a", 1)))
    monkeypatch.setattr(commits, "ATTEMPTS", 2)
    other = CommittedTable(spark, folder, SCHEMA)

    def disturbed(df):
        other.append(rows(spark, ("b", 1)))
        return df

    with pytest.raises(CommitConflict, match="2 times"):
        table.change(disturbed)
    assert found(table.read()) == [("a", 1), ("b", 1), ("b", 1)]


def test_statuses_set_at_once(spark, folder):
    registry = Registry(spark, folder)
    base = spark.range(6).selectExpr("concat('job_', id % 2) AS job_name", "concat('/nb/', id) AS notebook_path", "'pending' AS status")
    registry.sync(evolve(base, REGISTRY_SCHEMA))
    one = lambda i, status: lambda: registry.set_status(base.where(f"notebook_path = '/nb/{i}'").withColumn("status", F.lit(status)))
    together([one(0, "approved"), one(2, "blocked"), one(4, "promoted"), one(1, "skipped")])
    assert {r.notebook_path: r.status for r in registry.read().collect()} == {
        "/nb/0": "approved", "/nb/2": "blocked", "/nb/4": "promoted", "/nb/1": "skipped", "/nb/3": "pending", "/nb/5": "pending"}
    assert {r.status for r in registry.read(0).collect()} == {"pending"}


def test_snapshots_committed_at_once(spark, folder):
    store = SnapshotStore(spark, folder)
    versions = together([lambda i=i: store.commit("t", spark.range(i + 1), datetime(2024, 1, 1 + i)) for i in range(4)])
    assert sorted(versions) == [0, 1, 2, 3]
    assert {store.read("t", v).count() for v in versions} == {1, 2, 3, 4}
    assert sorted(r.version for r in store.history().collect()) == [0, 1, 2, 3]
