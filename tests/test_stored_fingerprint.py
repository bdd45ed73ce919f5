"""Fingerprints put together from stored states against a full pass."""

import os

import pytest
from pyspark.sql import functions as F

from tabproof.functions.floats import close_sums
from tabproof.operators.fingerprint import compare_fingerprints
from tabproof.operators.stored_fingerprint import StoredFingerprint
from tabproof.plans import recipes


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def files_of(table):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(local(table)) for f in names if f.endswith(".parquet"))


def check(stored):
    """All exact metrics are those of a full pass; distinct estimates are close to the exact numbers."""
    rows = stored.rows()
    full = compare_fingerprints(rows, rows, distinct="exact").select("column", "metric", F.col("baseline").alias("full"))
    joined = stored.metrics().join(full, ["column", "metric"], "full").withColumn("off", F.expr(
        f"CASE metric WHEN 'distinct' THEN abs(value - full) > 0.06D * full + 1 WHEN 'sum' THEN NOT {close_sums('value', 'full', 'abs(full)', 1e-6)} "
        "ELSE NOT (value <=> full) END"))
    assert joined.where("off IS NULL OR off").collect() == []
    assert joined.count() == full.count()


@pytest.fixture
def rows(views):
    return views.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag", "l_shipdate", F.expr("if(l_linenumber > 4, NULL, l_linenumber)").alias("p"),
                                 F.expr("cast(l_quantity AS decimal(12,2))").alias("q"), F.expr("map('k', l_returnflag)").alias("m"),
                                 F.expr("if(l_orderkey % 50 = 0, double('NaN'), NULL)").alias("odd"))


def test_only_changed_partitions_are_read(spark, rows, folder):
    table = f"{folder}/table"
    rows.write.partitionBy("p").parquet(table)
    stored = StoredFingerprint(spark, table, ["p"], f"{folder}/states")
    assert stored.refresh() == 5
    check(stored)
    assert stored.refresh() == 0
    before = {f: open(f, "rb").read() for f in files_of(table)}
    recipes.reload_partitions(rows.where("p = 2").withColumn("l_extendedprice", F.col("l_extendedprice") + 1), table, "p")
    # Files of the other partitions are overwritten with noise of the same length and time: whoever opens one fails.
    kept = [f for f in files_of(table) if "/p=2/" not in f]
    for f in kept:
        times = os.stat(f)
        with open(f, "r+b") as out:
            out.write(b"x" * times.st_size)
        os.utime(f, ns=(times.st_atime_ns, times.st_mtime_ns))
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    again = StoredFingerprint.__new__(StoredFingerprint)
    again.__dict__ = dict(stored.__dict__)  # the schema would be read from a file that is noise now
    again.rows = lambda: spark.read.schema(rows.select(*[c for c in rows.columns if c != "p"], "p").schema).parquet(table)
    assert again.refresh() == 1
    for f in kept:
        times = os.stat(f)
        with open(f, "wb") as out:
            out.write(before[f])
        os.utime(f, ns=(times.st_atime_ns, times.st_mtime_ns))
    check(stored)


def test_partitions_come_and_go(spark, rows, folder, monkeypatch):
    table = f"{folder}/table"
    rows.where("p IN (1, 2)").write.partitionBy("p").parquet(table)
    stored = StoredFingerprint(spark, table, ["p"], f"{folder}/states")
    assert stored.refresh() == 2
    recipes.reload_partitions(rows.where("p = 3"), table, "p")
    for f in files_of(f"{table}/p=1"):
        os.remove(f)
    monkeypatch.setattr("tabproof.operators.stored_fingerprint.LISTED", 0)  # by a join instead of literals
    assert stored.refresh() == 1
    assert sorted(r.p for r in stored.states.read().collect()) == [2, 3]
    check(stored)


def test_two_partition_columns(spark, rows, folder):
    table = f"{folder}/table"
    rows.withColumn("flag", F.col("l_returnflag")).write.partitionBy("p", "flag").parquet(table)
    stored = StoredFingerprint(spark, table, ["p", "flag"], f"{folder}/states")
    n = stored.rows().select("p", "flag").distinct().count()
    assert stored.refresh() == n and stored.refresh() == 0
    check(stored)
