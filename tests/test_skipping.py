"""Files left out by an index, and samples that hold together."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tabproof.functions.hashing import in_sample
from tabproof.operators.closed_sample import Reference, closed_sample
from tabproof.plans import recipes
from tabproof.sources.skipping import SkippingTable


def bag(df):
    return sorted(map(str, df.collect()))


def test_a_box_leaves_files_out(spark, views, folder):
    path = f"{folder}/table"
    recipes.write_zordered(views.orders, ["o_custkey", "o_orderdate"], path, files=16)
    table = SkippingTable(spark, path, f"{folder}/index", ["o_custkey", "o_orderdate"], ["o_orderkey"])
    assert table.read({"o_custkey": (1, 5)}).count() == views.orders.where("o_custkey BETWEEN 1 AND 5").count()  # no index yet: all files
    files = len(spark.read.parquet(path).inputFiles())
    assert table.refresh() == files >= 8 and table.refresh() == 0
    high = views.orders.agg(F.max("o_custkey")).first()[0]
    box = {"o_custkey": (high // 3, high // 2), "o_orderdate": (datetime(1994, 1, 1), datetime(1995, 6, 1))}
    chosen = {r.file for r in table.files(box).where("chosen").collect()}
    found = table.read(box)
    assert 0 < len(chosen) <= files // 2 and {f.replace("file:///", "file:/") for f in found.inputFiles()} == {f.replace("file:///", "file:/") for f in chosen}
    assert bag(found) == bag(views.orders.where(
        f"o_custkey BETWEEN {high // 3} AND {high // 2} AND o_orderdate BETWEEN timestamp_ntz'1994-01-01' AND timestamp_ntz'1995-06-01'"))
    for key in (1, 77, 500):
        one = table.files(equal={"o_orderkey": key}).where("chosen").count()
        assert bag(table.read(equal={"o_orderkey": key})) == bag(views.orders.where(f"o_orderkey = {key}")) and one <= files // 2
    assert table.read({"o_custkey": (high + 1, None)}).collect() == []
    assert table.read().count() == views.orders.count()


def test_files_that_the_index_does_not_know_are_read(spark, folder):
    path = f"{folder}/table"
    rows = lambda a, b: spark.range(a, b, numPartitions=2).selectExpr("id AS k", "if(id % 2 = 0, NULL, id) AS n")
    rows(0, 100).write.parquet(path)
    table = SkippingTable(spark, path, f"{folder}/index", ["k", "n"], ["n"])
    table.refresh()
    rows(100, 140).write.mode("append").parquet(path)
    assert table.read({"k": (90, 110)}).count() == 21
    assert table.read(equal={"n": 121}).count() == 1 and table.read(equal={"n": 122}).count() == 0
    assert table.refresh() == 2
    assert table.read({"k": (90, 110), "n": (None, 105)}).count() == 8
    rows(0, 10).write.mode("overwrite").parquet(path)
    assert table.read({"k": (5, 500)}).count() == 5
    table.refresh()
    assert table.index.read().count() == len(spark.read.parquet(path).inputFiles())


TABLES = {"orders": ["o_orderkey"], "customer": ["c_custkey"]}


def test_no_sampled_row_lacks_its_parent(views):
    tables = {t: views.table(t) for t in ("lineitem", "orders", "customer")}
    links = [Reference("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), Reference("orders", ("o_custkey",), "customer", ("c_custkey",))]
    taken = closed_sample(tables, links, {"lineitem": ["l_orderkey"], "customer": ["c_custkey"]}, 10)
    assert bag(taken["lineitem"]) == bag(tables["lineitem"].where(in_sample([F.col("l_orderkey")], 10)))
    assert taken["lineitem"].join(taken["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count() == \
        taken["lineitem"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").count()
    assert taken["orders"].join(taken["customer"], F.col("o_custkey") == F.col("c_custkey"), "left_anti").count() == 0
    assert 0 < taken["orders"].count() < tables["orders"].count() / 2
    assert taken["customer"].count() >= tables["customer"].where(in_sample([F.col("c_custkey")], 10)).count()
    with pytest.raises(ValueError, match="unknown tables"):
        closed_sample(tables, links, {"nope": ["k"]}, 10)


def test_references_in_a_circle(spark):
    """People with a boss, in teams whose lead is one of the people; null and missing references stay."""
    people = spark.createDataFrame([(i, i // 2 if i else None, i % 3) for i in range(64)] + [(99, 1234, None)], "id int, boss int, team int")
    teams = spark.createDataFrame([(0, 60), (1, None), (2, 63)], "team int, lead int")
    links = [Reference("people", ("boss",), "people", ("id",)), Reference("people", ("team",), "teams", ("team",)), Reference("teams", ("lead",), "people", ("id",))]
    taken = closed_sample({"people": people, "teams": teams}, links, {"people": ["id"]}, 5, seed=3)
    rows = {r.id: r for r in people.collect()}
    expected = {r.id for r in people.where(in_sample([F.col("id")], 5, 3)).collect()}
    assert expected
    leads, used = {0: 60, 2: 63}, set()
    while True:
        more = {rows[i].boss for i in expected} | {leads.get(rows[i].team) for i in expected}
        used |= {rows[i].team for i in expected} - {None}
        more = {i for i in more if i in rows} - expected
        if not more:
            break
        expected |= more
    assert {r.id for r in taken["people"].collect()} == expected and {r.team for r in taken["teams"].collect()} == used


def test_copies_and_two_column_references(spark):
    child = spark.createDataFrame([(1, 1, "x"), (1, None, "y"), (2, 2, "z")], "a int, b int, v string")
    parent = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (None, None)], "a int, b int")
    taken = closed_sample({"child": child, "parent": parent}, [Reference("child", ("a", "b"), "parent", ("a", "b"))], {"child": ["v"]}, 100)
    assert bag(taken["child"]) == bag(child)
    assert sorted(map(tuple, taken["parent"].collect())) == [(1, 1), (1, 1), (2, 2)]
