"""Registry rows: seeding, selection, storage, lookup."""

import pytest
from pyspark.sql import functions as F

from tabproof import Registry, select_notebooks
from tabproof.sources.registry import (LOOKUP_COLUMNS, REGISTRY_SCHEMA, carry_forward, in_order, pending,
                                       register_lookup, seed)
from tabproof.sources.storage import evolve

JOBS = [("etl", "7", "load", "/nb/load"), ("etl", "7", "clean", "/nb/clean"), ("etl", "7", "wait", None),
        ("etl", "7", "sum", "/nb/sum"), ("ml", "8", "fit", "/nb/fit")]
EDGES = [("7", "clean", "load"), ("7", "wait", "clean"), ("7", "sum", "wait"), ("8", "fit", "elsewhere")]


@pytest.fixture(scope="module")
def rows(spark):
    return seed(spark.createDataFrame(JOBS, "job_name string, job_id string, task_key string, notebook_path string"),
                spark.createDataFrame(EDGES, "job_id string, task_key string, depends_on string")).cache()


def statuses(df):
    return {(r.job_name, r.notebook_path): r.status for r in df.collect()}


def test_seed(rows):
    assert rows.schema.simpleString() == REGISTRY_SCHEMA.simpleString()
    found = {r.notebook_path: r for r in rows.collect()}
    assert {n: r.dag_order for n, r in found.items()} == {"/nb/load": 0, "/nb/clean": 1, "/nb/sum": 3, "/nb/fit": 0}
    assert found["/nb/sum"].optimized_folder == "optimized/etl" and found["/nb/sum"].target_tables == []
    assert (found["/nb/fit"].epsilon, found["/nb/fit"].min_gain, found["/nb/fit"].benchmark_runs) == (1e-6, 0.2, 3)


def test_settled_statuses_are_carried_forward(spark, rows):
    prior = spark.createDataFrame([("etl", "/nb/load", "promoted"), ("etl", "/nb/clean", "validated"), ("ml", "/nb/fit", "blocked"),
                                   ("gone", "/nb/x", "promoted")], "job_name string, notebook_path string, status string")
    assert statuses(carry_forward(rows, prior)) == {
        ("etl", "/nb/load"): "promoted", ("etl", "/nb/clean"): "pending", ("etl", "/nb/sum"): "pending", ("ml", "/nb/fit"): "blocked"}


def test_selection(rows):
    settled = rows.withColumn("status", F.expr("if(task_key = 'load', 'promoted', status)"))
    assert statuses(select_notebooks(settled, [3, "fit"])) == {
        ("etl", "/nb/load"): "promoted", ("etl", "/nb/clean"): "skipped", ("etl", "/nb/sum"): "pending", ("ml", "/nb/fit"): "pending"}
    assert set(statuses(select_notebooks(settled, "all")).values()) == {"promoted", "pending"}
    assert statuses(select_notebooks(settled)) == statuses(select_notebooks(settled, ["all"]))
    for nothing in ("nope", 77, True, [True, False], []):
        with pytest.raises(ValueError, match="no notebook matches"):
            select_notebooks(settled, nothing)
    with pytest.raises(ValueError, match="no notebook matches 1 in: 1 row.* ml"):
        select_notebooks(settled, 1)
    with pytest.raises(ValueError, match="no rows of 'absent'"):
        select_notebooks(settled, 1, job="absent")
    picked = select_notebooks(select_notebooks(settled, 1, job="etl"), 3, job="etl")
    assert statuses(picked)[("ml", "/nb/fit")] == "pending"
    assert statuses(picked)[("etl", "/nb/clean")] == "skipped" and statuses(picked)[("etl", "/nb/sum")] == "pending"


def test_order_and_pending(rows):
    assert [r.task_key for r in in_order(rows, "etl").collect()] == ["load", "clean", "sum"]
    assert [r.task_key for r in pending(select_notebooks(rows, ["sum", 0]), "etl").collect()] == ["load", "sum"]


def test_sync_replaces_only_its_jobs(spark, rows, folder):
    registry = Registry(spark, folder)
    assert registry.read().count() == 0
    registry.sync(rows)
    registry.sync(rows.where("task_key = 'sum'").drop("compute_cluster_id"))
    assert sorted(r.notebook_path for r in registry.read().collect()) == ["/nb/fit", "/nb/sum"]
    assert registry.read().schema == REGISTRY_SCHEMA


def test_set_status(spark, rows, folder):
    registry = Registry(spark, folder)
    registry.sync(rows)

    def update(*changes):
        registry.set_status(spark.createDataFrame(changes, "job_name string, notebook_path string, status string"))

    update(("etl", "/nb/sum", "validated"), ("etl", "/nb/load", "promoted"))
    assert statuses(registry.read()) == {("etl", "/nb/load"): "promoted", ("etl", "/nb/clean"): "pending",
                                         ("etl", "/nb/sum"): "validated", ("ml", "/nb/fit"): "pending"}
    for changes, message in (([("etl", "/nb/sum", "done")], "status must be one of"), ([("etl", "/nb/none", "blocked")], "no registry row"),
                             ([("etl", "/nb/sum", "blocked"), ("etl", "/nb/sum", "promoted")], "several statuses"),
                             ([("etl", "/nb/sum", None)], "status must be one of")):
        with pytest.raises(ValueError, match=message):
            update(*changes)
    assert statuses(registry.read())[("etl", "/nb/sum")] == "validated"


def test_lookup_function(spark, rows):
    register_lookup(spark, rows)
    found = spark.sql("SELECT * FROM get_opt_config('etl')")
    assert found.columns == LOOKUP_COLUMNS and len(LOOKUP_COLUMNS) == 15
    assert [r.notebook_path for r in found.collect()] == ["/nb/load", "/nb/clean", "/nb/sum"]
    assert spark.sql("SELECT * FROM get_opt_config(:job)", args={"job": "x' OR 'a' = 'a"}).count() == 0


def test_evolution(spark):
    older = spark.createDataFrame([("etl", 3)], "job_name string, dag_order bigint")
    row = evolve(older, REGISTRY_SCHEMA).first()
    assert row.dag_order == 3 and row.compute_cluster_id is None and len(row) == 17
