"""Dependency order of tasks, for all jobs at once."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, functions as F

from ..session import Stored, checkpoint, stored
from .running import ordered_position

TASK = ["job_id", "task_key"]
# Tasks and edges of a job that are put in order by one task of Spark; larger jobs go through rounds.
IN_ONE_TASK = 500_000
# For both sides of joins that hold a row per task or edge. Numbers shuffle to so few bytes that Spark would take millions
# of them for small, and gather them in the driver.
SORTED = "merge"


def dag_order(tasks: DataFrame, edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``(job_id, task_key, wave, dag_order)``: consecutive from 0 in each job, by wave, then by name.

    ``tasks`` is ``(job_id, task_key)``, ``edges`` is ``(job_id, task_key,
    depends_on)``. A task's wave is one after the last of its dependencies; one
    that is no task of the job counts as met. Tasks on a cycle, or after one,
    never become ready; they form one last wave.

    A job of up to ``in_one_task`` tasks and edges is one group of one shuffle,
    whatever its depth. Larger ones are ordered by joins, see :func:`_by_rounds`.
    """
    rows = tasks.select(*TASK, F.lit(None).cast(dict(tasks.dtypes)["task_key"]).alias("depends_on"), F.lit(False).alias("edge")).unionByName(
        edges.select(*TASK, "depends_on", F.lit(True).alias("edge")))
    large = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > in_one_task).select("job_id")
    types = dict(tasks.dtypes)
    schema = f"job_id {types['job_id']}, task_key {types['task_key']}, wave int, dag_order bigint"
    if large.isEmpty():
        return rows.groupBy("job_id").applyInPandas(_order, schema)
    large = checkpoint(large)
    small = rows.join(large, "job_id", "left_anti").groupBy("job_id").applyInPandas(_order, schema)
    waves = _by_rounds(tasks.join(large, "job_id", "left_semi"), edges.join(large, "job_id", "left_semi"))
    return small.unionByName(ordered_position(waves, ["job_id"], ["wave", "task_key"], "dag_order"))


def dag_waves(tasks: DataFrame, edges: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``(job_id, task_key, wave)``, see :func:`dag_order`."""
    return dag_order(tasks, edges, in_one_task).drop("dag_order")


def _order(rows: pd.DataFrame) -> pd.DataFrame:
    """Tasks of one job in order."""
    marked = rows["edge"].to_numpy()
    names = set(rows.loc[~marked, "task_key"])
    waits, needed_by = defaultdict(int), defaultdict(list)
    for task, dep in set(zip(rows.loc[marked, "task_key"], rows.loc[marked, "depends_on"])):
        if task in names and dep in names and task is not None and dep is not None:
            waits[task] += 1
            needed_by[dep].append(task)
    wave, level = {}, 0
    ready = [t for t in names if not waits[t]]
    while ready:
        wave.update(dict.fromkeys(ready, level))
        after = []
        for later in [x for t in ready for x in needed_by[t]]:
            waits[later] -= 1
            if not waits[later]:
                after.append(later)
        ready, level = after, level + 1
    ordered = sorted(((wave.get(t, level), t is not None, t) for t in names), key=lambda x: x[:2] + (x[2] or "",))
    return pd.DataFrame({"job_id": rows["job_id"].iloc[0], "task_key": [t for *_, t in ordered],
                         "wave": [w for w, *_ in ordered], "dag_order": range(len(ordered))})


def _by_rounds(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """``(job_id, task_key, wave)`` by joins over numbered tasks.

    First, tasks with a single dependency are hung on the nearest ancestor that
    has none or several, by doubling the pointers: the rounds follow the
    logarithm of a chain's length. What is left, tasks with several
    dependencies, closes one wave a round; only their number reaches the driver.
    Rounds are read from files: of a checkpoint Spark keeps the size it guessed,
    and the guess for a join, a product, has twice the digits after every round.
    """
    # Numbers are taken from the stored rows, which hold still when a task runs again.
    numbered = stored(checkpoint(tasks.select(*TASK).distinct()).withColumn("id", F.monotonically_increasing_id()), "dag-tasks")
    dependency = numbered.select("job_id", F.col("task_key").alias("depends_on"), F.col("id").alias("dep"))
    linked = stored(
        edges.select(*TASK, "depends_on").distinct().join(numbered.hint(SORTED), TASK)
        .join(dependency.hint(SORTED), ["job_id", "depends_on"]).select("id", "dep"), "dag-links")
    degree = linked.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("dep").alias("dep"))
    hops = Stored(degree.where("n = 1").select("id", "dep", F.lit(1).alias("steps")), "dag-hops")
    moved, before = hops.df.count(), -1
    while moved and moved != before:
        single = hops.df
        onward, seen = single.select(F.col("id").alias("dep"), F.col("dep").alias("next"), F.col("steps").alias("more")), Observation()
        further = Stored(
            single.join(onward.hint(SORTED), "dep", "left").observe(seen, F.count("next").alias("moved"))
            .select("id", F.coalesce("next", "dep").alias("dep"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "dag-hops")
        hops.discard()
        hops = further
        # Pointers that never stop moving are on cycles or lead into one.
        before, moved = moved, seen.get["moved"]
    single = hops.df
    hung = single.select(F.col("id").alias("dep"), F.col("dep").alias("root"), "steps")
    several = linked.join(degree.where("n > 1").select("id").hint(SORTED), "id", "left_semi")
    waiting = stored(several.join(hung.hint(SORTED), "dep", "left").select(
        "id", F.coalesce("root", "dep").alias("dep"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.lit(0).alias("best")), "dag-waiting")
    count = waiting.count()
    free = numbered.select("id").join(linked.select("id").distinct().hint(SORTED), "id", "left_anti").withColumn("wave", F.lit(0))
    known, fresh = [free], free
    while count:
        seen = Observation()
        merged = stored(
            waiting.join(fresh.select(F.col("id").alias("dep"), F.col("wave").alias("at")).hint(SORTED), "dep", "left")
            .withColumn("best", F.greatest("best", F.coalesce(F.col("at") + F.col("steps"), F.lit(0))))
            .withColumn("open", F.expr("if(dep IS NOT NULL AND at IS NULL, struct(dep, steps), NULL)"))
            .groupBy("id").agg(F.max("best").alias("best"), F.collect_set("open").alias("open"))
            .observe(seen, F.count_if(F.size("open") == 0).alias("closed"), F.sum(F.size("open")).alias("left")), "dag-round")
        if not seen.get["closed"]:
            break
        fresh = merged.where(F.size("open") == 0).select("id", F.col("best").alias("wave"))
        known.append(fresh)
        waiting = merged.select("id", F.explode("open").alias("o"), "best").select("id", "o.dep", "o.steps", "best")
        count = seen.get["left"]
    placed = reduce(DataFrame.unionByName, known)
    chained = single.join(placed.select(F.col("id").alias("dep"), "wave").hint(SORTED), "dep").select(
        "id", (F.col("wave") + F.col("steps")).alias("wave"))
    waves = numbered.join(placed.unionByName(chained).hint(SORTED), "id", "left")
    last = waves.where("wave IS NOT NULL").groupBy("job_id").agg((F.max("wave") + 1).alias("last"))
    return waves.join(last, "job_id", "left").select(*TASK, F.coalesce("wave", "last", F.lit(0)).alias("wave"))
