"""The registry: one row per (job, notebook) with its settings and its status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.names import DEFAULT_SANDBOX
from ..operators.dag import SORTED, dag_order
from .commits import CommittedTable
from .storage import evolve, refuse_rows

LIST = T.ArrayType(T.StringType())

# The columns of a row, its defaults and its statuses.
REGISTRY_SCHEMA = T.StructType([
    T.StructField("job_name", T.StringType()),
    T.StructField("job_id", T.StringType()),
    T.StructField("notebook_path", T.StringType()),
    T.StructField("task_key", T.StringType()),
    T.StructField("dag_order", T.IntegerType()),
    T.StructField("operation", T.StringType()),
    T.StructField("source_tables", LIST),
    T.StructField("target_tables", LIST),
    T.StructField("equivalence_keys", LIST),
    T.StructField("sandbox_schema", T.StringType()),
    T.StructField("optimized_folder", T.StringType()),
    T.StructField("epsilon", T.DoubleType()),
    T.StructField("min_gain", T.DoubleType()),
    T.StructField("benchmark_runs", T.IntegerType()),
    T.StructField("compute_cluster_id", T.StringType()),
    T.StructField("nondeterministic", T.BooleanType()),
    T.StructField("status", T.StringType()),
])
DEFAULTS = {"epsilon": 1e-6, "min_gain": 0.20, "benchmark_runs": 3}
STATUSES = ("pending", "skipped", "proposed", "approved", "validated", "promoted", "blocked")
SETTLED = ("promoted", "blocked")

ROW = ["job_name", "notebook_path"]
LOOKUP_COLUMNS = [f.name for f in REGISTRY_SCHEMA.fields if f.name not in ("job_id", "task_key")]


def carry_forward(seed: DataFrame, prior: DataFrame) -> DataFrame:
    """Seed rows whose status is that of an earlier run where it was settled, else ``pending``."""
    before = prior.where(F.col("status").isin(*SETTLED)).select(*ROW, F.col("status").alias("settled"))
    return seed.join(before.hint(SORTED), ROW, "left").withColumn(
        "status", F.coalesce("settled", F.lit("pending"))).drop("settled")


def seed(tasks: DataFrame, edges: DataFrame, prior: DataFrame | None = None,
         sandbox_schema: str = DEFAULT_SANDBOX, folder: str = "optimized") -> DataFrame:
    """Registry rows for the notebook tasks of all given jobs.

    ``tasks`` is ``(job_name, job_id, task_key, notebook_path)``, ``edges`` is
    ``(job_id, task_key, depends_on)``. Every task takes part in the order,
    only those with a notebook get a row. Tables and keys are filled in later.
    """
    order = dag_order(tasks, edges).select("job_id", "task_key", F.col("dag_order").cast("int").alias("dag_order"))
    rows = (
        tasks.where("notebook_path IS NOT NULL").join(order.hint(SORTED), ["job_id", "task_key"])
        .withColumns({
            "job_id": F.col("job_id").cast("string"),
            **{name: F.array().cast(LIST) for name in ("source_tables", "target_tables", "equivalence_keys")},
            **{name: F.lit(value) for name, value in DEFAULTS.items()},
            "sandbox_schema": F.lit(sandbox_schema),
            "optimized_folder": F.concat(F.lit(f"{folder}/"), F.col("job_name")),
            "status": F.lit("pending"),
        })
    )
    rows = evolve(rows.select(*[n for n in rows.columns if n in REGISTRY_SCHEMA.names]), REGISTRY_SCHEMA)
    if prior is not None:
        rows = carry_forward(rows, prior)
    return rows.select(*REGISTRY_SCHEMA.names)


def select_notebooks(rows: DataFrame, picks: int | str | list | None = None, job: str | None = None) -> DataFrame:
    """Picked rows become ``pending``, the rest ``skipped``; settled rows stay as they are.

    An integer picks a place in the DAG order, a text the paths that contain it; no picks, or ``all``, pick every row. With
    ``job``, only its rows are selected from and others stay. Jobs of which nothing is picked are an error.
    """
    wanted = list(picks) if isinstance(picks, (list, tuple)) else [picks]
    places = [p for p in wanted if isinstance(p, int) and not isinstance(p, bool)]
    texts = [p for p in wanted if isinstance(p, str)]
    here = F.lit(True) if job is None else F.col("job_name").eqNullSafe(job)
    if wanted in ([None], ["all"]):
        chosen = F.lit(True)
    else:
        chosen = F.col("dag_order").isin(*places) | F.exists(
            F.array(*map(F.lit, texts)).cast("array<string>"), lambda t: F.contains(F.col("notebook_path"), t))
        chosen = F.coalesce(chosen, F.lit(False))
    without = rows.where(here).groupBy("job_name").agg(F.bool_or(chosen).alias("any")).where("NOT any").select("job_name")
    refuse_rows(without, f"no notebook matches {picks!r} in")
    if job is not None and rows.where(here).isEmpty():
        raise ValueError(f"no notebook matches {picks!r} in: no rows of {job!r}")
    status = (F.when(~here | F.col("status").isin(*SETTLED), F.col("status"))
              .when(chosen, "pending").otherwise("skipped"))
    return rows.withColumn("status", status)


def in_order(rows: DataFrame, job: str | None = None) -> DataFrame:
    """Rows of a job, or of all jobs, in DAG order."""
    if job is not None:
        rows = rows.where(F.col("job_name") == job)
    return rows.orderBy("job_name", "dag_order", "notebook_path")


def pending(rows: DataFrame, job: str | None = None) -> DataFrame:
    """Rows still to be processed, in DAG order."""
    return in_order(rows.where(F.col("status") == "pending"), job)


def apply_status(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows with the statuses of ``updates(job_name, notebook_path, status)`` written in."""
    new = updates.select(*ROW, F.col("status").alias("new_status"))
    return rows.join(new, ROW, "left").withColumn(
        "status", F.coalesce("new_status", "status")).select(*rows.columns)


def register_lookup(spark: SparkSession, rows: DataFrame, function: str = "get_opt_config",
                    view: str = "opt_config") -> None:
    """Makes ``SELECT * FROM get_opt_config('<job>')`` available to SQL for this session."""
    types = {f.name: f.dataType.simpleString() for f in REGISTRY_SCHEMA.fields}
    rows.createOrReplaceTempView(view)
    columns = ", ".join(f"{n} {types[n]}" for n in LOOKUP_COLUMNS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(p_job STRING) RETURNS TABLE ({columns}) "
              f"RETURN SELECT {', '.join(LOOKUP_COLUMNS)} FROM {view} WHERE job_name = p_job ORDER BY dag_order")


class Registry:
    """Registry rows stored under one folder, partitioned by job.

    Every change is one commit: readers see the rows before or after it, whatever happens to the writer, and
    writers of the same job don't undo each other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = CommittedTable(spark, path, REGISTRY_SCHEMA, "job_name")

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def sync(self, rows: DataFrame) -> None:
        """Replaces all rows of the jobs that occur in ``rows``; other jobs stay."""
        self.table.replace(evolve(rows, REGISTRY_SCHEMA))

    def set_status(self, updates: DataFrame) -> None:
        """Writes statuses of ``updates(job_name, notebook_path, status)`` in one pass.

        An unknown status, a row that does not exist, or two statuses for one
        row are errors, found before anything is written. Only the touched jobs
        are rewritten, again if another writer changed one of them meanwhile.
        """
        refuse_rows(updates.where(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))
                    .select(*ROW, "status"), f"status must be one of {STATUSES}")
        refuse_rows(updates.groupBy(*ROW).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*ROW),
                    "several statuses for one row")

        def written_in(rows: DataFrame) -> DataFrame:
            refuse_rows(updates.join(rows, ROW, "left_anti").select(*ROW), "no registry row")
            touched = rows.join(updates.select("job_name").distinct(), "job_name", "left_semi")
            return apply_status(touched, updates).select(*REGISTRY_SCHEMA.names)

        self.table.change(written_in, "set_status")
