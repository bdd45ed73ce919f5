"""Session helpers: a local session for tests and bench, and the shared scratch folder.

Nothing in this library changes a session setting; the options below apply only
to sessions that tests and the bench start themselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "tabproof") -> SparkSession:
    """A local session for tests and bench. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a ``local`` master, where there is one machine, falls back to a
    temporary folder; anywhere else a missing setting is an error, because a
    lost executor could not read another machine's files again.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    current = spark.sparkContext.getCheckpointDir()
    if named or current:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named or current
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tabproof-")
    if os.environ.get("TABPROOF_KEEP_SCRATCH") is None:
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name under :func:`shared_dir`; the first write creates it."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpoint(df):
    """Reliable checkpoint: cuts the lineage and survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stored:
    """A table written once and read from there: the lineage ends, and lost executors cost no recomputation.

    Leaving a ``with`` block, or :meth:`discard`, deletes the files.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark: SparkSession = df.sparkSession
        self.path = new_folder(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Bucketed(Stored):
    """Like :class:`Stored`, in buckets of ``key``, one file each: a join on ``key`` moves the other side only.

    Buckets are a matter of the catalog, where the table has a name of its own until it is discarded.
    """

    def __init__(self, df: DataFrame, key: str, label: str):
        self.spark = df.sparkSession
        self.path = new_folder(self.spark, label)
        self.name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, key).write.format("parquet").option("path", self.path).bucketBy(n, key).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def discard(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().discard()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` after writing them; the files stay until the shared folder is cleaned."""
    return Stored(df, label).df


def concurrently(spark: SparkSession, jobs: list, parallel: int = 4) -> list:
    """Results of the given functions in order, a few of them submitted to Spark at a time.

    Small tables then do not wait for the last tasks of large ones. The first
    error is raised after all have ended.
    """
    if parallel <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]
