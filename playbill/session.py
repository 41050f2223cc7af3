"""Session set-up and the few run-time settings the operators rely on."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "playbill", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with adaptive skew handling on. ``master`` is left to spark-submit unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, taking a local one only when a local master has none set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
    return folder


def working_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}"


_open = threading.local()
#: rows that go to a Python worker at once while a working table is written; with whole texts in them, Spark's 10,000 would fill both sides
BATCH_ROWS = 2_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut_lineage(df: DataFrame, outlive: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The plan is computed a single time, survives the loss of executors, and later joins know its true size. With ``outlive``, the table
    stays when the innermost block of ``working_tables`` ends.
    """
    spark = df.sparkSession
    path = f"{working_folder(spark)}/{uuid.uuid4().hex}"
    with _setting(spark, BATCH, str(BATCH_ROWS)):
        df.write.parquet(path)
    scopes = getattr(_open, "scopes", [])
    for scope in scopes[:-1] if outlive else scopes:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are stored by now.

    Executors delete them when the driver's collector finds the plan dead, which otherwise happens at long intervals only.
    """
    spark._jvm.System.gc()


def cut_and_count(df: DataFrame, outlive: bool = False) -> tuple[DataFrame, int]:
    """``cut_lineage`` with the number of rows, which the pass that writes them counts."""
    seen = Observation()
    stored = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")), outlive)
    return stored, seen.get["n"]


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside the block when it ends. Results that need them must be stored by then."""
    scopes = _open.__dict__.setdefault("scopes", [])
    mine: list[str] = []
    scopes.append(mine)
    try:
        yield
    finally:
        scopes.pop()
        for path in mine:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored_step(spark: SparkSession, make: Callable[[], DataFrame]) -> tuple[DataFrame, int]:
    """The stored and counted result of a step, whose own working tables and shuffles go."""
    with working_tables(spark):
        result = cut_and_count(make(), outlive=True)
    release_shuffles(spark)
    return result
