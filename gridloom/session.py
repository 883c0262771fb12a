"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local master may go without: it gets its own temporary folder. On a
    cluster a machine-local folder would be lost with its executor, so a missing
    setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if sc.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[sc.applicationId] = tempfile.mkdtemp(prefix="gridloom-")
    return _LOCAL_ROOTS[sc.applicationId]


def scratch_path(spark: SparkSession, label: str = "t") -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/gridloom/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    This cuts the plan like a reliable checkpoint, survives lost executors, runs
    the plan once, and gives the optimizer true sizes for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs inside hands its Python tasks ``most`` rows at a time: whole texts are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_counted(df: DataFrame, path: str) -> int:
    """Write parquet and count the rows on the way, without a second job.

    A retried task may be counted twice, so use the number as a bound; 0 is always exact.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def materialize_counted(df: DataFrame, label: str = "t") -> tuple[DataFrame, int]:
    """``materialize`` with the number of rows written."""
    path = scratch_path(df.sparkSession, label)
    n = write_counted(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), n


TASK_ROWS = 250_000  # fixed value: about so many rows are sorted or grouped by one task, whatever their number


def tasks_of(n_rows: int) -> int:
    """How many tasks so many rows need."""
    return -(-n_rows // TASK_ROWS) or 1


def tasks_for(rows: DataFrame) -> int:
    """How many tasks the number of ``rows`` needs."""
    return tasks_of(rows.count())


def release_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables. DataFrames built on them stop working."""
    jvm = spark.sparkContext._jvm
    app = spark.sparkContext.applicationId
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/gridloom/{app}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(path, True)
