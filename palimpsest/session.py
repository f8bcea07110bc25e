"""Session helpers: table access, the shared scratch folder, and shipping the package to workers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; any path that Spark itself can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver was started elsewhere.

    On a cluster the package is shipped with ``--py-files``; this covers local runs.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers get whole texts a thousand at a time, not Spark's ten thousand, unless the session was set to
    other batches: a batch is held by the JVM and the worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, local mode) is a local folder made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    return f"{shared_dir(spark)}/palimpsest-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder, which ``sweep`` removes."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}/{name}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage so that several consumers neither recompute nor depend on an executor's disk.
    """
    return spooled(df, name)[0]


def spooled(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``spool``, with the path, which ``discard`` removes once nothing reads it any more."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that fit a pattern of the file system's, such as ``folder/*/name``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return [str(f.getPath().toString()) for f in found]


def sweep(spark: SparkSession) -> None:
    """Remove all that this application wrote to the shared folder; for when the queries' results have been read."""
    discard(spark, _own_folder(spark))
