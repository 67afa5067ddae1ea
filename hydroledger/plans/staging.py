"""Written intermediate tables.

An operator that reads the same expensive input several times (totals, part
boundaries, the rows themselves) writes it once to the shared folder of the
cluster and reads it back.  The table survives the loss of an executor and
cuts the lineage, and its file sizes tell Spark how to join it.

Staging is eager: building a query that stages runs the jobs that write.  The written
tables belong to the scope around the build and go with it::

    with staged(spark):
        catalog.savings_table(spark, folder).collect()

Outside of any scope they stay until the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_SCOPE: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the session; a temporary one only for a local session."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    local = spark.sparkContext.master.split("[")[0] in ("local", "local-cluster")
    if named:
        if not local and named.startswith("file:"):
            raise RuntimeError(f"{SETTING} names a folder of one machine: {named}")
        return named.rstrip("/")
    if not local:
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="hydroledger-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at its end; those of other scopes are not.

    Scopes nest, and each thread or asynchronous task has its own.
    """
    written: list[str] = []
    token = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in written:
            files, hadoop_path = _locate(spark, path)
            files.delete(hadoop_path, True)


def new_folder(spark: SparkSession) -> str:
    """A path for a written table of the current scope, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    files, hadoop_path = _locate(spark, path)
    files.deleteOnExit(hadoop_path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder now and return the written table."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _locate(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path
