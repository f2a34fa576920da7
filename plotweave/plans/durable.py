"""Cutting lineage in storage that every executor can read.

Executors may be lost at any time, so intermediate results are written either with
``DataFrame.checkpoint`` or as Parquet under the folder named by ``spark.checkpoint.dir``.
Local checkpoints are never used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"  # of rows that go to Python at once; an executor holds batches for each task, and so does each worker


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only on one machine (master ``local``) where the setting is unset."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
        folder = folder or "file://" + tempfile.mkdtemp(prefix="plotweave-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable, eager checkpoint of ``df``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _settings_for_tables(spark: SparkSession) -> Iterator[None]:
    """Queries that start in here delete their shuffle files when they end, and send small batches to Python unless the session says how large."""
    before = {key: spark.conf.get(key, None) for key in (_CLEANUP, _BATCH)}
    spark.conf.set(_CLEANUP, "true")
    if before[_BATCH] is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Scratch:
    """Parquet tables in the shared folder that live as long as a driver-side loop needs them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/plotweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.written = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a new table and read it; a table of that name from before goes once the new one stands."""
        self.written += 1
        path = f"{self.root}/{name}-{self.written}"
        schema = df.schema
        with _settings_for_tables(self.spark):
            df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later plan reads."""
        path = self.paths.pop(name, None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
