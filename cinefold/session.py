"""Shared scratch space and step tables.

Anything that has to be cut from its lineage is written as a Parquet table under
the folder the cluster names in ``spark.checkpoint.dir``. A written table survives
the loss of executors, and its size on disk is known to the planner, so a join
against a small one is broadcast only after Spark has checked that size against
``spark.sql.autoBroadcastJoinThreshold``; a large one is joined with a shuffle and
adaptive execution splits its hot keys.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for step tables, streams and checkpoints."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def use_checkpoint_dir(spark: SparkSession, folder: str) -> SparkSession:
    """Name a shared folder for a local session that has none; any other session keeps its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def use_package(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver found it; elsewhere it must be installed."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if folder not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [folder, known]))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def step_table(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once and continue from the written table."""
    return _written(frame, name, _scopes())


def _written(frame: DataFrame, name: str, scopes: list[list[str]]) -> DataFrame:
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    for paths in scopes:
        paths.append(path)
    return spark.read.schema(frame.schema).parquet(path)


_local = threading.local()


def _scopes() -> list[list[str]]:
    """The open scopes of this thread; a stream's micro-batches run in a thread of their own."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def dropping_steps(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the step tables written inside the block when it ends.

    Write the wanted results before: frames that read a step table are of no use after. The block gets a
    function like ``step_table`` whose tables outlive it, until an outer block ends.
    """
    paths: list[str] = []
    outer = list(_scopes())
    _scopes().append(paths)
    try:
        yield lambda frame, name: _written(frame, name, outer)
    finally:
        _scopes().pop()
        for path in paths:
            location = spark._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)
