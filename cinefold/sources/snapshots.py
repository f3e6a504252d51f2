"""Snapshot, report and export files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cinefold.operators.merge import SNAPSHOT, SNAPSHOT_TYPES, Merge, changed_buckets, clustered, empty_snapshot
from cinefold.session import step_table

BUCKETS = 64


def exists(spark: SparkSession, path: str, marker: str | None = "_SUCCESS") -> bool:
    """Whether a table was written to its end, or with no ``marker`` whether the folder is there."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path if marker is None else f"{path}/{marker}")
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def read_snapshot(spark: SparkSession, path: str | None) -> DataFrame:
    """The stored catalogue, or an empty one before the first run."""
    if path is None or not exists(spark, path):
        return empty_snapshot(spark)
    return spark.read.parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """A new snapshot folder; the one being read is never overwritten."""
    clustered(snapshot).write.mode("errorifexists").parquet(path)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue that is renewed in place, with the ``bucket`` of each row; empty before the first run."""
    schema = ", ".join(f"{name} {kind}" for name, kind in [*SNAPSHOT_TYPES.items(), ("bucket", "int")])
    if not exists(spark, path, marker=None):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def renew_catalogue(merged: Merge, path: str, buckets: int = BUCKETS) -> int:
    """Rewrite the buckets that a run's written rows fall into; the number of rows written by the run.

    Nothing is written when nothing changed. The buckets' new rows are brought together in a table of their own first,
    as a bucket is not overwritten while it is read. Only one run may renew a catalogue at a time.
    """
    spark = merged.rows.sparkSession
    changed = merged.rows.filter(F.col("action").isin("inserted", "updated")).count()
    if changed:
        stored = read_catalogue(spark, path)
        rows = step_table(changed_buckets(stored, merged, buckets), "catalogue-buckets")
        laid = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "decade", "major_genre")
        (laid.select(*SNAPSHOT, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
    return changed


def write_report(report: DataFrame, path: str) -> None:
    """The run report as one JSON document; its rows are one per rule, so few."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_export(frame: DataFrame, path: str, force: bool = False) -> None:
    """Parquet export; an export that is already there is left alone unless forced."""
    frame.write.mode("overwrite" if force else "ignore").parquet(path)
