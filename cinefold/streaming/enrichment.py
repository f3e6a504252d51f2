"""Incremental enrichment: every micro-batch of raw records is merged into the snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.operators import cleaning, features, imputation, merge
from cinefold.operators.embedding import Embedder, offline_embedder
from cinefold.session import dropping_steps, step_table
from cinefold.sources import snapshots


@dataclass
class Frozen:
    """Statistics that belong to a snapshot and are refreshed in batch, not per micro-batch."""

    statistics: imputation.FillStatistics
    variants: DataFrame


def enrich_stream(
    raw: DataFrame, folder: str, frozen: Frozen, run_time: str, version: str = "1.0.0",
    plan: Embedder | None = None, order: str = "ord", last_year: int = S.LAST_RELEASE_YEAR,
    first: str | None = None,
) -> None:
    """Merge what is there now, one micro-batch after the other.

    A micro-batch reads the stored rows of its own keys and writes only the rows it
    inserts or updates, as ``folder/epoch=n``; ``current`` puts the snapshot together. One
    that is repeated after a failure reads the same input and replaces its own output.
    """
    spark, plan = raw.sparkSession, plan or offline_embedder()

    def merge_batch(batch: DataFrame, epoch: int) -> None:
        cleaned = cleaning.clean(batch, order, last_year, frozen.variants)
        rows = step_table(
            features.augment(imputation.impute(cleaned, frozen.statistics)).drop(order), "enriched"
        )
        before = _written(spark, folder, first, epoch)
        stored = step_table(
            newest(before.join(rows.select("source_key"), "source_key", "left_semi")), "stored"
        )
        merged = merge.merge(stored, rows, plan, version, F.lit(run_time).cast("timestamp"))
        changed = merged.rows.filter(F.col("action").isin("inserted", "updated")).select(*merge.SNAPSHOT)
        changed.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    def step(batch: DataFrame, epoch: int) -> None:
        with dropping_steps(spark):
            merge_batch(batch, epoch)

    query = (
        raw.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _written(spark: SparkSession, folder: str, first: str | None, before: int | None = None) -> DataFrame:
    """The first snapshot and the rows of the epochs before ``before``, with their epoch."""
    base = snapshots.read_snapshot(spark, first).withColumn("epoch", F.lit(-1))
    if not snapshots.exists(spark, f"{folder}/rows", marker=None):
        return base
    schema = base.schema
    rows = spark.read.schema(schema).parquet(f"{folder}/rows")
    if before is not None:
        rows = rows.filter(F.col("epoch") < before)
    return base.unionByName(rows)


def newest(rows: DataFrame) -> DataFrame:
    """The last version of every key; each task first keeps one row per key."""
    latest = rows.withColumn("__age", -F.col("epoch"))
    return cleaning.first_per_key(latest, "source_key", "__age").select(*merge.SNAPSHOT)


def current(spark: SparkSession, folder: str, first: str | None = None) -> DataFrame:
    """The snapshot after the last micro-batch."""
    return newest(_written(spark, folder, first))


def compact(spark: SparkSession, folder: str, path: str, first: str | None = None) -> None:
    """Write the current snapshot as one table, to start the next stream from."""
    snapshots.write_snapshot(current(spark, folder, first), path)
