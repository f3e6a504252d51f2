"""The windowed metrics on streams.

Streams need a timestamp with time zone for the watermark, so event times are cast first.
Late events are dropped past the watermark, as Spark does by default.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinefold import schemas as S
from cinefold.operators import metrics
from cinefold.session import scratch_path


def event_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """A Parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def _windowed(events: DataFrame, ts: str, delay: str, dims: Sequence[str], *window: str):
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, *window).alias("w"), *dims)


def rates(
    events: DataFrame, ts: str, length: str, delay: str, hit: Column, dims: Sequence[str] = ()
) -> DataFrame:
    """Events per second and share of hits per tumbling window."""
    return (
        _windowed(events, ts, delay, dims, length)
        .agg(F.count("*").alias("events"), F.count_if(hit).alias("hits"))
        .select(
            F.col("w.start").alias("window_start"), *dims, "events", "hits",
            (F.col("events") / float(metrics.seconds_of(length))).alias("per_second"),
            metrics.guarded(F.col("hits"), F.col("events")).alias("ratio"),
        )
    )


def histograms(
    events: DataFrame, ts: str, value: Column, length: str, slide: str, delay: str,
    dims: Sequence[str] = (), bounds: Sequence[float] = tuple(S.LATENCY_BOUNDS),
) -> DataFrame:
    """Cumulative bucket counts per sliding window; ``metrics.quantiles_of`` reads them."""
    counters = metrics.cumulative_counts(value, bounds)
    return (
        _windowed(events, ts, delay, dims, length, slide)
        .agg(*[c.alias(n) for n, c in counters.items()])
        .select(F.col("w.start").alias("window_start"), *dims, *counters)
    )


def over_budget_counts(
    events: DataFrame, ts: str, key: str, length: str, limit: int, delay: str
) -> DataFrame:
    """Keys that used more than their permits in a window, and by how much."""
    return (
        _windowed(events, ts, delay, [key], length).agg(F.count("*").alias("events"))
        .filter(F.col("events") > limit)
        .select(F.col("w.start").alias("window_start"), key, "events",
                (F.col("events") - limit).alias("rejected"))
    )


def run_to_table(
    stream: DataFrame, name: str, transform: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Run a stream over what is there now, append its closed windows to a table, and read it.

    ``transform`` works on each micro-batch before it is written. A micro-batch writes its own
    folder, so one that is repeated after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    target, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    shape = transform(spark.createDataFrame([], stream.schema)) if transform else stream

    def write(batch: DataFrame, epoch: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    query = (
        stream.writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(shape.schema).parquet(target).select(*shape.columns)
