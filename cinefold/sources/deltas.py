"""A catalogue kept as a base table and deltas that are merged when it is read.

A run adds the rows that it wrote as one delta, so its cost follows them and not the catalogue. Reading takes each
key's newest row: deltas first, then the base without their keys. When the deltas hold ``COMPACT_SHARE`` of the base, or there are
``MOST_DELTAS`` of them, the next base is written, laid out for decade and genre filters, in files whose number follows from its size.

Every run ends with a commit, a folder of its own with one row that names the tables that count. It is written last, so a run that was
cut off leaves the catalogue as it was, and what is being read is never overwritten. One run at a time may commit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators.merge import SNAPSHOT, SNAPSHOT_TYPES, Merge, action_counts, clustered, empty_snapshot
from cinefold.sources.snapshots import exists

COMPACT_SHARE = 0.2
MOST_DELTAS = 16
COMMIT = ("number long, base string, deltas array<string>, base_rows long, delta_rows long, digest string, report string, delivered long,"
          " kept long, pending long")


@dataclass
class Commit:
    """``delivered`` rows came with the last run and ``kept`` ones did not; ``pending`` ones still want a vector."""

    number: int = 0
    base: str | None = None
    deltas: list[str] = field(default_factory=list)
    base_rows: int = 0
    delta_rows: int = 0
    digest: str | None = None
    report: str | None = None
    delivered: int = 0
    kept: int = 0
    pending: int = 0


def current(spark: SparkSession, path: str) -> Commit:
    """The last commit that was written to its end; one without tables before the first run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return Commit()
    names = sorted((status.getPath().getName() for status in files.listStatus(folder)), reverse=True)
    last = next((name for name in names if exists(spark, f"{path}/commits/{name}")), None)
    return Commit(**spark.read.schema(COMMIT).json(f"{path}/commits/{last}").first().asDict()) if last else Commit()


def _rows(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{n} {kind}" for n, kind in SNAPSHOT_TYPES.items())).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, commit: Commit | None = None) -> DataFrame:
    """The catalogue as of its last commit."""
    commit = commit or current(spark, path)
    if commit.base is None:
        return empty_snapshot(spark)
    base = _rows(spark, path, commit.base)
    if not commit.deltas:
        return base
    numbered = [_rows(spark, path, name).withColumn("delta", F.lit(i)) for i, name in enumerate(commit.deltas)]
    newest = reduce(DataFrame.unionByName, numbered)
    if len(numbered) > 1:
        newest = newest.groupBy("source_key").agg(F.max_by(F.struct(*SNAPSHOT), "delta").alias("row")).select("row.*")
    keys = reduce(DataFrame.unionByName, (_rows(spark, path, name).select("source_key") for name in commit.deltas))
    return base.join(keys, "source_key", "left_anti").select(*SNAPSHOT).unionByName(newest.select(*SNAPSHOT))


def commit(spark: SparkSession, path: str, merged: Merge, digest: str | None = None, report: DataFrame | None = None,
           share: float = COMPACT_SHARE, most: int = MOST_DELTAS) -> Commit:
    """Add what a run has written, compact if that is due, and make it the catalogue."""
    last = current(spark, path)
    counts = {row["action"]: row["rows"] for row in action_counts(merged).collect()}
    pending = merged.rows.filter("needed AND embed_error IS NOT NULL").count()
    written, number = counts.get("inserted", 0) + counts.get("updated", 0), last.number + 1
    new = Commit(number, last.base, list(last.deltas), last.base_rows, last.delta_rows + written, digest, last.report,
                 written + counts.get("unchanged", 0), counts.get("kept", 0), pending)
    if last.base is None:
        new.base, new.base_rows, new.delta_rows = f"base-{number:09d}", written, 0
        clustered(merged.snapshot).write.parquet(f"{path}/{new.base}")
    elif written:
        name = f"delta-{number:09d}"
        merged.rows.filter(F.col("action").isin("inserted", "updated")).select(*SNAPSHOT).write.parquet(f"{path}/{name}")
        new.deltas.append(name)
        if new.delta_rows > share * new.base_rows or len(new.deltas) > most:
            new = _compacted(spark, path, new)
    if report is not None:
        new.report = f"report-{number:09d}"
        report.coalesce(1).write.parquet(f"{path}/{new.report}")
    spark.createDataFrame([tuple(vars(new).values())], COMMIT).coalesce(1).write.json(f"{path}/commits/{number:09d}")
    return new


def _compacted(spark: SparkSession, path: str, commit: Commit) -> Commit:
    base = f"base-{commit.number:09d}"
    clustered(read(spark, path, commit)).write.parquet(f"{path}/{base}")
    commit.base, commit.deltas, commit.base_rows, commit.delta_rows = base, [], _rows(spark, path, base).count(), 0
    return commit


def stored_report(spark: SparkSession, path: str, commit: Commit) -> DataFrame:
    return spark.read.parquet(f"{path}/{commit.report}")
