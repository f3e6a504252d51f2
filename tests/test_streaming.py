from __future__ import annotations

import os

import pytest
from compare import connect, differences
from records import ROWS_OUT
from pyspark.sql import functions as F

from cinefold.operators import merge, metrics
from cinefold.plans import enrichment
from cinefold.sources import snapshots
from cinefold.streaming import enrichment as streamed
from cinefold.streaming import metrics as stream_metrics


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    """The log as files in order of time, one micro-batch each."""
    path = str(tmp_path_factory.mktemp("events") / "log")
    for day, name in ((10, "a"), (20, "b"), (40, "c")):
        low = {"a": 0, "b": 10, "c": 20}[name]
        events.filter((F.dayofmonth("ts") > low) & (F.dayofmonth("ts") <= day)).coalesce(1).write.mode("append").parquet(path)
    return path


def test_rates_of_closed_windows_equal_the_batch_result(spark, events, folder):
    stream = stream_metrics.event_stream(spark, folder, events.schema, 1)
    error = F.col("event_type") == "error"
    got = stream_metrics.run_to_table(stream_metrics.rates(stream, "ts", "1 day", "1 hour", error, ["user_id"]), "r")
    closed = F.lit(events.agg(F.max("ts")).first()[0]) - F.expr("interval 1 hour")
    want = metrics.share(events, "ts", "1 day", error, ["user_id"]).filter(
        F.col("window_start") + F.expr("interval 1 day") <= closed)
    columns = ["window_start", "user_id", "events", "hits", "ratio"]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0
    assert got.count() == want.count() > 100


def test_streamed_enrichment_equals_the_batch_run(spark, raw, tmp_path):
    """Two micro-batches into a first snapshot, the second one changing a row of the first."""
    stats = enrichment.enrich(raw)
    frozen = streamed.Frozen(stats.statistics, stats.variants)
    base = str(tmp_path / "base")
    at = F.lit("2024-01-01").cast("timestamp")
    first = enrichment.run(raw.filter("ord in (6, 8, 15)"), merge.empty_snapshot(spark), at,
                           statistics=stats.statistics, variants=stats.variants)
    snapshots.write_snapshot(first.snapshot, base)
    log = str(tmp_path / "log")
    raw.filter("ord < 8").coalesce(1).write.mode("append").json(log)
    later = raw.filter("ord >= 8").unionByName(
        raw.filter("ord = 1").withColumn("ord", F.lit(20).cast("bigint")).withColumn("us_gross", F.lit("99")))
    later.coalesce(1).write.mode("append").json(log)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).json(log)
    target = str(tmp_path / "stream")
    streamed.enrich_stream(stream, target, frozen, "2024-02-01 00:00:00", first=base)
    got = {r["title"]: r for r in streamed.current(spark, target, base).filter("title <> 'The Ferry'").collect()}
    assert len(got) == ROWS_OUT - 3 and streamed.current(spark, target, base).count() == ROWS_OUT
    assert got["Harbour Lights"]["us_gross"] == 99 and got["2112"]["us_gross"] == 31_000_000
    whole = {r["source_key"]: r["content_hash"] for r in stats.rows.collect()}
    assert all(r["content_hash"] == whole[r["source_key"]] for t, r in got.items() if t != "Harbour Lights")
    again = str(tmp_path / "compact")
    streamed.compact(spark, target, again, base)
    assert spark.read.parquet(again).count() == ROWS_OUT
    # The remakes were stored before and did not change, so the stream wrote nothing for them.
    assert spark.read.parquet(f"{target}/rows").filter("title = 'The Ferry'").count() == 0


def test_streamed_query_with_order_numbers_on_two_records(spark, sf_dir, tmp_path):
    """Part keys a thousand million apart: the copies that the records hold take order numbers of other parts."""
    import __spark_entry__ as entry

    con = connect(sf_dir)
    keys = {"p_partkey", "l_partkey", "s_suppkey", "l_suppkey", "l_orderkey"}
    for name in ("part", "lineitem", "supplier"):
        shifted = ", ".join(f"{c} + i * 1000000000 AS {c}" if c in keys else c for c in con.table(name).columns)
        con.execute(f"COPY (SELECT {shifted} FROM {name}, range(3) r(i)) TO '{tmp_path}/{name}.parquet'")
    for name in os.listdir(sf_dir):
        if not (tmp_path / name).exists():
            (tmp_path / name).symlink_to(f"{sf_dir}/{name}")
    query, check = entry.queries()["st4_streamed_enrichment"], entry.oracle_sql()["st4_streamed_enrichment"]
    assert differences(query(spark, str(tmp_path)), connect(str(tmp_path)), check) == []
