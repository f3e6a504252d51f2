"""The catalogue of deltas, and runs against it."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from records import ROWS_OUT

from cinefold.operators import embedding, merge
from cinefold.operators.embedding import Embedder, Rejected, hashed_words
from cinefold.plans import refresh
from cinefold.sources import deltas


def at(day):
    return F.lit(f"2024-03-{day:02d} 00:00:00").cast("timestamp")


def unable():
    """An embedder whose service answers the probe only."""
    def connect():
        service = hashed_words()

        def embed(texts):
            if texts != ["dimension probe"]:
                raise Rejected("not now")
            return service(texts)

        return embed

    return Embedder(embedding.offline_embedder().model, connect)


def rows(frame):
    return sorted(map(str, frame.collect()))


def counts(report, stage="load"):
    return {r["issue"]: r["count"] for r in report.filter(F.col("stage") == stage).collect()}


def merged(stored, incoming, day, plan=None):
    return merge.merge(stored, incoming, plan or embedding.offline_embedder(), "1.0.0", at(day))


def edited(done, title, gross):
    return done.rows.drop("ord").withColumns({
        "us_gross": F.when(F.col("title") == title, F.lit(gross)).otherwise(F.col("us_gross")),
        "content_hash": F.when(F.col("title") == title, F.sha2(F.lit(str(gross)), 256)).otherwise(F.col("content_hash"))})


def test_reading_merges_deltas_as_a_whole_table_would(spark, done, tmp_path):
    path, whole = str(tmp_path), merge.empty_snapshot(spark)
    titles = [r["title"] for r in done.rows.orderBy("source_key").limit(2).collect()]
    for day, (title, gross) in enumerate([(None, 0), (titles[0], 5), (titles[1], 6), (titles[0], 7)], 1):
        out = merged(deltas.read(spark, path), edited(done, title, gross), day)
        whole = spark.createDataFrame(merged(whole, edited(done, title, gross), day).snapshot.collect(), merge.empty_snapshot(spark).schema)
        made = deltas.commit(spark, path, out, share=0.9)
        assert rows(deltas.read(spark, path).select(*merge.SNAPSHOT)) == rows(whole.select(*merge.SNAPSHOT))
    assert len(made.deltas) == 3 and made.base_rows == ROWS_OUT and made.number == 4
    delta = spark.read.parquet(f"{path}/{made.deltas[-1]}")
    assert 1 <= delta.count() < ROWS_OUT  # no more than what was touched


@pytest.mark.parametrize("limit", [{"share": 0.05}, {"most": 0}])
def test_compaction_keeps_the_rows(spark, done, tmp_path, limit):
    path, title = str(tmp_path), done.rows.first()["title"]
    deltas.commit(spark, path, merged(deltas.read(spark, path), done.rows.drop("ord"), 1))
    out = merged(deltas.read(spark, path), edited(done, title, 3), 2)
    want = rows(out.snapshot.select(*merge.SNAPSHOT))
    made = deltas.commit(spark, path, out, **limit)
    assert made.deltas == [] and made.base == "base-000000002" and made.base_rows == ROWS_OUT
    assert rows(deltas.read(spark, path).select(*merge.SNAPSHOT)) == want


def test_a_run_that_was_cut_off_leaves_the_catalogue_as_it_was(spark, done, tmp_path):
    path = str(tmp_path)
    first = deltas.commit(spark, path, merged(deltas.read(spark, path), done.rows.drop("ord"), 1))
    os.makedirs(f"{path}/commits/000000002")  # without its mark of success
    spark.range(1).write.parquet(f"{path}/delta-000000002")
    assert deltas.current(spark, path) == first and deltas.read(spark, path).count() == ROWS_OUT


def test_unchanged_input_reads_no_stored_row_and_writes_nothing(spark, raw, tmp_path):
    path = str(tmp_path)
    first = refresh.refresh(raw, path, at(1))
    assert first.changed and counts(first.report) == {"inserted": ROWS_OUT, "updated": 0, "unchanged": 0, "held_back": 0, "total_rows": ROWS_OUT}
    before = {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path)}
    os.rename(f"{path}/{first.commit.base}", f"{path}/aside")  # it isn't opened
    again = refresh.refresh(raw.repartition(5), path, at(2))
    os.rename(f"{path}/aside", f"{path}/{first.commit.base}")
    assert not again.changed and counts(again.report) == {"inserted": 0, "updated": 0, "unchanged": ROWS_OUT, "held_back": 0, "total_rows": ROWS_OUT}
    assert counts(again.report, "embedding") == {"embedded": 0, "reused": ROWS_OUT, "batches": 0, "failures": 0}
    assert {d: sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path)} == before
    stages = lambda report: rows(report.filter(~F.col("stage").isin("embedding", "load")))
    assert stages(again.report) == stages(first.report) and len(stages(first.report)) > 10


def test_what_makes_a_run_necessary(spark, raw, tmp_path):
    path = str(tmp_path)
    refresh.refresh(raw, path, at(1))
    assert not refresh.refresh(raw, path, at(2)).changed
    newer = refresh.refresh(raw, path, at(3), version="1.1.0")
    assert newer.changed and counts(newer.report)["updated"] == ROWS_OUT
    assert refresh.refresh(raw, path, at(4), version="1.1.0", force=True).changed
    column = next(n for n, kind in raw.dtypes if kind == "string" and n != "ord")
    assert refresh.digest(raw) != refresh.digest(raw.withColumn(column, F.lit(None).cast("string")))
    assert refresh.digest(raw) != refresh.digest(raw.union(raw.limit(1)))


def test_rows_without_a_vector_are_tried_again(spark, raw, tmp_path):
    path = str(tmp_path)
    failed = refresh.refresh(raw, path, at(1), plan=unable())
    assert failed.commit.pending == ROWS_OUT and counts(failed.report)["held_back"] == ROWS_OUT
    mended = refresh.refresh(raw, path, at(2))
    assert mended.changed and counts(mended.report)["inserted"] == ROWS_OUT
    assert not refresh.refresh(raw, path, at(3)).changed and deltas.read(spark, path).count() == ROWS_OUT
