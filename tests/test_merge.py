from __future__ import annotations

import pytest
from records import ROWS_OUT
from pyspark.sql import functions as F

from cinefold.operators import merge
from cinefold.operators.embedding import Embedder, Rejected, hashed_words, offline_embedder
from cinefold.plans import enrichment
from cinefold.session import dropping_steps, step_table
from cinefold.sources import snapshots


def at(day):
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")


def refusing(word):
    def connect():
        service = hashed_words()

        def embed(texts):
            if any(word in t for t in texts):
                raise Rejected("no")
            return service(texts)

        return embed

    return Embedder("hashed-words-64", connect)


@pytest.fixture(scope="module")
def first(spark, raw):
    return enrichment.run(raw, merge.empty_snapshot(spark), at(1))


@pytest.fixture(scope="module")
def stored(first):
    return step_table(first.snapshot, "stored")


def counts(merged):
    return {r["action"]: r["rows"] for r in merge.action_counts(merged).collect()}


def test_first_run_inserts_everything(first):
    assert counts(first.merged) == {"inserted": ROWS_OUT}
    report = merge.embedding_report(first.merged).first()
    assert first.merged.keys.filter("action <> 'touched'").count() == 0
    assert (report["embedded"], report["reused"], report["failures"]) == (ROWS_OUT, 0, 0)


def test_second_run_writes_and_embeds_nothing(raw, stored):
    again = enrichment.run(raw, stored, at(2))
    assert counts(again.merged) == {"unchanged": ROWS_OUT}
    assert merge.embedding_report(again.merged).first()["embedded"] == 0
    assert again.merged.rows.count() == 0
    assert again.snapshot.filter(F.col("updated_at") != at(1)).count() == 0
    assert again.snapshot.exceptAll(stored).count() == 0


def test_change_detection(done, stored):
    incoming = done.rows.drop("ord")

    def needed(old, model="hashed-words-64", force=False):
        rows = merge.needing_vectors(old, incoming, model, force).collect()
        return {r["source_key"] for r in rows if r["needs_embedding"]}

    assert needed(stored) == set()
    assert len(needed(stored, model="other")) == ROWS_OUT and len(needed(stored, force=True)) == ROWS_OUT
    one = F.col("source_key") == "winter-ledger::2005-02-18"
    assert needed(stored.filter(~one)) == {"winter-ledger::2005-02-18"}
    assert needed(stored.withColumn("embedding", F.when(~one, F.col("embedding")))) == {"winter-ledger::2005-02-18"}
    assert needed(stored.withColumn("embedded_text_hash", F.when(one, F.lit("x")).otherwise(F.col("embedded_text_hash")))
                  ) == {"winter-ledger::2005-02-18"}


def test_a_number_changes_the_row_but_keeps_the_vector(done, stored):
    incoming = done.rows.drop("ord").withColumn("content_hash", F.concat("content_hash", F.lit("x")))
    merged = merge.merge(stored, incoming, offline_embedder(), "1.0.0", at(3))
    assert counts(merged) == {"updated": ROWS_OUT} and merged.rows.filter("needed").count() == 0
    row, before = (f.orderBy("id").first() for f in (merged.snapshot, stored))
    assert row["embedding"] == before["embedding"] and row["created_at"] == before["created_at"]
    assert row["updated_at"] > before["updated_at"]


def test_a_new_version_alone_updates(done, stored):
    merged = merge.merge(stored, done.rows.drop("ord"), offline_embedder(), "2.0.0", at(3))
    assert counts(merged) == {"updated": ROWS_OUT}


def test_forcing_embeds_all_and_updates_none(done, stored):
    merged = merge.merge(stored, done.rows.drop("ord"), offline_embedder(), "1.0.0", at(3), force=True)
    assert counts(merged) == {"unchanged": ROWS_OUT} and merge.embedding_report(merged).first()["embedded"] == ROWS_OUT


def test_rows_that_are_no_longer_delivered_stay(done, stored):
    incoming = done.rows.drop("ord").filter("title <> 'Winter Ledger'")
    merged = merge.merge(stored, incoming, offline_embedder(), "1.0.0", at(3))
    assert counts(merged) == {"unchanged": ROWS_OUT - 1, "kept": 1}


def test_new_rows_without_a_vector_are_held_back(spark, done):
    merged = merge.merge(merge.empty_snapshot(spark), done.rows.drop("ord"), refusing("Winter"), "1.0.0", at(1))
    assert counts(merged) == {"inserted": ROWS_OUT - 1, "held_back": 1}
    assert merged.snapshot.count() == ROWS_OUT - 1
    assert merge.load_report(merged).first()["total_rows"] == ROWS_OUT - 1


def test_a_failed_renewal_is_picked_up_by_the_next_run(done, stored):
    one = F.col("title") == "Winter Ledger"
    incoming = done.rows.drop("ord").withColumns({
        "augmented_text": F.when(one, F.concat("augmented_text", F.lit(" new"))).otherwise(F.col("augmented_text")),
        "content_hash": F.when(one, F.lit("new")).otherwise(F.col("content_hash")),
    })
    failed = merge.merge(stored, incoming, refusing("Winter"), "1.0.0", at(3))
    assert counts(failed) == {"updated": 1, "unchanged": ROWS_OUT - 1}
    after = step_table(failed.snapshot, "s")
    row, before = (f.filter(one).first() for f in (after, stored))
    assert row["embedding"] == before["embedding"] and row["augmented_text"].endswith(" new")
    repaired = merge.merge(after, incoming, offline_embedder(), "1.0.0", at(4))
    assert repaired.rows.filter("needed").count() == 1
    assert repaired.snapshot.filter(one).first()["embedding"] != before["embedding"]


def test_a_model_change_renews_every_vector(done, stored):
    other = Embedder("other", hashed_words)
    merged = merge.merge(stored, done.rows.drop("ord"), other, "1.0.0", at(3))
    assert counts(merged) == {"updated": ROWS_OUT}
    assert {r[0] for r in merged.snapshot.select("embedding_model").distinct().collect()} == {"other"}


def test_snapshots_are_written_beside_the_old_one(spark, stored, tmp_path):
    path = str(tmp_path / "snapshot")
    snapshots.write_snapshot(stored, path)
    assert snapshots.read_snapshot(spark, path).exceptAll(stored).count() == 0
    with pytest.raises(Exception, match="already exists"):
        snapshots.write_snapshot(stored, path)


def _files(path):
    return sorted((str(p.relative_to(path)), p.stat().st_mtime_ns) for p in path.rglob("*.parquet"))


def test_a_catalogue_is_renewed_in_place(spark, raw, done, first, tmp_path):
    path = tmp_path / "catalogue"
    assert snapshots.renew_catalogue(first.merged, str(path)) == ROWS_OUT
    stored = snapshots.read_catalogue(spark, str(path))
    assert stored.select(*merge.SNAPSHOT).exceptAll(first.snapshot).count() == 0 and stored.count() == ROWS_OUT
    before = _files(path)
    same = merge.merge(stored.drop("bucket"), done.rows.drop("ord"), offline_embedder(), "1.0.0", at(2))
    assert snapshots.renew_catalogue(same, str(path)) == 0 and _files(path) == before
    one = F.col("title") == "Winter Ledger"
    hit = stored.filter(one).first()["bucket"]  # these files will be gone
    incoming = done.rows.drop("ord").withColumn("content_hash", F.when(one, F.lit("new")).otherwise(F.col("content_hash")))
    touched = merge.merge(stored.drop("bucket"), incoming, offline_embedder(), "1.0.0", at(3))
    assert snapshots.renew_catalogue(touched, str(path)) == 1
    after = _files(path)
    assert {f.split("/")[0] for f, _ in set(after) - set(before)} == {f"bucket={hit}"}
    spark.catalog.refreshByPath(str(path))
    again = snapshots.read_catalogue(spark, str(path))
    assert again.count() == ROWS_OUT and again.filter(one).first()["updated_at"] > again.filter(~one).first()["updated_at"]


def test_step_tables_can_be_dropped(spark, tmp_path):
    with dropping_steps(spark):
        table = step_table(spark.range(5), "gone")
        path = table.inputFiles()[0]
        assert table.count() == 5
    assert not snapshots.exists(spark, path, marker=None)


def test_run_report_is_one_document(first, spark, tmp_path):
    document = enrichment.report_document(first.report, "1.0.0").first()
    assert [s["stage"] for s in document["stages"]] == ["cleaning", "embedding", "features", "imputation", "load"]
    snapshots.write_report(enrichment.report_document(first.report, "1.0.0"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_classification_reads_neither_texts_nor_vectors(spark, done, stored):
    shown = merge.classify(stored, done.rows, "m", "1")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in shown.split("\n") if "FileScan" in line and "embedded_text_hash" in line]
    assert len(scans) == 1 and "embedding:array" not in scans[0] and "augmented_text:" not in scans[0]
