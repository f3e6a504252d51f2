from __future__ import annotations

import json

import pytest
from records import RECORDS, record
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.sources import records, snapshots


def test_array_file_keeps_the_order_and_unifies_number_and_text(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(RECORDS))
    rows = records.read_array(spark, str(tmp_path)).orderBy("ord").collect()
    titles = [r["Title"] for r in rows]
    assert titles[2] is None and titles[3] == "2112" and titles[-1] == "The Ferry"
    assert rows[1]["IMDB Rating"] == "6.8"


def test_both_spellings_of_the_columns_are_read(spark, tmp_path):
    spelled = [{k.replace(" ", "_"): v for k, v in r.items()} for r in RECORDS]
    (tmp_path / "a.json").write_text(json.dumps(spelled))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "l.json").write_text(
        "\n".join(json.dumps({"ord": i} | r) for i, r in enumerate(spelled)))
    for frame in (records.read_array(spark, str(tmp_path / "a.json")), records.read_lines(spark, str(tmp_path / "lines"))):
        assert frame.columns == ["ord", *S.SOURCE_COLUMNS]
        assert frame.filter(F.col("US Gross") == "31000000").count() == len(RECORDS) - 1


def test_a_missing_column_is_named(spark, tmp_path):
    cut = [{k: v for k, v in r.items() if k != "Director"} | {"Extra": 1} for r in RECORDS]
    (tmp_path / "a.json").write_text(json.dumps(cut))
    with pytest.raises(ValueError, match="Director"):
        records.read_array(spark, str(tmp_path))
    frame = spark.createDataFrame([("x", 1)], "Title string, Extra int")
    with pytest.raises(ValueError, match="US Gross"):
        records.require_columns(frame)


def test_extra_columns_are_dropped(spark):
    frame = spark.createDataFrame([tuple(map(str, record().values())) + ("x", 1)],
                                  [c.replace(" ", "_") for c in S.SOURCE_COLUMNS] + ["Extra", "ord"])
    assert records.load(frame).columns == ["ord", *S.SOURCE_COLUMNS.values()]


def test_export_is_written_once_unless_forced(spark, tmp_path):
    path = str(tmp_path / "export")
    snapshots.write_export(spark.range(3), path)
    snapshots.write_export(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    snapshots.write_export(spark.range(5), path, force=True)
    assert spark.read.parquet(path).count() == 5


def test_an_unwritten_snapshot_reads_as_empty(spark, tmp_path):
    assert snapshots.read_snapshot(spark, str(tmp_path / "none")).count() == 0
    assert snapshots.read_snapshot(spark, None).columns[0] == "id"
