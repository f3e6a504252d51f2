"""The physical plans that make the operators hold at scale, and hot keys."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cinefold.operators import cleaning, search
from cinefold.operators.medians import exact_medians
from cinefold.plans.registry.base import Shared


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hybrid_search_pushes_its_filter_and_keeps_k_rows_per_task(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shown = plan(search.search(vectors, [1.0] * 64, 5, [F.col("label") == 3], "vec_id", columns=["vec_id"]))
    assert "TakeOrderedAndProject" in shown and "EqualTo(label,3)" in shown
    assert "Exchange" not in shown


def test_batch_search_reads_the_catalogue_once_without_a_shuffle(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shown = plan(search.top_k_per_request(vectors, vectors, 5, id="vec_id", request_id="vec_id", request_vector="embedding"))
    assert shown.count("FileScan") == 1 and "CartesianProduct" not in shown and "NestedLoop" not in shown
    assert shown.index("MapInArrow") > shown.index("Exchange")  # only answers are shuffled


def test_metadata_filters_do_not_read_the_vectors(spark, sf_dir):
    snapshot = Shared.of(spark, sf_dir).snapshot
    shown = plan(search.result_rows(search.filtered(snapshot, search.optional_filters(genre="ECONOMY"))))
    scan = shown[shown.index("FileScan"):]
    assert "EqualTo(major_genre,ECONOMY)" in scan and "embedding:" not in scan


def test_keys_are_thinned_out_before_the_shuffle(spark):
    frame = spark.range(1000).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("k"))
    shown = plan(cleaning.first_per_key(frame, "k"))
    assert shown.count("WindowGroupLimit") >= 2


def test_majority_vote_shuffles_counts_not_rows(spark):
    frame = spark.range(9).select(F.col("id").alias("ord"), F.lit("x").alias("distributor"))
    shown = plan(cleaning.variant_spellings(frame, ["distributor"]))
    assert "partial_count" in shown and "Window" not in shown


def test_lookups_of_known_size_are_broadcast_by_the_planner(spark, sf_dir):
    shared = Shared.of(spark, sf_dir)
    shown = plan(cleaning.apply_spellings(shared.normal, shared.variants, ["director", "source"]))
    assert shown.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in shown


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_lookups_too_large_to_broadcast_give_the_same_rows(spark, sf_dir, threshold):
    shared = Shared.of(spark, sf_dir)
    expected = shared.cleaned.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = cleaning.clean(shared.raw, variants=shared.variants)
        assert rows.exceptAll(shared.cleaned.select(rows.columns)).count() == 0 and rows.count() == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_projections_too_large_for_the_compiler_are_split(spark, sf_dir):
    shared = Shared.of(spark, sf_dir)
    rows = cleaning.keyed(shared.raw, variants=shared.variants)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenString(rows._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    largest = max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code))
    assert largest <= 8000 or int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_a_hot_group_is_spread_by_its_values_for_the_median(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.col("id").cast("double").alias("v"))
    shown = plan(exact_medians(rows, ["g"], "v"))
    assert "partial_percentile_approx" in shown or "partial_approx_percentile" in shown
    got = {r["g"]: r["median"] for r in exact_medians(rows, ["g"], "v").collect()}
    want = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want
