"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is run to
the end of all its columns. ``first_run`` and ``second_run`` are whole enrichment runs, the
second on unchanged input.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cinefold.plans import refresh
from cinefold.plans.registry import collect
from cinefold.plans.registry.base import Shared
from cinefold.session import scratch_path, use_checkpoint_dir, use_package

HEADLINE = [
    "v2_hybrid_search", "v3_all_neighbours", "v4_batch_search", "v4_batch_search_within_label",
    "v6_approximate_search", "p5_exact_titles", "t4_fuzzy_titles", "t6_title_lookup",
    "a4_summary", "a5_statistics", "i1_group_medians", "i1_order_value_medians", "i2_line_fit",
    "c3_majority_spelling", "c8_exact_copies", "c11_first_per_key", "f6_document_text", "e3_embedded_documents",
    "m1_merged_snapshot", "s10_constraint_audit", "w1_event_rate", "w3_latency_quantiles",
    "w6_latency_alarm", "w7_over_budget", "st1_streamed_rates", "x3_planar_projection",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_checkpoint_dir(use_package(spark), os.environ.get("BENCH_CHECKPOINTS", "/tmp/checkpoints/bench"))
    queries, times = collect().queries, {}

    def timed(name, action):
        started = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name:32s} {times[name]:8.2f}", file=sys.stderr, flush=True)
        return result

    shared = Shared.of(spark, sf_dir)
    landed = shared.landed.count()

    path = scratch_path(spark, "bench-catalogue")

    def run(day):
        """One enrichment run against the catalogue in its folder, reports included."""
        when = F.lit(f"2024-01-{day} 00:00:00").cast("timestamp")
        refresh.refresh(shared.raw, path, when).report.collect()

    timed("first_run", lambda: run("01"))
    timed("second_run", lambda: run("02"))
    shared.snapshot.count()
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    requests = shared.table("embeddings").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "enrichment_rows_per_sec": round(landed / times["first_run"], 1),
        "unchanged_rows_per_sec": round(landed / times["second_run"], 1),
        "exact_searches_per_sec": round(requests / times["v3_all_neighbours"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
