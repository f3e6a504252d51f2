from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cinefold.functions import numeric
from cinefold.operators import metrics

START = dt.datetime(2024, 1, 1)


def log(spark, rows):
    """Rows of (second, key, value)."""
    data = [(i, START + dt.timedelta(seconds=s), k, float(v)) for i, (s, k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, ts timestamp, k string, value double")


@pytest.mark.parametrize(("values", "quantile", "expected"), [
    ([0.5] * 10, 0.5, 0.5), ([1.5] * 10, 0.5, 1.5), ([0.5] * 5 + [1.5] * 5, 0.75, 1.5), ([9.0] * 10, 0.95, 4.0),
    ([], 0.5, None), ([1.0], 1.0, 1.0), ([3.0, 3.5], 0.5, 3.0),
])
def test_histogram_quantile(spark, values, quantile, expected):
    bounds = [1.0, 2.0, 4.0]
    cumulative = [sum(v <= b for v in values) for b in bounds] + [len(values)]
    frame = spark.createDataFrame([(cumulative,)], "c array<bigint>")
    assert frame.select(numeric.histogram_quantile(quantile, bounds, F.col("c"))).first()[0] == expected


def test_sliding_windows_equal_the_events_they_cover(spark):
    draw = random.Random(1)
    events = log(spark, [(draw.randrange(3600), draw.choice("ab"), 1) for _ in range(500)])
    got = metrics.event_rate(events, "ts", "5 minutes", ["k"], slide="1 minute")
    want = events.groupBy(F.window("ts", "5 minutes", "1 minute").start.alias("window_start"), "k").agg(
        F.count("*").alias("events"))
    assert got.drop("per_second").exceptAll(want).count() == 0 and got.count() == want.count()


def test_windows_must_be_whole_panes(spark):
    with pytest.raises(ValueError):
        metrics.event_rate(log(spark, [(0, "a", 1)]), "ts", "5 minutes", slide="2 minutes")


def test_alarm_needs_enough_of_the_last_periods_and_gaps_do_not_breach(spark):
    breaching = {0, 1, 4, 5, 9, 10, 11}
    rows = [(60 * m, "a", 9 if m in breaching else 1) for m in range(13) if m not in (2, 3, 6)]
    periods = metrics.per_window(log(spark, rows), "ts", "1 minute", ["k"], {"v": F.max("value")})
    out = metrics.alarm(periods, "1 minute", F.col("v") > 5, 3, 5, ["k"]).orderBy("window_start").collect()
    assert len(out) == 13
    want = [sum(m in breaching for m in range(max(0, i - 4), i + 1)) >= 3 for i in range(13)]
    assert [r["alarm"] for r in out] == want and any(want) and not all(want)


@pytest.mark.parametrize("slots", [1, 7, 64])
def test_numbering_is_the_same_however_a_hot_key_is_cut(spark, slots):
    draw = random.Random(2)
    rows = [(draw.randrange(180), "hot" if i % 3 else f"k{i % 11}", 0) for i in range(1500)]
    events = log(spark, rows)
    out = metrics.over_budget(events, "ts", "k", "id", "60 seconds", 60, slots).collect()
    seen, want = {}, {}
    for i, (s, k, _) in sorted(enumerate(rows), key=lambda e: (e[1][0], e[0])):
        seen[k, s // 60] = seen.get((k, s // 60), 0) + 1
        want[i] = (seen[k, s // 60], seen[k, s // 60] > 60, 60 - s % 60 if seen[k, s // 60] > 60 else None)
    assert {r["id"]: (r["request_number"], r["rejected"], r["retry_after"]) for r in out} == want


def test_ratio_of_an_empty_window_is_zero(spark):
    frame = spark.createDataFrame([(0, 0), (1, 4)], "a int, b int")
    assert [r[0] for r in frame.select(metrics.guarded(F.col("a"), F.col("b"))).collect()] == [0.0, 0.25]


def test_gauges_take_the_last_sample_and_silent_series_are_down(spark):
    events = log(spark, [(0, "a", 5), (100, "a", 7), (100, "a", 8), (10, "b", 1), (200, "c", 2)])
    out = metrics.gauge_total(events.withColumn("one", F.lit("all")), "ts", "value", ["one", "k"], "id", ["one"], "150 seconds")
    assert tuple(out.first()) == ("all", 11.0, 2, 1)
