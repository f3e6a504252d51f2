"""Windowed metrics over event logs.

Column arguments are generic: ``ts`` is the event time, ``dims`` the label columns.
Every metric first counts per short pane inside the task, so only counters are shuffled,
never events; sliding windows are put together from the panes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import numeric


def seconds_of(length: str) -> int:
    number, unit = length.split()
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    return int(number) * sizes[unit.rstrip("s")]


def window_start(ts: Column, length: str) -> Column:
    """Start of the tumbling window, aligned to the epoch."""
    size = seconds_of(length)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / size) * size)


def per_window(
    events: DataFrame, ts: str, length: str, dims: Sequence[str], measures: dict[str, Column]
) -> DataFrame:
    """Tumbling windows: ``window_start, dims, measures``."""
    return events.groupBy(window_start(F.col(ts), length).alias("window_start"), *dims).agg(
        *[m.alias(n) for n, m in measures.items()]
    )


def sliding(
    panes: DataFrame, pane: str, length: str, dims: Sequence[str], counters: Sequence[str]
) -> DataFrame:
    """Sum additive counters of tumbling panes over windows that advance by one pane."""
    size, step = seconds_of(length), seconds_of(pane)
    if size % step:
        raise ValueError("a sliding window must be a whole number of panes")
    starts = F.explode(F.sequence(F.lit(0), F.lit(size // step - 1)))
    spread = panes.select(
        F.col("window_start").alias("__pane"), *dims, *counters, starts.alias("__back")
    )
    start = F.timestamp_seconds(F.unix_timestamp("__pane") - F.col("__back") * step)
    return spread.groupBy(start.alias("window_start"), *dims).agg(
        *[F.sum(c).alias(c) for c in counters]
    )


def event_rate(
    events: DataFrame, ts: str, length: str, dims: Sequence[str] = (), include: Column | None = None,
    exclude: Column | None = None, slide: str | None = None,
) -> DataFrame:
    """Events per second per window and label, over the events the filters leave."""
    if include is not None:
        events = events.filter(include)
    if exclude is not None:
        events = events.filter(~exclude)
    counted = per_window(events, ts, slide or length, dims, {"events": F.count("*")})
    if slide:
        counted = sliding(counted, slide, length, dims, ["events"])
    return counted.withColumn("per_second", F.col("events") / float(seconds_of(length)))


def cumulative_counts(value: Column, bounds: Sequence[float]) -> dict[str, Column]:
    """Histogram counters: one per upper bound (inclusive) and the total."""
    counters = {f"le_{i}": F.count_if(value <= bound) for i, bound in enumerate(bounds)}
    return counters | {f"le_{len(bounds)}": F.count(value)}


def quantiles_of(
    histogram: DataFrame, bounds: Sequence[float], quantiles: Sequence[float]
) -> DataFrame:
    """Replace histogram counters by interpolated quantiles ``p50, p95, ...``."""
    names = [f"le_{i}" for i in range(len(bounds) + 1)]
    counts = F.array(*names)
    return histogram.withColumns({
        f"p{round(q * 100)}": numeric.histogram_quantile(q, bounds, counts) for q in quantiles
    }).withColumn("events", F.col(names[-1])).drop(*names)


def latency_quantiles(
    events: DataFrame, ts: str, value: Column, length: str, dims: Sequence[str] = (),
    bounds: Sequence[float] = tuple(S.LATENCY_BOUNDS), quantiles: Sequence[float] = (0.5, 0.95, 0.99),
    slide: str | None = None,
) -> DataFrame:
    counters = cumulative_counts(value, bounds)
    histogram = per_window(events, ts, slide or length, dims, counters)
    if slide:
        histogram = sliding(histogram, slide, length, dims, list(counters))
    return quantiles_of(histogram, bounds, quantiles)


def guarded(part: Column, total: Column) -> Column:
    """A ratio that is 0, not an error, on an empty window."""
    return part / F.greatest(total.cast("double"), F.lit(S.RATIO_FLOOR))


def share(
    events: DataFrame, ts: str, length: str, hit: Column, dims: Sequence[str] = ()
) -> DataFrame:
    """Part of the events that meet a condition: error rate, hit ratio."""
    counted = per_window(events, ts, length, dims, {"hits": F.count_if(hit), "events": F.count("*")})
    return counted.withColumn("ratio", guarded(F.col("hits"), F.col("events")))


def mean(
    events: DataFrame, ts: str, length: str, value: Column, dims: Sequence[str] = ()
) -> DataFrame:
    """Mean from the sum and the count of a window."""
    counted = per_window(events, ts, length, dims, {"total": F.sum(value), "events": F.count(value)})
    return counted.withColumn("mean", guarded(F.coalesce(F.col("total"), F.lit(0)), F.col("events")))


def alarm(
    periods: DataFrame, period: str, breach: Column, needed: int, of: int, dims: Sequence[str] = ()
) -> DataFrame:
    """``window_start, dims, breaching, breaches, alarm`` for every period of a series.

    The alarm is on when at least ``needed`` of the last ``of`` periods breach. A period
    without data does not breach. ``periods`` holds one row per series and period, so a
    busy series is no longer than a quiet one.
    """
    step = seconds_of(period)
    marked = periods.select("window_start", *dims, F.coalesce(breach, F.lit(False)).alias("breaching"))
    second = F.unix_timestamp("window_start")
    calendar = marked.groupBy(*dims).agg(F.min(second).alias("a"), F.max(second).alias("b")).select(
        *dims,
        F.explode(F.sequence("a", "b", F.lit(step).cast("bigint"))).alias("__second"),
    ).withColumn("window_start", F.timestamp_seconds("__second")).drop("__second")
    dense = calendar.join(marked, ["window_start", *dims], "left").withColumn(
        "breaching", F.coalesce("breaching", F.lit(False))
    )
    # A breach counts in its own period and the next of - 1, so no series has to be put in order.
    counted = marked.filter("breaching").select(
        *dims, F.unix_timestamp("window_start").alias("__second"), F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias("__later")
    ).groupBy(*dims, F.timestamp_seconds(F.col("__second") + F.col("__later") * F.lit(step).cast("bigint")).alias("window_start")).agg(
        F.count("*").alias("breaches"))
    return dense.join(counted, ["window_start", *dims], "left").withColumn(
        "breaches", F.coalesce("breaches", F.lit(0))
    ).withColumn("alarm", F.col("breaches") >= needed)


def over_budget(
    events: DataFrame, ts: str, key: str, id: str, length: str = f"{S.WINDOW_SECONDS} seconds",
    limit: int = S.WINDOW_PERMITS, slots: int = 64,
) -> DataFrame:
    """Every event with its number in its key's window, whether it is rejected, and the wait.

    Numbering is split by time: a window is cut into slots, slots are counted, and an
    event's number is the count of the slots before it plus its place in its slot. A key
    with a third of all events is so spread over windows and slots.
    """
    size = seconds_of(length)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = F.floor(F.pmod(micros, F.lit(size * 1_000_000)) * slots / (size * 1_000_000))
    placed = events.withColumn("window_start", window_start(F.col(ts), length)).withColumn("__slot", slot)
    group = [key, "window_start"]
    before = (
        placed.groupBy(*group, "__slot").agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(
            Window.partitionBy(*group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        ))
        .drop("__n")
    )
    in_slot = F.row_number().over(Window.partitionBy(*group, "__slot").orderBy(ts, id))
    numbered = placed.withColumn("__place", in_slot).join(before, [*group, "__slot"])
    number = F.col("__place") + F.coalesce("__before", F.lit(0))
    wait = F.unix_timestamp("window_start") + size - F.floor(micros / 1_000_000)
    return (
        numbered.withColumn("request_number", number)
        .withColumn("rejected", F.col("request_number") > limit)
        .withColumn("retry_after", F.when(F.col("rejected"), wait))
        .drop("__slot", "__place", "__before")
    )


def latest_per_series(
    samples: DataFrame, ts: str, value: str, series: Sequence[str], tie: str
) -> DataFrame:
    """The last sample of every series."""
    last = F.struct(ts, tie)
    return samples.groupBy(*series).agg(
        F.max_by(value, last).alias("value"), F.max(ts).alias("last_seen")
    )


def gauge_total(
    samples: DataFrame, ts: str, value: str, series: Sequence[str], tie: str, by: Sequence[str],
    silence: str,
) -> DataFrame:
    """Per label: the sum of the last values and the series up and down at the last sample.

    A series counts as down when it was silent for longer than ``silence`` before the
    newest sample of all.
    """
    latest = latest_per_series(samples, ts, value, series, tie)
    newest = F.lit(samples.agg(F.max(ts)).first()[0])
    quiet = F.unix_timestamp(newest.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    up = quiet <= seconds_of(silence)
    return latest.groupBy(*by).agg(
        F.round(F.sum("value"), 4).alias("total"), F.count_if(up).alias("up"), F.count_if(~up).alias("down")
    )
