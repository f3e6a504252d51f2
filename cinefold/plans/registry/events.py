"""Windowed metrics on the event log, in batch and as streams, and streamed enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import text
from cinefold.operators import cleaning, metrics
from cinefold.plans.registry import Registry, sql
from cinefold.plans.registry.base import RUN_TIME, Shared, plain
from cinefold.plans.registry.merging import vector_digits, vector_digits_sql
from cinefold.session import scratch_path
from cinefold.sources import records
from cinefold.streaming import enrichment as streamed
from cinefold.streaming import metrics as stream_metrics


def latency():
    return F.col("value") / 1000.0


def _start(unit: str, ts: str = "ts") -> str:
    return f"strftime(date_trunc('{unit}', {ts}), '%Y-%m-%d %H:%M:%S')"


def _cumulative(value: str = "value / 1000.0", bounds: list[float] = S.LATENCY_BOUNDS) -> str:
    counts = [f"count_if({value} <= {b}) AS le_{i}" for i, b in enumerate(bounds)]
    return ", ".join([*counts, f"count({value}) AS le_{len(bounds)}"])


def _quantile(q: float, bounds: list[float] = S.LATENCY_BOUNDS) -> str:
    """Linear inside the first bucket that reaches the rank."""
    last, cases = len(bounds), []
    for i, bound in enumerate(bounds):
        low, before = (bounds[i - 1], f"le_{i - 1}") if i else (0.0, "0")
        share = f"CASE WHEN le_{i} = {before} THEN 0 ELSE ({q} * le_{last} - {before}) / (le_{i} - {before}) END"
        cases.append(f"WHEN le_{i} >= {q} * le_{last} THEN {low} + ({bound} - {low}) * {share}")
    return f"CASE WHEN le_{last} = 0 THEN NULL {' '.join(cases)} ELSE {bounds[-1]} END"


_QUANTILES = ", ".join(f"round({_quantile(q)}, 9) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99))


def _rounded(frame, *names):
    return plain(frame.withColumns({n: F.round(n, 9) for n in names}))


def _sliding(dims: str, panes: str, counters: str, hours: int) -> str:
    """Panes of one hour spread over the windows that hold them."""
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in counters.split(", "))
    return f"""
      SELECT pane - to_hours(CAST(back AS INT)) AS start, {dims} {sums}
      FROM ({panes}) CROSS JOIN range({hours}) r(back) GROUP BY ALL"""


def _alarm(periods: str, unit: str, dims: str, breach: str, needed: int, of: int) -> str:
    """``periods`` gives ``w, dims, stat``; missing periods do not breach."""
    by = f"PARTITION BY {dims}" if dims else ""
    keys, join = (f"{dims},", f"c.{dims} = p.{dims} AND") if dims else ("", "")
    out = f"c.{dims}," if dims else ""
    return f"""
      WITH p AS ({periods}),
      c AS (SELECT {keys} unnest(generate_series(min(w), max(w), INTERVAL 1 {unit})) AS w FROM p
            {'GROUP BY ' + dims if dims else ''}),
      d AS (SELECT {out} c.w, coalesce({breach}, false) AS breaching FROM c LEFT JOIN p ON {join} c.w = p.w)
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, {keys} breaching, breaches,
        breaches >= {needed} AS alarm
      FROM (SELECT *, CAST(sum(CAST(breaching AS INT)) OVER ({by} ORDER BY w ROWS BETWEEN {of - 1} PRECEDING
              AND CURRENT ROW) AS BIGINT) AS breaches FROM d)"""


def register(r: Registry) -> None:
    def events(spark, sf):
        return Shared.of(spark, sf).table("events")

    def failed():
        return F.col("event_type") == "error"

    @r.add("w1_event_rate", f"""
        SELECT {_start('hour')} AS window_start, event_type, count(*) AS events, count(*) / 3600.0::DOUBLE AS per_second
        FROM events WHERE value > 1 AND event_type <> 'signup' GROUP BY 1, 2""")
    def w1(spark, sf):
        return plain(metrics.event_rate(events(spark, sf), "ts", "1 hour", ["event_type"],
                                        include=F.col("value") > 1, exclude=F.col("event_type") == "signup"))

    hourly = "SELECT date_trunc('hour', ts) AS pane, event_type, count(*) AS events FROM events GROUP BY ALL"

    @r.add("w2_sliding_rate", f"""
        SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, events,
          events / 21600.0::DOUBLE AS per_second FROM ({_sliding('event_type,', hourly, 'events', 6)})""")
    def w2(spark, sf):
        return plain(metrics.event_rate(events(spark, sf), "ts", "6 hours", ["event_type"], slide="1 hour"))

    @r.add("w3_latency_quantiles", f"""
        SELECT {_start('day', 'w')} AS window_start, event_type, le_11 AS events, {_QUANTILES} FROM (
          SELECT date_trunc('day', ts) AS w, event_type, {_cumulative()} FROM events GROUP BY ALL)""")
    def w3(spark, sf):
        out = metrics.latency_quantiles(events(spark, sf), "ts", latency(), "1 day", ["event_type"])
        return _rounded(out, "p50", "p95", "p99")

    # Whole tens of the value stand for the number of results a search returned.
    tens, small = "floor(value / 10)", list(S.RESULT_COUNT_BOUNDS)

    @r.add("w3_result_count_median", f"""
        SELECT {_start('day', 'w')} AS window_start, le_{len(small)} AS events, round({_quantile(0.5, small)}, 9) AS p50
        FROM (SELECT date_trunc('day', ts) AS w, {_cumulative(tens, small)} FROM events GROUP BY ALL)""")
    def w3_results(spark, sf):
        out = metrics.latency_quantiles(events(spark, sf), "ts", F.floor(F.col("value") / 10), "1 day", [], small, [0.5])
        return _rounded(out, "p50")

    hourly_counts = f"SELECT date_trunc('hour', ts) AS pane, {_cumulative()} FROM events GROUP BY ALL"
    counters = ", ".join(f"le_{i}" for i in range(len(S.LATENCY_BOUNDS) + 1))

    @r.add("w3_sliding_quantiles", f"""
        SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, le_11 AS events, {_QUANTILES}
        FROM ({_sliding('', hourly_counts, counters, 5)})""")
    def w3_sliding(spark, sf):
        out = metrics.latency_quantiles(events(spark, sf), "ts", latency(), "5 hours", slide="1 hour")
        return _rounded(out, "p50", "p95", "p99")

    @r.add("w4_error_share", f"""
        SELECT {_start('hour')} AS window_start, count_if(event_type = 'error')::BIGINT AS hits, count(*) AS events,
          count_if(event_type = 'error') / greatest(CAST(count(*) AS DOUBLE), 0.0001) AS ratio
        FROM events GROUP BY 1""")
    def w4(spark, sf):
        return plain(metrics.share(events(spark, sf), "ts", "1 hour", failed()))

    @r.add("w5_mean_value", f"""
        SELECT {_start('day')} AS window_start, event_type, round(sum(value), 6) AS total, count(value) AS events,
          round(sum(value) / greatest(CAST(count(value) AS DOUBLE), 0.0001), 6) AS mean
        FROM events GROUP BY 1, 2""")
    def w5(spark, sf):
        out = metrics.mean(events(spark, sf), "ts", "1 day", F.col("value"), ["event_type"])
        return plain(out.withColumns({n: F.round(n, 6) for n in ("total", "mean")}))

    @r.add("w6_error_alarm", _alarm("""
        SELECT date_trunc('hour', ts) AS w, count(*) AS stat FROM events WHERE event_type = 'error' GROUP BY 1""",
        "HOUR", "", "stat > 3", 3, 5))
    def w6(spark, sf):
        periods = metrics.per_window(events(spark, sf).filter(failed()), "ts", "1 hour", [], {"stat": F.count("*")})
        return plain(metrics.alarm(periods, "1 hour", F.col("stat") > 3, 3, 5))

    @r.add("w6_latency_alarm", _alarm(f"""
        SELECT w, event_type, {_quantile(0.95)} AS stat FROM (
          SELECT date_trunc('hour', ts) AS w, event_type, {_cumulative()} FROM events GROUP BY ALL)""",
        "HOUR", "event_type", "stat > 0.1", 3, 5))
    def w6_latency(spark, sf):
        periods = metrics.latency_quantiles(events(spark, sf), "ts", latency(), "1 hour", ["event_type"],
                                            quantiles=[0.95])
        return plain(metrics.alarm(periods, "1 hour", F.col("p95") > 0.1, 3, 5, ["event_type"]))

    for name, function, fold, limit, needed in (
        ("max", "max", F.max, "stat > 200", 3), ("mean", "avg", F.avg, "stat > 50", 3),
        ("min", "min", F.min, "stat < 0.5", 2),
    ):
        @r.add(f"w6_{name}_alarm", _alarm(f"""
            SELECT date_trunc('day', ts) AS w, event_type, round({function}(value), 6) AS stat FROM events GROUP BY ALL""",
            "DAY", "event_type", limit, needed, needed))
        def w6_other(spark, sf, fold=fold, limit=limit, needed=needed):
            periods = metrics.per_window(events(spark, sf), "ts", "1 day", ["event_type"],
                                         {"stat": F.round(fold("value"), 6)})
            return plain(metrics.alarm(periods, "1 day", F.expr(limit), needed, needed, ["event_type"]))

    @r.add("w7_over_budget", f"""
        SELECT event_id, user_id, {_start('day')} AS window_start, n AS request_number, n > 3 AS rejected,
          CASE WHEN n > 3 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 - CAST(floor(epoch(ts)) AS BIGINT) END
            AS retry_after
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n
              FROM events)""")
    def w7(spark, sf):
        out = metrics.over_budget(events(spark, sf).select("event_id", "user_id", "ts"), "ts", "user_id", "event_id",
                                  "1 day", 3)
        return plain(out.drop("ts"))

    @r.add("w8_gauge_total", """
        WITH latest AS (
          SELECT event_type, user_id, max(ts) AS seen, arg_max(value, (ts, event_id)) AS value
          FROM events GROUP BY ALL)
        SELECT event_type, round(sum(value), 4) AS total,
          count_if(age <= 604800)::BIGINT AS up, count_if(age > 604800)::BIGINT AS down
        FROM (SELECT *, floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(seen)) AS age FROM latest)
        GROUP BY event_type""")
    def w8(spark, sf):
        return metrics.gauge_total(events(spark, sf), "ts", "value", ["event_type", "user_id"], "event_id",
                                   ["event_type"], "7 days")

    def stream(spark, sf):
        return stream_metrics.event_stream(spark, sf, events(spark, sf).schema, glob="events.parquet")

    closed = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"

    @r.add("st1_streamed_rates", f"""
        SELECT {_start('day')} AS window_start, user_id, count(*) AS events,
          count_if(event_type = 'error')::BIGINT AS hits, count(*) / 86400.0::DOUBLE AS per_second,
          count_if(event_type = 'error') / greatest(CAST(count(*) AS DOUBLE), 0.0001) AS ratio
        FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {closed} GROUP BY 1, 2""")
    def st1(spark, sf):
        rates = stream_metrics.rates(stream(spark, sf), "ts", "1 day", "1 hour", failed(), ["user_id"])
        return plain(stream_metrics.run_to_table(rates, "rates"))

    @r.add("st2_streamed_quantiles", f"""
        SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, le_11 AS events, {_QUANTILES}
        FROM ({_sliding('', hourly_counts, counters, 5)}) WHERE start + INTERVAL 5 HOUR <= {closed}""")
    def st2(spark, sf):
        counts = stream_metrics.histograms(stream(spark, sf), "ts", latency(), "5 hours", "1 hour", "1 hour")
        table = stream_metrics.run_to_table(
            counts, "quantiles", lambda batch: metrics.quantiles_of(batch, S.LATENCY_BOUNDS, (0.5, 0.95, 0.99)))
        return _rounded(table, "p50", "p95", "p99")

    @r.add("st3_streamed_over_budget", f"""
        SELECT {_start('day')} AS window_start, user_id, count(*) AS events, count(*) - 3 AS rejected
        FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {closed} GROUP BY 1, 2 HAVING count(*) > 3""")
    def st3(spark, sf):
        counts = stream_metrics.over_budget_counts(stream(spark, sf), "ts", "user_id", "1 day", 3, "1 hour")
        return plain(stream_metrics.run_to_table(counts, "budget"))

    @r.add("st4_streamed_enrichment", sql.upto("snapshot", f"""
        SELECT source_key, content_hash, embedding_model, {vector_digits_sql('embedding')} AS embedding,
          '{RUN_TIME}' AS updated_at FROM snapshot"""))
    def st4(spark, sf):
        shared = Shared.of(spark, sf)
        folder = scratch_path(spark, "raw-stream")
        # Records of one key arrive together; the key is made of the record, as an order number may be that of two.
        date = text.roll_back_century(text.parse_date(F.col("Release Date"), S.DATE_LAYOUTS), S.LAST_RELEASE_YEAR)
        landed = records.normalise_names(shared.landed)
        placed = cleaning.add_key(landed.withColumns({"__title": text.collapse(F.col("Title")), "__date": date}), "__title", "__date")
        placed.repartition(4, "source_key").select(landed.columns).write.json(folder)
        schema = "ord bigint, " + ", ".join(f"`{n}` string" for n in S.SOURCE_COLUMNS)
        raw = records.load(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(folder))
        target = scratch_path(spark, "stream")
        streamed.enrich_stream(raw, target, streamed.Frozen(shared.statistics, shared.variants), RUN_TIME)
        snapshot = streamed.current(spark, target)
        return plain(snapshot.select("source_key", "content_hash", "embedding_model",
                                     vector_digits(F.col("embedding")).alias("embedding"), "updated_at"))
