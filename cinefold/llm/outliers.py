"""Quality rules by robust multivariate outliers, in DataFrame functions alone.

Each text gives a vector of transformed statistics. Per language and source a minimum covariance
determinant estimate is made: from two deterministic starts, concentration steps keep the three quarters of
vectors that are nearest by Mahalanobis distance and estimate centre and covariance from them, and the start with the
smaller determinant wins. A text is rejected if its distance from its group's centre is beyond a
chi-squared quantile.

Copies must not make an estimate: equal vectors of a group count once. A group with fewer than
``least_vectors`` of them uses its language's estimate, and that the whole corpus's; if that is too small too, nothing is
rejected by distance. ``FLOOR`` is added to the variances, so that a statistic that is constant among clean texts (no
symbols at all) does not reject the first text that has one. Rates are drawn to ``TYPICAL`` by ``PRIOR_WORDS`` words, so that the chance
variation of short texts is no outlier. Quantiles are Spark's mergeable ones, with an accuracy of one in ten thousand.

Repeated windows are told by a 64-bit hash of their five words, within one text.

Defined cases: a null or empty text has no words and fails the base rule. A null language or source is a group
of its own. Repeated rows get the same verdict. An empty table gives no rows. Only ``text``, ``lang`` and ``source`` are
looked at; ``keep`` returns all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import whole_rows, words
from cinefold.session import step_table

LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words
WINDOW = 5
PRIOR_WORDS = 50.0
#: Statistic: its value in ordinary prose, and the standard deviation that is no outlier in any group.
TYPICAL = {"word_length": 5.0, "symbols": 0.0, "repeated_lines": 0.0, "repeated_words": 0.0, "capitals": 0.04}
FLOOR = {"word_length": 0.25, "symbols": 0.08, "repeated_lines": 0.15, "repeated_words": 0.15, "capitals": 0.02}
FEATURES = list(TYPICAL)
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
KEPT_SHARE = 0.75
STEPS = 4
LEAST_VECTORS = 60
TAIL = 1e-7  # share of ordinary texts beyond the cutoff, were they normal
ACCURACY = 10_000
GROUP = ["lang_key", "source_key"]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution, by the series of the incomplete gamma function."""
    a, half, term, total, n = k / 2, x / 2, 2 / k, 2 / k, 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < p else (low, middle)
    return high


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def statistics(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the statistics of the whole ``text`` beside: base ones, and what else the vector needs."""
    own = rows.columns
    base = rows.select(*own, F.coalesce(text, F.lit("")).alias("_text"))
    split = base.select(*own, "_text", words(F.col("_text")).alias("_words"), _lines_with_words(F.col("_text")).alias("_lines"))
    hashed = split.select(
        *own, "_text", "_words", "_lines", F.size("_words").alias("_n"),
        F.when(F.size("_words") >= WINDOW,
               F.transform(F.sequence(F.lit(1), F.size("_words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("_grams"))
    # Most texts repeat no window; only the others put theirs in order.
    placed = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.select(
        *own, F.col("_n").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("n_lines"), F.regexp_count("_text", F.lit(r"[A-Z]")).alias("n_capitals"),
        F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), placed).alias("_placed"))
    same = lambda e, j: F.get("_placed", j)["h"] == e["h"]
    repeated = F.filter("_placed", lambda e, j: F.coalesce(same(e, j - 1), F.lit(False)) | F.coalesce(same(e, j + 1), F.lit(False)))
    starts = ordered.select(*[c for c in ordered.columns if c != "_placed"],
                            F.sort_array(F.transform(repeated, lambda e: e["i"])).alias("_starts"))
    covered = F.aggregate(
        F.transform("_starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x)
    told = [c for c in starts.columns if c not in (*own, "_starts")]
    # Behind the generator no filter on a statistic is moved down into the steps above, where it would repeat them.
    row = F.struct(*told, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return starts.select(*own, F.explode(F.array(row)).alias("_told")).select(*own, "_told.*")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics; rates by their square root, which evens out the variance of counts."""
    rate = lambda count, of, typical=0.0: (F.col(count) + PRIOR_WORDS * typical) / (F.col(of) + PRIOR_WORDS)
    return [
        rate("word_chars", "n_words", TYPICAL["word_length"]).alias("word_length"),
        F.sqrt(rate("n_symbols", "n_words")).alias("symbols"),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)).alias("repeated_lines"),
        F.sqrt(rate("n_repeat_words", "n_words")).alias("repeated_words"),
        (F.col("n_capitals") + PRIOR_WORDS * 5 * TYPICAL["capitals"]).__truediv__(F.col("word_chars") + PRIOR_WORDS * 5).alias("capitals"),
    ]


def group_keys(lang: Column, source: Column) -> list[Column]:
    key = lambda c: F.when(c.isNull(), "null").otherwise(F.concat(F.lit("="), c))
    return [key(lang).alias("lang_key"), key(source).alias("source_key")]


def _distance(centre: str, root: str) -> Column:
    """Squared Mahalanobis distance of the features, by forward substitution in the Cholesky factor."""
    solved: list[Column] = []
    for i, name in enumerate(FEATURES):
        rest = F.col(name) - F.col(f"{centre}{i}")
        for j in range(i):
            rest = rest - F.col(f"{root}{i}{j}") * solved[j]
        solved.append(rest / F.col(f"{root}{i}{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def _factor(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Cholesky factors ``r`` and the log determinant of covariances ``s``, with ``FLOOR`` added, column by column."""
    for j in range(D):
        pivot = F.col(f"s{j}{j}") + F.lit(FLOOR[FEATURES[j]] ** 2)
        for k in range(j):
            pivot = pivot - F.col(f"r{j}{k}") * F.col(f"r{j}{k}")
        # The floor bounds the pivot from below; rounding alone could take it further.
        estimates = estimates.withColumn(f"r{j}{j}", F.sqrt(F.greatest(pivot, F.lit(1e-12))))
        for i in range(j + 1, D):
            value = F.col(f"s{i}{j}")
            for k in range(j):
                value = value - F.col(f"r{i}{k}") * F.col(f"r{j}{k}")
            estimates = estimates.withColumn(f"r{i}{j}", value / F.col(f"r{j}{j}"))
    log_det = sum((F.log(F.col(f"r{i}{i}")) for i in range(1, D)), F.log(F.col("r00")))
    return estimates.select(*keys, *[f"m{i}" for i in range(D)], *[f"r{i}{j}" for i, j in PAIRS], log_det.alias("log_det"))


def _moments(scale: float = 1.0) -> list[Column]:
    sums = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    return sums + [(F.covar_pop(FEATURES[i], FEATURES[j]) * scale).alias(f"s{i}{j}") for i, j in PAIRS]


def estimates(vectors: DataFrame, least_vectors: int = LEAST_VECTORS) -> DataFrame:
    """Centre and factor per group, from the rows of ``vectors`` (keys and features). One row per group and level.

    ``level`` 0: language and source; 1: language; 2: all. Groups with too few vectors are left out.
    """
    distinct = vectors.select(*GROUP, *FEATURES).distinct()
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang_key").alias("l"), F.col("source_key").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang_key").alias("l"), F.lit("*").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit("*").alias("l"), F.lit("*").alias("s")))
    keyed = step_table(distinct.select(F.explode(levels).alias("g"), *FEATURES).select(
        F.col("g.level").alias("level"), F.col("g.l").alias("lang_key"), F.col("g.s").alias("source_key"), *FEATURES), "vectors")
    keys = ["level", *GROUP]

    # Starts: medians with absolute deviations, alone and with the correlations of the directions.
    median = lambda c: F.percentile_approx(c, 0.5, ACCURACY)
    centres = keyed.groupBy(*keys).agg(F.count("*").alias("n"), *[median(f).alias(f"m{i}") for i, f in enumerate(FEATURES)])
    centres = step_table(centres.filter(F.col("n") >= least_vectors).drop("n"), "centres")
    spreads = keyed.join(centres, keys).groupBy(*keys).agg(
        *[(1.4826 * median(F.abs(F.col(f) - F.col(f"m{i}")))).alias(f"d{i}") for i, f in enumerate(FEATURES)])
    spread = step_table(centres.join(spreads, keys), "spreads")
    scaled = [(F.col(f) - F.col(f"m{i}")) / F.greatest(F.col(f"d{i}"), F.lit(FLOOR[f])) for i, f in enumerate(FEATURES)]
    length = F.greatest(sum((z * z for z in scaled[1:]), scaled[0] * scaled[0]), F.lit(1e-12))
    direction = keyed.join(spread, keys).groupBy(*keys).agg(
        *[F.avg(scaled[i] * scaled[j] / length).alias(f"c{i}{j}") for i, j in PAIRS])
    both = spread.join(direction, keys).withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for i, j in PAIRS:
        own = F.greatest(F.sqrt(F.col(f"c{i}{i}") * F.col(f"c{j}{j}")), F.lit(1e-12))
        tied = F.lit(1.0) if i == j else F.when(F.col("start") == 0, 0.0).otherwise(F.col(f"c{i}{j}") / own)
        both = both.withColumn(f"s{i}{j}", tied * F.col(f"d{i}") * F.col(f"d{j}"))
    keys = [*keys, "start"]
    current = step_table(_factor(both, keys), "start")

    shrink = KEPT_SHARE / chi2_cdf(chi2_quantile(KEPT_SHARE, D), D + 2)  # makes the kept share's covariance that of all
    starts = F.explode(F.array(F.lit(0), F.lit(1))).alias("start")
    rows = keyed.select("*", starts)
    for _ in range(STEPS):
        away = rows.join(current, keys).select(*keys, *FEATURES, _distance("m", "r").alias("away"))
        # One row per group, written so that its size is known: joined as it is it would deal all rows by group.
        reach = step_table(away.groupBy(*keys).agg(F.percentile_approx("away", KEPT_SHARE, ACCURACY).alias("reach")), "reach")
        inside = away.join(reach, keys).filter("away <= reach")
        current = step_table(_factor(inside.groupBy(*keys).agg(*_moments(shrink)), keys), "concentrated")
    best = current.groupBy("level", *GROUP).agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    return current.join(best, keys).drop("start", "log_det")


def judged(rows: DataFrame, estimate: DataFrame, tail: float = TAIL) -> DataFrame:
    """``rows`` (with statistics and keys) with ``distance`` (null without an estimate), ``base_failed`` and ``kept``."""
    cutoff = chi2_quantile(1 - tail, D)
    parts = ["lang_key", "source_key"]
    held = [c for c in estimate.columns if c not in ("level", *parts)]
    seen = rows.select(*rows.columns, *vector())
    seen = seen.join(estimate.filter("level = 0").select(*parts, F.struct(*held).alias("e0")), parts, "left")
    seen = seen.join(estimate.filter("level = 1").select("lang_key", F.struct(*held).alias("e1")), "lang_key", "left")
    corpus = estimate.filter("level = 2").select(F.lit(1).alias("one"), F.struct(*held).alias("e2"))
    seen = seen.withColumn("one", F.lit(1)).join(corpus, "one", "left")
    seen = seen.withColumn("e", F.coalesce("e0", "e1", "e2"))
    away = _distance("e.m", "e.r")
    return seen.select(*rows.columns, away.alias("distance"), base_failed().alias("base_failed"),
                       (~base_failed() & F.coalesce(away <= cutoff, F.lit(True))).alias("kept"))


def verdicts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the statistics, ``distance``, ``base_failed`` and ``kept``."""
    measured = statistics(docs.select("doc_id", *group_keys(F.col("lang"), F.col("source")), "text"), F.col("text"))
    measured = step_table(measured.drop("text"), "statistics")
    estimate = estimates(measured.filter(~base_failed()).select(*GROUP, *vector()), **options)
    return judged(measured, step_table(estimate, "estimates")).drop(*GROUP)


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass. The texts are measured twice rather than stored or shuffled."""
    rows = whole_rows(docs).select("row", *group_keys(F.col("row.lang"), F.col("row.source")))
    measured = statistics(rows, F.col("row.text"))
    vectors = step_table(measured.filter(~base_failed()).select(*GROUP, *vector()).distinct(), "vectors")
    estimate = step_table(estimates(vectors, **options), "estimates")
    return judged(measured, estimate).filter("kept").select("row.*")
