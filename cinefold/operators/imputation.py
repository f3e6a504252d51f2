"""Imputation: group medians, a fitted line, sentinels, and the provenance of every fill."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import numeric
from cinefold.operators.medians import exact_medians
from cinefold.session import step_table

# Group of rows without one, per grouping column.
NO_GENRE, NO_DECADE = "__missing__", "-1"
# Median-filled column -> (its group, digits kept).
MEDIAN_FILLS = {
    "imdb_rating": ("genre", 1),
    "running_time_min": ("genre", 0),
    "production_budget": ("decade", 0),
}
# Every column that can be filled.
FILLABLE = [*MEDIAN_FILLS, "rt_rating", *S.SENTINELS]


def genre_key() -> Column:
    return F.coalesce(F.col("major_genre"), F.lit(NO_GENRE))


def decade_key() -> Column:
    return F.coalesce(numeric.decade(F.col("release_year")).cast("string"), F.lit(NO_DECADE))


def _group_of(kind: str) -> Column:
    return genre_key() if kind == "genre" else decade_key()


@dataclass
class Line:
    """Least-squares line of the critic score over the audience score."""

    pairs: int
    slope: float | None
    intercept: float | None
    correlation: float | None

    @property
    def usable(self) -> bool:
        return self.pairs >= S.MIN_FIT_PAIRS and self.slope is not None


def fit_summary(frame: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pairs, slope, intercept, correlation; pairs with a NULL are left out."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    return frame.agg(
        F.regr_count(ys, xs).alias("pairs"), F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"), F.corr(xs, ys).alias("correlation"),
    )


def fit_line(frame: DataFrame, x: str = "imdb_rating", y: str = "rt_rating") -> Line:
    return Line(*fit_summary(frame, x, y).first())


def predict_clipped(x: Column, line: Line) -> Column:
    """The line's value held to [0, 100]; NULL where x is NULL or the line was not fitted."""
    if not line.usable:
        return F.lit(None).cast("double")
    raw = x * F.lit(line.slope) + F.lit(line.intercept)
    return F.when(x.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)))


def with_prediction(frame: DataFrame, line: Line) -> DataFrame:
    """Critic score with its gaps predicted from the audience score as it was observed."""
    return frame.withColumn(
        "rt_rating", F.coalesce(F.col("rt_rating"), predict_clipped(F.col("imdb_rating"), line))
    )


def long_values(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(field, grp, value)`` per value and once more, with ``grp`` NULL, for the whole column."""
    entries = []
    for name, kind in columns.items():
        for group in (_group_of(kind), F.lit(None).cast("string")):
            entries.append(F.struct(
                F.lit(name).alias("field"), group.alias("grp"), F.col(name).cast("double").alias("value")
            ))
    return frame.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


@dataclass
class FillStatistics:
    """What the fills need, computed once per snapshot and kept as tables and scalars."""

    medians: DataFrame  # field, grp, n, median
    overall: dict[str, float]
    line: Line

    def save(self, path: str) -> None:
        spark = self.medians.sparkSession
        self.medians.write.mode("overwrite").parquet(f"{path}/medians")
        line = [(self.line.pairs, self.line.slope, self.line.intercept, self.line.correlation)]
        spark.createDataFrame(
            line, "pairs bigint, slope double, intercept double, correlation double"
        ).write.mode("overwrite").parquet(f"{path}/line")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FillStatistics:
        medians = spark.read.parquet(f"{path}/medians")
        line = Line(*spark.read.parquet(f"{path}/line").first())
        return FillStatistics(medians, _overall(medians), line)


def _overall(medians: DataFrame) -> dict[str, float]:
    """The whole-column medians: one row per filled column."""
    return {r["field"]: r["median"] for r in medians.filter("grp is null").collect()}


def fill_statistics(cleaned: DataFrame, observed_only: bool = False) -> FillStatistics:
    """Medians and the fitted line of a cleaned table.

    The fallback median of the critic score is taken over observed and predicted values;
    ``observed_only`` leaves the predicted ones out.
    """
    line = fit_line(cleaned)
    base = cleaned if observed_only else with_prediction(cleaned, line)
    columns = {name: kind for name, (kind, _) in MEDIAN_FILLS.items()} | {"rt_rating": "genre"}
    medians = step_table(
        exact_medians(long_values(base, columns), ["field", "grp"], "value"), "medians"
    )
    return FillStatistics(medians, _overall(medians), line)


def provenance(columns: list[str]) -> Column:
    """Sorted names of the columns that are NULL, taken before anything is filled."""
    names = [F.when(F.col(c).isNull(), F.lit(c)) for c in sorted(columns)]
    return F.array_compact(F.array(*names))


def impute(cleaned: DataFrame, statistics: FillStatistics) -> DataFrame:
    """Fill missing values from the statistics and list the filled columns per row.

    One join per grouping (genre, decade) against a table with one row per group.
    """
    overall = {n: F.lit(statistics.overall.get(n)).cast("double") for n in [*MEDIAN_FILLS, "rt_rating"]}

    def by_group(kind: str, fields: list[str]) -> DataFrame:
        per_field = [
            F.max(F.when(F.col("field") == f, F.col("median"))).alias(f"__{f}") for f in fields
        ]
        return (
            statistics.medians.filter(F.col("grp").isNotNull() & F.col("field").isin(fields))
            .groupBy(F.col("grp").alias(f"__{kind}")).agg(*per_field)
        )

    frame = (
        cleaned.withColumn("imputed_fields", provenance(FILLABLE))
        .withColumn("__genre", genre_key())
        .withColumn("__decade", decade_key())
    )
    frame = with_prediction(frame, statistics.line)
    frame = frame.join(
        by_group("genre", ["imdb_rating", "running_time_min", "rt_rating"]), "__genre", "left"
    ).join(by_group("decade", ["production_budget"]), "__decade", "left")
    digits = {n: d for n, (_, d) in MEDIAN_FILLS.items()} | {"rt_rating": 0}
    filled = {
        n: numeric.round_even(F.coalesce(F.col(n), F.col(f"__{n}"), overall[n], F.lit(0.0)), digits[n])
        for n in digits
    }
    return frame.withColumns(filled).fillna(S.SENTINELS).select(*cleaned.columns, "imputed_fields")


def imputation_report(cleaned: DataFrame, line: Line) -> DataFrame:
    """Missing values per field with the strategy used for them."""
    strategies = {
        "imdb_rating": "median within genre, then overall median",
        "rt_rating": "fitted line over the observed audience score, then genre median"
        if line.usable else "genre median (line skipped)",
        "running_time_min": "median within genre, then overall median",
        "production_budget": "median within decade, then overall median",
        **{name: f"constant '{value}'" for name, value in S.SENTINELS.items()},
        **{name: "left as NULL" for name in S.LEFT_MISSING},
    }
    detail = {
        "rt_rating": f"{line.pairs} pairs"
        + (f", {line.slope:.2f} * audience + {line.intercept:.2f}" if line.usable else "")
    }
    counts = cleaned.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in strategies])
    return counts.select(F.explode(F.array(*[
        F.struct(
            F.lit("imputation").alias("stage"), F.lit("missing_values").alias("issue"),
            F.lit(n).alias("field"), F.col(n).alias("count"), F.lit(how).alias("action"),
            F.lit(detail.get(n, "")).alias("detail"),
        )
        for n, how in strategies.items()
    ])).alias("r")).select("r.*")
