"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.operators.medians import exact_medians


def counts_by(catalogue: DataFrame, column: str, name: str) -> DataFrame:
    """``name, count`` of every value that is present."""
    return (
        catalogue.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias(name)).agg(F.count("*").alias("count"))
    )


def genres(catalogue: DataFrame) -> DataFrame:
    """Distinct genres, the most common first."""
    return genre_counts(catalogue).select("genre")


def genre_counts(catalogue: DataFrame) -> DataFrame:
    return counts_by(catalogue, "major_genre", "genre").orderBy(F.desc("count"), F.asc("genre"))


def decade_counts(catalogue: DataFrame) -> DataFrame:
    return counts_by(catalogue, "decade", "decade").orderBy("decade")


def exact_mean(column: str, digits: int) -> Column:
    """Mean of a value with ``digits`` decimals, from whole numbers, rounded to two places."""
    scale = 10**digits
    total = F.sum((F.col(column) * scale).cast("bigint"))
    mean = F.try_divide(total.cast("double"), F.count(column) * F.lit(scale))
    return F.round(mean, 2)


_COUNTED = ("major_genre", "director", "distributor", "embedding_model", "pipeline_version", "decade")


def value_counts(catalogue: DataFrame, columns: tuple[str, ...] = _COUNTED) -> DataFrame:
    """``field, value, count`` of the values present in any of ``columns``, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return catalogue.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull()).groupBy(
        "field", "value").agg(F.count("*").alias("count"))


def _facts(catalogue: DataFrame) -> DataFrame:
    """One row from the counts of values: how many there are, the most common ones, and the nested lists."""
    def of(field: str) -> Column:
        return F.col("field") == field

    def commonest(field: str) -> Column:
        return F.min_by("value", F.when(of(field), F.struct(-F.col("count"), F.col("value")))).alias(field)

    genre = F.collect_list(F.when(of("major_genre"), F.struct((-F.col("count")).alias("n"), F.col("value").alias("genre"))))
    decade = F.collect_list(F.when(of("decade"), F.struct(F.col("value").cast("int").alias("decade"), F.col("count"))))
    return value_counts(catalogue).agg(
        F.count_if(of("major_genre")).alias("distinct_genres"), F.count_if(of("director")).alias("distinct_directors"),
        F.count_if(of("distributor")).alias("distinct_distributors"), commonest("embedding_model"), commonest("pipeline_version"),
        F.transform(F.array_sort(genre), lambda e: F.struct(e["genre"].alias("genre"), (-e["n"]).alias("count"))).alias("movies_per_genre"),
        F.array_sort(decade).alias("movies_per_decade"),
    )


def _summary(catalogue: DataFrame) -> DataFrame:
    """Counts, ranges and means in one pass, the facts of the values in a second, the exact median beside them."""
    one = F.lit(1).alias("one")
    base = catalogue.agg(
        F.count("*").alias("total_movies"),
        F.count("embedding").alias("movies_with_embeddings"),
        F.min("release_year").alias("earliest_release_year"),
        F.max("release_year").alias("latest_release_year"),
        exact_mean("imdb_rating", 1).alias("average_imdb_rating"),
        exact_mean("rt_rating", 0).alias("average_rt_rating"),
        F.sum("worldwide_gross").alias("total_worldwide_gross"),
        F.max("updated_at").alias("last_updated"),
    )
    median = exact_medians(
        catalogue.select(one, F.col("production_budget").cast("double").alias("budget")), ["one"], "budget"
    ).select("one", F.col("median").alias("median_production_budget"))
    return (
        base.select(one, "*").join(_facts(catalogue).select(one, "*"), "one", "left")
        .join(median, "one", "left").drop("one")
    )


def summary(catalogue: DataFrame) -> DataFrame:
    """One row of counts, ranges, means, the median budget and the most common versions."""
    return _summary(catalogue).select(
        "total_movies", "movies_with_embeddings", "distinct_genres", "distinct_directors",
        "distinct_distributors", "earliest_release_year", "latest_release_year",
        "average_imdb_rating", "average_rt_rating", "median_production_budget",
        "total_worldwide_gross", "last_updated", "embedding_model", "pipeline_version",
    )


def statistics(catalogue: DataFrame, width: int = S.EMBEDDING_WIDTH) -> DataFrame:
    """The summary with the genre and decade counts nested; median cut to a whole number."""
    return (
        _summary(catalogue)
        .withColumn("median_production_budget", F.col("median_production_budget").cast("bigint"))
        .withColumn("embedding_dimension", F.lit(width))
    )


def readiness(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(F.count("embedding").alias("embedded")).withColumn(
        "ready", F.col("embedded") > 0
    )
