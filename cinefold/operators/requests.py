"""Search requests as rows: validation, normalisation and the key of identical requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S

REQUEST_COLUMNS = ["query", "top_k", "genre", "min_imdb_rating", "mpaa_rating", "decade"]


def _stripped(name: str) -> Column:
    """Without white space at both ends; NULL when nothing is left."""
    return F.nullif(F.regexp_replace(F.col(name), r"(?U)^\s+|\s+$", ""), F.lit(""))


def validated(requests: DataFrame) -> DataFrame:
    """Normalised requests with ``invalid_param``: the first parameter that breaks a rule."""
    normal = requests.withColumns({
        "query": _stripped("query"),
        "top_k": F.coalesce("top_k", F.lit(S.TOP_K_DEFAULT)),
        "genre": _stripped("genre"),
        "mpaa_rating": _stripped("mpaa_rating"),
    })
    decade = F.col("decade")
    problem = (
        F.when(F.col("query").isNull() | (F.length("query") > S.QUERY_CHARS), "q")
        .when(~F.col("top_k").between(S.TOP_K_MIN, S.TOP_K_MAX), "top_k")
        .when(~F.col("min_imdb_rating").between(S.RATING_MIN, S.RATING_MAX), "min_imdb_rating")
        .when(~decade.between(S.DECADE_MIN, S.DECADE_MAX) | (decade % 10 != 0), "decade")
    )
    return normal.withColumn("invalid_param", problem)


def valid_only(requests: DataFrame) -> DataFrame:
    return validated(requests).filter("invalid_param is null").drop("invalid_param")


def request_key() -> Column:
    """Equal for requests that differ only in the case of their texts."""

    def part(value: Column) -> Column:
        return F.coalesce(value, F.lit("-"))

    rating = F.col("min_imdb_rating").cast("decimal(4,1)").cast("string")
    return F.concat_ws(
        "|", F.lit("search"), F.lower("query"), F.col("top_k").cast("string"),
        part(F.lower("genre")), part(rating), part(F.lower("mpaa_rating")),
        part(F.col("decade").cast("string")),
    )


def distinct_requests(requests: DataFrame, order: str = "request_id") -> DataFrame:
    """One row per key: the first request with it and how often it was asked."""
    return (
        requests.withColumn("request_key", request_key())
        .groupBy("request_key")
        .agg(F.min(order).alias(order), F.count("*").alias("asked"))
    )
