"""Title lookup: exact, trigram-fuzzy, and the cascade of both, for many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import trigram
from cinefold.session import step_table


def _newest_first() -> Column:
    """Smallest first: newest year, years missing last, then the identifier."""
    return F.struct(F.col("__year").isNull().alias("a"), (-F.coalesce("__year", F.lit(0))).alias("b"), F.col("__id").alias("c"))


def _newest(catalogue: DataFrame, wanted: DataFrame, key: Column, year: str, id: str) -> DataFrame:
    """``__year`` and ``__id`` of the newest row of each ``__key`` that is wanted.

    The least identifier of a title's year comes first, which a hash table of plain values holds; what is put in order
    after it is one row per title and year, so a title on a third of the rows is neither sorted nor shuffled as such.
    """
    rows = catalogue.select(key.alias("__key"), F.col(year).alias("__year"), F.col(id).alias("__id"))
    of_year = rows.join(wanted.select("__key"), "__key", "left_semi").groupBy("__key", "__year").agg(F.min("__id").alias("__id"))
    return of_year.groupBy("__key").agg(F.min_by(F.struct("__year", "__id"), _newest_first()).alias("r")).select("__key", "r.*")


def _fetched(
    best: DataFrame, catalogue: DataFrame, columns: Sequence[str], key: Column, year: str, id: str,
) -> DataFrame:
    """``best`` (one row per query) with the ``row`` it names by ``__key``, ``__year`` and ``__id``, one if several have them."""
    best = step_table(best, "title-best")
    rows = catalogue.select(key.alias("k"), F.col(year).alias("y"), F.col(id).alias("i"), F.struct(*columns).alias("row"))
    same = (F.col("k") == F.col("__key")) & F.col("y").eqNullSafe(F.col("__year")) & F.col("i").eqNullSafe(F.col("__id"))
    return rows.join(best, same).groupBy(*best.columns).agg(F.first("row").alias("row"))


def exact_titles(
    queries: DataFrame, catalogue: DataFrame, columns: Sequence[str] = tuple(S.RESULT_COLUMNS),
    title: str = "title", year: str = "release_year", id: str = "id",
) -> DataFrame:
    """``query_id, query`` plus the newest row whose title equals the query, case aside.

    Rows are told apart by title, year and identifier alone; the other columns are fetched for those that are answers.
    """
    asked = step_table(
        queries.select("query_id", "query", F.lower(F.trim("query")).alias("__key")), "title-queries"
    )
    best = asked.join(_newest(catalogue, asked, F.lower(title), year, id), "__key")
    return _fetched(best, catalogue, columns, F.lower(title), year, id).select("query_id", "query", "row.*")


def rarest_trigrams(queries: DataFrame, titles: DataFrame, threshold: float) -> DataFrame:
    """The trigrams of each query that every acceptable title must share one of.

    Both measures are at most ``shared / |Q|``, so an acceptable title shares at least
    ``c = ceil(threshold * |Q|)`` of the query's trigrams and hence one of any
    ``|Q| - c + 1`` of them. Taking the rarest keeps very common trigrams out of the
    join without losing a title.
    """
    grams = queries.select("query_id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    in_use = (
        titles.select(F.explode("grams").alias("gram"))
        .join(grams.select("gram").distinct(), "gram", "left_semi")
        .groupBy("gram").agg(F.count("*").alias("titles"))
    )
    rarity = Window.partitionBy("query_id").orderBy(F.coalesce("titles", F.lit(0)), "gram")
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    return (
        grams.join(in_use, "gram", "left").withColumn("place", F.row_number().over(rarity))
        .filter(F.col("place") <= kept).select("query_id", "gram")
    )


def fuzzy_scores(queries: DataFrame, titles: DataFrame, threshold: float = S.TITLE_THRESHOLD) -> DataFrame:
    """``query_id, query, title, score`` of every title that clears the threshold.

    ``titles`` holds distinct titles, ``queries`` has ``query_id, query``.
    """
    asked = step_table(
        queries.select("query_id", "query", trigram.trigrams(F.col("query")).alias("grams"))
        .filter(F.size("grams") > 0), "title-queries",
    )
    listed = titles.select("title", trigram.trigrams(F.col("title")).alias("grams"))
    prefix = step_table(rarest_trigrams(asked, listed, threshold), "title-prefixes")
    pairs = (
        listed.select("title", F.explode("grams").alias("gram")).join(prefix, "gram")
        .select("query_id", "title").distinct()
    )
    checked = pairs.join(asked, "query_id").withColumn("t", trigram.trigrams(F.col("title"))).filter(
        F.size(F.array_intersect("grams", "t")) >= F.ceil(F.lit(threshold) * F.size("grams"))
    )
    score = F.greatest(
        trigram.set_similarity(F.col("grams"), F.col("t")),
        trigram.extent_similarity(F.col("grams"), trigram.ordered_trigrams(F.col("title"))),
    )
    return (
        checked.select("query_id", "query", "title", score.alias("score"))
        .filter(F.col("score") >= threshold)
    )


def fuzzy_titles(
    queries: DataFrame, catalogue: DataFrame, columns: Sequence[str] = tuple(S.RESULT_COLUMNS),
    title: str = "title", year: str = "release_year", id: str = "id",
    threshold: float = S.TITLE_THRESHOLD,
) -> DataFrame:
    """The best-scoring row per query; shortest title, then newest, on a tie.

    Titles are made distinct first, so copies of a title are scored once. Of the catalogue only
    titles are looked at until the scores are known; the scores are written, and rows are
    fetched for the titles that have one.
    """
    listed = catalogue.filter(F.col(title).isNotNull()).select(F.col(title).alias("title")).distinct()
    scored = step_table(fuzzy_scores(queries, listed, threshold).withColumnRenamed("title", "__key"), "title-scores")
    order = F.struct(-F.col("score"), F.length("__key"), _newest_first())
    best = scored.join(_newest(catalogue, scored, F.col(title), year, id), "__key").groupBy("query_id", "query").agg(
        F.min_by(F.struct("__key", "__year", "__id"), order).alias("b"), F.max("score").alias("title_score"))
    best = best.select("query_id", "query", "b.*", "title_score")
    return _fetched(best, catalogue, columns, F.col(title), year, id).select("query_id", "query", "row.*", "title_score")


def lookup(
    queries: DataFrame, catalogue: DataFrame, columns: Sequence[str] = tuple(S.RESULT_COLUMNS),
    title: str = "title", year: str = "release_year", id: str = "id",
    threshold: float = S.TITLE_THRESHOLD,
) -> DataFrame:
    """Exact matches win; only the queries without one are matched by trigrams.

    The trigram score is a text score and is not given out as a similarity.
    """
    exact = step_table(exact_titles(queries, catalogue, columns, title, year, id), "exact-titles")
    rest = step_table(queries.join(exact.select("query_id"), "query_id", "left_anti"), "title-rest")
    if rest.isEmpty():
        return exact.withColumn("matched", F.lit("exact"))
    fuzzy = fuzzy_titles(rest, catalogue, columns, title, year, id, threshold).drop("title_score")
    return exact.withColumn("matched", F.lit("exact")).unionByName(
        fuzzy.withColumn("matched", F.lit("fuzzy"))
    )
