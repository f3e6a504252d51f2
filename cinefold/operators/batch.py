"""Text requests in bulk, from what was typed to result rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.operators import requests as R
from cinefold.operators import search
from cinefold.operators.embedding import Embedder, embedded
from cinefold.session import step_table

EQUAL = {"major_genre": "genre", "mpaa_rating": "mpaa_rating", "decade": "decade"}
MINIMUM = {"imdb_rating": "min_imdb_rating"}


def search_texts(
    asked: DataFrame, catalogue: DataFrame, plan: Embedder, prefix: str = "",
    columns: Sequence[str] = tuple(S.RESULT_COLUMNS),
) -> DataFrame:
    """Every request with its result rows, or one row that says why it has none.

    ``asked`` has ``request_id`` and the request columns. Requests are judged, those that
    are the same but for case are searched once, and each different text is embedded once,
    with the instruction for queries in front. ``status`` is ``ok``, ``invalid`` (see
    ``invalid_param``), ``not embedded`` or ``no match``.
    """
    judged = step_table(R.validated(asked).withColumn("request_key", R.request_key()), "requests-judged")
    kept = F.struct(*R.REQUEST_COLUMNS)
    single = judged.filter("invalid_param IS NULL").groupBy("request_key").agg(
        F.min_by(kept, F.struct("request_id", "query")).alias("r")
    ).select("request_key", "r.*")
    # A request is searched under a number: its key holds the whole text, and every answer carries what it is searched under.
    single = step_table(single.withColumn("number", F.monotonically_increasing_id()), "requests-distinct")
    vectors = step_table(
        single.select("query").distinct().withColumn("e", embedded(F.col("query"), replace(plan, prefix=prefix)))
        .select("query", F.col("e.vector").alias("vector")), "request-vectors",
    )
    with_vectors = step_table(single.join(vectors, "query"), "requests-embedded")
    best = search.top_k_per_request(
        catalogue, with_vectors, equal=EQUAL, minimum=MINIMUM, request_id="number")
    rows = search.with_rows(best, catalogue, columns=columns).withColumnRenamed("request_id", "number")
    known = with_vectors.select("request_key", "number", F.col("vector").isNotNull().alias("embedded"))
    back = judged.select("request_id", "request_key", "invalid_param").join(known, "request_key", "left").join(
        rows, "number", "left")
    status = (
        F.when(F.col("invalid_param").isNotNull(), "invalid").when(~F.col("embedded"), "not embedded")
        .when(F.col("rank").isNull(), "no match").otherwise("ok")
    )
    # A request that breaks a rule may share its key with no valid one, as the key holds every parameter.
    return back.select("request_id", "invalid_param", status.alias("status"), "rank", "similarity", *columns)
