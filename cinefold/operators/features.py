"""Derived features, the text document of a row and its content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import numeric, text

# Columns of a stored row that the enrichment stages themselves produce.
_TYPED = [c for c in S.STORED_TYPES if c not in ("embedding", "embedding_model", "pipeline_version")]


def derive(imputed: DataFrame) -> DataFrame:
    """Decade, budget tier, score delta, blockbuster flag and profit ratio."""
    gross, budget = F.col("worldwide_gross"), F.col("production_budget")
    return imputed.withColumns({
        "decade": numeric.decade(F.col("release_year")),
        "budget_tier": numeric.tier(budget, 1),
        "rating_score_delta": numeric.score_delta(F.col("imdb_rating"), F.col("rt_rating")),
        "blockbuster_flag": numeric.blockbuster(gross, budget),
        "profit_ratio": numeric.capped_ratio(gross, budget),
    })


def cast_stored(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Stored types: NaN becomes NULL, whole numbers become integers."""
    kinds = dict(frame.dtypes)

    def stored(name: str) -> Column:
        value = F.col(name)
        if kinds[name] in ("double", "float"):
            value = F.when(~F.isnan(value), value)
        return value.cast(S.STORED_TYPES[name]).alias(name)

    others = [c for c in frame.columns if c not in columns]
    return frame.select(*others, *[stored(c) for c in columns])


def document() -> Column:
    """The text that is embedded: one line per known fact.

    Lines of sentinel-filled columns are left out, and phrases that judge a film are
    only written from observed scores and budgets.
    """

    def observed(name: str) -> Column:
        return ~F.array_contains("imputed_fields", name)

    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("Unknown"))

    def unless_filled(label: str, name: str) -> Column:
        return F.when(observed(name), F.concat(F.lit(f"{label}: "), F.col(name)))

    critics, audience = F.col("rt_rating"), F.col("rating_score_delta")
    gap_known = observed("rt_rating") & observed("imdb_rating")
    votes = F.coalesce(
        F.concat(numeric.thousands(F.col("imdb_votes")), F.lit(" votes")), F.lit("vote count unknown")
    )
    budget = F.coalesce(numeric.thousands(F.col("production_budget")), F.lit("unknown"))
    earner = F.when(F.col("blockbuster_flag"), S.BIG_EARNER).otherwise(S.SMALL_EARNER)
    lines = [
        F.concat(F.lit("Title: "), F.col("title")),
        unless_filled("Genre", "major_genre"),
        unless_filled("Director", "director"),
        unless_filled("MPAA Rating", "mpaa_rating"),
        F.concat(F.lit("Release Year: "), known("release_year")),
        F.concat(F.lit("Runtime: "), known("running_time_min"), F.lit(" minutes")),
        F.concat(F.lit("IMDB Rating: "), known("imdb_rating"), F.lit("/10 ("), votes, F.lit(")")),
        F.concat(F.lit("Rotten Tomatoes: "), known("rt_rating"), F.lit("%")),
        F.concat(F.lit("Budget: $"), budget),
        unless_filled("Distributor", "distributor"),
        unless_filled("Creative Type", "creative_type"),
        unless_filled("Source", "source"),
        F.when(
            F.col("release_year").isNotNull(),
            F.concat(F.lit("Decade: "), F.col("decade").cast("string"), F.lit("s")),
        ),
        F.when(
            observed("production_budget"),
            F.concat(F.lit("Budget Tier: "), numeric.tier(F.col("production_budget"), 2)),
        ),
        F.when(
            observed("rt_rating"),
            F.concat(F.lit("Critical Reception: "), numeric.reception(critics)),
        ),
        F.when(
            gap_known & (audience >= S.AUDIENCE_GAP),
            F.lit(f"Audience Reception: {S.AUDIENCE_AHEAD}"),
        ).when(
            gap_known & (audience <= -S.AUDIENCE_GAP),
            F.lit(f"Audience Reception: {S.CRITICS_AHEAD}"),
        ),
        F.concat(
            F.lit("Box Office: $"), numeric.thousands(F.col("worldwide_gross")),
            F.lit(" worldwide, "), earner,
        ),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def with_fingerprint(frame: DataFrame) -> DataFrame:
    return frame.withColumn(
        "content_hash", text.fingerprint({c: S.STORED_TYPES[c] for c in S.HASHED_COLUMNS})
    )


def augment(imputed: DataFrame) -> DataFrame:
    """Imputed rows to stored types with features, document and fingerprint."""
    known = [c for c in _TYPED if c not in ("augmented_text", "content_hash")]
    typed = cast_stored(derive(imputed), known)
    return with_fingerprint(typed.withColumn("augmented_text", document()))


def feature_report(augmented: DataFrame) -> DataFrame:
    """Filled counts per derived feature, flags set, and the length of the documents."""
    counts = augmented.agg(
        F.count("decade").alias("decade"),
        F.count("budget_tier").alias("budget_tier"),
        F.count("rating_score_delta").alias("rating_score_delta"),
        F.count_if(F.col("blockbuster_flag")).alias("blockbuster_flag"),
        F.count("profit_ratio").alias("profit_ratio"),
        F.count("*").alias("augmented_text"),
        F.sum(F.length("augmented_text")).alias("chars"),
        F.max(F.length("augmented_text")).alias("longest"),
    )
    lengths = F.concat(
        F.lit("mean "), F.try_divide("chars", "augmented_text").cast("bigint").cast("string"),
        F.lit(" characters, longest "), F.col("longest").cast("string"),
    )
    fields = ["decade", "budget_tier", "rating_score_delta", "blockbuster_flag", "profit_ratio",
              "augmented_text"]
    return counts.select(F.explode(F.array(*[
        F.struct(
            F.lit("features").alias("stage"), F.lit("derived_feature").alias("issue"),
            F.lit(n).alias("field"), F.col(n).alias("count"), F.lit("created").alias("action"),
            F.coalesce(lengths, F.lit("")).alias("detail") if n == "augmented_text"
            else F.lit("").alias("detail"),
        )
        for n in fields
    ])).alias("r")).select("r.*")
