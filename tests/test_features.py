from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import numeric
from cinefold.operators import features


def test_tiers_follow_their_bounds(spark):
    """Just below and at each bound of the table, and far beyond the last."""
    bounds = [t[0] for t in S.BUDGET_TIERS if t[0]]
    asked = [float(x) for b in bounds for x in (b - 1, b)] + [1.0, 9e12, None]
    want = [next(code for top, code, _ in S.BUDGET_TIERS if top is None or x < top) if x is not None else None for x in asked]
    frame = spark.createDataFrame(list(enumerate(asked)), "i int, b double")
    assert [r[1] for r in sorted(frame.select("i", numeric.tier(F.col("b"), 1)).collect())] == want


@pytest.mark.parametrize(("gross", "budget", "flag"), [
    (2.2e8, 1.05e8, True), (1.4e8, 8e7, False), (9.9e7, 2e6, False), (None, 4e6, None), (3.1e8, None, None), (1.7e8, 0.0, False),
])
def test_flag_needs_both_bars(spark, gross, budget, flag):
    frame = spark.createDataFrame([(gross, budget)], "g double, b double")
    assert frame.select(numeric.blockbuster(F.col("g"), F.col("b"))).first()[0] is flag


@pytest.mark.parametrize(("gross", "budget", "ratio"), [
    (2.7e9, 218.0, 9999.0), (1e6, 3e6, 0.333), (1e6, 0.0, None), (None, 1e6, None),
])
def test_ratio_is_capped(spark, gross, budget, ratio):
    frame = spark.createDataFrame([(gross, budget)], "g double, b double")
    assert frame.select(numeric.capped_ratio(F.col("g"), F.col("b"))).first()[0] == ratio


def test_rounding_is_half_even_after_scaling(spark):
    frame = spark.createDataFrame([(1.015,), (106.5,), (-0.25,)], "x double")
    assert [r[0] for r in frame.select(numeric.round_even(F.col("x"), 2)).collect()][0] == 1.01
    assert [r[0] for r in frame.select(numeric.round_even(F.col("x"), 0)).collect()][1] == 106.0


def test_document_of_a_full_row(by_title):
    lines = by_title["harbour-lights::1994-03-04"]["augmented_text"].split("\n")
    told = dict(line.split(": ", 1) for line in lines)
    assert list(told) == ["Title", "Genre", "Director", "MPAA Rating", "Release Year", "Runtime", "IMDB Rating", "Rotten Tomatoes", "Budget",
                          "Distributor", "Creative Type", "Source", "Decade", "Budget Tier", "Critical Reception", "Box Office"]
    assert told["IMDB Rating"] == "6.8/10 (41,300 votes)" and told["Budget"] == "$12,500,000" and told["Decade"] == "1990s"
    assert told["Budget Tier"] == S.BUDGET_TIERS[1][2] and told["Critical Reception"] == S.RECEPTIONS[1][1]
    assert told["Box Office"] == f"$64,500,000 worldwide, {S.SMALL_EARNER}" and told["Runtime"] == "97 minutes"


def test_document_leaves_out_what_was_filled(by_title):
    lines = by_title["quiet-acre::1989-07-19"]["augmented_text"].split("\n")
    told = dict(line.split(": ", 1) for line in lines)
    assert set(told) == {"Title", "Release Year", "Runtime", "IMDB Rating", "Rotten Tomatoes", "Budget", "Decade"}
    assert told["IMDB Rating"].endswith("(vote count unknown)") and not {"None", "nan"} & set(" ".join(lines).split())


def test_document_of_a_film_that_critics_disliked(by_title):
    content = by_title["winter-ledger::2005-02-18"]["augmented_text"]
    for phrase in (S.RECEPTIONS[-1][1], S.AUDIENCE_AHEAD, S.SMALL_EARNER):
        assert phrase in content


def test_document_of_a_bare_row(spark, by_title):
    kinds = {c: "string" for c in ("title", "major_genre", "director", "mpaa_rating", "distributor", "creative_type", "source")}
    kinds |= {c: "int" for c in ("release_year", "running_time_min", "imdb_votes", "rt_rating", "decade")}
    kinds |= {"production_budget": "bigint", "worldwide_gross": "bigint", "imdb_rating": "decimal(3,1)",
              "rating_score_delta": "decimal(4,1)", "blockbuster_flag": "boolean", "imputed_fields": "array<string>"}
    bare = spark.range(1).select(*[
        (F.lit("Bare") if c == "title" else F.array().cast(k) if c == "imputed_fields" else F.lit(None).cast(k)).alias(c)
        for c, k in kinds.items()])
    content = bare.select(features.document()).first()[0]
    assert "Runtime: Unknown minutes" in content and "Budget: $unknown" in content and "Release Year: Unknown" in content


def test_fingerprint_follows_the_content(done):
    rows = done.rows.filter("source_key = 'harbour-lights::1994-03-04'")
    same = features.with_fingerprint(rows).first()["content_hash"]
    assert same == rows.first()["content_hash"] and len(same) == 64
    for change in ({"title": F.lit("Other")}, {"us_gross": F.col("us_gross") + 1}, {"us_gross": F.lit(None).cast("bigint")},
                   {"imputed_fields": F.array(F.lit("title"))}):
        assert features.with_fingerprint(rows.withColumns(change)).first()["content_hash"] != same


def test_fingerprint_keeps_neighbouring_columns_apart(done):
    rows = done.rows.filter("source_key = 'harbour-lights::1994-03-04'")
    one = features.with_fingerprint(rows.withColumns({"director": F.lit("a|b"), "distributor": F.lit("c")}))
    two = features.with_fingerprint(rows.withColumns({"director": F.lit("a"), "distributor": F.lit("b|c")}))
    assert one.first()["content_hash"] != two.first()["content_hash"]
