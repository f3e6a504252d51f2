from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cinefold.functions import trigram
from cinefold.operators import titles

TITLES = [
    ("The Terminator", 1984), ("Terminator 2: Judgment Day", 1991), ("Jurassic Park", 1993), ("Jurassic Park 3", 2001),
    ("The Godfather", 1972), ("The Shawshank Redemption", 1994), ("Casino Royale", 1967), ("Casino Royale", 2006),
    ("Casino Royale", None), ("300", 2007),
]
COLUMNS = ["id", "title", "release_year"]


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate(TITLES)]
    return spark.createDataFrame(rows, "id bigint, title string, release_year int")


def ask(spark, catalogue, *texts):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query string")
    out = titles.lookup(queries, catalogue, COLUMNS)
    return {r["query"]: (r["title"], r["release_year"], r["matched"]) for r in out.collect()}


def test_misspelled_titles_are_found(spark, catalogue):
    got = ask(spark, catalogue, "Termnator 2", "Jurasic Park", "Godfathr", "shawshank redemtion", "qqqqq wwwww eeeee")
    assert got == {
        "Termnator 2": ("Terminator 2: Judgment Day", 1991, "fuzzy"), "Jurasic Park": ("Jurassic Park", 1993, "fuzzy"),
        "Godfathr": ("The Godfather", 1972, "fuzzy"), "shawshank redemtion": ("The Shawshank Redemption", 1994, "fuzzy"),
    }


def test_exact_matches_win_and_the_newest_is_taken(spark, catalogue):
    got = ask(spark, catalogue, " casino ROYALE ", "300", "")
    assert got == {" casino ROYALE ": ("Casino Royale", 2006, "exact"), "300": ("300", 2007, "exact")}


def py_trigrams(text):
    import re

    return [("  " + w + " ")[i : i + 3] for w in re.findall(r"[a-z0-9]+", text.lower()) for i in range(len(w) + 1)]


def py_similarity(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


def py_score(query, title):
    q, o = py_trigrams(query), py_trigrams(title)
    best = max((py_similarity(q, o[i:j]) for i in range(len(o)) for j in range(i + 1, len(o) + 1)), default=0.0)
    return max(best, py_similarity(q, o))


def test_documented_measures(spark):
    frame = spark.createDataFrame([("word", "two words")], "q string, t string")
    q, t = F.col("q"), F.col("t")
    row = frame.select(
        F.size(trigram.trigrams(q)).alias("n"), trigram.set_similarity(trigram.trigrams(q), trigram.trigrams(t)).alias("s"),
        trigram.word_similarity(q, t).alias("w")).first()
    assert row["n"] == 5 and row["s"] == pytest.approx(4 / 11) and row["w"] == pytest.approx(0.8)


def test_candidates_lose_no_acceptable_title(spark):
    """Against all pairs, with words so common that nearly every title shares them."""
    draw = random.Random(3)
    words = ["the", "of", "night", "nights", "star", "stars", "wars", "war", "day", "dawn", "red", "redd"]
    listed = sorted({" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(150)})
    asked = sorted({" ".join(draw.choices(words, k=draw.randint(1, 3)))[draw.randint(0, 2):] for _ in range(40)} - {""})
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query_id int, query string")
    got = titles.fuzzy_scores(queries, spark.createDataFrame([(t,) for t in listed], "title string"))
    scores = {(r["query"], r["title"]): r["score"] for r in got.collect()}
    want = {(q, t): py_score(q, t) for q in asked for t in listed if py_trigrams(q)}
    assert scores == pytest.approx({k: v for k, v in want.items() if v >= 0.5})


def test_copies_of_a_title_are_scored_once(spark):
    rows = [(i, "The Godfather" if i % 3 == 0 else f"Film {i}", 1900 + i % 90) for i in range(900)]
    frame = spark.createDataFrame(rows, "id bigint, title string, release_year int")
    assert ask(spark, frame, "Godfathr")["Godfathr"] == ("The Godfather", 1987, "fuzzy")


def test_the_newest_copy_of_a_title_is_found_without_sorting_the_catalogue(spark, monkeypatch):
    """Rows of the whole catalogue meet hash tables only; payloads are fetched for answers alone."""
    rows = [(i, f"Copied Title {i % 3}", None if i % 4 == 0 else 1950 + (i * 7) % 60, f"note {i}") for i in range(600)]
    films = spark.createDataFrame(rows, "id bigint, title string, release_year int, note string").repartition(5)
    asked = spark.createDataFrame([(0, "copied TITLE 1"), (1, "copied titel 2"), (2, "copied title")], "query_id int, query string")
    plans, write = {}, titles.step_table

    def noted(frame, name):
        plans.setdefault(name, []).append(frame._jdf.queryExecution().sparkPlan().toString())
        return write(frame, name)

    monkeypatch.setattr(titles, "step_table", noted)
    got = {r["query"]: tuple(r)[2:] for r in titles.lookup(asked, films, [*COLUMNS, "note"]).collect()}

    def newest(title):
        return min((r for r in rows if r[1] == title), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))

    assert got["copied TITLE 1"] == (*newest("Copied Title 1"), "exact")
    assert got["copied titel 2"] == (*newest("Copied Title 2"), "fuzzy")
    tied = min((newest(f"Copied Title {i}") for i in range(3)), key=lambda r: (-r[2], r[0]))
    assert got["copied title"] == (*tied, "fuzzy")
    assert len(plans["title-best"]) == 2
    for plan in plans["title-best"]:
        lowest = [line for line in plan.splitlines() if "Aggregate(" in line][-1]
        assert "HashAggregate" in lowest and "min(__id" in lowest


def test_word_similarity_is_spread_over_all_partitions(spark, sf_dir):
    import __spark_entry__ as entry

    frame = entry.queries()["t3_word_similarity"](spark, sf_dir)
    assert "REPARTITION_BY_NUM" in frame._jdf.queryExecution().executedPlan().toString()
