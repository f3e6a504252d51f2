from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from records import RECORDS, ROWS_OUT
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import text
from cinefold.operators import cleaning


@pytest.fixture(scope="module")
def report(done):
    return {(r["issue"], r["field"]): r["count"] for r in cleaning.cleaning_report(done.keyed).collect()}


def test_rows_in_and_out(report):
    assert report["rows_in", "*"] == len(RECORDS) and report["rows_out", "*"] == ROWS_OUT
    assert report["missing_title", "title"] == 1 and report["exact_duplicate_row", "*"] == 2
    assert report["duplicate_natural_key", "title + release_date"] == 0


@pytest.mark.parametrize(("rule", "field", "count"), [
    ("two_digit_year_rollover", "release_date", 2), ("unparseable_date", "release_date", 1), ("repeated_title_kept", "title", 3),
    ("whitespace_or_type", "title", 1), ("out_of_range_or_non_numeric", "worldwide_gross", 1),
    ("out_of_range_or_non_numeric", "rt_rating", 1), ("out_of_range_or_non_numeric", "imdb_rating", 1),
    ("out_of_range_or_non_numeric", "running_time_min", 1), ("out_of_range_or_non_numeric", "production_budget", 1),
    ("out_of_range_or_non_numeric", "imdb_votes", 0),
])
def test_each_rule_is_counted(report, rule, field, count):
    assert report[rule, field] == count


def test_copies_of_a_wrong_category_are_counted_each(report):
    assert report["invalid_category", "mpaa_rating"] in (1, 2)


def test_repairs(done):
    rows = {r["source_key"]: r for r in done.cleaned.collect()}
    assert rows["glass-orchard::1992-09-30"]["title"] == "Glass Orchard" and rows["2112::1999-05-21"]["title"] == "2112"
    assert rows["lantern-street::1931-08-15"]["release_date"] == dt.date(1931, 8, 15)
    assert rows["paper-sail::1918-11-05"]["release_year"] == 1918
    assert rows["sundial::undated"]["release_date"] is None
    assert rows["open-water-mill::2001-12-24"]["mpaa_rating"] == "Not Rated"
    odd = rows["broken-figures::1997-01-27"].asDict()
    assert {c for c in ("imdb_rating", "rt_rating", "production_budget", "worldwide_gross", "running_time_min", "imdb_votes")
            if odd[c] is None} == {"imdb_rating", "rt_rating", "production_budget", "worldwide_gross", "running_time_min"}


def test_three_remakes_have_three_keys(done):
    keys = [r[0] for r in done.cleaned.filter("title = 'The Ferry'").select("source_key").collect()]
    assert sorted(k.rpartition("::")[2] for k in keys) == ["1951-02-02", "1978-10-13", "2003-06-01"]


@pytest.mark.parametrize(("title", "slug"), [
    ("Øre & Sund", "re-sund"), ("Ça ira", "ca-ira"), ("--x--Y--", "x-y"), ("12½ Days", "1212-days"), ("Дом", ""), ("ＡＢ c", "ab-c"),
    ("No.7: The Quay!", "no-7-the-quay"), ("", ""),
])
def test_slug(spark, title, slug):
    frame = spark.createDataFrame([(title,)], "t string")
    assert frame.select(text.slug(F.col("t"))).first()[0] == slug


def test_a_title_without_a_slug_takes_its_whole_digest(spark):
    frame = spark.createDataFrame([("Дом", "1999-01-02")], "title string, d string")
    key = cleaning.add_key(frame.withColumn("release_date", F.to_date("d"))).first()["source_key"]
    assert key == hashlib.sha256("Дом".encode()).hexdigest() + "::1999-01-02"


def test_titles_without_ascii_letters_do_not_collide(spark):
    frame = spark.createDataFrame([("七人の侍", "1954-04-26"), ("生きる", "1954-04-26")], "title string, d string")
    keyed = cleaning.add_key(frame.withColumn("release_date", F.to_date("d")))
    assert keyed.select("source_key").distinct().count() == 2


def test_unicode_white_space_is_collapsed(spark):
    frame = spark.createDataFrame([("a   b\t",), ("  ",), (None,)], "t string")
    assert [r[0] for r in frame.select(text.collapse(F.col("t"))).collect()] == ["a b", None, None]


@pytest.mark.parametrize(("value", "expected"), [
    ("Jun 9 1998", dt.date(1998, 6, 9)), ("Jun 09 1998", dt.date(1998, 6, 9)), ("1998-06-09", dt.date(1998, 6, 9)),
    ("6/9/1998", dt.date(1998, 6, 9)), ("June 9, 1998", dt.date(1998, 6, 9)), ("1998", dt.date(1998, 1, 1)),
    ("Feb 29 1999", None), ("not a date", None), (None, None),
])
def test_date_layouts(spark, value, expected):
    frame = spark.createDataFrame([(value,)], "d string")
    assert frame.select(text.parse_date(F.col("d"), S.DATE_LAYOUTS)).first()[0] == expected


def test_leap_day_rolls_back_to_a_real_day(spark):
    frame = spark.createDataFrame([(dt.date(2096, 2, 29),), (dt.date(2100, 2, 28),)], "d date")
    back = [r[0] for r in frame.select(text.roll_back_century(F.col("d"), 2011)).collect()]
    assert back == [dt.date(1996, 2, 29), dt.date(2000, 2, 28)]


def test_majority_spelling_and_first_seen_on_a_tie(spark):
    rows = [(1, "warner bros."), (2, "Warner Bros."), (3, "Warner Bros."), (4, "FOX"), (5, "Fox"), (6, None),
            (7, "Straße"), (8, "STRASSE"), (9, "Straße")]
    frame = spark.createDataFrame(rows, "ord bigint, distributor string")
    variants = cleaning.variant_spellings(frame, ["distributor"])
    out = cleaning.apply_spellings(frame, variants, ["distributor"]).orderBy("ord")
    assert [r["distributor"] for r in out.collect()] == [
        "Warner Bros.", "Warner Bros.", "Warner Bros.", "FOX", "FOX", None, "Straße", "Straße", "Straße"]


def test_the_first_row_of_a_key_is_kept(spark):
    rows = [(3, "a", "late"), (1, "a", "first"), (2, "b", "only")]
    out = cleaning.first_per_key(spark.createDataFrame(rows, "ord bigint, k string, v string"), "k")
    assert {(r["k"], r["v"]) for r in out.collect()} == {("a", "first"), ("b", "only")}


def test_rows_of_one_key_and_order_number_go_by_their_content(spark, raw):
    one = raw.filter("ord = 1")
    other = one.withColumn("us_gross", F.lit("99"))
    got = [cleaning.clean(a.unionByName(b).coalesce(1)).first()["us_gross"] for a, b in ((one, other), (other, one))]
    assert got[0] == got[1]


def test_spellings_first_seen_under_one_order_number_go_by_their_text(spark):
    rows = [(1, "FOX"), (1, "Fox"), (1, "fox")]
    for given in (rows, rows[::-1]):
        frame = spark.createDataFrame(given, "ord bigint, distributor string").coalesce(1)
        assert {r["canonical"] for r in cleaning.variant_spellings(frame, ["distributor"]).collect()} == {"FOX"}


def test_copies_treat_null_as_equal(spark):
    frame = spark.createDataFrame([(2, None, "x"), (1, None, "x"), (3, "y", "x")], "ord bigint, a string, b string")
    out = cleaning.drop_copies(frame, ["a", "b"])
    assert sorted((r["ord"], r["a"]) for r in out.collect()) == [(1, None), (3, "y")]
