"""Cleaning: raw text records to typed, keyed, duplicate-free rows, with counts per rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import numeric, text
from cinefold.session import step_table


def normalise_text(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.withColumns({name: text.collapse(F.col(name)) for name in columns})


def drop_untitled(frame: DataFrame, title: str = "title") -> DataFrame:
    return frame.filter(F.col(title).isNotNull())


def titled_text(raw: DataFrame) -> DataFrame:
    """Normalised text, rows with a title only, certificates repaired."""
    return drop_untitled(normalise_text(raw, S.TEXT_COLUMNS)).withColumn(
        "mpaa_rating", text.repair(F.col("mpaa_rating"), S.CERTIFICATES)
    )


def variant_spellings(frame: DataFrame, columns: Sequence[str], order: str = "ord") -> DataFrame:
    """``(field, spelling, canonical)`` for every spelling that loses its vote.

    All spellings that fold alike take the most frequent one, the one seen first on a
    tie, the least in order if two were seen first in rows of one ``order``. Rows are counted per distinct spelling before anything is shuffled, so a value
    held by a third of the rows costs no more than a rare one.
    """
    spellings = F.explode(
        F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("spelling")) for c in columns])
    )
    votes = (
        frame.select(order, spellings.alias("s"))
        .select("s.*", order)
        .filter(F.col("spelling").isNotNull())
        .groupBy("field", "spelling")
        .agg(F.count("*").alias("votes"), F.min(order).alias("first_seen"))
        .withColumn("folded", text.fold(F.col("spelling")))
    )
    winners = votes.groupBy("field", "folded").agg(
        F.min_by("spelling", F.struct(-F.col("votes"), F.col("first_seen"), F.col("spelling"))).alias("canonical")
    )
    return (
        votes.join(winners, ["field", "folded"])
        .filter(F.col("spelling") != F.col("canonical"))
        .select("field", "spelling", "canonical")
    )


def apply_spellings(
    frame: DataFrame, variants: DataFrame, columns: Sequence[str], mark: str | None = None
) -> DataFrame:
    """Replace losing spellings; ``variants`` should be a written table of known size.

    ``mark`` prefixes a flag per column that tells whether its value was replaced.
    """
    joined, out = frame, {}
    for name in columns:
        lookup = variants.filter(F.col("field") == name).select(
            F.col("spelling").alias(f"__from_{name}"), F.col("canonical").alias(f"__to_{name}")
        )
        joined = joined.join(lookup, F.col(name) == F.col(f"__from_{name}"), "left")
        out[name] = F.coalesce(F.col(f"__to_{name}"), F.col(name)).alias(name)
    marks = [] if mark is None else [F.col(f"__to_{c}").isNotNull().alias(f"{mark}{c}") for c in columns]
    return joined.select(*[out.get(c, F.col(c)) for c in frame.columns], *marks)


def parse_release(frame: DataFrame, last_year: int = S.LAST_RELEASE_YEAR) -> DataFrame:
    parsed = text.parse_date(F.col("release_date"), S.DATE_LAYOUTS)
    return (
        frame.withColumn("release_date", parsed)
        .withColumn("release_date", text.roll_back_century(F.col("release_date"), last_year))
        .withColumn("release_year", F.year("release_date"))
    )


def coerce_numbers(
    frame: DataFrame, ranges: dict[str, tuple[float, float]] = S.NUMERIC_RANGES
) -> DataFrame:
    return frame.withColumns(
        {n: numeric.in_range(numeric.to_number(F.col(n)), *ranges[n]) for n in ranges}
    )


def drop_copies(frame: DataFrame, columns: Sequence[str], order: str = "ord") -> DataFrame:
    """Rows equal in all of ``columns`` (NULL equal to NULL) become one, the first in order."""
    return frame.groupBy(*columns).agg(F.min(order).alias(order))


def add_key(frame: DataFrame, title: str = "title", date: str = "release_date") -> DataFrame:
    return frame.withColumn("title_slug", text.slug_or_digest(F.col(title), text.slug(F.col(title)))).withColumn(
        "source_key",
        text.natural_key(F.col("title_slug"), F.col(date)),
    )


def first_per_key(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key by the columns of ``order`` (``ord`` if none is given).

    Spark keeps only the first row per key inside each task before the shuffle
    (``WindowGroupLimit``), so a key held by a third of the rows arrives as one row per task.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["ord"])))
    return frame.withColumn("__place", place).filter("__place = 1").drop("__place")


def repeated_titles(frame: DataFrame, by: str = "title_slug") -> DataFrame:
    """Titles on more than one row, with the number of rows."""
    return frame.groupBy(by).agg(F.count("*").alias("rows")).filter("rows > 1")


# The rules of the report that look at one value: issue, field, what is done.
VALUE_RULES = (
    [("whitespace_or_type", c, "normalised to single-spaced text") for c in S.TEXT_COLUMNS]
    + [
        ("missing_title", "title", "row dropped"),
        ("invalid_category", "mpaa_rating", "mapped to the official certificates"),
    ]
    + [("case_or_spacing_variant", c, "replaced by the most common spelling") for c in S.VOTED_COLUMNS]
    + [
        ("unparseable_date", "release_date", "set to NULL"),
        ("missing_date", "release_date", "left as NULL"),
        ("two_digit_year_rollover", "release_date", "moved back 100 years"),
    ]
    + [
        ("out_of_range_or_non_numeric", c, f"set to NULL outside [{low:g}, {high:g}]")
        for c, (low, high) in S.NUMERIC_RANGES.items()
    ]
)


def keyed(
    raw: DataFrame, order: str = "ord", last_year: int = S.LAST_RELEASE_YEAR,
    variants: DataFrame | None = None,
) -> DataFrame:
    """Every raw record with typed columns, its key and what was done to it.

    Rows without a title are still there, with a NULL title. ``faults`` has one bit per
    value rule, ``row_digest`` is equal for exact copies. One pass over the raw records;
    write it once when both the clean rows and the report are wanted.
    """
    if variants is None:
        variants = step_table(variant_spellings(titled_text(raw), S.VOTED_COLUMNS, order), "variants")
    hits: dict[tuple[str, str], Column] = {}

    kept = raw.withColumns({f"raw_{c}": F.col(c) for c in [*S.TEXT_COLUMNS, "release_date", *S.NUMERIC_RANGES]})
    rows = normalise_text(kept, S.TEXT_COLUMNS)
    titled = F.col("title").isNotNull()
    for c in S.TEXT_COLUMNS:
        hits["whitespace_or_type", c] = F.col(f"raw_{c}").isNotNull() & ~F.col(f"raw_{c}").eqNullSafe(
            text.collapse(F.col(f"raw_{c}"))
        )
    hits["missing_title", "title"] = ~titled
    rows = rows.withColumn("before_mpaa_rating", F.col("mpaa_rating")).withColumn(
        "mpaa_rating", text.repair(F.col("mpaa_rating"), S.CERTIFICATES)
    ).withColumn("repaired", ~F.col("mpaa_rating").eqNullSafe(F.col("before_mpaa_rating")))
    hits["invalid_category", "mpaa_rating"] = titled & F.col("repaired")

    rows = apply_spellings(rows, variants, S.VOTED_COLUMNS, mark="voted_")
    for c in S.VOTED_COLUMNS:
        hits["case_or_spacing_variant", c] = titled & F.col(f"voted_{c}")

    rows = rows.withColumn("parsed", text.parse_date(F.col("release_date"), S.DATE_LAYOUTS))
    given = F.col("raw_release_date").isNotNull()
    hits["unparseable_date", "release_date"] = titled & given & F.col("parsed").isNull()
    hits["missing_date", "release_date"] = titled & ~given
    hits["two_digit_year_rollover", "release_date"] = titled & (F.year("parsed") > last_year)
    rows = rows.withColumn("release_date", text.roll_back_century(F.col("parsed"), last_year)).withColumn(
        "release_year", F.year("release_date")
    )

    rows = add_key(coerce_numbers(rows))
    for c in S.NUMERIC_RANGES:
        hits["out_of_range_or_non_numeric", c] = titled & F.col(f"raw_{c}").isNotNull() & F.col(c).isNull()

    business = [c for c in raw.columns if c != order]
    bits = [
        F.when(hits[issue, field], F.lit(1 << place)).otherwise(0).cast("bigint")
        for place, (issue, field, _) in enumerate(VALUE_RULES)
    ]
    return rows.select(
        order, *business, "release_year", "title_slug", "source_key",
        reduce(lambda left, right: left + right, bits).alias("faults"),
        text.digest(business).alias("row_digest"),
    )


def clean_rows(keyed_rows: DataFrame, order: str = "ord") -> DataFrame:
    """The first titled row per key. Exact copies share their key, so they go as well.

    Rows of one key and one ``order`` go by their digest, so that every run keeps the same one.
    """
    rows = drop_untitled(keyed_rows).drop("title_slug", "faults")
    return first_per_key(rows, "source_key", order, "row_digest").drop("row_digest")


def clean(
    raw: DataFrame, order: str = "ord", last_year: int = S.LAST_RELEASE_YEAR,
    variants: DataFrame | None = None,
) -> DataFrame:
    """Raw records (catalogue names, all text) to clean rows."""
    return clean_rows(keyed(raw, order, last_year, variants), order)


def cleaning_report(keyed_rows: DataFrame) -> DataFrame:
    """One row per rule with the number of records it touched; zero counts are kept."""
    counts = keyed_rows.agg(
        F.count("*").alias("rows_in"),
        *[
            F.count_if(F.col("faults").bitwiseAND(F.lit(1 << place)) != 0).alias(f"n{place}")
            for place in range(len(VALUE_RULES))
        ],
    )
    by_value = [
        _rule(issue, field, action, F.col(f"n{place}"))
        for place, (issue, field, action) in enumerate(VALUE_RULES)
    ]
    by_value.append(_rule("rows_in", "*", "read", F.col("rows_in")))
    # Copies per row, rows per key, keys per title: each step works on the counts of the
    # one before, so a row or key on a third of the records is counted in parts first.
    groups = (
        drop_untitled(keyed_rows).groupBy("source_key", "title_slug", "row_digest")
        .agg(F.count("*").alias("rows"))
        .groupBy("source_key", "title_slug")
        .agg(F.sum("rows").alias("rows"), F.count("*").alias("distinct_rows"))
        .groupBy("title_slug")
        .agg(F.sum("rows").alias("rows"), F.sum("distinct_rows").alias("distinct_rows"),
             F.count("*").alias("keys"))
        .agg(
            F.sum(F.col("rows") - F.col("distinct_rows")).alias("copies"),
            F.sum(F.col("distinct_rows") - F.col("keys")).alias("further"),
            F.sum(F.when(F.col("keys") > 1, F.col("keys"))).alias("repeated"),
            F.sum("keys").alias("kept"),
        )
    )
    by_group = [
        _rule("exact_duplicate_row", "*", "kept the first occurrence", F.col("copies")),
        _rule("duplicate_natural_key", "title + release_date", "kept the first occurrence", F.col("further")),
        _rule("repeated_title_kept", "title", "kept every row", F.col("repeated")),
        _rule("rows_out", "*", "written", F.col("kept")),
    ]

    def listed(frame: DataFrame, rules: list[Column]) -> DataFrame:
        return frame.select(F.explode(F.array(*rules)).alias("r")).select(
            F.lit("cleaning").alias("stage"), "r.*", F.lit("").alias("detail")
        )

    return listed(counts, by_value).unionByName(listed(groups, by_group))


def _rule(issue: str, field: str, action: str, count: Column) -> Column:
    return F.struct(
        F.lit(issue).alias("issue"), F.lit(field).alias("field"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("count"), F.lit(action).alias("action"),
    )
