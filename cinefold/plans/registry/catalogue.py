"""Sources, cleaning, imputation, features, statistics and audits on the raw catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import numeric, text
from cinefold.operators import cleaning, export, features, imputation, medians, quality, search, stats
from cinefold.operators.merge import stored_state
from cinefold.plans import enrichment
from cinefold.plans.registry import Registry, sql
from cinefold.plans.registry.base import RUN_TIME, Shared, plain, plain_sql
from cinefold.session import scratch_path, step_table
from cinefold.sources import records, snapshots

_REPORT = "stage, issue, field, CAST(count AS BIGINT) AS count, action, detail"


def _entries(stage: str, rows: list[tuple[str, str, str, str, str]], source: str) -> str:
    """Report rows in SQL: ``(issue, field, count expression, action, detail expression)``."""
    return " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, {sql.sql_text(i)} AS issue, {sql.sql_text(f)} AS field, "
        f"CAST(coalesce({c}, 0) AS BIGINT) AS count, {sql.sql_text(a)} AS action, {d} AS detail FROM {source}"
        for i, f, c, a, d in rows
    )


def _register_sources(r: Registry) -> None:
    spaced = ", ".join(
        f"{sql.q(n.replace(' ', '_'))} AS {sql.q(n)}" for n in S.SOURCE_COLUMNS
    )

    @r.add("s1_json_records", sql.upto("raw", f"SELECT ord, {spaced} FROM raw"))
    def s1(spark, sf):
        path = scratch_path(spark, "records")
        Shared.of(spark, sf).landed.write.json(path)
        return records.read_lines(spark, path)

    @r.add("s2_column_names", sql.upto("named", "SELECT * FROM named"))
    def s2(spark, sf):
        return records.to_catalogue_names(records.normalise_names(Shared.of(spark, sf).landed))

    @r.add("s3_column_contract", sql.upto("raw", f"SELECT ord, {spaced} FROM raw"))
    def s3(spark, sf):
        extra = records.normalise_names(Shared.of(spark, sf).landed.withColumn("Extra", F.lit("x")))
        return records.require_columns(extra, keep=["ord"])

    @r.add("s4_stored_state", sql.upto("snapshot", """
        SELECT source_key, content_hash, augmented_text, embedding_model,
               embedding IS NOT NULL AS has_embedding FROM snapshot"""))
    def s4(spark, sf):
        return stored_state(Shared.of(spark, sf).snapshot)

    typed = {c: t for c, t in S.STORED_TYPES.items() if not c.startswith(("embedding", "pipeline"))}

    @r.add("s5_typed_sink", sql.upto("enriched", f"SELECT {plain_sql(typed)} FROM enriched"))
    def s5(spark, sf):
        shared = Shared.of(spark, sf)
        rows = features.augment(imputation.impute(shared.cleaned, shared.statistics))
        return plain(rows.select(*typed))

    @r.add("s8_run_report", sql.upto("enriched", f"SELECT {_REPORT} FROM ({_report_sql()})"))
    def s8(spark, sf):
        shared = Shared.of(spark, sf)
        path = scratch_path(spark, "report")
        snapshots.write_report(shared.report, path)
        return _plain_report(spark.read.schema(S.REPORT_SCHEMA).json(path))

    @r.add("s9_export_once", sql.upto("snapshot", "SELECT id, title, augmented_text AS text FROM snapshot"))
    def s9(spark, sf):
        rows = search.searchable(Shared.of(spark, sf).snapshot).select(
            "id", "title", F.col("augmented_text").alias("text")
        )
        path = scratch_path(spark, "export")
        snapshots.write_export(rows, path)
        snapshots.write_export(rows.withColumn("title", F.lit("left alone")), path)
        return spark.read.parquet(path)

    faults = {
        "title": "CASE WHEN ord % 41 = 0 THEN NULL ELSE title END",
        "source_key": "CASE WHEN ord % 37 = 0 THEN 'same' ELSE source_key END",
        "imdb_rating": "CASE WHEN ord % 13 = 0 THEN 10.5 ELSE CAST(imdb_rating AS DOUBLE) END",
        "rt_rating": "CASE WHEN ord % 11 = 0 THEN -1 ELSE rt_rating END",
        "running_time_min": "CASE WHEN ord % 17 = 0 THEN 0 ELSE running_time_min END",
        "production_budget": "CASE WHEN ord % 19 = 0 THEN -production_budget ELSE production_budget END",
        "imdb_votes": "CASE WHEN ord % 23 = 0 THEN -imdb_votes ELSE imdb_votes END",
        "release_year": "CASE WHEN ord % 29 = 0 THEN 1800 ELSE release_year END",
    }
    others = ["imputed_fields", "augmented_text", "content_hash"]
    broken = ", ".join([f"{e} AS {c}" for c, e in faults.items()] + others)
    checks = [(f"not_null_{c}", f"{c} IS NULL") for c in quality.NOT_NULL]
    checks += [("imdb_rating_range", "imdb_rating < 0 OR imdb_rating > 10"),
               ("rt_rating_range", "rt_rating < 0 OR rt_rating > 100"),
               ("runtime_positive", "running_time_min <= 0"),
               ("budget_nonnegative", "production_budget < 0"),
               ("votes_nonnegative", "imdb_votes < 0"),
               ("year_range", "release_year < 1900 OR release_year > 2100")]
    audit = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) AS violations FROM broken WHERE {c}" for n, c in checks
    ) + " UNION ALL SELECT 'unique_source_key', CAST(count(*) - count(DISTINCT source_key) AS BIGINT) FROM broken"

    @r.add("s10_constraint_audit", sql.upto("enriched", audit, ("broken", f"SELECT {broken} FROM enriched")))
    def s10(spark, sf):
        rows = Shared.of(spark, sf).enriched
        return quality.audit(rows.selectExpr(*[f"{e} AS {c}" for c, e in faults.items()], *others))


def _cleaning_sql() -> str:
    values: list[tuple[str, str, str, str, str]] = []
    for c in S.TEXT_COLUMNS:
        values.append(("whitespace_or_type", c,
                       f"count_if({c} IS NOT NULL AND {sql.collapse(c)} IS DISTINCT FROM {c})",
                       "normalised to single-spaced text", "''"))
    titled = f"{sql.collapse('title')} IS NOT NULL"
    rating = sql.collapse("mpaa_rating")
    date = sql.parsed("release_date")
    values += [
        ("missing_title", "title", f"count_if(NOT ({titled}))", "row dropped", "''"),
        ("invalid_category", "mpaa_rating",
         f"count_if({titled} AND {sql.certificate(rating)} IS DISTINCT FROM {rating})",
         "mapped to the official certificates", "''"),
        ("unparseable_date", "release_date",
         f"count_if({titled} AND release_date IS NOT NULL AND {date} IS NULL)", "set to NULL", "''"),
        ("missing_date", "release_date", f"count_if({titled} AND release_date IS NULL)", "left as NULL", "''"),
        ("two_digit_year_rollover", "release_date",
         f"count_if({titled} AND year({date}) > {S.LAST_RELEASE_YEAR})", "moved back 100 years", "''"),
    ]
    for c, (low, high) in S.NUMERIC_RANGES.items():
        values.append(("out_of_range_or_non_numeric", c,
                       f"count_if({titled} AND {c} IS NOT NULL AND ({sql.in_range(c, low, high)}) IS NULL)",
                       f"set to NULL outside [{low:g}, {high:g}]", "''"))
    values.append(("rows_in", "*", "count(*)", "read", "''"))
    variants = " UNION ALL ".join(
        f"SELECT 'cleaning', 'case_or_spacing_variant', '{c}', count(*), "
        f"'replaced by the most common spelling', '' FROM normal JOIN variants "
        f"ON field = '{c}' AND spelling = {c}"
        for c in S.VOTED_COLUMNS
    )
    business = ", ".join([*sql.CATALOGUE_COLUMNS, "source_key"])
    rows = f"(SELECT DISTINCT {business}, title_slug FROM keyed)"
    keys = f"(SELECT DISTINCT source_key, title_slug FROM keyed)"
    duplicates = f"""
      SELECT 'cleaning', 'exact_duplicate_row', '*', (SELECT count(*) FROM keyed) - (SELECT count(*) FROM {rows}),
        'kept the first occurrence', ''
      UNION ALL SELECT 'cleaning', 'duplicate_natural_key', 'title + release_date',
        (SELECT count(*) FROM {rows}) - (SELECT count(*) FROM {keys}), 'kept the first occurrence', ''
      UNION ALL SELECT 'cleaning', 'repeated_title_kept', 'title',
        CAST((SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {keys} GROUP BY title_slug) WHERE n > 1) AS BIGINT),
        'kept every row', ''
      UNION ALL SELECT 'cleaning', 'rows_out', '*', (SELECT count(*) FROM {keys}), 'written', ''"""
    return f"{_entries('cleaning', values, 'named')} UNION ALL {variants} UNION ALL {duplicates}"


def _imputation_sql() -> str:
    strategies = {
        "imdb_rating": "median within genre, then overall median",
        "rt_rating": "fitted line over the observed audience score, then genre median",
        "running_time_min": "median within genre, then overall median",
        "production_budget": "median within decade, then overall median",
        **{n: f"constant '{v}'" for n, v in S.SENTINELS.items()},
        **{n: "left as NULL" for n in S.LEFT_MISSING},
    }
    detail = "(SELECT CAST(pairs AS BIGINT) || ' pairs' FROM line)"
    rows = [("missing_values", n, f"count_if({n} IS NULL)", how, detail if n == "rt_rating" else "''")
            for n, how in strategies.items()]
    return _entries("imputation", rows, "cleaned")


def _feature_sql() -> str:
    lengths = ("'mean ' || CAST(floor(avg(length(augmented_text))) AS BIGINT) || ' characters, longest ' "
               "|| max(length(augmented_text))")
    rows = [("derived_feature", n, f"count({n})", "created", "''")
            for n in ("decade", "budget_tier", "rating_score_delta")]
    rows += [("derived_feature", "blockbuster_flag", "count_if(blockbuster_flag)", "created", "''"),
             ("derived_feature", "profit_ratio", "count(profit_ratio)", "created", "''"),
             ("derived_feature", "augmented_text", "count(*)", "created", lengths)]
    return _entries("features", rows, "enriched")


def _first_run_sql() -> str:
    """Embedding and load of a run into an empty catalogue: every row is new and gets a vector."""
    every, none = "count(*)", "count(*) * 0"
    counts = {"embedding": {"embedded": every, "reused": none, "failures": none},
              "load": {"inserted": every, "updated": none, "unchanged": none, "held_back": none, "total_rows": every}}
    return " UNION ALL ".join(
        f"SELECT '{stage}' AS stage, '{issue}' AS issue, '*' AS field, CAST({n} AS BIGINT) AS count, 'counted' AS action, '' AS detail FROM enriched"
        for stage, issues in counts.items() for issue, n in issues.items())


def _report_sql() -> str:
    return " UNION ALL ".join((_cleaning_sql(), _imputation_sql(), _feature_sql(), _first_run_sql()))


def _plain_report(report):
    """Without the coefficients in the text, which print differently in the last digit."""
    return report.withColumn("detail", F.regexp_replace("detail", r" pairs, .*", " pairs"))


def _register_cleaning(r: Registry) -> None:
    collapsed = ", ".join(f"{sql.collapse(c)} AS {c}" for c in S.TEXT_COLUMNS)

    @r.add("c1_text_normalisation", sql.upto("named", f"SELECT ord, {collapsed} FROM named"))
    def c1(spark, sf):
        rows = Shared.of(spark, sf).raw.select("ord", *S.TEXT_COLUMNS)
        return cleaning.normalise_text(rows, S.TEXT_COLUMNS)

    @r.add("c1_documents_normalised", """
        SELECT doc_id, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS text FROM documents""")
    def c1_documents(spark, sf):
        rows = Shared.of(spark, sf).table("documents").select("doc_id", "text")
        return cleaning.normalise_text(rows, ["text"])

    @r.add("p2_untitled_rows_dropped", sql.upto("normal", "SELECT ord, title FROM normal"))
    def p2(spark, sf):
        rows = Shared.of(spark, sf).raw.select("ord", "title")
        return cleaning.drop_untitled(cleaning.normalise_text(rows, ["title"]))

    @r.add("c2_certificate_repair", sql.upto("normal", "SELECT ord, mpaa_rating FROM normal"))
    def c2(spark, sf):
        return Shared.of(spark, sf).normal.select("ord", "mpaa_rating")

    @r.add("c3_majority_spelling", sql.upto("voted", f"SELECT ord, {', '.join(S.VOTED_COLUMNS)} FROM voted"))
    def c3(spark, sf):
        rows = Shared.of(spark, sf).normal.select("ord", *S.VOTED_COLUMNS)
        variants = step_table(cleaning.variant_spellings(rows, S.VOTED_COLUMNS), "variants")
        return cleaning.apply_spellings(rows, variants, S.VOTED_COLUMNS)

    @r.add("c3_variant_spellings", sql.upto("variants", "SELECT field, spelling, canonical FROM variants"))
    def c3_variants(spark, sf):
        return cleaning.variant_spellings(Shared.of(spark, sf).normal, S.VOTED_COLUMNS)

    @r.add("c4_date_parsing", sql.upto("normal", f"""
        SELECT ord, CAST({sql.parsed('release_date')} AS VARCHAR) AS release_date FROM normal"""))
    def c4(spark, sf):
        rows = Shared.of(spark, sf).normal
        return rows.select("ord", text.parse_date(F.col("release_date"), S.DATE_LAYOUTS)
                           .cast("string").alias("release_date"))

    @r.add("c5_century_rollover", """
        SELECT o_orderkey, CAST(CASE WHEN year(d) > 2001 THEN d - INTERVAL 100 YEAR ELSE d END AS DATE)::VARCHAR
          AS order_date
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 50 = 0
                THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END AS d FROM orders)""")
    def c5(spark, sf):
        late = F.when(F.col("o_orderkey") % 50 == 0, 1200).otherwise(0)
        date = F.add_months(F.to_date("o_orderdate"), late)
        back = text.roll_back_century(date, 2001).cast("string")
        return Shared.of(spark, sf).table("orders").select("o_orderkey", back.alias("order_date"))

    @r.add("c6_release_year", sql.upto("keyed", """
        SELECT ord, CAST(release_date AS VARCHAR) AS release_date, release_year FROM keyed"""))
    def c6(spark, sf):
        rows = cleaning.parse_release(Shared.of(spark, sf).normal.select("ord", "release_date"))
        return rows.withColumn("release_date", F.col("release_date").cast("string"))

    numbers = ", ".join(S.NUMERIC_RANGES)

    @r.add("c7_numeric_ranges", sql.upto("typed", f"SELECT ord, {numbers} FROM typed"))
    def c7(spark, sf):
        return cleaning.coerce_numbers(Shared.of(spark, sf).normal.select("ord", *S.NUMERIC_RANGES))

    @r.add("c8_exact_copies", "SELECT text, lang, min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
    def c8(spark, sf):
        return cleaning.drop_copies(Shared.of(spark, sf).table("documents"), ["text", "lang"], "doc_id")

    @r.add("c8_raw_copies", sql.upto("normal", f"""
        SELECT {', '.join(sql.CATALOGUE_COLUMNS)}, min(ord) AS ord FROM normal GROUP BY ALL"""))
    def c8_raw(spark, sf):
        return cleaning.drop_copies(Shared.of(spark, sf).normal, sql.CATALOGUE_COLUMNS)

    @r.add("c9_slug", sql.upto("normal", f"SELECT ord, {sql.slug('title')} AS title_slug FROM normal"))
    def c9(spark, sf):
        return Shared.of(spark, sf).normal.select("ord", text.slug(F.col("title")).alias("title_slug"))

    @r.add("c10_natural_key", sql.upto("keyed", "SELECT ord, source_key FROM keyed"))
    def c10(spark, sf):
        shared = Shared.of(spark, sf)
        rows = cleaning.drop_untitled(cleaning.keyed(shared.raw, variants=shared.variants))
        return rows.select("ord", "source_key")

    cleaned = {c: "double" if c in S.NUMERIC_RANGES else "date" if c == "release_date" else "string"
               for c in sql.CATALOGUE_COLUMNS} | {"ord": "bigint", "release_year": "int", "source_key": "string"}

    @r.add("c11_first_per_key", sql.upto("cleaned", f"SELECT {plain_sql(cleaned)} FROM cleaned"))
    def c11(spark, sf):
        shared = Shared.of(spark, sf)
        return plain(cleaning.clean(shared.raw, variants=shared.variants).select(*cleaned))

    @r.add("c12_repeated_titles", sql.upto("cleaned", """
        SELECT title_slug, count(*) AS rows FROM cleaned GROUP BY title_slug HAVING count(*) > 1"""))
    def c12(spark, sf):
        rows = Shared.of(spark, sf).cleaned.withColumn("title_slug", text.slug_or_digest(F.col("title"), text.slug(F.col("title"))))
        return cleaning.repeated_titles(rows)

    @r.add("c13_cleaning_report", sql.upto("keyed", f"SELECT {_REPORT} FROM ({_cleaning_sql()})"))
    def c13(spark, sf):
        shared = Shared.of(spark, sf)
        return cleaning.cleaning_report(cleaning.keyed(shared.raw, variants=shared.variants))


def _register_imputation(r: Registry) -> None:
    long_sql = " UNION ALL ".join(
        f"SELECT '{c}' AS field, {g} AS grp, count({v}) AS n, median({v}) AS median FROM predicted GROUP BY ALL"
        for c, v, group in (("imdb_rating", "imdb_rating", "g"), ("running_time_min", "running_time_min", "g"),
                            ("production_budget", "production_budget", "d"), ("rt_rating", "rt_p", "g"))
        for g in (group, "CAST(NULL AS VARCHAR)")
    )

    @r.add("i1_group_medians", sql.upto("predicted", f"""
        SELECT field, grp, n, round(median, 6) AS median FROM ({long_sql}) WHERE n > 0"""))
    def i1(spark, sf):
        shared = Shared.of(spark, sf)
        return shared.statistics.medians.withColumn("median", F.round("median", 6))

    @r.add("i1_part_price_medians", """
        WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price FROM part),
        m AS (SELECT p_brand, median(price) AS median FROM p GROUP BY p_brand)
        SELECT p_partkey, p.p_brand, round(coalesce(price, median), 4) AS price FROM p JOIN m USING (p_brand)""")
    def i1_parts(spark, sf):
        price = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))
        rows = Shared.of(spark, sf).table("part").select("p_partkey", "p_brand", price.alias("price"))
        table = step_table(medians.exact_medians(rows, ["p_brand"], "price"), "medians")
        filled = medians.fill_with_group_median(rows, "price", "p_brand", table, None)
        return filled.withColumn("price", F.round("price", 4))

    @r.add("i1_order_value_medians", """
        SELECT o_orderpriority, count(*) AS n, round(median(o_totalprice), 4) AS median
        FROM orders GROUP BY o_orderpriority""")
    def i1_orders(spark, sf):
        rows = Shared.of(spark, sf).table("orders").select("o_orderpriority", "o_totalprice")
        out = medians.exact_medians(rows, ["o_orderpriority"], "o_totalprice")
        return out.withColumn("median", F.round("median", 4))

    @r.add("i2_line_fit", """
        SELECT CAST(regr_count(y, x) AS BIGINT) AS pairs, round(regr_slope(y, x), 8) AS slope,
          round(regr_intercept(y, x), 4) AS intercept, round(corr(x, y), 8) AS correlation
        FROM (SELECT CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice END AS x,
                CASE WHEN l_partkey % 6 <> 0 THEN l_extendedprice * (1 - l_discount) END AS y FROM lineitem)""")
    def i2(spark, sf):
        fit = imputation.fit_summary(_priced_lines(spark, sf), "x", "y")
        return fit.select("pairs", F.round("slope", 8).alias("slope"),
                          F.round("intercept", 4).alias("intercept"),
                          F.round("correlation", 8).alias("correlation"))

    @r.add("i3_predicted_scores", sql.upto("predicted", """
        SELECT ord, round(rt_p, 6) AS rt_rating FROM predicted"""))
    def i3(spark, sf):
        shared = Shared.of(spark, sf)
        rows = imputation.with_prediction(shared.cleaned, shared.statistics.line)
        return rows.select("ord", F.round("rt_rating", 6).alias("rt_rating"))

    @r.add("i4_fallback_medians", sql.upto("predicted", """
        SELECT g AS grp, count(rt_p) AS n, round(median(rt_p), 6) AS median FROM predicted GROUP BY g"""))
    def i4(spark, sf):
        medians_table = Shared.of(spark, sf).statistics.medians
        return medians_table.filter("field = 'rt_rating' and grp is not null").select(
            "grp", "n", F.round("median", 6).alias("median"))

    @r.add("i4_observed_only_medians", sql.upto("grouped", """
        SELECT g AS grp, count(rt_rating) AS n, round(median(rt_rating), 6) AS median FROM grouped
        GROUP BY g HAVING count(rt_rating) > 0"""))
    def i4_observed(spark, sf):
        rows = imputation.long_values(Shared.of(spark, sf).cleaned, {"rt_rating": "genre"})
        table = medians.exact_medians(rows.filter("grp is not null"), ["grp"], "value")
        return table.withColumn("median", F.round("median", 6))

    sentinels = ", ".join(f"coalesce({c}, {sql.sql_text(v)}) AS {c}" for c, v in S.SENTINELS.items())

    @r.add("i5_sentinels", sql.upto("cleaned", f"SELECT ord, {sentinels} FROM cleaned"))
    def i5(spark, sf):
        return Shared.of(spark, sf).cleaned.select("ord", *S.SENTINELS).fillna(S.SENTINELS)

    @r.add("i6_left_missing", sql.upto("cleaned", " UNION ALL ".join(
        f"SELECT '{c}' AS field, count_if({c} IS NULL)::BIGINT AS missing FROM cleaned" for c in S.LEFT_MISSING)))
    def i6(spark, sf):
        shared = Shared.of(spark, sf)
        report = imputation.imputation_report(shared.cleaned, shared.statistics.line)
        return report.filter(F.col("field").isin(S.LEFT_MISSING)).select(
            "field", F.col("count").alias("missing"))

    filled = {"ord": "bigint", "imdb_rating": "double", "rt_rating": "double", "running_time_min": "double",
              "production_budget": "double", "imputed_fields": "array<string>"}

    @r.add("i7_provenance", sql.upto("imputed", f"SELECT {plain_sql(filled)} FROM imputed"))
    def i7(spark, sf):
        shared = Shared.of(spark, sf)
        return plain(imputation.impute(shared.cleaned, shared.statistics).select(*filled))

    @r.add("i8_imputation_report", sql.upto("line", f"SELECT {_REPORT} FROM ({_imputation_sql()})"))
    def i8(spark, sf):
        shared = Shared.of(spark, sf)
        return _plain_report(imputation.imputation_report(shared.cleaned, shared.statistics.line))


def _priced_lines(spark, sf):
    x = F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice"))
    y = F.when(F.col("l_partkey") % 6 != 0, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return Shared.of(spark, sf).table("lineitem").select(x.alias("x"), y.alias("y"))


def _register_features(r: Registry) -> None:
    def derived(column: str) -> str:
        return sql.upto("derived", f"SELECT ord, {column} FROM derived")

    def rows(spark, sf):
        shared = Shared.of(spark, sf)
        return imputation.impute(shared.cleaned, shared.statistics)

    @r.add("f1_decade", derived("decade"))
    def f1(spark, sf):
        return rows(spark, sf).select("ord", numeric.decade(F.col("release_year")).cast("int").alias("decade"))

    @r.add("f2_budget_tier", derived(
        f"budget_tier, {sql.tier_case('production_budget', 2)} AS phrase"))
    def f2(spark, sf):
        budget = F.col("production_budget")
        return rows(spark, sf).select("ord", numeric.tier(budget, 1).alias("budget_tier"),
                                      numeric.tier(budget, 2).alias("phrase"))

    @r.add("f3_score_delta", derived("rating_score_delta"))
    def f3(spark, sf):
        delta = numeric.score_delta(F.col("imdb_rating"), F.col("rt_rating"))
        return rows(spark, sf).select("ord", delta.alias("rating_score_delta"))

    @r.add("f4_blockbuster_flag", derived("blockbuster_flag"))
    def f4(spark, sf):
        flag = numeric.blockbuster(F.col("worldwide_gross"), F.col("production_budget"))
        return rows(spark, sf).select("ord", flag.alias("blockbuster_flag"))

    @r.add("f5_profit_ratio", derived("profit_ratio"))
    def f5(spark, sf):
        ratio = numeric.capped_ratio(F.col("worldwide_gross"), F.col("production_budget"))
        return rows(spark, sf).select("ord", ratio.alias("profit_ratio"))

    @r.add("f6_document_text", sql.upto("documented", "SELECT ord, augmented_text FROM documented"))
    def f6(spark, sf):
        return features.augment(rows(spark, sf)).select("ord", "augmented_text")

    @r.add("f7_fingerprint", sql.upto("enriched", "SELECT ord, content_hash FROM enriched"))
    def f7(spark, sf):
        return features.augment(rows(spark, sf)).select("ord", "content_hash")

    @r.add("f8_feature_report", sql.upto("enriched", f"SELECT {_REPORT} FROM ({_feature_sql()})"))
    def f8(spark, sf):
        return features.feature_report(Shared.of(spark, sf).enriched)


_SUMMARY = """
SELECT count(*) AS total_movies, count(embedding) AS movies_with_embeddings,
  count(DISTINCT major_genre) AS distinct_genres, count(DISTINCT director) AS distinct_directors,
  count(DISTINCT distributor) AS distinct_distributors,
  min(release_year) AS earliest_release_year, max(release_year) AS latest_release_year,
  round(CAST(sum(CAST(imdb_rating * 10 AS BIGINT)) AS DOUBLE) / (count(imdb_rating) * 10), 2) AS average_imdb_rating,
  round(CAST(sum(rt_rating) AS DOUBLE) / count(rt_rating), 2) AS average_rt_rating,
  {median} AS median_production_budget, CAST(sum(worldwide_gross) AS BIGINT) AS total_worldwide_gross,
  '{run_time}' AS last_updated, mode() WITHIN GROUP (ORDER BY embedding_model) AS embedding_model,
  mode() WITHIN GROUP (ORDER BY pipeline_version) AS pipeline_version
FROM snapshot"""


def _register_statistics(r: Registry) -> None:
    genres = "SELECT major_genre AS genre, count(*) AS count FROM snapshot WHERE major_genre IS NOT NULL GROUP BY 1"
    decades = "SELECT decade, count(*) AS count FROM snapshot WHERE decade IS NOT NULL GROUP BY decade"

    @r.add("a1_genres", sql.upto("snapshot", f"SELECT genre FROM ({genres}) ORDER BY count DESC, genre"))
    def a1(spark, sf):
        return stats.genres(Shared.of(spark, sf).snapshot)

    @r.add("a2_genre_counts", sql.upto("snapshot", genres))
    def a2(spark, sf):
        return stats.genre_counts(Shared.of(spark, sf).snapshot)

    @r.add("a3_decade_counts", sql.upto("snapshot", decades))
    def a3(spark, sf):
        return stats.decade_counts(Shared.of(spark, sf).snapshot)

    @r.add("a4_summary", sql.upto("snapshot", _SUMMARY.format(run_time=RUN_TIME, median="median(production_budget)")))
    def a4(spark, sf):
        return plain(stats.summary(Shared.of(spark, sf).snapshot))

    nested = f"""
      SELECT s.*, {S.EMBEDDING_WIDTH} AS embedding_dimension,
        (SELECT string_agg(genre || '=' || count, ',' ORDER BY count DESC, genre) FROM ({genres})) AS movies_per_genre,
        (SELECT string_agg(decade || '=' || count, ',' ORDER BY decade) FROM ({decades})) AS movies_per_decade
      FROM ({_SUMMARY.format(run_time=RUN_TIME, median="CAST(trunc(median(production_budget)) AS BIGINT)")}) s"""

    @r.add("a5_statistics", sql.upto("snapshot", nested))
    def a5(spark, sf):
        def listed(column: str, name: str):
            pair = lambda e: F.concat(e[name].cast("string"), F.lit("="), e["count"].cast("string"))
            return F.array_join(F.transform(column, pair), ",")

        return stats.statistics(Shared.of(spark, sf).snapshot).withColumns({
            "last_updated": F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"),
            "movies_per_genre": listed("movies_per_genre", "genre"),
            "movies_per_decade": listed("movies_per_decade", "decade"),
        })

    @r.add("a6_readiness", sql.upto("snapshot", """
        SELECT count(embedding) AS embedded, count(embedding) > 0 AS ready FROM snapshot"""))
    def a6(spark, sf):
        return stats.readiness(Shared.of(spark, sf).snapshot)

    @r.add("a7_run_report", sql.upto("enriched", f"""
        SELECT '1.0.0' AS version, stage, count(*) AS entries, CAST(sum(count) AS BIGINT) AS total
        FROM ({_report_sql()}) GROUP BY stage"""))
    def a7(spark, sf):
        document = enrichment.report_document(Shared.of(spark, sf).report, "1.0.0")
        stages = document.select("version", F.explode("stages").alias("s"))
        total = F.aggregate("s.entries", F.lit(0).cast("bigint"), lambda t, e: t + e["count"])
        return stages.select("version", "s.stage", F.size("s.entries").cast("bigint").alias("entries"),
                             total.alias("total"))

    shown = {c: S.STORED_TYPES.get(c, "string") for c in S.RESULT_COLUMNS}

    @r.add("p1_result_projection", sql.upto("snapshot", f"SELECT {plain_sql(shown)} FROM snapshot"))
    def p1(spark, sf):
        return plain(search.result_rows(Shared.of(spark, sf).snapshot))

    exported = {c: S.STORED_TYPES.get(c, "string") for c in S.EXPORT_COLUMNS}

    @r.add("x1_export_rows", sql.upto("snapshot", f"""
        SELECT {plain_sql(exported)}, augmented_text AS text, len(embedding) AS width
        FROM snapshot WHERE embedding IS NOT NULL"""))
    def x1(spark, sf):
        rows = export.export_rows(Shared.of(spark, sf).snapshot)
        return plain(rows.withColumn("width", F.size("embedding").cast("bigint")).drop("embedding"))

    @r.add("x4_export_table", sql.upto("snapshot", f"""
        SELECT {plain_sql(exported)}, augmented_text AS text, true AS placed FROM snapshot WHERE embedding IS NOT NULL"""))
    def x4(spark, sf):
        placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
        return plain(export.export_table(Shared.of(spark, sf).snapshot).withColumn("placed", placed).drop("x", "y"))


def register(r: Registry) -> None:
    _register_sources(r)
    _register_cleaning(r)
    _register_imputation(r)
    _register_features(r)
    _register_statistics(r)
