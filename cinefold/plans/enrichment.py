"""The whole enrichment run: raw records to the next snapshot and the run report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.operators import cleaning, features, imputation, merge
from cinefold.operators.embedding import (
    Embedder, offline_embedder, require_service, require_stored_width,
)
from cinefold.session import step_table


@dataclass
class Run:
    merged: merge.Merge
    snapshot: DataFrame
    statistics: imputation.FillStatistics
    variants: DataFrame
    report: DataFrame


@dataclass
class Enriched:
    keyed: DataFrame
    cleaned: DataFrame
    rows: DataFrame
    statistics: imputation.FillStatistics
    variants: DataFrame


def enrich(
    raw: DataFrame, order: str = "ord", last_year: int = S.LAST_RELEASE_YEAR,
    statistics: imputation.FillStatistics | None = None, variants: DataFrame | None = None,
) -> Enriched:
    """Raw records to enriched rows.

    The keyed and the cleaned records are written, since the statistics, the fills and
    the reports read them several times. Given ``statistics`` and ``variants`` are used
    in place of new ones.
    """
    if variants is None:
        variants = spelling_variants(raw, order)
    keyed = step_table(cleaning.keyed(raw, order, last_year, variants), "keyed")
    cleaned = step_table(cleaning.clean_rows(keyed, order), "cleaned")
    if statistics is None:
        statistics = imputation.fill_statistics(cleaned)
    rows = features.augment(imputation.impute(cleaned, statistics))
    return Enriched(keyed, cleaned, rows, statistics, variants)


def stage_reports(done: Enriched) -> DataFrame:
    """The cleaning, imputation and feature reports."""
    return run_report(
        cleaning.cleaning_report(done.keyed),
        imputation.imputation_report(done.cleaned, done.statistics.line),
        features.feature_report(done.rows),
    )


def run(
    raw: DataFrame, stored: DataFrame, run_time: Column, version: str = "1.0.0",
    plan: Embedder | None = None, order: str = "ord", last_year: int = S.LAST_RELEASE_YEAR,
    force: bool = False, statistics: imputation.FillStatistics | None = None,
    variants: DataFrame | None = None,
) -> Run:
    """One enrichment run against the stored snapshot."""
    plan = plan or offline_embedder()
    require_service(plan)
    require_stored_width(stored, plan.width)
    done = enrich(raw, order, last_year, statistics, variants)
    done.rows = step_table(done.rows, "enriched")
    merged = merge.merge(stored, done.rows.drop(order), plan, version, run_time, force)
    return Run(merged, merged.snapshot, done.statistics, done.variants, whole_report(done, merged))


def whole_report(done: Enriched, merged: merge.Merge) -> DataFrame:
    """The reports of all five stages of a run."""
    return run_report(
        stage_reports(done),
        merge.as_report(merge.embedding_report(merged), "embedding"),
        merge.as_report(merge.load_report(merged), "load"),
    )


def spelling_variants(raw: DataFrame, order: str = "ord") -> DataFrame:
    base = cleaning.titled_text(raw)
    return step_table(cleaning.variant_spellings(base, S.VOTED_COLUMNS, order), "variants")


def run_report(*stages: DataFrame) -> DataFrame:
    """All stage reports as one table."""
    return reduce(DataFrame.unionByName, stages)


def report_document(report: DataFrame, version: str) -> DataFrame:
    """The run report as one nested document; it holds one entry per rule and stage."""
    entry = F.struct("issue", "field", "count", "action", "detail")
    stages = report.groupBy("stage").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return stages.agg(
        F.array_sort(F.collect_list(F.struct("stage", "entries"))).alias("stages")
    ).select(F.lit(version).alias("version"), "stages")
