"""Enrichment runs against a catalogue of deltas; a run on unchanged input ends after one look at the raw records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.operators import merge
from cinefold.operators.embedding import Embedder, offline_embedder
from cinefold.plans import enrichment
from cinefold.session import dropping_steps
from cinefold.sources import deltas

_RUN_STAGES = ("embedding", "load")


@dataclass
class Refreshed:
    """``report`` has all five stages; ``changed`` is false if the input was that of the last run."""

    commit: deltas.Commit
    report: DataFrame
    changed: bool


def digest(raw: DataFrame, *settings: object) -> str:
    """Of the records as a bag and of what else decides a run's results: two sums of 64-bit hashes and a count.

    Votes, medians and the line fit look at all records, so a record's row can change if any other does; only a whole
    input that is the same can be passed over. A record is hashed by name and value, so a null differs from an absent neighbour.
    """
    text = F.to_json(F.struct(*sorted(raw.columns)))
    sums = [F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")) for seed in (1, 2)]
    found = raw.agg(F.count("*"), *sums).first()
    return "/".join(map(str, (*found, *settings)))


def unchanged_report(spark: SparkSession, path: str, commit: deltas.Commit) -> DataFrame:
    """The report of a run that has nothing to do: the stages of the last one, all rows reused and unchanged."""
    known = deltas.stored_report(spark, path, commit).filter(~F.col("stage").isin(*_RUN_STAGES))
    kinds = ((commit.delivered, "unchanged"), (commit.kept, "kept"))
    keys = [spark.range(n).select(F.col("id").cast("string").alias("source_key"), F.lit(kind).alias("action")) for n, kind in kinds]
    rows = merge.empty_snapshot(spark).selectExpr("*", "'' AS action", "false AS needed", "'' AS embed_error", "false AS batch_head")
    nothing = merge.Merge(keys[0].unionByName(keys[1]), rows, rows)
    return enrichment.run_report(known, merge.as_report(merge.embedding_report(nothing), "embedding"),
                                 merge.as_report(merge.load_report(nothing), "load"))


def refresh(
    raw: DataFrame, path: str, run_time: Column, version: str = "1.0.0", plan: Embedder | None = None, order: str = "ord",
    last_year: int = S.LAST_RELEASE_YEAR, force: bool = False,
) -> Refreshed:
    """Bring the catalogue in ``path`` up to ``raw``.

    Without ``force`` nothing but the raw records is read if they, the version, the model and the last year are those of the last run and
    no row of it is without its vector. A row held back or not renewed by a failing service is tried again by the next run.
    """
    spark, plan = raw.sparkSession, plan or offline_embedder()
    last = deltas.current(spark, path)
    own = digest(raw, version, plan.model, last_year)
    if not force and last.digest == own and not last.pending:
        return Refreshed(last, unchanged_report(spark, path, last), False)
    with dropping_steps(spark):
        out = enrichment.run(raw, deltas.read(spark, path, last), run_time, version, plan, order, last_year, force)
        made = deltas.commit(spark, path, out.merged, own, out.report)
    return Refreshed(made, deltas.stored_report(spark, path, made), True)
