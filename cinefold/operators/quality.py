"""Audit of a stored snapshot against its constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that may not be missing, and the closed range of each checked column.
NOT_NULL = ["source_key", "title", "imputed_fields", "augmented_text", "content_hash"]
RANGES: dict[str, tuple[str, float | None, float | None]] = {
    "imdb_rating_range": ("imdb_rating", 0, 10),
    "rt_rating_range": ("rt_rating", 0, 100),
    "runtime_positive": ("running_time_min", 1, None),
    "budget_nonnegative": ("production_budget", 0, None),
    "votes_nonnegative": ("imdb_votes", 0, None),
    "year_range": ("release_year", 1900, 2100),
}


def _outside(column: str, low: float | None, high: float | None) -> Column:
    value, broken = F.col(column), F.lit(False)
    if low is not None:
        broken = broken | (value < low)
    if high is not None:
        broken = broken | (value > high)
    return broken


def audit(snapshot: DataFrame, key: str = "source_key") -> DataFrame:
    """``rule, violations`` per constraint: one pass, and one count per key."""
    rules = {f"not_null_{c}": F.col(c).isNull() for c in NOT_NULL}
    rules |= {name: _outside(*bounds) for name, bounds in RANGES.items()}
    counted = snapshot.agg(*[F.count_if(broken).alias(n) for n, broken in rules.items()])
    by_row = counted.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules
    ])).alias("r")).select("r.*")
    repeats = (
        snapshot.groupBy(key).agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        .select(F.lit(f"unique_{key}").alias("rule"), "violations")
    )
    return by_row.unionByName(repeats)
