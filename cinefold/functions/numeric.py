"""Numeric expressions: coercion, rounding, tiers, ratios and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinefold import schemas as S


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def in_range(value: Column, low: float, high: float) -> Column:
    """The value when it lies in the closed range, else NULL."""
    return F.when(value.between(low, high), value)


def round_even(value: Column, digits: int) -> Column:
    """Round the binary value half to even, after scaling."""
    if digits == 0:
        return F.rint(value)
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def decade(year: Column) -> Column:
    return F.floor(year / 10) * 10


def tier(amount: Column, part: int) -> Column:
    """Code (``part`` 1) or phrase (``part`` 2) of the budget tier; upper bounds are exclusive."""
    chain = None
    for entry in S.BUDGET_TIERS:
        ceiling, label = entry[0], F.lit(entry[part])
        fits = amount.isNotNull() if ceiling is None else amount < ceiling
        chain = F.when(fits, label) if chain is None else chain.when(fits, label)
    return chain


def score_delta(audience: Column, critics: Column) -> Column:
    return round_even(audience * 10 - critics, 1)


def blockbuster(gross: Column, budget: Column) -> Column:
    """Both bars cleared; NULL when either input is missing."""
    clears = (gross >= S.BLOCKBUSTER_GROSS) & (
        F.coalesce(F.try_divide(gross, budget), F.lit(0.0)) >= S.BLOCKBUSTER_MULTIPLE
    )
    return F.when(gross.isNotNull() & budget.isNotNull(), clears)


def capped_ratio(gross: Column, budget: Column) -> Column:
    ratio = F.try_divide(gross, budget)
    return round_even(F.when(ratio.isNotNull(), F.least(ratio, F.lit(S.RATIO_CAP))), 3)


def reception(score: Column) -> Column:
    chain = None
    for floor, phrase in S.RECEPTIONS:
        fits = score.isNotNull() if floor is None else score >= floor
        chain = F.when(fits, F.lit(phrase)) if chain is None else chain.when(fits, F.lit(phrase))
    return chain


def thousands(amount: Column) -> Column:
    return F.format_number(amount.cast("bigint"), 0)


def histogram_quantile(quantile: float, bounds: Sequence[float], cumulative: Column) -> Column:
    """Quantile from cumulative bucket counts, linear inside the bucket.

    ``cumulative`` is an array with one count per bound and the total as last entry.
    The lower edge of the first bucket is 0; a quantile past the last finite bound is
    that bound.
    """
    total = cumulative[len(bounds)]
    rank = total * F.lit(quantile)
    chain = F.when(total == 0, F.lit(None).cast("double"))
    lower, before = F.lit(0.0), F.lit(0)
    for position, bound in enumerate(bounds):
        inside = cumulative[position] - before
        share = F.coalesce(F.try_divide(rank - before, inside.cast("double")), F.lit(0.0))
        chain = chain.when(cumulative[position] >= rank, lower + (F.lit(bound) - lower) * share)
        lower, before = F.lit(bound), cumulative[position]
    return chain.otherwise(F.lit(float(bounds[-1])))
