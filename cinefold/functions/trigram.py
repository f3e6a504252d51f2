"""Trigram expressions for fuzzy title matching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_trigrams(text: Column) -> Column:
    """All trigrams of a text in order, repeats kept.

    Words are runs of letters and digits in lower case; each is padded with two spaces
    in front and one behind.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        starts = F.sequence(F.lit(1), F.length(word) + 1)
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))

    return F.flatten(F.transform(words, of_word))


def trigrams(text: Column) -> Column:
    """The set of trigrams of a text."""
    return F.array_distinct(ordered_trigrams(text))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body refers to it."""
    return F.transform(F.array(value), body)[0]


def _similarity(left: Column, right: Column) -> Column:
    return _once(
        F.size(F.array_intersect(left, right)),
        lambda shared: F.try_divide(
            shared.cast("double"), (F.size(left) + F.size(right) - shared).cast("double")
        ),
    )


def set_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two sets."""
    sets = F.struct(left.alias("a"), right.alias("b"))
    return _once(sets, lambda both: _similarity(both["a"], both["b"]))


def extent_similarity(wanted: Column, ordered: Column) -> Column:
    """Best similarity of a set to any contiguous stretch of ordered trigrams.

    A best stretch starts and ends on a wanted trigram (cutting other ends off only
    shrinks the union), so only those positions are tried.
    """

    def over_hits(both: Column) -> Column:
        places = F.transform(both["o"], lambda gram, i: F.when(F.array_contains(both["q"], gram), i + 1))
        return _once(F.array_compact(places), lambda hits: best(both, hits))

    def best(both: Column, hits: Column) -> Column:
        def from_start(low: Column) -> Column:
            stretches = F.transform(
                F.filter(hits, lambda i: i >= low),
                lambda high: F.array_distinct(F.slice(both["o"], low, high - low + 1)),
            )
            return F.array_max(F.transform(stretches, lambda e: _similarity(both["q"], e)))

        return F.array_max(F.transform(hits, from_start))

    parts = F.struct(wanted.alias("q"), ordered.alias("o"))
    return F.coalesce(_once(parts, over_hits), F.lit(0.0))


def word_similarity(query: Column, text: Column) -> Column:
    """How well the query matches the best stretch of the text."""
    return extent_similarity(trigrams(query), ordered_trigrams(text))
