"""Text expressions: normalisation, folding, slugs, date parsing, reports of text values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse(value: Column) -> Column:
    """Text with every run of (Unicode) white space made one space; blank becomes NULL."""
    text = F.trim(F.regexp_replace(value.cast("string"), r"(?U)\s+", " "))
    return F.nullif(text, F.lit(""))


def repair(value: Column, dictionary: Mapping[str, str]) -> Column:
    """Replace a value by the dictionary entry for its upper case; keep it when there is none."""
    entries = F.create_map(*[F.lit(part) for pair in dictionary.items() for part in pair])
    return F.coalesce(F.try_element_at(entries, F.upper(value)), value)


def fold(value: Column) -> Column:
    """Case-insensitive form; going through upper case also unifies letters such as sharp s.

    Something must stand between the two, as Catalyst shortens ``lower(upper(x))`` to ``lower(x)``.
    """
    return F.lower(F.concat(F.upper(value), F.lit("")))


@F.pandas_udf(T.StringType())
def _to_ascii(titles: pd.Series) -> pd.Series:
    decomposed = titles.str.normalize("NFKD")
    return decomposed.str.encode("ascii", "ignore").str.decode("ascii")


def slug(value: Column) -> Column:
    """Lower-case ASCII words joined by hyphens.

    Only values with a character outside ASCII go to the Arrow function, the others
    are handed over as NULL and stay in generated code.
    """
    foreign = value.rlike(r"[^\x00-\x7F]")
    plain = F.when(foreign, _to_ascii(F.when(foreign, value))).otherwise(value)
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))


def slug_or_digest(title: Column, title_slug: Column) -> Column:
    """The slug, or a digest of the title when no ASCII letter or digit is left of it."""
    return F.when(title_slug == "", F.sha2(title, 256)).otherwise(title_slug)


def natural_key(title_slug: Column, date: Column) -> Column:
    return F.concat_ws(
        "::", title_slug, F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("undated"))
    )


def parse_date(value: Column, layouts: Sequence[str]) -> Column:
    """The date under the first layout that fits, NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(layout)) for layout in layouts]).cast("date")


def roll_back_century(date: Column, last_year: int) -> Column:
    """Undo two-digit-year rollover: a year past the data's last year is a century too late."""
    return F.when(F.year(date) > last_year, F.add_months(date, -1200)).otherwise(date)


def with_prefix(prefix: str, text: Column) -> Column:
    """An instruction and one space in front of a text; a blank instruction changes nothing."""
    instruction = prefix.strip()
    return F.concat(F.lit(instruction + " "), text) if instruction else text


def render(value: Column, kind: str) -> Column:
    """A canonical text form of a typed column."""
    if kind.startswith("array"):
        return F.array_join(value, ",")
    return value.cast("string")


def _framed(text: Column) -> Column:
    """A text with its length in front, so that joined texts cannot run into each other."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fingerprint(columns: Mapping[str, str]) -> Column:
    """SHA-256 over the canonical forms of ``{column: type}``."""
    texts = [_framed(render(F.col(name), kind)) for name, kind in columns.items()]
    return F.sha2(F.concat_ws("|", *texts), 256)


def digest(columns: Sequence[str]) -> Column:
    """A short value that is equal for rows equal in all of ``columns``, NULL equal to NULL."""
    return F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256))
