from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from prose import PROSE  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that a caller may have, under names that operators use inside.
CLASH = "row string, size long, words string, kept string, copies int"

@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, source[, lang]]), with clashing extra columns."""

    def build(rows, clash=True):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        extra = [("r", 1, "w", "k", 2)] if clash else [()]
        schema = f"{SCHEMA}, {CLASH}" if clash else SCHEMA
        return spark.createDataFrame([f + extra[0] for f in full], schema)

    return build


@pytest.fixture(scope="session")
def texts(sf_dir):
    """(doc_id, text) of the smallest documents table, in order."""
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture
def odd():
    """Nulls, empty and long texts, repeated rows, ties."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, PROSE), (5, PROSE), (6, PROSE + " end"), (None, PROSE), (None, None),
            (7, PROSE.upper()), (8, " ".join([PROSE] * 400)), (9, "two words"), (10, "été \U0001f600 " * 30)]
