"""Every registered query against its SQL check, on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import connect, differences


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_check(spark, sf_dir, duck, name):
    assert differences(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_check_gives_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and rows[0]["similarity"] >= rows[-1]["similarity"]
