from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import make_spark  # noqa: E402  (also puts the repository on the path)
from records import RECORDS  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_spark()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def raw(spark, tmp_path_factory):
    """The records, read through the JSON source, under catalogue names."""
    from cinefold.sources import records

    path = tmp_path_factory.mktemp("raw") / "records.json"
    path.write_text("\n".join(json.dumps({"ord": i} | r) for i, r in enumerate(RECORDS)))
    return records.load(records.read_lines(spark, str(path))).cache()


@pytest.fixture(scope="session")
def done(raw):
    from cinefold.plans import enrichment

    return enrichment.enrich(raw)


@pytest.fixture(scope="session")
def by_title(done):
    rows = done.rows.collect()
    return {row["source_key"]: row for row in rows}
