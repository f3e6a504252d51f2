"""The index of cells against an exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinefold.operators import cells, search

SCHEMA = "id long, genre string, rating double, embedding array<float>"


def _rows(n, groups, width=16, seed=5):
    """Vectors around ``groups`` directions; a third of them around the first."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((groups, width)) * 4
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    return [(i, "ab"[i % 2], float(i % 7), (middle[g] + rng.standard_normal(width)).astype("float32").tolist()) for i, g in enumerate(at)]


@pytest.fixture(scope="module")
def grouped(spark):
    odd = [(900, "a", 1.0, None), (901, "a", 1.0, [0.0] * 16), (902, "b", None, [1.0] * 16), (903, None, 1.0, [1.0] * 16)]
    return spark.createDataFrame(_rows(700, 12) + odd, SCHEMA)


@pytest.fixture(scope="module")
def index(grouped):
    return cells.stored(cells.build(grouped))


def _found(frame):
    return sorted(tuple(r) for r in frame.select("request_id", "id", "similarity", "rank").collect())


@pytest.mark.parametrize("limits", [{}, {"group_rows": 16, "group_requests": 8}])
@pytest.mark.parametrize("filters", [{}, {"equal": {"genre": "genre"}, "minimum": {"rating": "rating"}, "not_self": True}])
def test_all_cells_give_the_exact_answer(grouped, index, limits, filters):
    asked = {"request_id": "id", "request_vector": "embedding", **filters}
    exact = _found(search.top_k_per_request(grouped, grouped, 5, **asked))
    assert _found(cells.search(index, grouped, 5, index.cells, **asked, **limits)) == exact and exact


def test_few_cells_suffice_where_vectors_form_groups(grouped, index):
    asked = {"request_id": "id", "request_vector": "embedding"}
    exact = search.top_k_per_request(grouped, grouped, 5, **asked)
    share = cells.share_found(index, grouped, exact, (1, 6), 5, **asked)
    assert share[1] < share[6] and share[6] >= 0.9 and index.cells == 27


def test_only_probed_cells_are_opened(grouped, index, spark):
    one = grouped.filter("id = 7").withColumnRenamed("embedding", "vector").withColumnRenamed("id", "request_id").select("request_id", "vector")
    probed = {r.cell for r in one.select(F.explode(cells._nearest(index.centres, 2)("vector")).alias("cell")).collect()}
    plan = cells.search(index, one, 3, 2)._jdf.queryExecution().toString()
    opened = [line for line in plan.split("\n") if "PartitionFilters" in line and "cell" in line]
    assert opened and any("cell#" in line.split("PartitionFilters")[1] and "IN" in line.upper() for line in opened)
    assert len(probed) == 2 and cells.search(index, one, 3, 2).count() == 3


def test_a_request_is_written_once_however_many_cells_it_probes(grouped, index, monkeypatch):
    written, write = {}, cells.step_table
    monkeypatch.setattr(cells, "step_table", lambda frame, name: written.setdefault(name, write(frame, name)))
    cells.search(index, grouped, 3, 20, request_id="id", request_vector="embedding")
    assert written["probes"].count() == grouped.filter("embedding IS NOT NULL AND id <> 901").count()


def test_small_cells_share_a_shelf_and_a_large_one_has_its_own():
    first, parts = cells._shelved({0: 3, 1: 4, 3: 25, 4: 2, 5: 9}, 6, 10)
    assert first.tolist() == [0, 0, 0, 1, 4, 5] and parts.tolist() == [1, 1, 1, 3, 1, 1]


def test_every_row_is_indexed_and_the_draw_is_stable(grouped, index):
    assert index.rows.count() == grouped.filter("embedding IS NOT NULL").count()
    again = cells.build(grouped.repartition(7))
    assert again.centres.orderBy("cell").collect() == index.centres.orderBy("cell").collect()
    assert sorted((r.id, r.cell) for r in again.rows.collect()) == sorted((r.id, r.cell) for r in index.rows.collect())
    assert {r.cell for r in index.rows.filter("id = 901").collect()} == {-1}


def test_empty_tables(spark, index):
    none = spark.createDataFrame([], SCHEMA)
    assert cells.search(cells.build(none), none, 3, request_id="id", request_vector="embedding").collect() == []
    assert cells.search(index, none, 3, request_id="id", request_vector="embedding").collect() == []
