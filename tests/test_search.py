from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import vector as V
from cinefold.operators import batch, search
from cinefold.operators.embedding import offline_embedder


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").cache()


@pytest.fixture(scope="module")
def matrix(vectors):
    rows = vectors.orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


def ranked(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["request_id"], {})[r["rank"]] = r["id"]
    return {q: [ids[p] for p in sorted(ids)] for q, ids in out.items()}


def brute_force(matrix, k, skip_self=True):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    out = {}
    for q in range(len(matrix)):
        order = sorted(range(len(matrix)), key=lambda i: (-scores[q, i], i))
        out[q] = [i for i in order if not (skip_self and i == q)][:k]
    return out


@pytest.mark.parametrize("held", [search.HELD_BYTES, 30_000])
def test_batch_search_is_exact_whether_held_or_in_a_grid(vectors, matrix, held, monkeypatch):
    monkeypatch.setattr(search, "CELL_BYTES", 60_000)
    got = search.top_k_per_request(vectors, vectors, 7, not_self=True, id="vec_id", request_id="vec_id",
                                   request_vector="embedding", held_bytes=held)
    assert ranked(got) == brute_force(matrix, 7)


def test_ties_go_by_identifier_even_when_a_third_of_the_rows_are_copies(spark):
    rows = [(i, [1.0, 0.0] if i % 3 == 0 else [float(i % 7), 1.0]) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id bigint, embedding array<float>").repartition(7)
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [0.0, 1.0])], "request_id string, vector array<float>")
    got = ranked(search.top_k_per_request(frame, asked, 5))
    assert got["q"] == [0, 3, 6, 9, 12]
    assert got["r"] == [7, 14, 28, 35, 49]


def test_requests_without_a_match_give_no_rows_and_own_k_is_used(spark, vectors):
    asked = vectors.filter("vec_id < 4").select(
        F.col("vec_id").alias("request_id"), F.col("embedding").alias("vector"),
        (F.col("vec_id") + 1).cast("int").alias("top_k"),
        F.when(F.col("vec_id") == 3, 99).when(F.col("vec_id") == 2, F.col("label")).alias("label"))
    got = ranked(search.top_k_per_request(vectors, asked, equal={"label": "label"}, id="vec_id"))
    assert {q: len(ids) for q, ids in got.items()} == {0: 1, 1: 2, 2: 3}
    label = dict(vectors.select("vec_id", "label").collect())
    assert {label[i] for i in got[2]} == {label[2]}


def test_text_identifiers(spark, vectors):
    named = vectors.select(F.concat(F.lit("v"), F.col("vec_id")).alias("id"), "embedding")
    asked = named.filter("id = 'v7'").select(F.col("id").alias("request_id"), F.col("embedding").alias("vector"))
    assert ranked(search.top_k_per_request(named, asked, 1)) == {"v7": ["v7"]}


def test_text_identifiers_are_held_as_bytes_in_the_same_order():
    named = ["é", "z", "a", "aé", "😀", "Z" * 64]
    held = V.identifiers(pa.array(named))
    assert held.itemsize == 64  # four times that as characters
    assert [held[i].decode() for i in np.argsort(held)] == sorted(named)


def test_an_answer_does_not_carry_the_text_of_its_request(spark, vectors, monkeypatch):
    kinds = []

    def seen(catalogue, requests, *args, request_id, **options):
        kinds.append(requests.schema[request_id].dataType.simpleString())
        return exact(catalogue, requests, *args, request_id=request_id, **options)

    exact = search.top_k_per_request
    monkeypatch.setattr(batch.search, "top_k_per_request", seen)
    asked = spark.createDataFrame([(i, t, 3, None, None, None, None) for i, t in enumerate(["One text", "one TEXT", "another"])],
                                  "request_id bigint, query string, top_k int, genre string, min_imdb_rating double, mpaa_rating string, decade int")
    rows = vectors.select(F.col("vec_id").cast("string").alias("id"), "embedding", *[
        F.lit(None).cast(kind).alias(c) for c, kind in (("major_genre", "string"), ("mpaa_rating", "string"), ("decade", "int"), ("imdb_rating", "double"))])
    found = batch.search_texts(asked, rows, offline_embedder(), columns=["id"]).collect()
    of = [sorted((r["rank"], r["id"]) for r in found if r["request_id"] == i) for i in range(3)]
    assert kinds == ["bigint"] and [len(o) for o in of] == [3, 3, 3] and of[0] == of[1] != of[2]


def test_no_requests(spark, vectors):
    none = vectors.filter("vec_id < 0")
    assert search.top_k_per_request(vectors, none, 3, id="vec_id", request_id="vec_id",
                                    request_vector="embedding").count() == 0


def test_approximate_search_finds_nearly_all(vectors, matrix):
    got = ranked(search.approximate_search(vectors, vectors, 10, id="vec_id", request_id="vec_id",
                                           request_vector="embedding", not_self=True))
    want = brute_force(matrix, 10)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.9


@pytest.fixture(scope="module")
def many(spark):
    """12,000 vectors of evenly spread directions under three labels."""
    drawn = np.random.default_rng(7).standard_normal((12_000, 64)).astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(drawn)), "label": np.arange(len(drawn)) % 3, "embedding": list(drawn)})
    return spark.createDataFrame(table).repartition(5).cache(), drawn.astype(np.float64)


@pytest.mark.parametrize("rows", [search.NEAR_ROWS, 3000])
def test_approximate_search_finds_nearly_all_of_a_larger_table(many, rows, monkeypatch):
    """The candidates of one group do not have to serve the whole table, nor do answers depend on the splits."""
    monkeypatch.setattr(search, "NEAR_ROWS", rows)
    frame, matrix = many
    got, again = (ranked(search.approximate_search(f, f.filter("vec_id % 100 = 0"), 10, id="vec_id", request_id="vec_id",
                                                   request_vector="embedding", not_self=True)) for f in (frame, frame.repartition(3)))
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = unit[::100] @ unit.T
    scores[np.arange(120), np.arange(120) * 100] = -1
    want = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(set(got[100 * i]) & set(want[i])) / 10 for i in range(120)]) >= 0.9
    assert got == again


def test_approximate_search_is_exact_under_a_filter_that_leaves_few_rows(many):
    frame, _ = many
    asked = frame.filter("vec_id % 100 = 0")
    options = dict(equal={"label": "label"}, id="vec_id", request_id="vec_id", request_vector="embedding")
    assert ranked(search.approximate_search(frame, asked, 10, **options)) == ranked(search.top_k_per_request(frame, asked, 10, **options))


def test_approximate_candidates_in_a_grid_equal_the_held_ones(vectors):
    signed = vectors.withColumn("signature", search.signature(F.col("embedding"), 64))
    sets = [set(map(tuple, search.approximate_candidates(signed, signed, 100, "vec_id", request_id="vec_id",
                                                         held_bytes=b).collect())) for b in (1 << 20, 2000)]
    assert sets[0] == sets[1] and len(sets[0]) == 500 * 100


def test_candidate_budget_is_clamped_at_both_ends():
    budgets = [search.candidate_budget(k) for k in range(1, 200)]
    assert budgets == sorted(budgets) and (budgets[0], budgets[-1]) == (S.CANDIDATES_MIN, S.CANDIDATES_MAX)
    assert search.candidate_budget(7) == 7 * S.CANDIDATES_PER_K


def test_each_request_is_embedded_once(spark, vectors, tmp_path):
    """The vectors come from an embedder that notes every text it is asked for."""
    note = str(tmp_path / "asked")

    @F.udf("array<float>")
    def vector(name):
        with open(note, "a") as out:
            out.write(name + "\n")
        return [float(len(name))] * 64

    asked = spark.createDataFrame([(f"q{i}", 3) for i in range(20)], "request_id string, top_k int").repartition(2)
    asked = asked.withColumn("vector", vector("request_id"))
    assert search.top_k_per_request(vectors, asked, id="vec_id").count() == 60
    with open(note) as told:
        assert sorted(told.read().split()) == sorted(f"q{i}" for i in range(20))


def test_kernel_work_per_pair_does_not_grow_with_requests():
    """Wide equality of many blocks with a full sort, over many requests at once."""
    rng = np.random.default_rng(1)
    rows, wanted = rng.normal(size=(400, 8)), rng.normal(size=(3000, 8))
    asked = V.Requests(np.arange(3000), V.unit_rows(wanted), 5)
    best = V.BestRows(3000, 5)
    for start in range(0, 400, 50):
        V.rank_block(asked, best, np.arange(start, start + 50), rows[start:start + 50], {})
    scores = np.round(V.unit_rows(wanted) @ V.unit_rows(rows).T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(400), scores.shape), -scores), axis=1)[:, :5]
    assert (best.row == order).all()


@pytest.mark.parametrize("filters", [{}, {"equal": "g"}, {"minimum": "m"}])
def test_kernel_rounds_and_orders_few_of_its_scores(filters, monkeypatch):
    """Vectors with copies, some without length; held against a full sort."""
    rng, rounded = np.random.default_rng(2), []
    rows = rng.normal(size=(9000, 16))
    rows[5000:5300], rows[7], rows[8] = rows[5], 0.0, np.nan
    wanted, ids = V.unit_rows(rows[:300]), rng.permutation(9000)
    columns = {name: rng.integers(0, 3, 9000).astype(object) for name in filters.values()}
    order = np.argsort([0] * 300 if "equal" not in filters else columns["g"][:300].astype(int), kind="stable")
    ask = {kind: {name: columns[name][:300][order]} for kind, name in filters.items()}
    asked = V.Requests(ids[:300][order], wanted[order], 5, not_id=True, **ask)
    best, plain_round = V.BestRows(300, 5), np.round
    monkeypatch.setattr(np, "round", lambda x, *a: rounded.append(np.size(x)) or plain_round(x, *a))
    for part in np.array_split(np.arange(9000), 2):
        V.rank_block(asked, best, ids[part], rows[part], {n: v[part] for n, v in columns.items()})
    monkeypatch.undo()
    scores = np.round(asked.vectors @ V.unit_rows(rows).T, 9)
    scores[np.isnan(scores) | ~asked.eligible(columns, ids, slice(0, 300))] = -np.inf
    first = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    known = np.isfinite(np.take_along_axis(scores, first, 1))
    assert (np.isfinite(best.score) == known).all() and (best.row == ids[first])[known].all() and known.sum() > 1400
    assert sum(rounded) < 300 * 9000 / 4


def test_groups_of_a_grid_are_not_joined_to_few_tasks(vectors):
    found = search.top_k_per_request(vectors, vectors, 2, id="vec_id", request_id="vec_id", request_vector="embedding", held_bytes=40_000)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_a_grid_has_groups_for_all_cores(spark, vectors, matrix, monkeypatch):
    monkeypatch.setattr(search, "LEAST_REQUESTS", 8, raising=False)
    cut, spread = [], search.spread_groups
    monkeypatch.setattr(search, "spread_groups", lambda *given: cut.append(given[-1]) or spread(*given))
    found = search.top_k_per_request(vectors, vectors, 3, not_self=True, id="vec_id", request_id="vec_id", request_vector="embedding", held_bytes=200_000)
    assert ranked(found) == brute_force(matrix, 3)
    assert cut[0] >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("kind", [np.int64, "S9"])
def test_rows_gained_one_by_one_take_their_places(kind):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 40, (30, 600)) / 40  # many ties
    ids = rng.permutation(600).astype(kind)
    best = V.BestRows(30, 5)
    for start in range(0, 600, 7):
        best.offer(np.arange(30), scores[:, start : start + 7].copy(), ids[start : start + 7])
    first = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.row == ids[first]).all() and (best.score == np.take_along_axis(scores, first, 1)).all() and (best.exact == best.score).all()


def test_many_requests_are_met_on_all_cores(vectors, monkeypatch):
    asked = {"id": "vec_id", "request_id": "vec_id", "request_vector": "embedding"}
    few = search.top_k_per_request(vectors, vectors, 2, **asked)
    monkeypatch.setattr(search, "MANY_REQUESTS", 10)
    many = search.top_k_per_request(vectors, vectors, 2, **asked)
    spread = ["REPARTITION_BY_NUM" in found._jdf.queryExecution().toString() for found in (few, many)]
    assert spread == [False, True] and sorted(few.collect()) == sorted(many.collect())


def test_neighbours_leave_out_the_row_and_need_a_vector(vectors):
    got = search.neighbours(vectors, 5, 3, "vec_id", columns=["vec_id"])
    assert 5 not in {r["vec_id"] for r in got.collect()} and got.count() == 3
    with pytest.raises(LookupError):
        search.neighbours(vectors, -1, 3, "vec_id", columns=["vec_id"])
    gap = vectors.withColumn("embedding", F.when(F.col("vec_id") != 5, F.col("embedding")))
    with pytest.raises(ValueError):
        search.neighbours(gap, 5, 3, "vec_id", columns=["vec_id"])


def test_similarity_is_clamped(spark):
    frame = spark.createDataFrame([(1.0000000004,), (-1e-9,), (None,), (0.8123456,)], "s double")
    assert [r[0] for r in frame.select(V.presented(F.col("s"))).collect()] == [1.0, 0.0, None, 0.812346]


def test_vector_text(spark):
    frame = spark.createDataFrame([([0.5, -0.25, 0.0, 1e-8],)], "v array<float>")
    back = frame.select(V.from_text(V.to_text(F.col("v"))).alias("b"), "v").first()
    assert back["b"] == back["v"]
    plain = spark.createDataFrame([([0.5, -0.25],)], "v array<float>")
    assert plain.select(V.to_text(F.col("v"))).first()[0] == "[0.5,-0.25]"


def test_a_zero_vector_is_similar_to_nothing(spark):
    frame = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id bigint, embedding array<float>")
    rows = search.search(frame, [1.0, 0.0], 2, columns=["id"]).collect()
    assert [(r["id"], r["similarity"]) for r in rows] == [(2, 1.0), (1, None)]


def test_result_rows_have_no_vector_and_no_null_provenance(spark):
    from cinefold import schemas as S

    row = spark.range(1).select(*[
        F.lit(None).cast(S.STORED_TYPES.get(c, "string")).alias(c) for c in [*S.RESULT_COLUMNS, "embedding"]])
    out = search.result_rows(row)
    assert "embedding" not in out.columns and out.first()["imputed_fields"] == []


@pytest.mark.parametrize(("change", "param"), [
    ({}, None), ({"query": None}, "q"), ({"query": " \t "}, "q"), ({"query": "x" * 1001}, "q"),
    ({"query": " " + "x" * 1000}, None), ({"top_k": 0}, "top_k"), ({"top_k": 51}, "top_k"), ({"top_k": 50}, None),
    ({"min_imdb_rating": -0.1}, "min_imdb_rating"), ({"min_imdb_rating": 10.1}, "min_imdb_rating"),
    ({"decade": 1890}, "decade"), ({"decade": 2110}, "decade"), ({"decade": 1995}, "decade"),
    ({"query": "", "decade": 1}, "q"),
])
def test_request_rules(spark, change, param):
    from cinefold.operators import requests

    base = {"query": "a film", "top_k": None, "genre": " ", "min_imdb_rating": None, "mpaa_rating": None, "decade": None}
    row = base | change
    frame = spark.createDataFrame([tuple(row.values())],
                                  "query string, top_k int, genre string, min_imdb_rating double, mpaa_rating string, decade int")
    out = requests.validated(frame).first()
    assert out["invalid_param"] == param
    if param is None:
        assert out["genre"] is None and out["top_k"] == (change.get("top_k") or 10)


def test_request_key_ignores_case_and_padding(spark):
    from cinefold.operators import requests

    rows = [(1, "Space Opera", "Drama", 7.0), (2, "  space opera ", " drama ", 7.0), (3, "space opera", None, 7.0)]
    frame = spark.createDataFrame(rows, "request_id int, query string, genre string, min_imdb_rating double")
    frame = frame.withColumns({"top_k": F.lit(None).cast("int"), "mpaa_rating": F.lit(None).cast("string"),
                               "decade": F.lit(None).cast("int")})
    out = {r["request_key"]: (r["request_id"], r["asked"])
           for r in requests.distinct_requests(requests.valid_only(frame)).collect()}
    assert out == {"search|space opera|10|drama|7.0|-|-": (1, 2), "search|space opera|10|-|7.0|-|-": (3, 1)}


def test_requests_that_share_all_filters_meet_only_their_rows(monkeypatch):
    """Products are formed for rows that pass every equality filter, and answers are those of each request on its own."""
    rng = np.random.default_rng(21)
    n, asked, seen = 400, 900, []
    rows = {"genre": rng.choice(np.array(["a", "b", None], object), n), "decade": rng.choice(np.array([1990, 2000, None], object), n)}
    vectors = rng.standard_normal((n, 8))
    wants = sorted(zip(rng.choice(["a", "b", None], asked), (None if x < 0 else int(x) for x in rng.choice([-1, 1990, 2000], asked))),
                   key=lambda pair: [(w is None, w or 0) for w in pair])
    equal = {c: np.array([w[i] for w in wants], object) for i, c in enumerate(rows)}
    requests = V.Requests(np.arange(asked), V.unit_rows(rng.standard_normal((asked, 8))), 5, equal)
    inner = V._rank_cosine
    monkeypatch.setattr(V, "_rank_cosine", lambda r, b, ids, units, kept, who: (seen.append(len(ids) * len(who)), inner(r, b, ids, units, kept, who)))
    best = V.BestRows(asked, 5)
    V.rank_block(requests, best, np.arange(n), vectors, rows)
    units, found = V.unit_rows(vectors), {}
    for request, row in zip(*best.found()[:2]):
        found.setdefault(int(request), []).append(int(row))
    allowed = 0
    for i, (genre, decade) in enumerate(wants):
        here = [k for k in range(n) if genre in (None, rows["genre"][k]) and decade in (None, rows["decade"][k])]
        allowed += len(here)
        assert found[i] == sorted(here, key=lambda k: (-round(float(requests.vectors[i] @ units[k]), 9), k))[:5]
    assert sum(seen) == allowed
