from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cinefold.functions import text
from cinefold.operators import embedding
from cinefold.operators.embedding import Embedder, Rejected, embed_batch

WIDTH = 3


def recorder(calls, refuse=(), fail=()):
    left = {t: n for t, n in fail}

    def service(texts):
        calls.append(list(texts))
        if any(t in refuse for t in texts):
            raise Rejected("refused")
        for t in texts:
            if left.get(t, 0) > 0:
                left[t] -= 1
                raise ConnectionError("down")
        return [[float(len(t)), 0.0, 1.0] for t in texts]

    return service


def plan(**options):
    return Embedder("m", lambda: None, WIDTH, first_wait=0.0, **options)


def test_a_poison_text_loses_only_itself():
    calls = []
    out = embed_batch(recorder(calls, refuse={"bad"}), ["a", "bb", "bad", "c"], plan())
    assert [v is None for v, _ in out] == [False, False, True, False]
    assert out[1][0][0] == 2.0 and out[2][1].startswith("Rejected")
    assert calls == [["a", "bb", "bad", "c"], ["a"], ["bb"], ["bad"], ["c"]]


def test_passing_errors_are_tried_again_and_refusals_are_not():
    calls = []
    assert embed_batch(recorder(calls, fail=[("a", 2)]), ["a"], plan())[0][0] is not None
    assert len(calls) == 3
    calls.clear()
    assert embed_batch(recorder(calls, refuse={"a"}), ["a"], plan())[0][0] is None
    assert len(calls) == 1
    calls.clear()
    assert embed_batch(recorder(calls, fail=[("a", 99)]), ["a"], plan(attempts=4))[0][0] is None
    assert len(calls) == 4


def test_a_vector_of_another_width_is_a_failure():
    out = embed_batch(lambda texts: [[1.0]] * len(texts), ["a", "b"], plan())
    assert all(v is None for v, _ in out)


@pytest.mark.parametrize(("size", "limit", "sizes"), [(4, None, [4, 4, 2]), (64, 8, [8, 2]), (32, 64, [10])])
def test_batches(spark, size, limit, sizes):
    def connect():
        return lambda texts: [[float(len(texts)), 0.0, 0.0] for _ in texts]

    frame = spark.range(10).coalesce(1).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("t"))
    made = frame.select(embedding.embedded(F.col("t"), Embedder("m", connect, 3, batch_size=size, batch_limit=limit)).alias("e"))
    rows = made.select("e.*").collect()
    assert [int(r["vector"][0]) for r in rows] == [n for n in sizes for _ in range(n)]
    assert sum(r["batch_head"] for r in rows) == len(sizes)


def test_missing_texts_are_passed_over_and_the_prefix_goes_in_front(spark):
    def connect():
        return lambda texts: [[float(t == "passage: x"), 0.0, 0.0] for t in texts]

    frame = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    made = frame.select("id", embedding.embedded(F.col("t"), Embedder("m", connect, 3, prefix="passage: ")).alias("e"))
    rows = {r["id"]: r["e"] for r in made.collect()}
    assert rows[1]["vector"][0] == 1.0 and rows[2]["vector"] is None and rows[2]["error"] is None


def test_blank_prefix_changes_nothing(spark):
    frame = spark.createDataFrame([("x",)], "t string")
    assert frame.select(text.with_prefix("  ", F.col("t"))).first()[0] == "x"


def test_offline_vectors_are_stable_and_of_unit_length():
    service = embedding.hashed_words()
    a, b, c = service(["The Godfather", "the  GODFATHER!", ""])
    assert a == b and math.isclose(sum(x * x for x in a), 1.0) and not any(c)
    assert service(["The Godfather"])[0] == embedding.hashed_words()(["The Godfather"])[0]


def test_a_capital_with_a_dot_does_not_end_a_word():
    service = embedding.hashed_words()
    assert service(["İzmir KİTAP"])[0] == service(["izmir kitap"])[0]


def test_width_contracts(spark):
    good = spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<float>")
    assert embedding.require_width(good, 2) is good
    with pytest.raises(ValueError, match="3 wide"):
        embedding.require_width(good, 3)
    with pytest.raises(ValueError):
        embedding.require_stored_width(good, 3)
    with pytest.raises(ValueError, match="dimensions"):
        embedding.require_service(Embedder("m", lambda: lambda texts: [[1.0]], 3))


def test_http_client(monkeypatch):
    import io
    import urllib.error
    import urllib.request

    from cinefold.sources.embedding_service import http_embedder

    seen = []

    def answer(request, timeout):
        seen.append(request)
        if len(seen) == 1:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, io.BytesIO(b""))
        if len(seen) == 3:
            raise urllib.error.HTTPError(request.full_url, 413, "large", {}, io.BytesIO(b"too large"))
        return io.BytesIO(b"[[1, 2, 3]]")

    monkeypatch.setattr(urllib.request, "urlopen", answer)
    service = http_embedder("http://host/", "m", 3, first_wait=0.0)
    assert embed_batch(service.connect(), ["x"], service) == [([1, 2, 3], None)]
    assert seen[0].full_url == "http://host/embed" and len(seen) == 2
    vector, error = embed_batch(service.connect(), ["x"], service)[0]
    assert vector is None and "413" in error and len(seen) == 3


def test_vectors_are_handed_over_a_few_at_a_time_in_the_same_batches(spark, monkeypatch):
    calls, made = [], []
    with monkeypatch.context() as patch:
        patch.setattr(embedding.F, "pandas_udf", lambda kind: lambda run: made.append(run) or (lambda column: column))
        embedding.embedded(F.lit("x"), Embedder("m", lambda: recorder(calls), WIDTH, batch_size=30))
    texts = pd.Series([None if i % 3 == 0 else "a" * (i % 17) for i in range(5000)])
    frames = list(made[0](iter([texts, pd.Series([None] * 40), texts[:0]])))
    assert max(len(f) for f in frames) <= 1000 and sum(map(len, frames)) == 5040
    whole = pd.concat(frames, ignore_index=True)
    present = [i for i in range(5000) if i % 3]
    assert [i for i, head in enumerate(whole["batch_head"]) if head] == present[::30]
    assert [len(c) for c in calls] == [30] * (len(present) // 30) + [len(present) % 30]
    assert [v and v[0] for v in whole["vector"]] == [None if t is None else float(len(t)) for t in texts] + [None] * 40


def test_rows_keep_their_vectors_when_an_arrow_batch_is_handed_over_in_pieces(spark):
    rows = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 5 != 0, F.concat(F.lit("w"), "id")).alias("t"))
    out = rows.select("id", "t", embedding.embedded(F.col("t"), embedding.offline_embedder())["vector"].alias("v")).collect()
    known = embedding.hashed_words()([r.t or "" for r in out])
    assert len(out) == 3000 and all((r.v is None) == (r.id % 5 == 0) and (r.v is None or r.v == v) for r, v in zip(out, known))
