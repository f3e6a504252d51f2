"""The mix, the packed rows and the pipeline."""

from __future__ import annotations

from collections import Counter, defaultdict

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pytest
from cinefold.llm import contamination, mixing, outliers, packing, queries, simhash
from cinefold.llm.common import table
from prose import PROSE


def _targets(sizes):
    """By hand: share out, cap, share out again what is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    fixed, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        rest, level = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / level >= 2 * sizes[s]}
        if not over:
            return fixed | {s: rest * weight[s] / level for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return fixed


def test_mix_of_the_table(spark, sf_dir):
    rows = queries.op10_cube_mixing(spark, sf_dir).collect()
    docs = duckdb.sql(f"select doc_id, source, text from '{sf_dir}/documents.parquet'").fetchall()
    size = {d: len(brute.WORD.findall(t or "")) for d, _, t in docs}
    sizes, taken = Counter(), Counter()
    for d, s, _ in docs:
        sizes[s] += size[d]
    source, goal = {d: s for d, s, _ in docs}, _targets(sizes)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(goal[source[r.doc_id]]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[source[r.doc_id]] += r.taken
    largest = defaultdict(int)
    for d, s in source.items():
        largest[s] = max(largest[s], size[d])
    assert len(rows) == len(docs) and all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_cube_mixing(spark, sf_dir).collect()))


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_balances_words_and_documents(make, block):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 60)), "big" if i % 3 else f"s{i % 9}") for i in range(900)]
    units = mixing.plan(make(rows).selectExpr("doc_id", "source", "size(split(trim(text), ' ')) + 0L AS size"), block=block).collect()
    for name in {r[2] for r in rows}:
        own = [u for u in units if u.source == name]
        rate = own[0].target / own[0].source_size
        assert abs(sum(u.copies * u["size"] for u in own) - own[0].target) <= 60
        assert abs(sum(u.copies for u in own) - rate * len(own)) <= 6


def test_flight_keeps_totals():
    import random

    draw = random.Random(4)
    sizes, rows = [draw.randrange(0, 50) * 1.0 for _ in range(300)], [draw.choice([1.0, 1.0, 2.0]) for _ in range(300)]
    chances = [0.37] * 300
    left = mixing.flight(chances, sizes, rows, draw)
    assert len(left) <= 2 and all(c in (0.0, 1.0) for i, c in enumerate(chances) if i not in left)
    for z in (sizes, rows):
        assert sum(c * v for c, v in zip(chances, z)) == pytest.approx(0.37 * sum(z))


def test_chances_are_kept():
    """Each unit is drawn as often as its chance says."""
    import random

    times = np.zeros(8)
    for seed in range(4000):
        draw, chances = random.Random(seed), [0.3] * 8
        left = mixing.flight(chances, [1.0, 2, 3, 4, 5, 6, 7, 8], [1.0] * 8, draw)
        mixing.landing(chances, [1.0, 2, 3, 4, 5, 6, 7, 8], left, draw)
        times += chances
    assert np.abs(times / 4000 - 0.3).max() < 0.03


def test_mix_odd_rows(make, odd):
    odd = [(d, t, s) for (d, t), s in zip(odd, [None, "", "a", None, "b", "b", "é", None, "a", "c", "c", "z", "\U0001f600"])]
    frame = make(odd)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    counts = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    assert all(n in (1, 2, 4) and k in {(d, t, s) for d, t, s in odd} for k, n in counts.items())
    assert mixing.mix(make([])).collect() == [] and mixing.mix(make([(1, None), (2, "")])).collect() == []


def test_packed_rows_hold_every_token_once(spark, sf_dir, texts):
    packed = queries.op1_token_packing(spark, sf_dir).collect()
    bpe = packing.encoder(packing.VOCABULARY)
    pieces = defaultdict(list)
    for r in packed:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<i4")
        assert len(ids) == len(places) == packing.ROW_TOKENS and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert len(r.doc_ids) == len(r.starts) == r.n_segments == len(r.cu_seqlens) - 1
        assert (ids[r.n_tokens:] == packing.SEPARATOR).all() and (places[r.n_tokens:] == 0).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert (places[a:b] == np.arange(b - a)).all()
            pieces[d].append((s, ids[a:b].tolist()))
    for d, text in texts:
        whole = []
        for start, ids in sorted(pieces.pop(d, [])):
            assert start == len(whole)
            whole += ids
        if text:
            assert whole[-1] == packing.SEPARATOR and bpe.decode(whole[:-1]) == text
        else:
            assert whole == []
    assert not pieces and len({(r.shard, r.pack) for r in packed}) == len(packed)
    assert sum(r.n_tokens for r in packed) > 0.97 * len(packed) * packing.ROW_TOKENS


def test_best_fit_is_that_of_a_full_search():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64, 100):
        for n in (0, 1, 5, 300):
            lengths = rng.integers(1, capacity + 1, n)
            bins = packing.best_fit_decreasing(lengths, capacity)
            room = sorted(capacity - np.bincount(bins, weights=lengths, minlength=0).astype(int)) if n else []
            assert room == brute.bins_of_best_fit(lengths.tolist(), capacity)[0]


def test_pack_odd_rows(make, odd):
    got = packing.unpack(packing.pack(make(odd), row_tokens=50, run_tokens=120)).collect()
    bpe, seen = packing.encoder(packing.VOCABULARY), Counter()
    for r in got:
        assert 0 < len(r.ids) <= 50
        seen[r.doc_id] += len(r.ids)
    want = Counter()
    for d, t in odd:
        if t:
            want[d] += len(bpe.encode_ordinary(t)) + 1
    assert seen == want
    assert packing.pack(make([])).collect() == []


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage of the whole run against its own operator by brute force, on what the stage before kept."""
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    verdict = {r.doc_id: r for r in outliers.verdicts(docs).collect()}
    first = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    left = {r.doc_id for r in first.collect()}
    assert left == {d for d, v in verdict.items() if v.kept} and all(not brute.statistics(rows[d])[-1] for d in left)
    second = corpus_pipeline.near_copies(spark, first, sf_dir)
    left = brute.first_of_near_copies([(d, rows[d]) for d in left])
    assert {r.doc_id for r in second.collect()} == left
    third = corpus_pipeline.decontamination(spark, second, sf_dir)
    leaks = {r.doc_id for r in contamination.matches(second, table(spark, sf_dir, "benchmark")).collect()}
    left -= leaks
    assert {r.doc_id for r in third.collect()} == left and leaks
    fourth = corpus_pipeline.mixing_weights(spark, third, sf_dir)
    times = Counter(r.doc_id for r in fourth.collect())
    assert set(times) <= left and set(times.values()) <= {1, 2}
    assert first.columns == second.columns == third.columns == fourth.columns == docs.columns
    packed = Counter()
    for r in packing.unpack(corpus_pipeline.run(spark, sf_dir)).collect():
        packed[r.doc_id] += r.start == 0
    assert packed == times


def test_pipeline_of_odd_tables(spark, make, odd, tmp_path):
    spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (odd, []):
        make(rows, clash=True).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert bool(out) == bool(rows)
    assert PROSE


def test_near_copies_in_the_pipeline_keep_the_first(make):
    frame = make([(3, PROSE), (2, PROSE.replace("the", "the", 1)), (9, PROSE.upper())])
    assert [r.doc_id for r in simhash.drop_near_copies(frame).collect()] == [2]
