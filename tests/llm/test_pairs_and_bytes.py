"""Fingerprints, byte strings and archives against brute force."""

from __future__ import annotations

import hashlib

import brute
import numpy as np
import pytest
from cinefold.llm import queries, simhash, suffixes, warc
from prose import PROSE


def test_fingerprints_and_components(spark, sf_dir, texts):
    prints = {d: brute.fingerprint(t) for d, t in texts}
    least = brute.components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_anchors(spark, sf_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", least[d]) for d in prints}


@pytest.mark.parametrize("hot", [1, 4096])
def test_links_reach_every_pair_within_two_bits(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    flips = [base ^ np.int64(1 << int(a)) ^ np.int64(1 << int(b)) for a, b in rng.integers(0, 63, (6, 2))]
    prints = np.unique(np.concatenate([base, *flips, rng.integers(0, 1 << 63, 300, dtype=np.int64)]))
    frame = spark.createDataFrame([(int(p),) for p in prints], "fingerprint long")
    for distinct in (1, 10_000, 10**9):
        roots = {r.member: r.least for r in simhash.components(simhash.links(frame, distinct, hot_homes=hot)).collect()}
        label = brute.components({int(p): int(p) for p in prints})
        assert {int(p): roots.get(int(p), int(p)) for p in prints} == label


def test_code_blocks_are_odd_and_full():
    for distinct in (0, 1, 1000, 10**6, 10**9, 10**12, 10**20):
        blocks = simhash.code_blocks(distinct)
        assert sum(blocks) == 64 and all(b % 2 for b in blocks)


def test_simhash_odd_rows(make, odd):
    rows = simhash.near_groups(make(odd)).collect()
    assert len(rows) == len(odd)
    zero = {r.doc_id for r in rows if r.fingerprint == 0}
    assert {1, 2, 3, None} <= zero and {r.component_id for r in rows if r.fingerprint == 0} == {1}
    kept = simhash.drop_near_copies(make(odd))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == make(odd).columns and ids.count(5) == 2 and 7 not in ids and ids.count(None) == 2
    assert simhash.near_groups(make([])).collect() == []


def test_repeated_bytes(spark, sf_dir, texts):
    want = brute.without_repeats(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix_repeats(spark, sf_dir).collect()}
    assert got == want


def _cut(frame, **options):
    return [(r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.without_repeats(frame, **options).collect()]


@pytest.mark.parametrize("options", [{}, {"hot": 3, "rows_at_once": 2}, {"rows_at_once": 5}])
def test_repeated_bytes_in_hot_passages(make, options):
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    passage, line = noise(260), "ab " * 90
    rows = [(i, noise(int(rng.integers(0, 150))) + (passage if i % 2 else line) + noise(60) + ("é" * 70 if i % 5 == 0 else "")) for i in range(24)]
    want = brute.without_repeats(rows)
    for doc_id, size, spans, kept in _cut(make(rows), **options):
        assert (size, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) == want[doc_id]


def test_repeated_bytes_odd_rows(make, odd):
    got = _cut(make(odd))
    assert len(got) == len(odd)
    by_id = {}
    for doc_id, size, spans, kept in got:
        by_id.setdefault(doc_id, []).append((size, spans, kept))
    assert by_id[1] == [(0, [], b"")] and by_id[5] == [(len(PROSE), [], PROSE.encode())] * 2
    assert (len(PROSE), [(0, len(PROSE))], b"") in by_id[None]  # a null id comes last
    assert _cut(make([])) == []


def test_text_longer_than_a_piece(make, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 10)
    rng = np.random.default_rng(8)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 5000))
    rows = [(1, text), (2, "x" * 37 + text[1000:4200])]
    want = brute.without_repeats(rows)
    for doc_id, size, spans, kept in _cut(make(rows)):
        assert (size, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) == want[doc_id]


def test_suffix_order_is_the_order_of_bytes():
    data = np.random.default_rng(1).integers(97, 100, 4000).astype(np.uint8)
    place = np.arange(0, 3900, 3)
    sizes = np.full(len(place), len(place))
    order = suffixes.Suffixes(data, 100).order(place, np.zeros(len(place), np.int64), sizes)
    assert order.tolist() == sorted(range(len(place)), key=lambda k: bytes(data[place[k]:place[k] + 100]))


def test_a_lying_hash_is_found_out(monkeypatch, make):
    monkeypatch.setattr(suffixes.Suffixes, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    held = {"key": np.zeros(3, np.int64), "doc": np.arange(3), "tag": np.zeros(3, np.int64), "start": np.zeros(3, np.int64),
            "offset": np.zeros(3, np.int64), "count": np.ones(3, np.int64), "sizes": np.full(3, 100), "bytes": b"a" * 100 + b"b" * 100 + b"a" * 100}
    assert suffixes.later_strings(held, 100).tolist() == [False, False, True]


@pytest.fixture
def pages(spark):
    magic = "WARC/1.0\r\n"
    body = "x" * 120
    trap = f"<p>{magic}WARC-Type: response\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n{magic}{magic}</p>" * 40
    rows = [(5, "http://a/1", body), (3, "http://a/2", body), (9, "http://b\r\nContent-Length: 9", body), (4, "u", "short"), (6, "u", "short"),
            (1, None, None), (2, "u", ""), (7, "u", trap), (8, "u", trap), (10, "u", "W" + magic), (None, "u", body), (11, "u", "é\r\n\r\n" * 50),
            (3, "http://a/2", body)] + [(100 + i, "u", f"{i} " * 300) for i in range(60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)


def _expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(ids, default=None)
        revisit = len(body) >= 100 and first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("split, compression", [("128m", "none"), ("700", "none"), ("128m", "gzip")])
def test_archives_come_back(spark, pages, split, compression):
    rows, frame = pages
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = [tuple(r) for r in warc.round_trip(frame, compression).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got, key=str) == _expected(rows)


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
