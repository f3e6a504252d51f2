"""Online packing: an exact round trip, bounded windows, little padding."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cinefold.llm import queries, streaming_packing
from cinefold.llm.streaming_packing import LENGTH, VOCABULARY, Windows
from pyspark.sql import functions as F
from tokenizers import Tokenizer


BPE = Tokenizer.from_file(VOCABULARY)
BPE.encode_special_tokens = True


def _ids(text):
    return [*BPE.encode(text or "", add_special_tokens=False).ids, 1]


def _check(pieces, want, length=LENGTH):
    """Each document's pieces (as rows of a dict) hold its ids once; sequences have no gaps. Returns the share of padding."""
    rows, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        rows[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(rows) == set(want)
    for doc_id, own in rows.items():
        at = 0
        for start, n, crc, total in sorted(own):
            assert start == at and total == len(want[doc_id])
            assert crc == zlib.crc32(np.array(want[doc_id][start:start + n], "<u4").tobytes())
            at += n
        assert at == len(want[doc_id])
    padding = total = 0
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padding / max(total, 1)


def test_table_round_trip(spark, sf_dir, texts):
    pieces = queries.op13_streaming_packing(spark, sf_dir).collect()
    assert _check(pieces, {d: _ids(t) for d, t in texts}) < 0.01


@pytest.mark.parametrize("merge", [4, 8192])
def test_many_tasks_and_rounds(make, merge):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["boat", "mill", "x1", "été"], int(rng.integers(0, 90))))) for i in range(300)]
    packed = streaming_packing.pack(make(rows).repartition(24), length=64, windows=2, slack=2, merge=merge)
    found = streaming_packing.segments(packed).select("*", F.crc32("input_ids").alias("ids_crc32")).collect()
    assert _check(found, {d: _ids(t) for d, t in rows}, 64) < 0.05
    for r in packed.collect():
        n = r.n_tokens
        assert len(r.input_ids) == 4 * (n if n & (n - 1) == 0 else 64) and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == n


def test_odd_rows(make, odd):
    packed = streaming_packing.pack(make(odd), length=50)
    seen, want = Counter(), Counter()
    for p in streaming_packing.segments(packed).collect():
        seen[p.doc_id] += p.length
        assert len(p.input_ids) == 4 * p.length
    for d, t in odd:
        want[d] += len(_ids(t))
    assert seen == want and streaming_packing.pack(make([])).collect() == []


def test_best_fit_and_bound():
    """Against a plain list of windows: the least room that fits, else a new one, else the fullest goes."""
    rng = np.random.default_rng(1)
    held, rooms, emitted, want = Windows(100, 3, 100), [], [], []
    for i in range(400):
        n = int(rng.integers(1, 101))
        emitted += [sum(len(p[3]) for p in own) for own in held.place(i, 0, n, np.zeros(n, "<u4"))]
        if n == 100:
            want.append(100)
            continue
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        elif len(rooms) < 3:
            rooms.append(100 - n)
        else:
            want.append(100 - min(rooms))
            rooms.remove(min(rooms))
            rooms.append(100 - n)
        want += [100] * rooms.count(0)
        rooms = [r for r in rooms if r]
        assert sorted(w[0] for w in held.open) == sorted(rooms) and len(held.open) <= 3
    assert emitted == want


SIGNS = ["a", "B", "é", "ß", "ɏ", "ʒ", "я", "中", "1", "²", "Ⅷ", "'", "'s", "'ll", ".", "!", "_", "-", "÷", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85",
         "\xa0", "\u2003", "\u3000", "\u200b", "\u0301", "\U0001f600", "<|endoftext|>", " the", " and", "x" * 70]


@pytest.mark.parametrize("known", [20, 900_000])
def test_ids_are_those_of_the_whole_text(monkeypatch, texts, known):
    monkeypatch.setattr(streaming_packing, "KNOWN", known)
    rng = np.random.default_rng(3)
    mixed = ["".join(rng.choice(SIGNS, int(rng.integers(1, 30)))) for _ in range(3000)] + [t or "" for _, t in texts[:60]] + ["", "y" * 5000]
    own = streaming_packing.Encoder(VOCABULARY)
    for i in range(0, len(mixed), 200):
        part = mixed[i:i + 200]
        assert [ids.tolist() for ids in own(part, 1)] == [_ids(t) for t in part]
    list(own(["a b"], 1))
    assert len(own.known) == 2 if known == 20 else len(own.known) > 1000
