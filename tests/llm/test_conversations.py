"""Conversation repair against plain tuples and against every edit sequence."""

from __future__ import annotations

import hashlib
import itertools
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from cinefold.llm import conversations
from pyspark.sql import functions as F

sys.setrecursionlimit(20_000)
GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def _damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv_id, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv_id, turn, "user" if kind == 4 else role, text


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(initials, faults):
    """(cost, audit) by memoised recursion over rows, what has been written, and inserts in a row."""

    @lru_cache(None)
    def rest(i, state, inserts):
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        ways = [(0, "")] if i == len(initials) and state in ("", "a") else []
        then = lambda cost, letter, way: (cost + way[0], letter + way[1])
        if inserts < 3:
            ways += [then(2, "I", rest(i, c, inserts + 1)) for c in nexts if c != "s"]
        if i < len(initials):
            ways.append(then(3, "D", rest(i + 1, state, 0)))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                ways += [then(2 + more, "R", rest(i + 1, c, 0)) for c in nexts if c != "s"]
                ways += [then(more, "K", rest(i + 1, c, 0)) for c in nexts if c == initials[i]]
        return min(ways, default=(10 ** 9, ""))

    return rest(0, "", 0)


def _repaired(rows, audit):
    kept, left = sum(c != "D" for c in audit), iter(rows)
    pattern = ("s" if kept % 2 else "") + "ua" * (kept // 2)
    out, at = [], 0
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter != "D":
            role = row[2] if letter == "K" else {"u": "user", "a": "assistant"}[pattern[at]]
            out.append(f"{role}:{row[3] if row else ''}")
            at += 1
    assert next(left, None) is None and GOOD.fullmatch("".join(line[0] for line in out))
    return "\n".join(out)


def _brute(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for r in _damage(rows) if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, initials = _faults(own), [r[2][:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = _cheapest(tuple(initials), tuple(faults))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv_id] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                        faults.count("truncated"), illegal, cost, audit, hashlib.sha256(_repaired(own, audit).encode()).hexdigest())
    return out


def _got(frame, **options):
    rows = conversations.repair(conversations.damaged(frame), **options).collect()
    found = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def _table(seed, n, turns):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No?", "and then", "", " \t", "ok!", "x.y", "the end. \n", None, " ", "again."]
    roles = ["user", "assistant", "system", "tool", "", None, "unit", "user", "assistant"]
    return [(None if c == 3 else c, None if rng.random() < 0.05 else int(rng.integers(0, turns)) if c % 2 else t,
             roles[rng.integers(0, len(roles))] if c % 3 else ("user", "assistant")[t % 2], texts[rng.integers(0, len(texts))] if c % 4 else f"Turn {t}.")
            for c in range(n) for t in range(int(rng.integers(1, turns)))]


@pytest.mark.parametrize("chunk, parts", [(1024, 1), (2, 7), (5, 40)])
def test_odd_conversations(spark, chunk, parts):
    rows = _table(chunk, 24, 14)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("clash")).withColumn("task", F.lit(1)).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert _got(frame, chunk=chunk) == _brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_hot_conversation_over_many_chunks(spark):
    rows = [(c, t, r, x) for c, t, r, x in _table(9, 6, 8)] + [(77, t // 2, ("user", "assistant", "system")[t % 5 % 3], f"{t % 40}{'.?,'[t % 3]}") for t in range(300)]
    assert _got(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=16) == _brute(rows)


def test_small_bytes_and_empty_table(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], "long text. " * 50) for t in range(9)] + [(2, 1, "user", "x" * 100_000), (3, -2 ** 63, "user", "a."), (3, 2 ** 63 - 1, "assistant", "b.")]
    found = _got(spark.createDataFrame(rows, SCHEMA), chunk_bytes=300)
    want = _brute(rows)
    want[3] = (min(want[3][0], 2 ** 63 - 1), *want[3][1:])
    assert found == want
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_dropped_conversations_stay(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    found = _got(spark.createDataFrame([(c, 0, "user", "hi") for c in gone], SCHEMA))
    assert gone and found == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone}


def _every(initials, faults):
    """All edit sequences with at most two inserts between rows, by (cost, audit)."""
    n, best = len(initials), None
    for letters in itertools.product("DKR", repeat=n):
        for inserts in itertools.product(range(3), repeat=n + 1):
            audit = "".join("I" * k + c for k, c in zip(inserts, [*letters, ""]))
            kept = [i for i, c in enumerate(letters) if c != "D"]
            if any(faults[i] in ("blank", "duplicate") for i in kept):
                continue
            total = len(kept) + sum(inserts)
            pattern, at, good = ("s" if total % 2 else "") + "ua" * (total // 2), 0, total != 1
            row = 0
            for c in audit:
                if c == "D":
                    row += 1
                    continue
                good &= (pattern[at] == initials[row]) if c == "K" else pattern[at] != "s"
                row += c != "I"
                at += 1
            cost = 3 * letters.count("D") + 2 * letters.count("R") + 2 * sum(inserts) + sum(faults[i] == "truncated" for i in kept)
            if good and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_every_edit_sequence():
    for n in range(4):
        for initials in itertools.product("suat", repeat=n):
            for faults in itertools.product((None, "truncated", "blank"), repeat=n):
                weights, width = conversations.least_weights(list(zip(initials, faults)), conversations.ENDS)
                assert conversations.told(weights[0], width) == _cheapest(initials, faults)
                if faults.count("blank") == 0 or n < 3:
                    assert _every(initials, faults) == _cheapest(initials, faults)
