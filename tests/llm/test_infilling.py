"""Fill-in-middle against a token-by-token version."""

from __future__ import annotations

import hashlib
import re

import pytest
from cinefold.llm import infilling
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _brute(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = [m[0] for m in UNIT.finditer(text)]
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    one, two, three, four = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or three % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = parts
    if four % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _rows(frame, **options):
    found = infilling.fill_in_middle(frame, **options)
    return found.select("row.doc_id", "row.text", "n", "form", F.char_length("prefix").alias("p"), F.char_length("middle").alias("m"), "output",
                        infilling.restored(F.col("output"), F.col("form")).alias("again")).collect()


@pytest.mark.parametrize("rate", [50, 100])
def test_odd_rows(make, odd, rate):
    marks = [(11, "a <P> b"), (12, "\x1f\u2003 \x0b x\u00a0y \n"), (13, "<S<S ><"), (14, "P> <M <"), (15, "  "), (16, "tail \n\n"), (17, "<M>")]
    frame = make(odd + marks + [(i, "le petit \U0001f600 mot  de  fin " * 3) for i in range(20, 60)])
    found = _rows(frame, rate=rate)
    assert len(found) == frame.count() and {r.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert (r.n, r.form, r.p, r.m, r.output) == _brute(r.doc_id, r.text, rate) and r.again == (r.text or "")
    assert infilling.fill_in_middle(frame).select("row.*").columns == frame.columns
    assert _rows(make([])) == []


def test_long_texts_are_matched_in_parts():
    for text in ("ab  cd\n" * 50, " " * 400, "x" * 400, "x" * 100 + " " * 100 + "y " * 100, "\n\n a b", ""):
        for part in (1, 7, 64, 1 << 20):
            assert infilling.unit_ends(text, part).tolist() == [m.end() for m in UNIT.finditer(text)]


def test_other_sentinels(make):
    marks = ("[.p]", "(s|", "{m}")
    frame = make([(i, f"one two three [.p four {i}") for i in range(30)])
    found = infilling.fill_in_middle(frame, rate=100, sentinels=marks)
    rows = found.select("row.text", "output", infilling.restored(F.col("output"), F.col("form"), marks).alias("again")).collect()
    assert all(r.again == r.text and all(mark in r.output for mark in marks) for r in rows)
