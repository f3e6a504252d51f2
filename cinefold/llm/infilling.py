"""Fill-in-middle: a text is cut at two unit borders and put together with its middle last.

A unit is a word with the white space before it, or white space at the end. One full match of ``(unit)*`` retains every
repetition of its group, so the group's ends tell the number of units and the offset of any of them; nothing is stepped through. Only
texts of more than ``PART`` characters are matched part by part (cut where a word ends, which is always a unit's end), as the
regular-expression library keeps some 200 bytes per repetition.

The draw is a hash of ``doc_id`` and the seed, so it is the same however rows are spread and in every run. Python sees the text and returns
three numbers; cutting and joining is done by DataFrame functions.

Defined cases: a null text is an empty one, which stays plain, and so does a text that holds a sentinel. A null ``doc_id`` is drawn by the
hash of the seed alone. Repeated rows get the same form. Without two borders prefix or middle are empty. Columns of any name are kept, in the
struct ``row``. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42
RATE, SPM_RATE = 50, 80  # percent of texts transformed, and of these with the suffix first
SENTINELS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
PART = 1 << 20

_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNITS = regex.compile(rf"({_SPACE}*+{_WORD}++|{_SPACE}++)*+")
CUT = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "first", "second")])
BORDER = re.compile(rf"(?<={_WORD})(?={_SPACE})")


def unit_ends(text: str, part: int = PART) -> np.ndarray:
    """The end of each unit, in code points."""
    ends, start = [np.zeros(0, np.int64)], 0
    while start < len(text):
        border = BORDER.search(text, start + part) if start + part < len(text) else None
        stop = border.end() if border else len(text)
        ends.append(np.array(UNITS.fullmatch(text, start, stop).ends(1), np.int64))
        start = stop
    return np.concatenate(ends)


@F.arrow_udf(CUT)
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Number of units and the ends of prefix and middle, for texts and two draws."""
    for texts, *draws in batches:
        rows = []
        for text, one, two in zip(texts, *(d.to_pylist() for d in draws)):
            ends = unit_ends(text.as_py() or "")
            first, second = sorted((one % (len(ends) + 1), two % (len(ends) + 1)))
            rows.append((len(ends), *(int(ends[k - 1]) if k else 0 for k in (first, second))))
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["n", "first", "second"])


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n`` units, ``form`` (plain, psm, spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``."""
    text = F.coalesce("text", F.lit(""))
    one, two, three, four = _draws(F.col("doc_id"), seed)
    holds = F.lit(False)
    for mark in sentinels:
        holds |= F.contains(text, F.lit(mark))
    form = (F.when((text == "") | holds | (three % 100 >= rate), "plain").when(four % 100 < spm_rate, "spm").otherwise("psm"))
    drawn = docs.select(F.struct("*").alias("row"), text.alias("text"), form.alias("form"), _cuts(text, one, two).alias("cut"))
    moved = F.col("form") != "plain"
    between = lambda start, stop: F.when(moved, F.expr(f"substring(text, cast({start} + 1 AS int), cast({stop} - {start} AS int))"))
    parts = drawn.select("row", F.col("cut.n").alias("n"), "form", "text", between("0", "cut.first").alias("prefix"),
                         between("cut.first", "cut.second").alias("middle"), between("cut.second", "length(text)").alias("suffix"))
    p, s, m = (F.lit(mark) for mark in sentinels)
    output = (F.when(~moved, F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
              .otherwise(F.concat(s, "suffix", p, "prefix", m, "middle")))
    return parts.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text again, from output and form alone."""
    found = F.split(output, "|".join(rf"\Q{mark}\E" for mark in sentinels), -1)
    joined = F.transform(F.array(found), lambda f: F.when(form == "psm", F.concat(f[1], f[3], f[2])).otherwise(F.concat(f[2], f[3], f[1])))
    return F.when(form == "plain", output).otherwise(joined[0])
