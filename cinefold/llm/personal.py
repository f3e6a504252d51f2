r"""Personal data: patterns with fixed rules, and identifiers that bootstrapped contexts discover.

Fixed rules find e-mail addresses, IP addresses, card and phone numbers (kinds in that order, leftmost and not overlapping per
kind). They are the seed entities. The one or two words before a seed are a lexical pattern of its kind; the patterns kept are those of at
least ``LEAST_SEEDS`` different seeds, whatever else the corpus holds. Candidates are the other words with a digit or an inner mark
(``jane(at)example``), and runs of digit groups of up to ``MOST_DIGITS`` digits. In the graph of patterns and instances, a pattern's confidence
is the score of its instances over all that stands behind it, ordinary words included; an instance's score is the chance that
one of its patterns is right (seeds: one). After ``ROUNDS`` rounds, candidates behind a pattern of ``CONFIDENCE`` or more are identifiers of
kind ``context``. The words before are counted in all texts, so a pattern that is a common word has no confidence. Tasks count only words whose checksum
is some pattern's (a table of ``SLOTS`` flags, whatever the number of patterns), and a join keeps the patterns themselves.

Defined cases: a null or empty text has no spans. Rows with the same ``doc_id`` and text share their findings and are all returned; a null
``doc_id`` is kept. A discovered span never overlaps one of the fixed rules. An empty table gives no rows. Places count code points, ends are
exclusive. Only ``doc_id`` and ``text`` are looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import slices
from cinefold.session import step_table

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"
LEAST_SEEDS = 5
ROUNDS = 4
CONFIDENCE = 0.8
MOST_DIGITS = 19
SLOTS = 1 << 22
AT_ONCE = 200_000  # counts that a task holds

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, so that a long run of digits is read once; a match that fails from its run's start fails from within too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
MARKED = re.compile(r"[0-9]+|(?<=[^\W_])[@_(\[{<](?=[^\W_])")
GROUP = re.compile(r"[0-9()+/-]*[0-9][0-9()+/-]*")
DIGITS = re.compile(r"[0-9]+")
EDGE = ".,;:!?\"'()[]{}<>"

SPAN = "struct<kind:string,start:int,end:int>"
SCAN = (f"doc_id long, tag long, spans array<{SPAN}>, seeds array<struct<kind:string,one:string,two:string,instance:string>>,"
        " candidates array<struct<one:string,two:string,instance:string,start:int,end:int>>")


def luhn(digits: str) -> bool:
    doubled = [d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2])]
    return (sum(doubled) + sum(map(int, digits[::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` from each @ outwards, which is linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (match := DOMAIN.match(text, at + 1)):
            yield start, match.end()
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed rules, kinds in order."""
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for match in CARD.finditer(text):
            digits = match[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", match.start(), match.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(len, DIGITS.findall(m[0]))) <= 15]
    return out


def before(text: str, at: int) -> tuple[str | None, str | None]:
    """The last word before ``at``, and the last two; lower-cased, as ``str.split`` cuts them."""
    reach = 64
    while True:
        low = max(0, at - reach)
        found = text[low:at].lower().split()
        if len(found) > 2 or low == 0:
            break
        reach *= 4
    return (found[-1] if found else None), (" ".join(found[-2:]) if len(found) > 1 else None)


def _word_end(text: str, at: int) -> int:
    while at < len(text) and not text[at].isspace():
        at += 1
    return at


def _inner(text: str, a: int, b: int) -> tuple[int, int]:
    """Without punctuation at the ends."""
    while a < b and text[a] in EDGE:
        a += 1
    while b > a and text[b - 1] in EDGE:
        b -= 1
    return a, b


def marked_words(text: str) -> Iterator[tuple[int, int, int]]:
    """Words that hold a digit or an inner mark, without punctuation at their ends, and where the run of digit groups that they begin ends."""
    end = 0
    for match in MARKED.finditer(text):
        if match.start() < end:
            continue
        start = match.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = _word_end(text, match.end())
        a, b = _inner(text, start, end)
        if b <= a:
            continue
        run = last = b
        if GROUP.fullmatch(text, start, end):
            stop, digits = end, sum(map(len, DIGITS.findall(text[a:b])))
            while digits <= MOST_DIGITS and text[stop:stop + 1] == " " and (group := GROUP.match(text, stop + 1)):
                whole = _word_end(text, group.end())
                if text[group.end():whole].strip(EDGE):
                    break
                digits += sum(map(len, DIGITS.findall(group[0])))
                run, last, stop = group.end(), whole, whole
                if whole > group.end():
                    break
            if digits > MOST_DIGITS:
                run = last = b
        yield a, b, _inner(text, a, run)[1]
        end = max(end, last)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    seed = pa.struct([(n, pa.string()) for n in ("kind", "one", "two", "instance")])
    candidate = pa.struct([*((n, pa.string()) for n in ("one", "two", "instance")), ("start", pa.int32()), ("end", pa.int32())])
    for batch in batches:
        for part in slices(batch, "text"):
            spans, seeds, candidates = [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                found = base_spans(text)
                taken = sorted((a, b) for _, a, b in found)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                one_two = [before(text, a) for _, a, _ in found]
                seeds.append([{"kind": k, "one": one, "two": two, "instance": text[a:b]} for (k, a, b), (one, two) in zip(found, one_two)])
                others, i = [], 0
                for a, b, run in marked_words(text):
                    while i < len(taken) and taken[i][1] <= a:
                        i += 1
                    free = taken[i][0] if i < len(taken) else len(text)
                    if free >= b:
                        one, two = before(text, a)
                        b = run if free >= run else b
                        others.append({"one": one, "two": two, "instance": text[a:b], "start": a, "end": b})
                candidates.append(others)
            yield pa.record_batch([part.column("doc_id"), part.column("tag"), pa.array(spans, pa.list_(span)),
                                   pa.array(seeds, pa.list_(seed)), pa.array(candidates, pa.list_(candidate))],
                                  names=["doc_id", "tag", "spans", "seeds", "candidates"])


def patterns(scanned: DataFrame, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """``kind`` and ``context`` of the lexical patterns that seeds induce."""
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.*")
    contexts = seeds.select("kind", "instance", F.explode(F.array("one", "two")).alias("context")).filter("context IS NOT NULL")
    counted = contexts.distinct().groupBy("kind", "context").agg(F.count("*").alias("seeds"))
    return counted.filter(F.col("seeds") >= least_seeds).select("kind", "context")


def _slot(context: str) -> int:
    return zlib.crc32(context.encode()) % SLOTS


def _occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each of ``contexts`` stands in all texts. The last word of a pattern of two words is a pattern too, so other pairs are not looked at."""
    wanted = contexts.select("context").distinct()
    # At most SLOTS / 32 rows, whatever the number of contexts.
    places = wanted.select((F.crc32(F.col("context").cast("binary")) % SLOTS).alias("slot")).groupBy(F.floor(F.col("slot") / 32).alias("row")).agg(
        F.bit_or(F.pow(F.lit(2.0), F.col("slot") % 32).cast("long")).alias("bits"))
    flags = np.zeros(SLOTS, np.uint8)
    for row, bits in places.collect():
        flags[row * 32:row * 32 + 32] = (bits >> np.arange(32)) & 1
    held = docs.sparkSession.sparkContext.broadcast(flags.tobytes())

    def counts(total: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["context", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = held.value
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [text.lower().split() for text in part.column("text").to_pylist() if text]
                single: Counter = Counter()
                for each in found:
                    single.update(each)
                known = {c: n for c, n in single.items() if told[_slot(c)]}
                total.update(known)
                double: Counter = Counter()
                for each in found:
                    double.update(pair for pair in zip(each, each[1:]) if pair[1] in known)
                total.update({c: n for (a, b), n in double.items() if told[_slot(c := f"{a} {b}")]})
                if len(total) > AT_ONCE:
                    yield counts(total)
                    total = Counter()
        yield counts(total)

    counted = docs.select("text").mapInArrow(count, "context string, n long").join(wanted, "context", "left_semi")
    return counted.groupBy("context").agg(F.sum("n").alias("times"))


def confidences(scanned: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Each pattern with its confidence after ``rounds`` rounds over the graph of patterns and instances."""
    known = step_table(patterns(scanned), "patterns")
    times = _occurrences(docs, known)
    rows = scanned.select(F.explode("seeds").alias("s")).select("s.kind", "s.instance", F.array("s.one", "s.two").alias("c")).unionByName(
        scanned.select(F.explode("candidates").alias("s")).select(F.lit(None).cast("string").alias("kind"), "s.instance", F.array("s.one", "s.two").alias("c")))
    placed = rows.select("kind", "instance", F.explode("c").alias("context"))
    # An edge counts its instance once; a seed of another kind is an instance that this pattern does not mean.
    edges = placed.join(known.withColumnRenamed("kind", "wanted"), "context").groupBy(F.col("wanted").alias("kind"), "context", "instance").agg(
        F.count("*").alias("n"), F.max(F.coalesce(F.col("kind") == F.col("wanted"), F.lit(False))).alias("seed"),
        F.max(F.col("kind").isNotNull() & (F.col("kind") != F.col("wanted"))).alias("foreign"))
    edges = step_table(edges, "pattern-edges")
    behind = edges.groupBy("kind", "context").agg(F.sum("n").alias("n"), F.count("*").alias("instances")).join(times, "context")
    behind = step_table(behind.select("kind", "context", (F.greatest(F.col("times") - F.col("n"), F.lit(0)) + F.col("instances")).alias("all")), "pattern-totals")
    score = edges.select("kind", "instance", F.col("seed").cast("double").alias("score")).groupBy("kind", "instance").agg(F.max("score").alias("score"))
    for _ in range(rounds):
        weighed = edges.join(score, ["kind", "instance"]).groupBy("kind", "context").agg(
            F.sum(F.when(F.col("foreign"), 0.0).otherwise(F.col("score"))).alias("good"))
        confidence = step_table(weighed.join(behind, ["kind", "context"]).select("kind", "context", (F.col("good") / F.col("all")).alias("confidence")), "pattern-confidence")
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12))))
        score = edges.join(confidence, ["kind", "context"]).groupBy("kind", "instance").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(doubt)).alias("score"))
    return confidence


def find(docs: DataFrame, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id``, ``base`` and ``discovered`` spans of each row. Wants ``doc_id`` and ``text``."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    scanned = step_table(texts.mapInArrow(_scan, SCAN), "personal-scan")
    sure = confidences(scanned, docs, rounds).filter(F.col("confidence") >= confidence).select("context").distinct()
    placed = scanned.select("doc_id", "tag", F.explode("candidates").alias("c")).select(
        "doc_id", "tag", "c.start", "c.end", F.explode(F.array("c.one", "c.two")).alias("context"))
    found = placed.join(sure, "context", "left_semi").groupBy("doc_id", "tag").agg(
        F.sort_array(F.collect_set(F.struct(F.lit(FOUND).alias("kind"), "start", "end"))).alias("discovered"))
    same = [F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("s.tag") == F.col("f.tag")]
    return scanned.alias("s").join(found.alias("f"), same, "left").select(
        "s.doc_id", F.col("spans").alias("base"), F.coalesce("discovered", F.array().cast(f"array<{SPAN}>")).alias("discovered"))
