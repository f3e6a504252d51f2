"""Repair of damaged conversations: the cheapest edits that give role initials ``(s?(ua)+)?``, decided by integers alone.

A row is kept (cost 0), given another role (2) or deleted (3, a must for blank and duplicate rows), and an empty row of user or assistant
can be inserted anywhere (2); a truncated row that stays adds 1. An edit sequence is weighed by one big integer: the high digits are its cost, below
are ``width`` digits, one per letter of its audit in order, with zeros behind its end. The least integer of a directed acyclic graph (row
by row, at each the states of the pattern, at most two inserts between rows) is thus the cheapest, and among equals the one whose audit is least in ASCII.

Rows are dealt by ranges of conversation and turn and ordered within, so a conversation of any size is spread over tasks. One that lies whole
within a task, in at most ``CHUNK`` rows and ``CHUNK_BYTES``, is repaired there as it streams by. Of the others (those at the ends of tasks, and long ones) each chunk of rows
gives the least integers from any state to any state; those are put together in order, per conversation. Equal costs with one audit at the beginning of
another do not exist (what follows would be inserts, which cost), so chunks can be decided alone. Their repaired text is then hashed by one reader per conversation
that holds a row and the audit, as a digest is sequential by nature.

Defined cases: null turns come first; a null role, text or key is one space. Rows of one turn go by role and text. A role is known by its first character; an
empty one fits nowhere. A null ``conv_id`` is a conversation like any other. A conversation without rows, or whose rows are all dropped, has zeros, an empty
audit and the digest of the empty string. Gaps are kept to 64 bits. An empty table gives no rows. Columns other than the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.session import step_table

CHUNK = 1024  # rows of one conversation that a task holds
CHUNK_BYTES = 16 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States of the pattern: nothing yet, behind s, behind u, behind a; where an initial leads; which role may come by itself.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")
STATES, ENDS = 4, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A letter's digit, in ASCII order; zero is no letter.
LETTERS = " DIKR"
DIGIT = {letter: digit for digit, letter in enumerate(LETTERS)}
BITS = 3

EMPTY = hashlib.sha256().hexdigest()
COUNTS = ("blank", "duplicate", "truncated", "illegal")
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
CHUNKS = ("conv_id long, task int, chunk long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string,"
          " first_turn long, last_turn long, turns long, costs array<long>, audits array<string>")
SPACES = " \t\n\x0b\x0c\r"


# --- One list of rows, each (initial, fault) ---------------------------------------------------------------------------------------------

def least_weights(rows: list[tuple[str, str | None]], ends: tuple[int, ...]) -> tuple[list[int | None], int]:
    """For each state before the rows, the least weight of edits that lead to one of ``ends``; and the number of digits in a weight."""
    width = 3 * len(rows) + 2
    unit, low = BITS * (width - 1), (1 << BITS * width) - 1

    def edge(cost: int, letter: str, then: int | None) -> int | None:
        """A letter in front: costs add up, the digits behind move on by one place."""
        if then is None:
            return None
        return ((then >> BITS * width) + cost << BITS * width) + (DIGIT[letter] << unit) + ((then & low) >> BITS)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(base: list[int | None]) -> list[int | None]:
        once = [least(base[q], edge(INSERT, "I", base[NEXT[q, WANTED[q]]])) for q in range(STATES)]
        return [least(base[q], edge(INSERT, "I", once[NEXT[q, WANTED[q]]])) for q in range(STATES)]

    weights = with_inserts([0 if q in ends else None for q in range(STATES)])
    for initial, fault in reversed(rows):
        base = []
        for q in range(STATES):
            edges = [edge(DELETE, "D", weights[q])]
            if fault not in ("blank", "duplicate"):
                more = TRUNCATED if fault else 0
                edges.append(edge(REROLE + more, "R", weights[NEXT[q, WANTED[q]]]))
                if (q, initial) in NEXT:
                    edges.append(edge(KEEP + more, "K", weights[NEXT[q, initial]]))
            base.append(least(*edges))
        weights = with_inserts(base)
    return weights, width


def told(weight: int, width: int) -> tuple[int, str]:
    """Cost and audit of a weight."""
    digits = (weight >> BITS * (width - 1 - k) & (1 << BITS) - 1 for k in range(width))
    return weight >> BITS * width, "".join(LETTERS[d] for d in digits if d)


def weighed(cost: int, audit: str, width: int) -> int:
    digits = 0
    for letter in audit:
        digits = digits << BITS | DIGIT[letter]
    return (cost << BITS * width) + (digits << BITS * (width - len(audit)))


def faults(rows: Iterator[tuple[str, str, bool]]) -> Iterator[str | None]:
    """The first fault of each (role, text, seen earlier)."""
    for _, text, seen in rows:
        bare = text.rstrip(SPACES)
        yield "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def bounded(n: int) -> int:
    return max(-1 << 63, min(n, (1 << 63) - 1))


def gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return bounded(max(known) - min(known) + 1 - len(set(known))) if known else 0


class Repaired:
    """The digest of the repaired rows, fed row by row along the audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.digest = audit, 0, 0, 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if not self.lines else chr(10)}{role}:{text}".encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            initial = WANTED[self.state]
            self._line(ROLES[initial], "")
            self.state, self.at = NEXT[self.state, initial], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter != "D":
            initial = role[:1] if letter == "K" else WANTED[self.state]
            self._line(role if letter == "K" else ROLES[initial], text)
            self.state = NEXT[self.state, initial]

    def hexdigest(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def repair_one(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The repaired columns but ``conv_id`` of a conversation's (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    again = []
    for _, role, text in rows:
        again.append((role, text) in seen)
        seen.add((role, text))
    found = list(faults((role, text, s) for (_, role, text), s in zip(rows, again)))
    initials = [role[:1] for _, role, _ in rows]
    weights, width = least_weights(list(zip(initials, found)), ENDS)
    cost, audit = told(weights[0], width)
    digest = Repaired(audit)
    for _, role, text in rows:
        digest.row(role, text)
    return (gaps([t for t, _, _ in rows]), *(found.count(f) for f in COUNTS[:3]), illegal_pairs(initials), cost, audit, digest.hexdigest())


# --- Over a table ------------------------------------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage. Dropped rows stay with ``absent`` set and without text, so that their conversation is known."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    copies = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), copies.alias("absent"))


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, rows as tuples) of rows that are in order, one conversation after another."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    return groupby(rows, key=lambda row: row[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 1, limit: int = 4096) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= limit:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def _weight_of_row(row: tuple) -> int:
    return 64 + len(row[-1] or "")


def scan(rows: DataFrame, chunk: int, chunk_bytes: int) -> DataFrame:
    """Repaired conversations that lie whole in a task, and the rows of all others (those with a ``task``), from ordered rows."""
    out = f"{REPAIRED}, task int, place long, turn long, role string, absent boolean, text string"
    schema = _schema(out)
    blank = (None,) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            held, first = None, True
            for conv_id, own in _by_conversation(batches):
                if held is not None:  # another conversation follows, so the one in hand ends here
                    yield (held[0], *repair_one([r[1:4] for r in held[1] if not r[4]]), *(None,) * 6)
                rows, n, place = [], 0, 0
                for row in own:
                    rows.append(row)
                    n += 64 + len(row[3])
                    if first or len(rows) > chunk or n > chunk_bytes or place:
                        for r in rows:
                            yield (conv_id, *blank, task, place, r[1], r[2], r[4], r[3])
                            place += 1
                        rows, n = [], 0
                held = (conv_id, rows) if rows else None
                first = False
            for place, r in enumerate(held[1] if held else []):
                yield (held[0], *blank, task, place, r[1], r[2], r[4], r[3])

        return _batches(made(), schema, _weight_of_row, 1 << 20)

    return rows.mapInArrow(run, out)


def chunks(rows: DataFrame) -> DataFrame:
    """Counts and least weights from any state to any state, for each chunk of rows in order of ``conv_id, task, chunk, place``."""
    schema = _schema(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            every = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
            for (conv_id, task, chunk), own in groupby(every, key=lambda row: row[:3]):
                own = [row[4:] for row in own]  # turn, initial, fault
                initials = [initial for _, initial, _ in own]
                costs, audits = [None] * STATES ** 2, [None] * STATES ** 2
                for end in range(STATES):
                    weights, width = least_weights([(initial, fault) for _, initial, fault in own], (end,))
                    for start, weight in enumerate(weights):
                        if weight is not None:
                            costs[STATES * start + end], audits[STATES * start + end] = told(weight, width)
                turns = [t for t, _, _ in own if t is not None]
                counts = [sum(f == kind for _, _, f in own) for kind in COUNTS[:3]]
                yield (conv_id, task, chunk, len(own), *counts, illegal_pairs(initials), initials[0], initials[-1], turns[0] if turns else None,
                       turns[-1] if turns else None, len(set(turns)), costs, audits)

        return _batches(made(), schema, lambda row: sum(len(a or "") for a in row[-1]) + 500, 1 << 20)

    return rows.mapInArrow(run, CHUNKS)


def joined(parts: Iterator[tuple]) -> tuple:
    """The repaired columns but digest of a conversation, from its chunks (as in ``CHUNKS``, from ``n`` on) in order."""
    best: list[tuple[int, str] | None] = [(0, "")] + [None] * (STATES - 1)
    totals, last, low, high, distinct = [0] * 4, None, None, None, 0
    for _, *counts, first, after, first_turn, last_turn, turns, costs, audits in parts:
        totals = [a + b for a, b in zip(totals, counts)]
        totals[3] += last is not None and illegal_pairs([last, first])
        last = after
        if first_turn is not None:
            distinct += turns - (first_turn == high)
            low, high = first_turn if low is None else low, last_turn
        ways = [[(best[q][0] + costs[k], best[q][1] + audits[k]) for q in range(STATES)
                 if best[q] is not None and costs[k := STATES * q + end] is not None] for end in range(STATES)]
        width = max((len(audit) for way in ways for _, audit in way), default=0)
        best = [min(way, key=lambda w: weighed(*w, width)) if len(way) > 1 else way[0] if way else None for way in ways]
    width = max(len(best[q][1]) for q in ENDS if best[q])
    cost, audit = min((best[q] for q in ENDS if best[q]), key=lambda w: weighed(*w, width))
    return (bounded(high - low + 1 - distinct) if high is not None else 0, *totals, cost, audit)


def repair(rows: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, absent``); absent rows only make their conversation known."""
    keys = ["conv_id", "turn", "role", "text", "tie"]
    placed = rows.select("*", F.monotonically_increasing_id().alias("tie"))  # equal rows can be told apart, so their group can be cut
    ordered = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    scanned = step_table(scan(ordered, chunk, chunk_bytes), "conversations")
    done = scanned.filter("task IS NULL").select(*(f.split()[0] for f in REPAIRED.split(", ")))
    cut = scanned.filter("task IS NOT NULL").select("conv_id", "task", "place", "turn", "role", "text", "absent")

    # Which rows repeat an earlier one: the first place of each role and text, counted before rows meet.
    spot = F.struct("task", "place")
    first = cut.filter("NOT absent").groupBy("conv_id", "role", F.sha2("text", 256).alias("digest")).agg(F.min(spot).alias("spot"))
    first = first.select(F.col("conv_id").alias("c"), F.col("spot.task").alias("t"), F.col("spot.place").alias("p"))
    own = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t")) & (F.col("place") == F.col("p"))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    fault = (F.when(bare == "", "blank").when(F.col("t").isNull(), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated"))
    flagged = cut.filter("NOT absent").join(first, own, "left").select(
        "conv_id", "task", F.floor(F.col("place") / chunk).alias("chunk"), "place", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    dealt = flagged.repartition("conv_id", "task", "chunk").sortWithinPartitions("conv_id", "task", "chunk", "place")
    parts = chunks(dealt)

    audits_out = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = _schema(audits_out)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(((conv_id, *joined(row[3:] for row in own)) for conv_id, own in _by_conversation(batches)), schema,
                        lambda row: 64 + len(row[-1]), 1 << 20)

    audits = parts.repartition("conv_id").sortWithinPartitions("conv_id", "task", "chunk").mapInArrow(fold, audits_out)

    # Each conversation's audit comes before its rows.
    head = audits.selectExpr("conv_id", "-1 AS task", "0L AS place", "gaps", *COUNTS, "cost", "audit", "CAST(NULL AS string) AS role", "CAST(NULL AS string) AS text",
                             "false AS absent")
    zero = [F.lit(None).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    tail = cut.select("conv_id", "task", "place", *zero, F.lit(None).cast("string").alias("audit"), "role", "text", "absent")
    read = head.unionByName(tail).repartition("conv_id").sortWithinPartitions("conv_id", "task", "place")
    result = _schema(REPAIRED)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv_id, own in _by_conversation(batches):
                values, digest = (0,) * 6 + ("",), Repaired("")
                for row in own:
                    if row[1] < 0:
                        values, digest = row[3:10], Repaired(row[9])
                    elif not row[12]:
                        digest.row(row[10], row[11])
                yield (conv_id, *values, digest.hexdigest())

        return _batches(made(), result)

    return done.unionByName(read.mapInArrow(digests, REPAIRED))
