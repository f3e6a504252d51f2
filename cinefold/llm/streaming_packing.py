"""Token ids packed online: a task keeps a fixed number of windows open.

Every document is encoded whole and ended by ``end_id``. It is placed as it comes: what is longer than a sequence gives full ones first; the rest
goes into the open window with the least room that still holds it. When none does, the fullest window is emitted: a gap of up to ``slack`` ids is
left to padding, a larger one is filled with the head of the piece in hand, so documents are cut only where padding would be noticed.

No task holds more than ``windows`` sequences and one slice of texts. What is open at a task's end is dealt to fewer tasks, each of
at most ``merge`` windows, and packed in the same way again, until one task is left; its last windows are put together and what is
then open is cut at powers of two, which need no padding. Documents are not shuffled, only these leftovers are.

Each row is a sequence: ``doc_ids``, ``starts`` (ids of the document before the piece), ``lengths``, ``doc_tokens``, ``cu_seqlens``, and
``input_ids`` (little-endian unsigned 32-bit, padded to ``length`` except at a power of two). ``sequence_id`` is made of round, task and number.

Defined cases: a null text is an empty one and has only the end id. A null ``doc_id`` stays null. Repeated rows are packed each time. The
tokenizer's special strings in a text are ordinary text. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import slices
from cinefold.session import step_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")  # a path that every node has
END_ID = PAD_ID = 1
LENGTH = 2048
WINDOWS = 32
SLACK = 16
MERGE = 8192
SLICE = 1 << 18  # bytes of text encoded at once
FLUSH = 512  # sequences written at once

#: Runs of text whose ids do not depend on what is around them: this vocabulary's pre-tokens never go on from a word to white space, nor from
#: letters to a mark. White space is Unicode's, so four control characters that Python adds to it count as word characters.
_LETTERS, _WORD, _SPACE = "A-Za-zÀ-ÖØ-öø-ɏ", r"[\S\x1c-\x1f]", r"[^\S\x1c-\x1f]"
UNIT = re.compile(rf" ?[{_LETTERS}]+(?=[\s!-/:-@\[-`{{-~]|\Z)|{_SPACE}*{_WORD}+|{_SPACE}+")
KNOWN = 900_000  # units whose ids a worker remembers, some 200 MB
SHORT = 64  # longer ones are not remembered
PLAIN = re.compile(rf" ?{_WORD}+")  # such units can be encoded together, with a line break, which is one id, between them
BREAK = "\n"

SCHEMA = ("sequence_id long, open boolean, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>,"
          " cu_seqlens array<int>, input_ids binary")


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary)
    made.encode_special_tokens = True
    return made


class Encoder:
    """Ids of whole texts. Units that come again, as most words do, are encoded once per worker."""

    def __init__(self, vocabulary: str):
        self.bpe, self.known = tokenizer(vocabulary), {}
        self.stop = self._ids(BREAK)[0]

    def _ids(self, text: str) -> list[int]:
        return self.bpe.encode(text, add_special_tokens=False).ids

    def _learn(self, units: set[str]) -> None:
        plain = [u for u in units if PLAIN.fullmatch(u)]
        ids = np.array(self._ids(BREAK.join(plain)) if plain else [], "<u4")
        ends = [*np.flatnonzero(ids == self.stop).tolist(), len(ids)]
        held, start = ids.tobytes(), 0
        for unit, end in zip(plain, ends):
            self.known[unit] = held[4 * start:4 * end]
            start = end + 1
        for unit in units.difference(plain):
            self.known[unit] = np.array(self._ids(unit), "<u4").tobytes()

    def __call__(self, texts: list[str], end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text and the end id."""
        if len(self.known) > KNOWN:
            self.known.clear()
        units = [UNIT.findall(text) for text in texts]
        new = set().union(*units).difference(self.known)
        long = {u: np.array(self._ids(u), "<u4").tobytes() for u in new if len(u) > SHORT}
        self._learn(new.difference(long))
        known, end = self.known, np.array([end_id], "<u4").tobytes()
        for own in units:
            yield np.frombuffer(b"".join([long[u] if u in long else known[u] for u in own] if long else map(known.__getitem__, own)) + end, "<u4")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class Windows:
    """The open windows of a task; a piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, length: int, windows: int, slack: int):
        self.length, self.windows, self.slack = length, windows, slack
        self.open: list[list] = []  # [room, pieces]

    def place(self, doc_id: int | None, start: int, total: int, ids: np.ndarray) -> Iterator[list]:
        """Put a piece somewhere; yields the windows that are thereby emitted."""
        whole = len(ids) - len(ids) % self.length if len(ids) >= self.length else 0
        for at in range(0, whole, self.length):
            yield [(doc_id, start + at, total, ids[at:at + self.length])]
        start, ids = start + whole, ids[whole:]
        while len(ids):
            fit = min((w for w in self.open if w[0] >= len(ids)), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.windows:
                self.open.append(fit := [self.length, []])
            if fit is not None:
                fit[0] -= len(ids)
                fit[1].append((doc_id, start, total, ids))
                if not fit[0]:
                    self.open.remove(fit)
                    yield fit[1]
                return
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if full[0] > self.slack:
                full[1].append((doc_id, start, total, ids[:full[0]]))
                start, ids = start + full[0], ids[full[0]:]
            yield full[1]

    def rest(self) -> Iterator[list]:
        """What is open, put together: full windows, then pieces cut at powers of two."""
        pieces = [piece for _, own in sorted(self.open, key=lambda w: w[0]) for piece in own]
        left = sum(len(piece[3]) for piece in pieces)
        while left:
            room = size = min(self.length, 1 << (left.bit_length() - 1))
            left -= size
            out = []
            while room:
                doc_id, start, total, ids = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc_id, start + room, total, ids[room:]))
                out.append((doc_id, start, total, ids[:room]))
                room -= len(out[-1][3])
            yield out


def _rows(made: list[list], first_id: int, is_open: bool, length: int, pad_id: int) -> pa.RecordBatch:
    pieces = [piece for own in made for piece in own]
    sizes = [[len(piece[3]) for piece in own] for own in made]
    sums = [sum(own) for own in sizes]
    ends = pa.array(np.cumsum([0, *map(len, made)]), pa.int32())
    listed = lambda values: pa.ListArray.from_arrays(ends, pa.array(values, pa.int64()))
    padded = [n if is_open or n & (n - 1) == 0 else length for n in sums]
    return pa.record_batch([
        pa.array(np.arange(first_id, first_id + len(made))), pa.array([is_open] * len(made), pa.bool_()), pa.array(sums, pa.int32()),
        listed([p[0] for p in pieces]), listed([p[1] for p in pieces]), listed([len(p[3]) for p in pieces]), listed([p[2] for p in pieces]),
        pa.array([np.cumsum([0, *own]).tolist() for own in sizes], pa.list_(pa.int32())),
        pa.array([np.concatenate([*(p[3] for p in own), np.full(to - n, pad_id, "<u4")]).astype("<u4").tobytes()
                  for own, n, to in zip(made, sums, padded)], pa.binary()),
    ], names=["sequence_id", "open", "n_tokens", "doc_ids", "starts", "lengths", "doc_tokens", "cu_seqlens", "input_ids"])


def _packer(pieces, length: int, windows: int, slack: int, pad_id: int, number: int, last: bool):
    """A task: places what ``pieces`` makes of its batches; at the end hands over what is open, or is the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made, next_id = Windows(length, windows, slack), [], number << 57 | TaskContext.get().partitionId() << 33

        def rows(is_open: bool = False) -> pa.RecordBatch:
            nonlocal made, next_id
            out = _rows(made, next_id, is_open, length, pad_id)
            next_id += len(made)
            made = []
            return out

        for batch in batches:
            for piece in pieces(batch):
                for sequence in held.place(*piece):
                    made.append(sequence)
                    if len(made) >= FLUSH:
                        yield rows()
        if last:
            made += held.rest()
        yield rows()
        if not last:
            made = [own for _, own in held.open]
            yield rows(True)

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, windows: int = WINDOWS, slack: int = SLACK, end_id: int = END_ID,
         pad_id: int = PAD_ID, merge: int = MERGE) -> DataFrame:
    """The packed sequences of ``docs`` (``doc_id`` and ``text``)."""
    if merge < 2 * windows:
        raise ValueError("merge must be at least twice the number of windows")

    def documents(batch: pa.RecordBatch) -> Iterator[tuple]:
        for part in slices(batch, "text", SLICE):
            texts = [text or "" for text in part.column("text").to_pylist()]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder(vocabulary)(texts, end_id)):
                yield doc_id, 0, len(ids), ids

    def leftovers(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row in batch.select(["doc_ids", "starts", "lengths", "doc_tokens", "input_ids"]).to_pylist():
            ids, at = np.frombuffer(row["input_ids"], "<u4"), 0
            for doc_id, start, n, total in zip(row["doc_ids"], row["starts"], row["lengths"], row["doc_tokens"]):
                yield doc_id, start, total, ids[at:at + n]
                at += n

    packed = step_table(docs.select("doc_id", "text").mapInArrow(_packer(documents, length, windows, slack, pad_id, 0, False), SCHEMA), "packed-0")
    done, number, last = packed.filter("NOT open"), 0, False
    while not last:
        left, number = packed.filter("open"), number + 1
        tasks = -(-left.count() // merge)
        last = tasks <= 1
        key = F.xxhash64("sequence_id")
        dealt = (left.coalesce(1) if last else left.repartition(tasks, key)).sortWithinPartitions("sequence_id")
        packed = step_table(dealt.mapInArrow(_packer(leftovers, length, windows, slack, pad_id, number, last), SCHEMA), f"packed-{number}")
        done = done.unionByName(packed.filter("NOT open"))
    return done.drop("open")


def segments(packed: DataFrame) -> DataFrame:
    """One row per piece: where it comes from, where it is, and its ids as ``input_ids``."""
    each = packed.select("sequence_id", "input_ids", F.explode(F.arrays_zip("doc_ids", "starts", "lengths", "doc_tokens", F.slice(
        "cu_seqlens", 1, F.size("doc_ids")).alias("offset"))).alias("piece"))
    ids = F.expr("substring(input_ids, 4 * piece.offset + 1, cast(4 * piece.lengths AS int))")
    return each.select(F.col("piece.doc_ids").alias("doc_id"), F.col("piece.starts").alias("start"), F.col("piece.lengths").alias("length"),
                       F.col("piece.doc_tokens").alias("doc_tokens"), "sequence_id", F.col("piece.offset").cast("long").alias("offset"),
                       ids.alias("input_ids"))
