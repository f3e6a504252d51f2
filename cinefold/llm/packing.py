"""Token ids packed into rows of one length: best fit decreasing, found by a segment tree.

Each document is encoded whole and ended by one separator id. Documents longer than a row
are cut into pieces, without loss: ``doc_ids`` and ``starts`` tell for each segment which
document it is from and at which of its tokens it begins. Pieces are dealt by a hash,
and each task packs them in runs of bounded size, largest piece first, each into the open
row with the least room that still holds it.

Every packed row has ``input_ids`` (the ids of the row, little endian, ``width`` bytes each,
filled up with ``pad_id``), ``position_ids`` (int32, from zero again at each segment) and ``cu_seqlens`` (cumulative
segment lengths, from zero to ``n_tokens``).

Defined cases: a null or empty text has no tokens and no segment. A null ``doc_id`` stays
null in ``doc_ids``. Repeated rows and ties are packed as often as they come. An empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a path that every node has
# Fixed value: how this public vocabulary cuts text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEPARATOR = 50256  # free in this vocabulary
ROW_TOKENS = 2048
RUN_TOKENS = 1 << 21  # tokens that a task packs at once

PIECE_SCHEMA = "doc_id long, start int, length int, ids binary, deal long"
PACKED_SCHEMA = ("shard int, pack long, n_tokens int, n_segments int, doc_ids array<long>, starts array<int>,"
                 " cu_seqlens array<int>, input_ids binary, position_ids binary")


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("packing", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length. Longest first (ties: in the order given), each into the fullest bin with room.

    The tree's leaves are the room a bin can have left; a node says whether any open bin is
    below it. The least sufficient room is found by going up from the leaf until there is
    something to the right, then down.
    """
    size = 1 << capacity.bit_length()
    alive = bytearray(2 * size)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(lengths), np.int64), 0

    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        node = need + size
        if not alive[node]:
            while node > 1 and (node & 1 or not alive[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < size:
                    node = 2 * node if alive[2 * node] else 2 * node + 1
        if node > 1:
            room = node - size
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                alive[node] = 0
                while node > 1 and not alive[node ^ 1]:
                    node >>= 1
                    alive[node] = 0
        else:
            room, chosen = capacity, made
            made += 1
        left = room - need
        if left:
            open_bins[left].append(chosen)
            node = left + size
            while node and not alive[node]:
                alive[node] = 1
                node >>= 1
        out[item] = chosen
    return out


def pieces(docs: DataFrame, vocabulary: str, separator: int, row_tokens: int) -> DataFrame:
    """Each document's ids, cut into pieces of at most ``row_tokens``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        kind = np.uint16 if max(bpe.max_token_value, separator) < 1 << 16 else np.uint32
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[], [], [], [], []]
                for doc_id, text, deal in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "deal"))):
                    ids = np.append(bpe.encode_to_numpy(text, disallowed_special=()), separator).astype(kind)
                    for start in range(0, len(ids), row_tokens):
                        piece = ids[start:start + row_tokens]
                        for column, value in zip(out, (doc_id, start, len(piece), piece.tobytes(), deal ^ start)):
                            column.append(value)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))],
                                      names=["doc_id", "start", "length", "ids", "deal"])

    kept = docs.filter(F.length("text") > 0)
    return kept.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("deal")).mapInArrow(encode, PIECE_SCHEMA)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, separator: int = SEPARATOR, pad_id: int = SEPARATOR,
         row_tokens: int = ROW_TOKENS, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """One row per packed row of ids. Wants ``doc_id`` and ``text``."""

    def rows(held: list[tuple], shard: int, first: int) -> pa.RecordBatch:
        lengths = np.array([h[2] for h in held])
        bins = best_fit_decreasing(lengths, row_tokens)
        order = np.lexsort((-lengths, bins))
        width = len(held[0][3]) // held[0][2]
        kind = np.dtype(f"<u{width}")
        n = int(bins.max()) + 1
        count = np.bincount(bins, minlength=n)
        ends = np.cumsum(count)
        # The place of each segment within its row, and of each of its ids within the matrix.
        sizes = lengths[order]
        before = np.cumsum(sizes) - sizes
        row_start = before[ends - count]
        offset = before - np.repeat(row_start, count)
        positions = np.arange(sizes.sum()) - np.repeat(before, sizes)
        place = np.repeat(bins[order] * row_tokens + offset, sizes) + positions
        ids, reset = np.full(n * row_tokens, pad_id, kind), np.zeros(n * row_tokens, np.int32)
        ids[place] = np.frombuffer(b"".join(held[i][3] for i in order), kind)
        reset[place] = positions
        bounds = pa.array(np.concatenate([[0], ends]), pa.int32())
        cut_at = np.concatenate([[0], np.cumsum(count + 1)])
        cuts = np.zeros(cut_at[-1], np.int32)
        cuts[np.arange(len(order)) + bins[order] + 1] = offset + sizes
        filled = np.add.reduceat(sizes, ends - count)

        def matrix(values: np.ndarray) -> pa.Array:
            step = values.itemsize * row_tokens
            starts = np.arange(0, (n + 1) * step, step, dtype=np.int32)
            return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(starts), pa.py_buffer(values)])

        return pa.record_batch([
            pa.array(np.full(n, shard), pa.int32()), pa.array(np.arange(first, first + n), pa.int64()),
            pa.array(filled, pa.int32()), pa.array(count, pa.int32()),
            pa.ListArray.from_arrays(bounds, pa.array([held[i][0] for i in order], pa.int64())),
            pa.ListArray.from_arrays(bounds, pa.array([held[i][1] for i in order], pa.int32())),
            pa.ListArray.from_arrays(pa.array(cut_at, pa.int32()), pa.array(cuts, pa.int32())),
            matrix(ids), matrix(reset),
        ], names=["shard", "pack", "n_tokens", "n_segments", "doc_ids", "starts", "cu_seqlens", "input_ids", "position_ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, made, shard = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids"))):
                if held and tokens + row[2] > run_tokens:
                    out = rows(held, shard, made)
                    made += out.num_rows
                    held, tokens = [], 0
                    yield out
                held.append(row)
                tokens += row[2]
        if held:
            yield rows(held, shard, made)

    cut = pieces(docs, vocabulary, separator, row_tokens)
    dealt = cut.repartition("deal").sortWithinPartitions("deal", "doc_id", "start", "length")
    return dealt.drop("deal").mapInArrow(run, PACKED_SCHEMA)


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """Back to segments: ``doc_id``, ``start`` and the ids as an array, one row per segment."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            for docs, starts, cuts, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "starts", "cu_seqlens", "input_ids"))):
                row = np.frombuffer(ids, kind)
                yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(starts, pa.int32()),
                                       pa.array([row[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32()))],
                                      names=["doc_id", "start", "ids"])

    return packed.select("doc_ids", "starts", "cu_seqlens", "input_ids").mapInArrow(split, "doc_id long, start int, ids array<int>")


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: each file holds id matrices with their segment lengths and positions."""
    packed.write.parquet(path)
