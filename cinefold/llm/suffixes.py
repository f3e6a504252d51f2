"""Removal of byte strings of ``LENGTH`` that stand earlier too, by a hash-compared suffix sort.

Any two equal strings of ``LENGTH`` bytes have their least gram (by a hash) at the same offset, so only strings whose least
gram comes twice can be equal. A first pass finds those grams: one row per run of strings with the same least gram, about one per forty bytes. The second
brings the bytes around them together by gram, and sorts their suffixes: a mergesort per gram and offset, whose comparisons find the longest
common extension by binary search over prefix polynomial hashes, so each takes a logarithmic number of steps. Equal neighbours in the
order are verified byte by byte; should a hash have lied, that part is sorted by its bytes. Of equal strings all but the earliest are removed.

Texts that equal an earlier one are known from their digest: they are wholly removed if ``LENGTH`` long, and not searched. Grams with more than ``HOT`` runs
(a passage in very many documents) are dealt by whole strings instead, and equal strings are thinned out in the task that reads the text before they are sent.
All passes read the same shuffled texts.

Defined cases: a null or empty text has no bytes and nothing is removed. Rows that are equal in ``doc_id`` and text are one document and get the same answer;
rows that share only the ``doc_id`` are not earlier than one another. A null ``doc_id`` comes after all others; rows without one
are told apart by their texts. An empty table gives no rows. Only ``doc_id`` and ``text`` are looked at. Texts with the same ``doc_id`` are told apart by a 32-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import slices

LENGTH = 100
GRAM = 24
HOT = 8192  # runs of one gram that a task brings together
ROWS_AT_ONCE = 6000  # contexts that a task sorts at once; more only within one gram
LAST = (1 << 63) - 1  # stands for a null doc_id
POSITION_BITS = 24  # of a place within the text handled at once
CHUNK = 1 << 20  # bytes of text handled at once
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; places near the end see zeros."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for s in range(8):
        part = padded[s:s + (len(padded) - s) // 8 * 8].view("<u8")
        target = out[s::8]
        target[:] = part[:len(target)]
    return out[:len(data)]


def _least_grams(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram at each place, and for each string of ``length`` the place of its least gram (the first, if equal)."""
    eights = _eights(data)
    n = len(data) - gram + 1
    hashed = np.zeros(n, np.uint64)
    for k in [*range(0, gram - 8, 8), gram - 8]:
        hashed = _mixed(hashed + eights[k:k + n])
    # The place in the low bits makes the first of equal grams the least.
    places = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashed & ~places) | np.arange(n, dtype=np.uint64)
    span, width = 1, length - gram + 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    return hashed, (least & places).astype(np.int64)


def _runs(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of strings with one least gram, over (row, place in the text, bytes): row, the gram's hash, the first string's place, the gram's offset in it, the number of strings."""
    sizes = np.array([len(p[2]) for p in pieces])
    ends = np.cumsum(sizes)
    hashed, least = _least_grams(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8), length, gram)
    whole = np.flatnonzero(np.arange(len(least)) + length <= np.repeat(ends, sizes)[:len(least)])
    least = least[whole]
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    first, gram_at = whole[start], least[start]
    piece = np.searchsorted(ends, first, "right")
    place = first - (ends - sizes)[piece] + np.array([p[1] for p in pieces])[piece]
    count = np.diff(np.concatenate([start, [len(least)]]))
    return np.array([p[0] for p in pieces])[piece], hashed[gram_at], place, gram_at - first, count


def _gram_rows(length: int, gram: int):
    def pieces(bodies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        for i, body in enumerate(bodies):
            # Long texts in pieces that overlap by one string less a byte; a run cut in two is two runs.
            for base in range(0, len(body) - length + 1, CHUNK):
                yield i, base, body[base:base + CHUNK + length - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", CHUNK):
                held: list[tuple[int, int, bytes]] = []
                for piece in [*pieces(part.column("body").to_pylist()), None]:
                    if held and (piece is None or sum(len(p[2]) for p in held[-1:]) >= CHUNK):
                        row, hashed, place, offset, count = _runs(held, length, gram)
                        yield pa.record_batch([
                            pa.array(hashed.view(np.int64)), part.column("doc").take(pa.array(row)), part.column("tag").take(pa.array(row)),
                            pa.array(place << 16 | offset << 8 | count)], names=["gram", "doc", "tag", "packed"])
                        held = []
                    if piece is not None:
                        held.append(piece)
    return run


def _repeated(hot: int):
    """Of rows in order of their gram, those whose gram comes twice; ``hot`` ones are told."""

    def told(rows: pa.Table, is_hot: np.ndarray) -> list[pa.RecordBatch]:
        return rows.append_column("hot", pa.array(is_hot)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, burning = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            grams = rows["gram"].to_numpy()
            start = np.concatenate([[0], np.flatnonzero(grams[1:] != grams[:-1]) + 1])
            size = np.diff(np.concatenate([start, [len(grams)]]))
            own = grams == burning if burning is not None else np.zeros(len(grams), bool)
            keep = np.repeat(size > 1, size) | own
            if size[-1] > hot or own[-1]:
                # All there is of this gram goes on at once, and so does what follows of it.
                burning, held, last = grams[-1], None, len(grams)
                own = own | (grams == burning)
            else:
                last = int(start[-1])
                held = rows.slice(last)
            if keep[:last].any():
                yield from told(rows.slice(0, last).filter(pa.array(keep[:last])), own[:last][keep[:last]])
        if held is not None and held.num_rows > 1:
            yield from told(held, np.zeros(held.num_rows, bool))

    return run


CONTEXT = "key long, doc long, tag int, start long, offset int, count int, bytes binary"


def _contexts(length: int):
    """The bytes of each repeated run. Equal contexts within a task's slice go once; the later ones are told as removed (no bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", CHUNK):
                out: list[list] = [[] for _ in range(7)]
                seen: dict[tuple, tuple] = {}

                def send(*row, out=out):
                    for column, value in zip(out, row):
                        column.append(value)

                columns = (part.column(c).to_pylist() for c in ("doc", "tag", "body", "found"))
                for doc, tag, body, found in sorted(zip(*columns), key=lambda r: (r[0], r[1])):
                    for run in sorted(found, key=lambda r: r["packed"]):
                        start, offset, count = run["packed"] >> 16, run["packed"] >> 8 & 255, run["packed"] & 255
                        strings = [(start, offset, count)] if not run["hot"] else [(start + k, 0, 1) for k in range(count)]
                        for at, shift, n in strings:
                            held = body[at:at + n - 1 + length]
                            first = seen.setdefault((held, shift), (doc, tag, at))
                            if first[0] < doc or first[:2] == (doc, tag) and first[2] < at:
                                send(hash((doc, at)), doc, tag, at, 0, n, None)
                                continue
                            key = run["gram"] if not run["hot"] else int.from_bytes(hashlib.blake2b(held, digest_size=8).digest(), "little", signed=True)
                            send(key, doc, tag, at, shift, n, held)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)],
                                      names=["key", "doc", "tag", "start", "offset", "count", "bytes"])
    return run


@lru_cache(maxsize=1)
def _powers(bits: int) -> np.ndarray:
    out = np.full(1 << bits, BASE)
    out[0] = 1
    return np.multiply.accumulate(out)


class Suffixes:
    """Strings of ``length`` bytes in a text, compared by prefix polynomial hashes modulo 2**64."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.power = _powers(max(16, int(len(data) + 1).bit_length()))
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:len(data)], out=self.prefix[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, n) -> np.ndarray:
        """Whether the hashes of ``n`` bytes from ``a`` and from ``b`` agree."""
        one = (self.prefix[a + n] - self.prefix[a]) * self.power[b]
        return one == (self.prefix[b + n] - self.prefix[b]) * self.power[a]

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the order of the strings at ``a`` and ``b``."""
        out = np.zeros(len(a), np.int8)
        other = np.flatnonzero(~self.equal(a, b, self.length))
        a, b = a[other], b[other]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length)
        while len(a) and (high - low > 1).any():
            middle = (low + high) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        out[other] = np.where(self.data[a + low] < self.data[b + low], -1, 1)
        return out

    def order(self, place: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Mergesort, stable, of each segment of ``place`` (``start`` and ``size`` of the element's segment): the new order of indexes."""
        out = np.arange(len(place))
        local, run, longest = out - start, 1, int(size.max(initial=0))
        while run < longest:
            live = np.flatnonzero(size > run)
            at = local[live]
            mine = at // run
            sibling = mine ^ 1
            length = np.clip(size[live] - sibling * run, 0, run)
            live, at, mine, sibling, length = (x[length > 0] for x in (live, at, mine, sibling, length))
            first = start[live] + sibling * run
            own, left = place[out[live]], mine & 1 == 0
            low, high = np.zeros(len(live), np.int64), length.copy()
            while True:
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                middle = (low[todo] + high[todo]) // 2
                found = self.compare(place[out[first[todo] + middle]], own[todo])
                # Equal strings keep their order: those of the left run come first.
                before = (found < 0) | (found == 0) & ~left[todo]
                low[todo] = np.where(before, middle + 1, low[todo])
                high[todo] = np.where(before, high[todo], middle)
            target = start[live] + (mine & ~1) * run + at % run + low
            moved = out.copy()
            moved[target] = out[live]
            out = moved
            run *= 2
        return out

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the strings at ``a`` are those at ``b``, byte by byte."""
        eights = _eights(self.data)
        return all((eights[a + k] == eights[b + k]).all() for k in [*range(0, self.length - 8, 8), self.length - 8])


def later_strings(held: dict, length: int) -> np.ndarray:
    """For contexts in order of key, doc, tag and start: which of their strings stand earlier too (flat, a context's strings in a row)."""
    count, size = held["count"], held["sizes"]
    data = np.frombuffer(held["bytes"], np.uint8)
    at = np.cumsum(size) - size
    row = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place, offset = at[row] + within, held["offset"][row] - within
    group = np.cumsum(np.concatenate([[0], held["key"][1:] != held["key"][:-1]]))[row]
    # Only strings with their gram at the same offset can be equal.
    by = np.argsort(group * 512 + offset + 256, kind="stable")
    place, row, segment, begin = place[by], row[by], (group * 512 + offset)[by], (held["start"][row] + within)[by]
    start = np.concatenate([[0], np.flatnonzero(segment[1:] != segment[:-1]) + 1])
    sizes = np.diff(np.concatenate([start, [len(segment)]]))
    suffixes = Suffixes(data, length)
    order = suffixes.order(place, np.repeat(start, sizes), np.repeat(sizes, sizes))

    def follows(order: np.ndarray, equal) -> np.ndarray:
        a, b = place[order[:-1]], place[order[1:]]
        return np.concatenate([[False], (segment[order[:-1]] == segment[order[1:]]) & equal(a, b)])

    same = follows(order, lambda a, b: suffixes.equal(a, b, length))
    pair = np.flatnonzero(same)
    if not suffixes.same_bytes(place[order[pair - 1]], place[order[pair]]):
        text = bytes(data)
        strings = [text[p:p + length] for p in place.tolist()]
        order = np.array(sorted(range(len(place)), key=lambda k: (segment[k], strings[k], k)))
        same = follows(order, lambda a, b: np.array([text[x:x + length] == text[y:y + length] for x, y in zip(a.tolist(), b.tolist())], bool))
    doc, tag, begin = held["doc"][row[order]], held["tag"][row[order]], begin[order]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    again = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])])
    own_first = np.maximum.accumulate(np.where(again, 0, np.arange(len(same))))
    later = same & ((doc > doc[first]) | (begin > begin[own_first]))
    out = np.zeros(len(later), bool)
    out[by[order]] = later
    return out


def _removed(length: int, rows_at_once: int, hot: int):
    """Spans of strings that stand earlier too. Rows come in order of key, doc, tag and start."""
    names = ["key", "doc", "tag", "start", "offset", "count"]

    def judge(rows: pa.Table, known: int) -> tuple[pa.RecordBatch, np.ndarray]:
        """Spans of all rows but the first ``known``; and which strings are later ones."""
        held = {c: rows[c].to_numpy().astype(np.int64) for c in names}
        values = rows["bytes"].combine_chunks()
        values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        held["sizes"] = pa.compute.binary_length(values).to_numpy().astype(np.int64)
        held["bytes"] = b"".join(values.to_pylist())
        later = later_strings(held, length)
        row = np.repeat(np.arange(rows.num_rows), held["count"])
        within = np.arange(len(row)) - np.repeat(np.cumsum(held["count"]) - held["count"], held["count"])
        told = later & (row >= known)
        before = np.concatenate([[False], told[:-1]]) & (within > 0)
        after = np.concatenate([told[1:], [False]]) & (within + 1 < held["count"][row])
        a, b = np.flatnonzero(told & ~before), np.flatnonzero(told & ~after)
        spans = pa.record_batch([
            pa.array(held["doc"][row[a]]), pa.array(held["tag"][row[a]].astype(np.int32)),
            pa.array(held["start"][row[a]] + within[a]), pa.array(held["start"][row[b]] + within[b] + length),
        ], names=["doc", "tag", "begin", "end"])
        return spans, later

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            told = batch.filter(pa.compute.is_null(batch.column("bytes")))
            if told.num_rows:
                begin = told.column("start").to_numpy()
                yield pa.record_batch([told.column("doc"), told.column("tag"), pa.array(begin),
                                       pa.array(begin + told.column("count").to_numpy() - 1 + length)], names=["doc", "tag", "begin", "end"])
            rows = pa.Table.from_batches([batch.filter(pa.compute.is_valid(batch.column("bytes")))])
            held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            while held.num_rows >= rows_at_once:
                keys = held["key"].to_numpy()
                # Whole keys, as many as fit; else the first one, as far as it came.
                cut = int(np.searchsorted(keys == keys[-1], True)) if keys[-1] != keys[0] else 0
                if cut > rows_at_once:
                    edges = np.flatnonzero(keys[1:cut] != keys[:cut - 1]) + 1
                    within = edges[edges <= rows_at_once]
                    cut = int(within[-1] if len(within) else edges[0]) if len(edges) else cut
                if cut:
                    yield judge(held.slice(0, cut), known)[0]
                    held, known = held.slice(cut), 0
                elif held.num_rows > hot:
                    # One string's key: those that are not later ones stand for all that came.
                    spans, later = judge(held, known)
                    yield spans
                    ends = np.cumsum(held["count"].to_numpy())
                    alive = np.add.reduceat(~later, np.concatenate([[0], ends[:-1]])) > 0
                    held = held.filter(pa.array(alive)).combine_chunks()
                    known = held.num_rows
                    break
                else:
                    break
        if held is not None and held.num_rows:
            yield judge(held, known)[0]

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, its spans merged."""
    for batch in batches:
        for part in slices(batch, "body", CHUNK):
            out: list[list] = [[], [], [], []]
            for doc_id, body, whole, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "whole", "spans"))):
                merged: list[list[int]] = [[0, len(body)]] if whole else []
                for span in [] if whole else sorted((s["begin"], s["end"]) for s in spans or ()):
                    if merged and span[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span[1])
                    else:
                        merged.append(list(span))
                edges = [0, *(place for span in merged for place in span), len(body)]
                kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (doc_id, len(body), [{"begin": a, "end": b} for a, b in merged], kept)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rows_at_once: int = ROWS_AT_ONCE, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``n_bytes``, the removed ``spans`` (bytes, merged) and the ``kept`` bytes of each row. Wants ``doc_id`` and ``text``."""
    body = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.hash(body).alias("tag"), body.cast("binary").alias("body"))
    digest = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.hash(body).alias("tag"), F.unhex(F.sha2(body, 256)).alias("digest"))
    firsts = digest.groupBy("digest", "tag").agg(F.min("doc").alias("doc")).select("doc", "tag").distinct()
    searched = texts.join(firsts, ["doc", "tag"]).select("doc_id", "doc", "tag", "body")
    grams = searched.mapInArrow(_gram_rows(length, gram), "gram long, doc long, tag int, packed long")
    repeated = grams.repartition("gram").sortWithinPartitions("gram").mapInArrow(
        _repeated(hot), "gram long, doc long, tag int, packed long, hot boolean")
    found = repeated.groupBy("doc", "tag").agg(F.collect_list(F.struct("gram", "packed", "hot")).alias("found"))
    contexts = searched.join(found, ["doc", "tag"]).select("doc_id", "doc", "tag", "body", "found").mapInArrow(_contexts(length), CONTEXT)
    dealt = contexts.repartition("key").sortWithinPartitions("key", "doc", "tag", "start")
    spans = dealt.mapInArrow(_removed(length, rows_at_once, hot), "doc long, tag int, begin long, end long")
    by_text = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    is_first = firsts.withColumn("first", F.lit(True))
    rows = texts.join(is_first, ["doc", "tag"], "left").join(by_text, ["doc", "tag"], "left")
    whole = F.col("first").isNull() & (F.octet_length("body") >= length)
    return rows.select("doc_id", "body", whole.alias("whole"), "spans").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<begin:bigint,end:bigint>>, kept binary")
