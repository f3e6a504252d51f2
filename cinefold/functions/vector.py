"""Vector expressions and the Arrow kernel of exact top-k similarity."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Similarities are ranked at this many decimals, finer than the float32 that is stored,
# so a ranking does not depend on the order in which products were summed.
RANK_DECIMALS = 9
# Signatures compared at once by the kernel (8 bytes each), and requests and rows whose cosines are computed at once.
_BLOCK_CELLS = 2_000_000
_TILE_REQUESTS, _TILE_ROWS = 256, 2048
# So many new rows of a request are put in their places one by one; sorting more is quicker.
_FEW_GAINS = 4
# Requests of a span are told apart by all equality filters if so many, on average, want the same.
_SHARING = 32


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity of two array columns; NULL when either has no length."""
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def ranked(similarity: Column) -> Column:
    """The similarity as far as it decides a rank."""
    return F.round(similarity, RANK_DECIMALS)


def presented(similarity: Column) -> Column:
    """Clamp to [0, 1] and round to six digits; NULL stays NULL."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))
    return F.when(similarity.isNotNull(), F.round(clamped, 6))


def to_text(vector: Column) -> Column:
    """``[a,b,...]`` with the shortest digits that give the same float32 again."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","), F.lit("]")
    )


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def cosine_to(target: list[float]):
    """An Arrow function giving the similarity of an array column to one fixed vector."""
    wanted = unit_rows(np.asarray([target], dtype=np.float64))[0]

    @F.arrow_udf(T.DoubleType())
    def similarity(vectors: pa.Array) -> pa.Array:
        present = vectors.is_valid().to_numpy(zero_copy_only=False)
        scores = np.full(len(vectors), np.nan)
        if present.any():
            scores[present] = unit_rows(matrix_of(vectors.drop_null())) @ wanted
        return pa.array(scores, mask=np.isnan(scores))

    return similarity


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / lengths


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal-width vectors as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def identifiers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Identifiers as one array. Texts are UTF-8 bytes, which sort as their characters do and take a quarter of the room."""
    if pa.types.is_string(column.type) and not column.null_count:
        return np.asarray([value.encode() for value in column.to_pylist()], np.bytes_)
    return np.asarray(column.to_pylist())


@dataclass
class Requests:
    """A block of search requests held by one task.

    ``minimum`` and ``equal`` hold, per filter column, the wanted value of each request
    with None where the request does not use that filter.
    """

    ids: np.ndarray
    vectors: np.ndarray
    k: int
    equal: dict[str, np.ndarray] = field(default_factory=dict)
    minimum: dict[str, np.ndarray] = field(default_factory=dict)
    not_id: bool = False
    codes: np.ndarray | None = None  # signatures, for a search that compares them first

    @cached_property
    def sharing(self) -> list[tuple[list[tuple[str, object]], slice]]:
        """Spans of requests and the (filter, value) that all of a span want: of the first equality filter, and of the others too where many want the same."""
        (first, wants), *_ = self.equal.items()
        out = []
        for start, stop in _spans([wants], 0, len(wants)):
            finer = _spans(list(self.equal.values()), start, stop)
            names = list(self.equal)
            if len(finer) * _SHARING > stop - start:
                finer, names = [(start, stop)], [first]
            out += [([(n, self.equal[n][a]) for n in names if self.equal[n][a] is not None], slice(a, b)) for a, b in finer]
        return out

    def eligible(self, rows: dict[str, np.ndarray], row_ids: np.ndarray, part: slice | np.ndarray) -> np.ndarray | None:
        """Request x row matrix of the rows each request of ``part`` may return; None means all."""
        allowed = self.matching(rows, part)
        if self.not_id:
            here = self.ids[part, None] != row_ids[None, :]
            allowed = here if allowed is None else allowed & here
        return allowed

    def matching(self, rows: dict[str, np.ndarray], part: slice | np.ndarray) -> np.ndarray | None:
        """As ``eligible``, by the filters alone."""
        allowed = None
        for name, wanted in self.equal.items():
            wanted = wanted[part]
            unused = np.array([w is None for w in wanted])
            if unused.all():
                continue
            codes, known = pd.factorize(rows[name])
            code_of = {value: code for code, value in enumerate(known)}
            sought = np.array([code_of.get(w, -2) for w in wanted])
            here = unused[:, None] | (sought[:, None] == codes[None, :])
            allowed = here if allowed is None else allowed & here
        for name, wanted in self.minimum.items():
            floor = np.array([-np.inf if w is None else float(w) for w in wanted[part]])
            values = np.array([np.nan if v is None else float(v) for v in rows[name]])
            here = np.isneginf(floor)[:, None] | (values[None, :] >= floor[:, None])
            allowed = here if allowed is None else allowed & here
        return allowed


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.nonzero`` of a matrix, which takes many times longer where little is set."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


class BestRows:
    """The best k (score, id) pairs per request over everything seen so far, best first, in arrays of fixed size."""

    def __init__(self, requests: int, k: int):
        self.k = k
        self.score = np.full((requests, k), -np.inf)
        self.exact = np.zeros((requests, k))
        self.row: np.ndarray | None = None

    def offer(self, at: np.ndarray, scores: np.ndarray, row_ids: np.ndarray) -> None:
        """Take in a block of scores for the requests ``at``; -inf marks a pair that is not allowed.

        ``row_ids`` are those of the block's columns, or of each of its cells.
        """
        floor = self.score[at, -1]
        unfilled = np.flatnonzero(np.isneginf(floor))
        if scores.shape[1] > self.k and len(unfilled):
            floor[unfilled] = np.round(np.partition(scores[unfilled], -self.k, axis=1)[:, -self.k], RANK_DECIMALS)
        # Rounding keeps the order and moves a score by less than this, so few scores need be rounded.
        request, position = _places(scores >= (floor - 10.0**-RANK_DECIMALS)[:, None])
        self.take(at, request, scores[request, position], row_ids[position] if row_ids.ndim == 1 else row_ids[request, position], floor)

    def take(self, at: np.ndarray, request: np.ndarray, exact: np.ndarray, row_ids: np.ndarray, floor: np.ndarray) -> None:
        """Take in pairs of ``at[request]``, ``request`` ascending, and ``row_ids``; none below its request's ``floor`` can be among the best.

        A request that gains few rows has them put in their places one by one, one that gains more is put in order again.
        """
        score = np.round(exact, RANK_DECIMALS)
        gains = np.isfinite(score) & (score >= floor[request])
        if self.row is not None:  # the last row kept stays before an equal one of a later identifier
            gains &= (score > self.score[at, -1][request]) | (row_ids < self.row[at, -1][request])
        if not gains.any():
            return
        request, exact, score, row_ids = request[gains], exact[gains], score[gains], row_ids[gains]
        if self.row is None:
            self.row = np.zeros(self.score.shape, row_ids.dtype)
        elif self.row.dtype != row_ids.dtype:
            kind = np.promote_types(self.row.dtype, row_ids.dtype)  # a longer text identifier
            self.row, row_ids = self.row.astype(kind), row_ids.astype(kind)
        starts = np.flatnonzero(np.diff(request, prepend=-1))
        counts = np.diff(starts, append=len(request))
        few = counts <= _FEW_GAINS
        for turn in range(min(_FEW_GAINS, counts.max())):
            pair = starts[few & (counts > turn)] + turn
            self._insert(at[request[pair]], score[pair], exact[pair], row_ids[pair])
        if few.all():
            return
        many = np.repeat(~few, counts)
        request, exact, score, row_ids = request[many], exact[many], score[many], row_ids[many]
        touched, local = np.unique(request, return_inverse=True)
        at = at[touched]
        old_local, old_place = np.nonzero(np.isfinite(self.score[at]))
        who = np.concatenate([old_local, local])
        score = np.concatenate([self.score[at][old_local, old_place], score])
        true = np.concatenate([self.exact[at][old_local, old_place], exact])
        row = np.concatenate([self.row[at][old_local, old_place], row_ids])
        order = np.lexsort((row, -score, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order], side="left")
        order, place = order[place < self.k], place[place < self.k]
        into = at[who[order]], place
        self.score[into], self.exact[into], self.row[into] = score[order], true[order], row[order]

    def _insert(self, at: np.ndarray, score: np.ndarray, exact: np.ndarray, row_ids: np.ndarray) -> None:
        """One row for each of the requests ``at``; those after its place move by one."""
        kept = self.score[at]
        place = ((kept > score[:, None]) | (kept == score[:, None]) & (self.row[at] < row_ids[:, None])).sum(axis=1)
        if (place == self.k).any():
            among = place < self.k
            at, score, exact, row_ids, place = at[among], score[among], exact[among], row_ids[among], place[among]
        places = np.arange(self.k)
        source = places - (places > place[:, None])
        for held, new in ((self.score, score), (self.exact, exact), (self.row, row_ids)):
            moved = held[at[:, None], source]
            moved[np.arange(len(at)), place] = new
            held[at] = moved

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(request, row id, exact score) of all that is kept."""
        request, place = np.nonzero(np.isfinite(self.score))
        rows = self.score[:0, 0] if self.row is None else self.row[request, place]
        return request, rows, self.exact[request, place]


def rank_block(
    requests: Requests, best: BestRows, row_ids: np.ndarray, vectors: np.ndarray,
    filters: dict[str, np.ndarray], similarity=None, who: np.ndarray | None = None,
) -> None:
    """Score one block of rows against all requests, or the ascending numbers ``who`` of them, a bounded number of cells at a time.

    Requests of one wanted value of the first equality filter, or of all where many share them, meet only the rows that have it.
    ``similarity`` scores some requests against some rows; the cosine of ``vectors`` without it.
    """
    who = np.arange(len(requests.ids)) if who is None else who
    rows_of = vectors if similarity else unit_rows(vectors)
    if not similarity:
        long = np.isfinite(rows_of).all(axis=1)  # the others are similar to nothing
        if not long.all():
            row_ids, rows_of, filters = row_ids[long], rows_of[long], {n: v[long] for n, v in filters.items()}
    width = 1 if rows_of.dtype.kind == "f" else max(1, rows_of.shape[1])  # cells that a bitwise score takes
    for rows, wanted in _meeting(requests, filters, len(row_ids)):
        ids, kept, here = row_ids[rows], {n: v[rows] for n, v in filters.items()}, rows_of[rows]
        asking = who[np.searchsorted(who, wanted.start) : np.searchsorted(who, wanted.stop)]
        if not similarity:
            _rank_cosine(requests, best, ids, here, kept, asking)
            continue
        step = max(1, _BLOCK_CELLS // max(1, len(ids) * width))
        for start in range(0, len(asking), step):
            at = asking[start : start + step]
            scores = similarity(requests.vectors[at], here)
            allowed = requests.eligible(kept, ids, at)
            scores[np.isnan(scores)] = -np.inf
            if allowed is not None:
                scores[~allowed] = -np.inf
            best.offer(at, scores, ids)


def _rank_cosine(
    requests: Requests, best: BestRows, ids: np.ndarray, units: np.ndarray, filters: dict[str, np.ndarray], asking: np.ndarray,
) -> None:
    """Once a request has ``k`` rows, a product in single precision tells which others may be better; those are computed in double."""
    rough, slack = units.astype(np.float32), (units.shape[1] + 8) * float(np.finfo(np.float32).eps)
    step = max(_TILE_REQUESTS, _TILE_REQUESTS * _TILE_ROWS // max(1, len(ids)))
    for start in range(0, len(asking), step):
        at = asking[start : start + step]
        wanted, own = requests.vectors[at], requests.ids[at]
        rough_wanted = wanted.astype(np.float32)
        for first in range(0, len(ids), _TILE_ROWS):
            tile = slice(first, first + _TILE_ROWS)
            allowed = requests.matching({n: v[tile] for n, v in filters.items()}, at)
            same = np.flatnonzero(np.isin(ids[tile], own)) if requests.not_id else ids[:0]

            def barred(scores: np.ndarray) -> np.ndarray:
                if allowed is not None:
                    scores[~allowed] = -np.inf
                if len(same):
                    scores[:, same] = np.where(own[:, None] == ids[tile][same], -np.inf, scores[:, same])
                return scores

            floor = best.score[at, -1]
            if np.isfinite(floor).all():
                request, position = _places(barred(rough_wanted @ rough[tile].T) >= (floor - slack).astype(np.float32)[:, None])
                if len(request) <= _TILE_REQUESTS * _TILE_ROWS // 16:
                    best.take(at, request, np.einsum("ij,ij->i", wanted[request], units[tile][position]), ids[tile][position], floor)
                    continue
            best.offer(at, barred(wanted @ units[tile].T), ids[tile])


def bits_apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many bits each pair of signatures (rows of 64-bit words) differs."""
    apart = np.zeros((len(left), len(right)), np.uint16)
    for word in range(left.shape[1]):
        apart += np.bitwise_count(left[:, word, None] ^ right[None, :, word])
    return apart


def rank_near(
    requests: Requests, best: BestRows, row_ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray,
    filters: dict[str, np.ndarray], budget: int, few: int,
) -> None:
    """Score, for each request, the ``budget`` rows of a block whose signatures differ least from its own.

    Rows that share a wanted value and are at most ``few`` are all scored: signatures would save nothing there.
    """
    order = np.argsort(row_ids, kind="stable")  # rows at the same distance are taken by identifier
    row_ids, units, codes = row_ids[order], unit_rows(vectors)[order], codes[order]
    filters, barred = {n: v[order] for n, v in filters.items()}, np.iinfo(np.uint16).max
    for rows, wanted in _meeting(requests, filters, len(row_ids)):
        ids, kept = row_ids[rows], {n: v[rows] for n, v in filters.items()}
        here, here_codes = units[rows], np.ascontiguousarray(codes[rows])
        step = max(1, _BLOCK_CELLS // len(ids))
        for start in range(wanted.start, wanted.stop, step):
            part = slice(start, min(start + step, wanted.stop))
            allowed = requests.eligible(kept, ids, part)
            if len(ids) <= max(few, budget):
                scores, near_ids = requests.vectors[part] @ here.T, ids
            else:
                apart = bits_apart(requests.codes[part], here_codes)
                if allowed is not None:
                    apart[~allowed] = barred
                near = np.argpartition(apart, budget - 1, axis=1)[:, :budget]
                scores, near_ids = np.einsum("rd,rbd->rb", requests.vectors[part], here[near]), ids[near]
                allowed = np.take_along_axis(apart, near, 1) != barred
            scores[np.isnan(scores)] = -np.inf
            if allowed is not None:
                scores[~allowed] = -np.inf
            best.offer(np.arange(part.start, part.stop), scores, near_ids)


def _spans(wants: list[np.ndarray], start: int, stop: int) -> list[tuple[int, int]]:
    """Runs of requests in ``start`` to ``stop`` that want the same of all ``wants``."""
    edges = [start, *(i for i in range(start + 1, stop) if any(w[i] != w[i - 1] for w in wants)), stop]
    return list(zip(edges[:-1], edges[1:]))


def _meeting(requests: Requests, filters: dict[str, np.ndarray], n: int):
    """(rows, span of requests) that may match; requests are in order of their wanted values, those without one last."""
    every = np.arange(n)
    if not requests.equal:
        yield every, slice(0, len(requests.ids))
        return
    known: dict[tuple, np.ndarray] = {}
    codes = {name: pd.factorize(filters[name]) for name in requests.equal}
    places = {name: {value: code for code, value in enumerate(values)} for name, (_, values) in codes.items()}
    for wanted, span in requests.sharing:
        rows = every
        for name, value in wanted:
            if (name, value) not in known:
                known[name, value] = codes[name][0] == places[name].get(value, -2)
            rows = rows[known[name, value][rows]]
        if len(rows):
            yield rows, span
