"""Approximate vector search through a stored index of cells.

Some rows, drawn by a hash of their identifier, are the centres; every row lies in the cell of its nearest centre. The index keeps
rows by cell in folders of their own, so a search opens only the cells it probes. Cells lie on shelves of a bounded number of rows (a larger
cell has some of its own); a block of requests meets a whole shelf at once and compares, cell by cell, only what it probes, so vectors and answers
are shuffled once per shelf and not per cell. What is found is ranked by the exact similarity.

A search that probes all cells is exact. How many must be probed for a wanted share of the true neighbours depends on the data: few if vectors form
groups, most of them if directions are evenly spread; ``share_found`` measures it on a bounded set of requests.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinefold.functions import vector as V
from cinefold.functions.vector import RANK_DECIMALS, BestRows, Requests, identifiers, matrix_of, rank_block, unit_rows
from cinefold.operators.export import seeded_sample
from cinefold.operators.search import _answer_schema, _answers, _arrow_schema, _as_requests, searchable, spread_groups
from cinefold.session import scratch_path, step_table

MOST_CELLS = 1 << 15  # centres are held by every task
GROUP_ROWS, GROUP_REQUESTS = 1 << 15, 1 << 15  # rows and requests that one task compares at once,
LEAST_ROWS = 1 << 10  # and those that are not cut further to give every core a group
PROBE_SHARE = 3 / 4  # finds nine of ten neighbours even if directions are evenly spread


@dataclass
class CellIndex:
    """``rows`` with their ``cell``, and ``centres`` (``cell``, ``centre``)."""

    rows: DataFrame
    centres: DataFrame
    cells: int


def cell_count(rows: int) -> int:
    return max(1, min(MOST_CELLS, math.ceil(math.sqrt(rows))))


def draw_centres(rows: DataFrame, cells: int, id: str = "id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """``cell`` (from 0, in order of the draw) and ``centre``: vectors of ``cells`` rows, the same in every run; rows without length are no centres."""
    long = searchable(rows, vector).filter(F.exists(vector, lambda x: x != 0)).select(F.col(id).alias("id"), F.col(vector).alias("centre"))
    drawn = seeded_sample(long, cells, seed, "id")
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")  # at most ``cells`` rows
    return drawn.select((F.row_number().over(order) - 1).alias("cell"), "centre")


def _held(centres: DataFrame):
    """The directions of all centres, by number, for every task."""
    held = centres.orderBy("cell").toArrow()  # at most MOST_CELLS rows
    return centres.sparkSession.sparkContext.broadcast(unit_rows(matrix_of(held["centre"])) if held.num_rows else np.zeros((0, 0)))


def _ranked_cells(units: np.ndarray, vectors: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each vector that has a length, and its ``most`` nearest cells, nearest first; equal ones by number."""
    present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(units) or not len(present):
        return
    wanted = unit_rows(matrix_of(vectors.drop_null()))
    for start in range(0, len(present), 1024):
        scores = np.round(wanted[start:start + 1024] @ units.T, RANK_DECIMALS)
        order = np.argmax(scores, axis=1)[:, None] if most == 1 else np.argsort(-scores, axis=1, kind="stable")[:, :most]
        for at, cells, unknown in zip(present[start:start + 1024], order, np.isnan(scores).any(axis=1)):
            if not unknown:
                yield at, cells


def _nearest(centres: DataFrame, most: int):
    """An Arrow function giving the ``most`` nearest cells of a vector, nearest first; equal ones by number."""
    units = _held(centres)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pa.Array) -> pa.Array:
        out: list[list[int] | None] = [None] * len(vectors)
        for at, cells in _ranked_cells(units.value, vectors, most):
            out[at] = cells.tolist()
        return pa.array(out, pa.list_(pa.int32()))

    return nearest


def _probes(centres: DataFrame, most: int, first: np.ndarray, parts: np.ndarray, listed: bool):
    """An Arrow function giving the shelves on which the ``most`` nearest cells of a vector lie, those cells as one bit each, and, if ``listed``, as numbers."""
    units = _held(centres)
    kind = T.StructType([
        T.StructField("shelves", T.ArrayType(T.IntegerType())), T.StructField("probed", T.BinaryType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])

    @F.arrow_udf(kind)
    def probes(vectors: pa.Array) -> pa.Array:
        shelves, bits, numbers = [None] * len(vectors), [None] * len(vectors), [None] * len(vectors)
        for at, cells in _ranked_cells(units.value, vectors, most):
            own = np.zeros(len(first), np.uint8)
            own[cells] = 1
            more = [np.arange(first[c], first[c] + parts[c]) for c in cells[parts[cells] > 1]]
            shelves[at] = np.unique(np.concatenate([first[cells[parts[cells] == 1]], *more])).tolist()
            bits[at] = np.packbits(own, bitorder="little").tobytes()
            numbers[at] = cells.tolist() if listed else []
        ints = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(shelves, ints), pa.array(bits, pa.binary()), pa.array(numbers, ints)], ["shelves", "probed", "cells"])

    return probes


def _shelved(counts: dict[int, int], cells: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first shelf and how many it has: neighbours in number share one while they have ``most`` rows or less."""
    first, parts, shelf, held = np.zeros(cells, np.int32), np.ones(cells, np.int32), 0, 0
    for cell in range(cells):
        n = counts.get(cell, 0)
        if held and held + n > most:
            shelf, held = shelf + 1, 0
        first[cell], parts[cell], held = shelf, max(1, math.ceil(n / most)), held + n
        if n > most:
            shelf, held = shelf + int(parts[cell]), 0
    return first, parts


def build(rows: DataFrame, id: str = "id", vector: str = "embedding", cells: int | None = None, seed: int = 42) -> CellIndex:
    """The cells of all rows with a vector; a vector without length is similar to nothing and has cell -1."""
    rows = searchable(rows, vector)
    cells = cells or cell_count(rows.count())
    centres = step_table(draw_centres(rows, cells, id, vector, seed), "centres")
    own = F.coalesce(F.get(_nearest(centres, 1)(F.col(vector)), F.lit(0)), F.lit(-1))
    return CellIndex(rows.withColumn("cell", own), centres, cells)


def write(index: CellIndex, path: str) -> None:
    """Cells as folders. A large cell is written by several tasks, any other as one file."""
    rows = step_table(index.rows, "celled")
    files = rows.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("files"))  # one row per cell
    salted = rows.join(F.broadcast(files), "cell").withColumn("file", F.pmod(F.monotonically_increasing_id(), F.col("files")))
    salted.repartition("cell", "file").drop("file", "files").write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/rows")
    index.centres.coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")


def read(spark: SparkSession, path: str) -> CellIndex:
    centres = spark.read.parquet(f"{path}/centres")
    return CellIndex(spark.read.parquet(f"{path}/rows"), centres, centres.count())


def stored(index: CellIndex) -> CellIndex:
    """The index written to the shared folder and read again."""
    spark = index.rows.sparkSession
    path = scratch_path(spark, "cells")
    write(index, path)
    return read(spark, path)


def search(
    index: CellIndex, requests: DataFrame, top_k: int, probes: int | None = None, *, equal: dict[str, str] | None = None,
    minimum: dict[str, str] | None = None, not_self: bool = False, id: str = "id", vector: str = "embedding",
    request_id: str = "request_id", request_vector: str = "vector", group_rows: int = GROUP_ROWS, group_requests: int = GROUP_REQUESTS,
) -> DataFrame:
    """``request_id, id, similarity, rank``: the best rows of the ``probes`` cells that are nearest to each request.

    Filters as of ``search.top_k_per_request``; they hold within the cells probed. Rows and requests meet in groups
    of about ``group_rows`` and ``group_requests``, so no task holds more, however many fall into one cell.
    """
    equal, minimum = equal or {}, minimum or {}
    probes = math.ceil(index.cells * PROBE_SHARE) if probes is None else min(probes, index.cells)
    wants = [F.col(r).alias(f"want_{c}") for c, r in equal.items()] + [F.col(r).cast("double").alias(f"want_{c}") for c, r in minimum.items()]
    spark = index.rows.sparkSession
    asked = searchable(requests, request_vector).select(F.col(request_id).alias("request_id"), F.col(request_vector).alias("vector"), *wants)
    counts = {r["cell"]: r["count"] for r in index.rows.filter("cell >= 0").groupBy("cell").count().collect()}  # at most one per cell
    sides = math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))
    most = min(group_rows, max(LEAST_ROWS, math.ceil(sum(counts.values()) / sides)))
    first, parts = _shelved(counts, index.cells, most)
    few = 2 * probes < index.cells
    probed = asked.repartition(spark.sparkContext.defaultParallelism, "request_id").withColumn("p", _probes(index.centres, probes, first, parts, few)(F.col("vector")))
    probed = step_table(probed.select("request_id", "vector", *[f"want_{c}" for c in [*equal, *minimum]], "p.*").filter("shelves IS NOT NULL"), "probes")
    rows = index.rows.filter("cell >= 0")
    if few:
        opened = [r["cell"] for r in probed.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most one per cell
        rows = index.rows.filter(F.col("cell").isin(opened))
    rows = rows.select(
        "cell", F.col(id).alias("id"), F.col(vector).alias("vector"), *[F.col(c) for c in equal], *[F.col(c).cast("double").alias(c) for c in minimum])
    asking_rows = probed.count()
    blocks = math.ceil(max(1, asking_rows) / min(group_requests, max(LEAST_ROWS, math.ceil(asking_rows / sides))))
    numbers = list(range(index.cells))
    places = spark.createDataFrame(list(zip(numbers, first.tolist(), parts.tolist())), "cell int, first int, parts int")  # one row per cell
    # The bytes of a request's bits that tell of a shelf's cells.
    spans: dict[int, list[int]] = {}
    for cell, shelf, n in zip(numbers, first.tolist(), parts.tolist()):
        for s in range(shelf, shelf + n):
            spans.setdefault(s, []).append(cell // 8)
    bounds = spark.createDataFrame([(s, min(of), max(of) - min(of) + 1) for s, of in spans.items()], "shelf int, start int, bytes int")
    own_slot = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    left = rows.join(F.broadcast(places), "cell").withColumn("shelf", F.col("first") + own_slot).drop("first", "parts")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = probed.drop("cells").withColumn("block", F.pmod(F.xxhash64("request_id"), F.lit(blocks)).cast("int")).withColumn("shelf", F.explode("shelves")).drop("shelves")
    right = right.join(F.broadcast(bounds), "shelf").withColumn("probed", F.substring("probed", F.col("start") + 1, F.col("bytes"))).drop("bytes")
    schema = _answer_schema(requests, request_id, index.rows, id)
    arrow = _arrow_schema(schema)

    def bits(table: pa.Table) -> np.ndarray:
        packed = np.frombuffer(b"".join(table["probed"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return np.unpackbits(packed, axis=1, bitorder="little")

    def best_of_group(stored: pa.Table, asking: pa.Table) -> pa.Table:
        if not stored.num_rows or not asking.num_rows:
            return arrow.empty_table()
        held = Requests(**_as_requests(asking, top_k, equal, minimum, not_self, codes=bits))
        best = BestRows(len(held.ids), top_k)
        filters = {n: np.asarray(stored[n].to_pylist(), object) for n in [*equal, *minimum]}
        cell_of, ids, vectors = stored["cell"].to_numpy(), identifiers(stored["id"]), matrix_of(stored["vector"])
        order = np.argsort(cell_of, kind="stable")
        cells, starts = np.unique(cell_of[order], return_index=True)
        for cell, rows in zip(cells - 8 * asking["start"][0].as_py(), np.split(order, starts[1:])):
            who = np.flatnonzero(held.codes[:, cell])
            if len(who):
                rank_block(held, best, ids[rows], vectors[rows], {n: v[rows] for n, v in filters.items()}, who=who)
        return _answers(held, best, arrow)

    local = spread_groups(spark, left, right, ["shelf", "block"], blocks * max(1, len(spans))).applyInArrow(best_of_group, schema)
    order = Window.partitionBy("request_id").orderBy(V.ranked(F.col("score")).desc(), F.asc("id"))
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("request_id", "id", V.presented(F.col("score")).alias("similarity"), "rank")


def share_found(index: CellIndex, requests: DataFrame, exact: DataFrame, probes: Iterable[int], top_k: int, **options) -> dict[int, float]:
    """For each number of probes, the share of the ``exact`` answers (``request_id, id``) of a few requests that a search finds."""
    exact = step_table(exact.select("request_id", "id"), "exact-answers")
    total = exact.count()
    return {p: exact.join(search(index, requests, top_k, p, **options), ["request_id", "id"], "left_semi").count() / max(total, 1) for p in probes}
