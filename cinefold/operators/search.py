"""Vector search: one request, neighbours of a row, many requests at once, and approximate."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from cinefold import schemas as S
from cinefold.functions import vector as V
from cinefold.functions.vector import BestRows, Requests, identifiers, matrix_of, rank_block, rank_near, unit_rows
from cinefold.session import step_table

# Requests held by every task are limited to this size; more of them are searched in a grid.
HELD_BYTES = 256 << 20
# What a request takes besides its vector: identifier and wanted values; and for each row it may keep, score twice and identifier
# (a text as its bytes, see ``identifiers``).
_REQUEST_BYTES, _ANSWER_BYTES = 512, 80
# Catalogue vectors per grid cell.
CELL_BYTES = 128 << 20
# A row that meets so many requests takes longer to score than to shuffle.
MANY_REQUESTS = 1 << 12
# Groups of the grid for each core, as hashing deals them unevenly; blocks are cut further for that down to so many requests.
CORE_GROUPS, LEAST_REQUESTS = 4, 1 << 10
# Rows and requests whose signatures are compared at once, and the most rows under a filter that are scored without.
NEAR_ROWS, NEAR_REQUESTS, FEW_ROWS = 1 << 14, 1 << 15, 1 << 12


def optional_filters(
    genre: str | None = None, min_imdb_rating: float | None = None,
    mpaa_rating: str | None = None, decade: int | None = None, exclude_imputed: bool = False,
) -> list[Column]:
    """Exact, case-sensitive predicates; a parameter that is None adds none."""
    out = []
    if genre is not None:
        out.append(F.col("major_genre") == genre)
    if min_imdb_rating is not None:
        out.append(F.col("imdb_rating") >= min_imdb_rating)
        if exclude_imputed:
            out.append(~F.array_contains("imputed_fields", "imdb_rating"))
    if mpaa_rating is not None:
        out.append(F.col("mpaa_rating") == mpaa_rating)
    if decade is not None:
        out.append(F.col("decade") == decade)
    return out


def filtered(catalogue: DataFrame, filters: Sequence[Column]) -> DataFrame:
    for condition in filters:
        catalogue = catalogue.filter(condition)
    return catalogue


def searchable(catalogue: DataFrame, vector: str = "embedding") -> DataFrame:
    return catalogue.filter(F.col(vector).isNotNull())


def result_rows(catalogue: DataFrame, columns: Sequence[str] = tuple(S.RESULT_COLUMNS)) -> DataFrame:
    """A search result never carries the vector; missing provenance reads as empty."""
    shown = [
        F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c == "imputed_fields"
        else F.col(c)
        for c in columns
    ]
    return catalogue.select(*shown)


def by_id(catalogue: DataFrame, ids: DataFrame | str, id: str = "id") -> DataFrame:
    """Rows of one identifier, or of a table of identifiers."""
    if isinstance(ids, DataFrame):
        return catalogue.join(ids.select(id).distinct(), id, "left_semi")
    return catalogue.filter(F.col(id) == ids)


def search(
    catalogue: DataFrame, target: Sequence[float], top_k: int = S.TOP_K_DEFAULT,
    filters: Sequence[Column] = (), id: str = "id", vector: str = "embedding",
    columns: Sequence[str] = tuple(S.RESULT_COLUMNS), not_id=None,
) -> DataFrame:
    """The ``top_k`` rows closest to ``target`` that pass the filters, best first.

    The filters reach the scan; each task keeps ``top_k`` rows (``TakeOrderedAndProject``).
    """
    rows = filtered(searchable(catalogue, vector), filters)
    if not_id is not None:
        rows = rows.filter(F.col(id) != not_id)
    scored = rows.withColumn("similarity", V.cosine_to(list(target))(F.col(vector)))
    best = scored.orderBy(V.ranked(F.col("similarity")).desc(), F.asc(id)).limit(top_k)
    return best.select(*columns, V.presented(F.col("similarity")).alias("similarity"))


def neighbours(
    catalogue: DataFrame, row_id, top_k: int = S.TOP_K_DEFAULT, id: str = "id",
    vector: str = "embedding", columns: Sequence[str] = tuple(S.RESULT_COLUMNS),
) -> DataFrame:
    """The rows closest to a stored one, itself left out."""
    found = catalogue.filter(F.col(id) == row_id).select(vector).head(1)
    if not found:
        raise LookupError(f"no row with {id} {row_id}")
    if found[0][0] is None:
        raise ValueError(f"row {row_id} has no vector and so no neighbours")
    return search(catalogue, found[0][0], top_k, (), id, vector, columns, not_id=row_id)


def _answer_schema(requests: DataFrame, request_id: str, catalogue: DataFrame, id: str) -> T.StructType:
    return T.StructType([
        T.StructField("request_id", requests.schema[request_id].dataType),
        T.StructField("id", catalogue.schema[id].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _as_requests(
    table: pa.Table, k: int, equal: dict, minimum: dict, not_self: bool,
    vectors: Callable[[pa.Table], np.ndarray] = lambda table: unit_rows(matrix_of(table["vector"])),
    codes: Callable[[pa.Table], np.ndarray] | None = None,
) -> dict:
    """Plain arrays, so that a broadcast needs no class on the executors; in order of the equality filters, the first one first."""
    if equal:
        wanted = list(zip(*(table[f"want_{c}"].to_pylist() for c in equal)))
        table = table.take(sorted(range(len(wanted)), key=lambda i: [(w is None, w if w is not None else 0) for w in wanted[i]]))
    return {
        "ids": identifiers(table["request_id"]),
        "vectors": vectors(table),
        "k": k,
        "equal": {c: np.asarray(table[f"want_{c}"].to_pylist(), object) for c in equal},
        "minimum": {c: np.asarray(table[f"want_{c}"].to_pylist(), object) for c in minimum},
        "not_id": not_self,
        "codes": codes(table) if codes else None,
    }


def _answers(requests: Requests, best: BestRows, schema: pa.Schema) -> pa.Table:
    request, ids, exact = best.found()
    columns = [pa.array(requests.ids[request]), pa.array(ids), pa.array(exact)]
    return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def top_k_per_request(
    catalogue: DataFrame, requests: DataFrame, top_k: int | None = None, *,
    equal: dict[str, str] | None = None, minimum: dict[str, str] | None = None,
    not_self: bool = False, id: str = "id", vector: str = "embedding",
    request_id: str = "request_id", request_vector: str = "vector", held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """``request_id, id, similarity, rank``: the exact best rows for every request.

    ``equal`` and ``minimum`` map catalogue columns to request columns; a request whose
    value is NULL does not use that filter. ``top_k`` None takes the request's own.

    No request-row pair leaves a task unless it is among the task's best for that request.
    Requests whose measured size fits ``held_bytes`` are held by every task and the
    catalogue is read once, without a shuffle unless there are ``MANY_REQUESTS``; more requests
    are cut into blocks, the catalogue into cells by a hash of the identifier, and every
    (block, cell) is one bounded group; blocks are small enough to give every core some.
    """
    equal, minimum = equal or {}, minimum or {}
    wants = [F.col(r).alias(f"want_{c}") for c, r in equal.items()]
    wants += [F.col(r).cast("double").alias(f"want_{c}") for c, r in minimum.items()]
    own_k = F.lit(top_k) if top_k is not None else F.col("top_k")
    asked = requests.select(
        F.col(request_id).alias("request_id"), F.col(request_vector).alias("vector"),
        own_k.cast("int").alias("k"), *wants,
    )
    # Written once, whole: a vector may come from an embedder, which must not be asked again by each use of it.
    asked = searchable(step_table(asked, "requests"), "vector")
    rows = searchable(catalogue, vector).select(
        F.col(id).alias("id"), F.col(vector).alias("vector"), *[F.col(c) for c in equal],
        *[F.col(c).cast("double").alias(c) for c in minimum],
    )
    size = asked.agg(
        F.max("k").alias("k"), F.count("*").alias("n"), F.max(F.size("vector")).alias("width")
    ).first()
    k = size["k"]

    def prepare(table: pa.Table) -> dict:
        return _as_requests(table, k, equal, minimum, not_self)

    def score(requests: Requests, best: BestRows, ids: np.ndarray, batch) -> None:
        names = [*equal, *minimum]
        filters = {n: np.asarray(batch[n].to_pylist(), object) for n in names}
        rank_block(requests, best, ids, matrix_of(batch["vector"]), filters)

    local = _best_per_task(
        rows, asked, size["n"], 8 * (size["width"] or 0) + _ANSWER_BYTES * (k or 0) + _REQUEST_BYTES, prepare, score,
        _answer_schema(requests, request_id, catalogue, id), held_bytes,
    )
    order = Window.partitionBy("request_id").orderBy(V.ranked(F.col("score")).desc(), F.asc("id"))
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.lit(k))
    if top_k is None:
        own = asked.select("request_id", "k")
        ranked = ranked.join(own, "request_id").filter("rank <= k")
    return ranked.select(
        "request_id", "id", V.presented(F.col("score")).alias("similarity"), "rank"
    )


def _best_per_task(
    rows: DataFrame, asked: DataFrame, count: int, width_bytes: int,
    prepare: Callable[[pa.Table], dict], score: Callable, schema: T.StructType, held_bytes: int,
    grid: tuple[int, int] | None = None,
) -> DataFrame:
    """Each task's best rows per request, over requests held whole or a grid of bounded groups.

    ``grid`` (request blocks, row cells) asks for a grid of that size whatever fits, so what meets does not depend on the splits.
    """
    spark, arrow = rows.sparkSession, _arrow_schema(schema)
    if not count:
        return spark.createDataFrame([], schema)

    if grid is None and count * width_bytes <= held_bytes:
        held = spark.sparkContext.broadcast(prepare(asked.toArrow()))

        def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            requests = Requests(**held.value)
            best = BestRows(len(requests.ids), requests.k)
            for batch in batches:
                score(requests, best, identifiers(batch["id"]), batch)
            yield from _answers(requests, best, arrow).to_batches()

        if count >= MANY_REQUESTS:  # the files may hold all rows in one part
            rows = rows.repartition(spark.sparkContext.defaultParallelism, "id")
        return rows.mapInArrow(best_of_task, schema)

    def best_of_cell(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        if not stored.num_rows or not wanted.num_rows:
            return arrow.empty_table()
        requests = Requests(**prepare(wanted))
        best = BestRows(len(requests.ids), requests.k)
        score(requests, best, identifiers(stored["id"]), stored)
        return _answers(requests, best, arrow)

    blocks, cells = grid or _grid(spark, count, rows.count(), width_bytes, held_bytes)

    def hashed(column: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = rows.withColumn("cell", hashed("id", cells)).withColumn("block", every(blocks))
    right = asked.withColumn("block", hashed("request_id", blocks)).withColumn("cell", every(cells))
    return spread_groups(spark, left, right, ["block", "cell"], blocks * cells).applyInArrow(best_of_cell, schema)


def _grid(spark: SparkSession, count: int, rows: int, width_bytes: int, held_bytes: int) -> tuple[int, int]:
    """Request blocks and row cells: groups of bounded size, and enough of them for all cores.

    More blocks cost a row's shuffle each; more cells would also begin each request's best rows anew.
    """
    cells = max(1, math.ceil(rows * width_bytes / CELL_BYTES))
    wanted = math.ceil(CORE_GROUPS * spark.sparkContext.defaultParallelism / cells)
    return max(math.ceil(count * width_bytes / held_bytes), min(wanted, math.ceil(count / LEAST_REQUESTS))), cells


def spread_groups(spark: SparkSession, left: DataFrame, right: DataFrame, keys: list[str], groups: int) -> PandasCogroupedOps:
    """Pairs of groups in a fixed number of parts; adaptive execution would join these to a few by their bytes, but their work is the product of their rows."""
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups), 4 * groups)
    left, right = (side.repartition(parts, *keys).groupBy(*keys) for side in (left, right))
    return left.cogroup(right)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def with_rows(
    answers: DataFrame, catalogue: DataFrame, id: str = "id",
    columns: Sequence[str] = tuple(S.RESULT_COLUMNS),
) -> DataFrame:
    """Attach catalogue columns; the answers are written first, so their size is known."""
    rows = result_rows(catalogue, columns).withColumnRenamed(id, "id")
    return step_table(answers, "answers").join(rows, "id")


def candidate_budget(top_k: int) -> int:
    return max(S.CANDIDATES_MIN, min(S.CANDIDATES_PER_K * top_k, S.CANDIDATES_MAX))


def signature(vector: Column, width: int, bits: int = 512, seed: int = 42) -> Column:
    """On which side of ``bits`` fixed random planes a vector lies, as bytes.

    Kept as a column of the snapshot, it lets an approximate search read a few bytes per
    row in place of the vector.
    """
    if bits % 64:
        raise ValueError("a signature is a whole number of 64-bit words")

    @F.arrow_udf(T.BinaryType())
    def sides(vectors: pa.Array) -> pa.Array:
        planes = np.random.default_rng(seed).standard_normal((bits, width))
        codes = np.packbits(matrix_of(vectors.drop_null()).reshape(-1, width) @ planes.T > 0, axis=1)
        present = iter(codes)
        return pa.array([next(present).tobytes() if v else None for v in vectors.is_valid().to_pylist()], pa.binary())

    return sides(vector)


def _unlike(wanted: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Minus the number of bits in which each pair of signatures differs."""
    return -np.bitwise_count(wanted[:, None, :] ^ codes[None, :, :]).sum(axis=2).astype(np.float64)


def _words(codes) -> np.ndarray:
    """Signatures as rows of 64-bit words."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint64).reshape(len(codes), -1)


def approximate_candidates(
    signed: DataFrame, requests: DataFrame, budget: int, id: str = "id",
    code: str = "signature", request_id: str = "request_id", request_code: str = "signature",
    held_bytes: int = HELD_BYTES, *, equal: dict[str, str] | None = None,
    minimum: dict[str, str] | None = None, not_self: bool = False,
) -> DataFrame:
    """``request_id, id``: of the rows that a request may return, those whose signatures differ least from its own."""
    equal, minimum = equal or {}, minimum or {}
    asked = requests.filter(F.col(request_code).isNotNull()).select(
        F.col(request_id).alias("request_id"), F.col(request_code).alias("code"),
        *[F.col(r).alias(f"want_{c}") for c, r in equal.items()],
        *[F.col(r).cast("double").alias(f"want_{c}") for c, r in minimum.items()],
    )
    rows = signed.filter(F.col(code).isNotNull()).select(
        F.col(id).alias("id"), F.col(code).alias("code"), *[F.col(c) for c in equal],
        *[F.col(c).cast("double").alias(c) for c in minimum],
    )
    size = asked.agg(F.count("*").alias("n"), F.max(F.octet_length("code")).alias("width")).first()

    def prepare(table: pa.Table) -> dict:
        return _as_requests(table, budget, equal, minimum, not_self, lambda t: _words(t["code"]))

    def score(requests: Requests, best: BestRows, ids: np.ndarray, batch) -> None:
        filters = {n: np.asarray(batch[n].to_pylist(), object) for n in [*equal, *minimum]}
        rank_block(requests, best, ids, _words(batch["code"]), filters, _unlike)

    local = _best_per_task(
        rows, asked, size["n"], (size["width"] or 0) + _ANSWER_BYTES * budget + _REQUEST_BYTES, prepare, score,
        _answer_schema(requests, request_id, signed, id), held_bytes,
    )
    order = Window.partitionBy("request_id").orderBy(V.ranked(F.col("score")).desc(), F.asc("id"))
    return (
        local.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= budget).select("request_id", "id")
    )


def approximate_search(
    catalogue: DataFrame, requests: DataFrame, top_k: int, *, equal: dict[str, str] | None = None,
    minimum: dict[str, str] | None = None, id: str = "id", vector: str = "embedding",
    request_id: str = "request_id", request_vector: str = "vector", width: int = S.EMBEDDING_WIDTH,
    not_self: bool = False, bits: int = 512, seed: int = 42,
) -> DataFrame:
    """Candidates by signature, then exact similarity and rank among them.

    Rows and requests meet in a grid of bounded groups. A group takes a request's ``candidate_budget`` of its own rows, so the
    candidates grow with the catalogue and with them the share found does not fall; they are scored where they were found, and
    only the best ``top_k`` of each group are shuffled, neither candidates nor their vectors.

    ``equal``, ``minimum`` and ``not_self`` (as of ``top_k_per_request``) hold before the candidates are drawn, so a
    request gets fewer than ``top_k`` rows only if fewer match. Where the first ``equal`` (or all, where many requests share them) leaves ``FEW_ROWS`` or less of a
    group's rows, all of them are scored and nothing is missed.
    """
    equal, minimum = equal or {}, minimum or {}
    if "signature" not in catalogue.columns:
        catalogue = catalogue.withColumn("signature", signature(F.col(vector), width, bits, seed))
    asked = step_table(searchable(requests, request_vector).select(
        F.col(request_id).alias("request_id"), F.col(request_vector).alias("vector"), signature(F.col(request_vector), width, bits, seed).alias("code"),
        *[F.col(r).alias(f"want_{c}") for c, r in equal.items()], *[F.col(r).cast("double").alias(f"want_{c}") for c, r in minimum.items()],
    ), "requests")
    rows = searchable(catalogue, vector).filter(F.col("signature").isNotNull()).select(
        F.col(id).alias("id"), F.col(vector).alias("vector"), F.col("signature").alias("code"), *[F.col(c) for c in equal],
        *[F.col(c).cast("double").alias(c) for c in minimum],
    )
    count, budget = asked.count(), candidate_budget(top_k)
    grid = math.ceil(count / NEAR_REQUESTS), max(1, math.ceil(searchable(catalogue, vector).count() / NEAR_ROWS))
    few = FEW_ROWS if equal else 0

    def prepare(table: pa.Table) -> dict:
        return _as_requests(table, top_k, equal, minimum, not_self, codes=lambda t: _words(t["code"]))

    def score(wanted: Requests, best: BestRows, ids: np.ndarray, stored) -> None:
        filters = {n: np.asarray(stored[n].to_pylist(), object) for n in [*equal, *minimum]}
        rank_near(wanted, best, ids, matrix_of(stored["vector"]), _words(stored["code"]), filters, budget, few)

    local = _best_per_task(rows, asked, count, 0, prepare, score, _answer_schema(requests, request_id, catalogue, id), HELD_BYTES, grid)
    order = Window.partitionBy("request_id").orderBy(V.ranked(F.col("score")).desc(), F.asc("id"))
    return (
        local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
        .select("request_id", "id", V.presented(F.col("score")).alias("similarity"), "rank")
    )
