"""Vector search, requests, and vector contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import vector
from cinefold.operators import batch, cells, export, requests, search
from cinefold.operators.embedding import offline_embedder, embedded, wrong_widths
from cinefold.plans.registry import Registry, sql
from cinefold.plans.registry.base import Shared, plain, plain_sql

_DOUBLES = "list_transform({x}, lambda v: CAST(v AS DOUBLE))"


def _similarity(a: str, b: str) -> str:
    return f"list_cosine_similarity({_DOUBLES.format(x=a)}, {_DOUBLES.format(x=b)})"


def _shown(s: str) -> str:
    return f"round(least(1.0, greatest(0.0, {s})), 6)"


def _top(pairs: str, k: str) -> str:
    """The best ``k`` of ``(request_id, id, s)`` per request."""
    return f"""
      SELECT request_id, id, {_shown('s')} AS similarity, CAST(place AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC, id) AS place
        FROM ({pairs})) WHERE place <= {k}"""


def request_rows(spark, sf):
    """Search requests from the documents: whole texts, with parameters in and out of bounds."""
    d = F.col("doc_id")
    return Shared.of(spark, sf).table("documents").select(
        d.alias("request_id"), F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("query"),
        F.when(d % 4 != 0, (d % 55).cast("int")).alias("top_k"),
        F.when(d % 3 == 0, F.upper("lang")).when(d % 3 == 1, F.lit("  ")).alias("genre"),
        F.when(d % 5 != 0, ((d % 23) - 1) / 2.0).alias("min_imdb_rating"),
        F.when(d % 6 == 0, F.lit(" R ")).alias("mpaa_rating"),
        F.when(d % 7 != 0, (1880 + (d % 24) * 10 + F.when(d % 8 == 0, 5).otherwise(0)).cast("int")).alias("decade"),
    )


_REQUESTS = """
SELECT doc_id AS request_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query,
  coalesce(CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 55 AS INT) END, 10) AS top_k,
  CASE WHEN doc_id % 3 = 0 THEN upper(lang) END AS genre,
  CASE WHEN doc_id % 5 <> 0 THEN ((doc_id % 23) - 1) / 2.0 END AS min_imdb_rating,
  CASE WHEN doc_id % 6 = 0 THEN 'R' END AS mpaa_rating,
  CASE WHEN doc_id % 7 <> 0 THEN CAST(1880 + (doc_id % 24) * 10 + CASE WHEN doc_id % 8 = 0 THEN 5 ELSE 0 END AS INT) END
    AS decade
FROM documents"""

_JUDGED = f"""
SELECT *, CASE WHEN query = '' OR length(query) > 1000 THEN 'q' WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k'
  WHEN min_imdb_rating NOT BETWEEN 0 AND 10 THEN 'min_imdb_rating'
  WHEN decade NOT BETWEEN 1900 AND 2100 OR decade % 10 <> 0 THEN 'decade' END AS invalid_param
FROM ({_REQUESTS})"""

_KEY = """concat_ws('|', 'search', lower(query), CAST(top_k AS VARCHAR), coalesce(lower(genre), '-'),
  coalesce(CAST(CAST(min_imdb_rating AS DECIMAL(4,1)) AS VARCHAR), '-'), coalesce(lower(mpaa_rating), '-'),
  coalesce(CAST(decade AS VARCHAR), '-'))"""


def catalogue_requests(shared: Shared):
    """One request per benchmark text, some filtered, searched in the catalogue by its own vector."""
    i = F.col("item_id")
    asked = shared.table("benchmark").select(
        i.alias("request_id"),
        embedded(F.col("text"), offline_embedder())["vector"].alias("vector"),
        (5 + i % 7).cast("int").alias("top_k"),
        F.when(i % 2 == 0, F.lit("ECONOMY")).alias("genre"),
        F.when(i % 3 == 0, 6.5).alias("min_imdb_rating"),
        F.when(i % 4 == 0, F.lit("R")).alias("mpaa_rating"),
        F.when(i % 5 == 0, 1990).alias("decade"),
    )
    return asked


_CATALOGUE_REQUESTS = [
    ("asked_vectors", sql.vectors("benchmark", "item_id", "text")),
    ("asked", """
      SELECT item_id AS request_id, v.embedding AS vector, CAST(5 + item_id % 7 AS INT) AS top_k,
        CASE WHEN item_id % 2 = 0 THEN 'ECONOMY' END AS genre, CASE WHEN item_id % 3 = 0 THEN 6.5 END AS min_rating,
        CASE WHEN item_id % 4 = 0 THEN 'R' END AS certificate, CASE WHEN item_id % 5 = 0 THEN 1990 END AS dec
      FROM benchmark LEFT JOIN asked_vectors v ON v.k = item_id"""),
    ("pairs", f"""
      SELECT request_id, id, top_k, {_similarity('a.vector', 'm.embedding')} AS s FROM asked a JOIN snapshot m
      ON (a.genre IS NULL OR m.major_genre = a.genre) AND (a.min_rating IS NULL OR m.imdb_rating >= a.min_rating)
        AND (a.certificate IS NULL OR m.mpaa_rating = a.certificate) AND (a.dec IS NULL OR m.decade = a.dec)
      WHERE m.embedding IS NOT NULL"""),
]


def register(r: Registry) -> None:
    def rows(spark, sf):
        return Shared.of(spark, sf).table("embeddings")

    def holed(spark, sf):
        """Vectors with gaps: every seventeenth is missing."""
        return rows(spark, sf).withColumn(
            "embedding", F.when(F.col("vec_id") % 17 != 0, F.col("embedding")))

    @r.add("s6_vector_text", """
        SELECT vec_id, CAST(len(embedding) AS INT) AS width, true AS same, true AS bracketed FROM embeddings""")
    def s6(spark, sf):
        written = rows(spark, sf).withColumn("t", vector.to_text(F.col("embedding")))
        return written.select(
            "vec_id", F.size(vector.from_text(F.col("t"))).alias("width"),
            (vector.from_text(F.col("t")) == F.col("embedding")).alias("same"),
            (F.col("t").startswith("[") & F.col("t").endswith("]")).alias("bracketed"))

    @r.add("s7_vector_width", """
        SELECT count_if(vec_id % 100 = 0)::BIGINT AS wrong_width FROM embeddings""")
    def s7(spark, sf):
        cut = F.when(F.col("vec_id") % 100 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))
        return wrong_widths(rows(spark, sf).withColumn("embedding", cut), S.EMBEDDING_WIDTH)

    @r.add("v1_cosine_similarity", f"""
        SELECT a.vec_id, round({_similarity('a.embedding', 'b.embedding')}, 9) AS similarity,
          round(1 - {_similarity('a.embedding', 'b.embedding')}, 8) AS distance
        FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b""")
    def v1(spark, sf):
        target = rows(spark, sf).filter("vec_id = 0").first()["embedding"]
        other = F.array(*[F.lit(float(x)) for x in target])
        score = vector.cosine(F.col("embedding"), other)
        return rows(spark, sf).select("vec_id", F.round(score, 9).alias("similarity"),
                                      F.round(1 - score, 8).alias("distance"))

    hybrid = """
        SELECT vec_id, label, {shown} AS similarity FROM (
          SELECT a.vec_id, a.label, {s} AS s FROM embeddings a,
            (SELECT embedding, label FROM embeddings WHERE vec_id = 0) b
          WHERE a.label = b.label AND a.vec_id <> 0) ORDER BY round(s, 9) DESC, vec_id LIMIT 10"""

    @r.add("v2_hybrid_search", hybrid.format(s=_similarity("a.embedding", "b.embedding"), shown=_shown("s")))
    def v2(spark, sf):
        target = rows(spark, sf).filter("vec_id = 0").first()
        return search.search(rows(spark, sf), target["embedding"], 10, [F.col("label") == target["label"]],
                             id="vec_id", columns=["vec_id", "label"], not_id=0)

    shown = {c: S.STORED_TYPES.get(c, "string") for c in S.RESULT_COLUMNS}

    @r.add("p3_optional_filters", sql.upto("snapshot", f"""
        SELECT {plain_sql(shown)}, {_shown('s')} AS similarity FROM (
          SELECT m.*, {_similarity('m.embedding', 'b.embedding')} AS s FROM snapshot m,
            (SELECT embedding FROM asked_vectors WHERE k = 0) b
          WHERE m.embedding IS NOT NULL AND major_genre = 'ECONOMY' AND imdb_rating >= 5.5 AND decade = 1990)
        ORDER BY round(s, 9) DESC, id LIMIT 50""", ("asked_vectors", sql.vectors("benchmark", "item_id", "text"))))
    def p3(spark, sf):
        shared = Shared.of(spark, sf)
        target = catalogue_requests(shared).filter("request_id = 0").first()["vector"]
        wanted = search.optional_filters(genre="ECONOMY", min_imdb_rating=5.5, mpaa_rating=None, decade=1990)
        return plain(search.search(shared.snapshot, target, 50, wanted))

    @r.add("p3_observed_ratings_only", sql.upto("snapshot", """
        SELECT id, CAST(imdb_rating AS DOUBLE) AS imdb_rating FROM snapshot
        WHERE imdb_rating >= 5.5 AND NOT list_contains(imputed_fields, 'imdb_rating')"""))
    def p3_observed(spark, sf):
        wanted = search.optional_filters(min_imdb_rating=5.5, exclude_imputed=True)
        return plain(search.filtered(Shared.of(spark, sf).snapshot, wanted).select("id", "imdb_rating"))

    @r.add("p4_rows_by_id", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)")
    def p4(spark, sf):
        ids = Shared.of(spark, sf).table("labels").select(F.col("doc_id").alias("vec_id"))
        return search.by_id(rows(spark, sf), ids, "vec_id").select("vec_id", "label")

    @r.add("p6_self_excluded", _top(f"""
        SELECT a.vec_id AS request_id, b.vec_id AS id, {_similarity('a.embedding', 'b.embedding')} AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id""", "1"))
    def p6(spark, sf):
        return search.top_k_per_request(rows(spark, sf), rows(spark, sf), 1, not_self=True, id="vec_id",
                                        request_id="vec_id", request_vector="embedding")

    @r.add("p7_searchable_rows", "SELECT vec_id, label FROM embeddings WHERE vec_id % 17 <> 0")
    def p7(spark, sf):
        return search.searchable(holed(spark, sf)).select("vec_id", "label")

    @r.add("p9_request_validation", f"SELECT * FROM ({_JUDGED})")
    def p9(spark, sf):
        return requests.validated(request_rows(spark, sf))

    @r.add("p10_request_keys", f"""
        SELECT {_KEY} AS request_key, min(request_id) AS request_id, count(*) AS asked
        FROM ({_JUDGED}) WHERE invalid_param IS NULL GROUP BY 1""")
    def p10(spark, sf):
        return requests.distinct_requests(requests.valid_only(request_rows(spark, sf)))

    neighbours = f"""
        SELECT vec_id, label, {_shown('s')} AS similarity FROM (
          SELECT a.vec_id, a.label, {_similarity('a.embedding', 'b.embedding')} AS s FROM embeddings a,
            (SELECT embedding FROM embeddings WHERE vec_id = 1) b WHERE a.vec_id <> 1 AND a.vec_id % 17 <> 0)
        ORDER BY round(s, 9) DESC, vec_id LIMIT 10"""

    @r.add("v3_neighbours", neighbours)
    def v3(spark, sf):
        return search.neighbours(holed(spark, sf), 1, 10, "vec_id", columns=["vec_id", "label"])

    all_pairs = f"""
        SELECT a.vec_id AS request_id, b.vec_id AS id, {_similarity('a.embedding', 'b.embedding')} AS s
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 17 <> 0 AND b.vec_id % 17 <> 0"""

    @r.add("v3_all_neighbours", _top(all_pairs, "5"))
    def v3_all(spark, sf):
        return search.top_k_per_request(holed(spark, sf), holed(spark, sf), 5, not_self=True, id="vec_id",
                                        request_id="vec_id", request_vector="embedding")

    @r.add("v4_batch_search", sql.upto("snapshot", _top("SELECT * FROM pairs", "top_k"), *_CATALOGUE_REQUESTS))
    def v4(spark, sf):
        shared = Shared.of(spark, sf)
        return search.top_k_per_request(
            shared.snapshot, catalogue_requests(shared),
            equal={"major_genre": "genre", "mpaa_rating": "mpaa_rating", "decade": "decade"},
            minimum={"imdb_rating": "min_imdb_rating"})

    judged = _JUDGED.replace("upper(lang)", "'ECONOMY'")

    @r.add("v4_text_search", sql.upto(
        "snapshot", f"""
        SELECT j.request_id, j.invalid_param, t.rank, t.similarity, t.id, m.title,
          CASE WHEN j.invalid_param IS NOT NULL THEN 'invalid' WHEN t.id IS NULL THEN 'no match' ELSE 'ok' END AS status
        FROM judged j LEFT JOIN top t USING (request_id) LEFT JOIN snapshot m ON m.id = t.id""",
        ("judged", judged), ("good", "SELECT * FROM judged WHERE invalid_param IS NULL"),
        ("asked", sql.vectors("good", "request_id", "'search_query: ' || query")),
        ("top", _top(f"""
          SELECT g.request_id, m.id, g.top_k, {_similarity('a.embedding', 'm.embedding')} AS s
          FROM good g JOIN asked a ON a.k = g.request_id JOIN snapshot m
          ON (g.genre IS NULL OR m.major_genre = g.genre) AND (g.min_imdb_rating IS NULL OR m.imdb_rating >= g.min_imdb_rating)
            AND (g.mpaa_rating IS NULL OR m.mpaa_rating = g.mpaa_rating) AND (g.decade IS NULL OR m.decade = g.decade)
          WHERE m.embedding IS NOT NULL""", "top_k"))))
    def v4_text(spark, sf):
        shared = Shared.of(spark, sf)
        asked = request_rows(spark, sf).withColumn(
            "genre", F.when(F.col("request_id") % 3 == 0, "ECONOMY").when(F.col("request_id") % 3 == 1, F.lit("  ")))
        return batch.search_texts(asked, shared.snapshot, offline_embedder(), "search_query:", ["id", "title"])

    @r.add("v4_batch_search_within_label", _top(f"""
        SELECT a.vec_id AS request_id, b.vec_id AS id, {_similarity('a.embedding', 'b.embedding')} AS s
        FROM embeddings a JOIN embeddings b ON a.label = b.label""", "10"))
    def v4_label(spark, sf):
        return search.top_k_per_request(rows(spark, sf), rows(spark, sf), 10, equal={"label": "label"}, id="vec_id",
                                        request_id="vec_id", request_vector="embedding")

    @r.add("v4_batch_search_in_grid", _top(all_pairs.replace("ON a.vec_id <> b.vec_id", "ON true"), "10"))
    def v4_grid(spark, sf):
        # Held requests limited to a sixteenth of what there is, so that the grid is taken.
        held = rows(spark, sf).count() * S.EMBEDDING_WIDTH * 8 // 16
        return search.top_k_per_request(holed(spark, sf), holed(spark, sf), 10, id="vec_id", request_id="vec_id",
                                        request_vector="embedding", held_bytes=held)

    @r.add("v4_search_results", sql.upto("snapshot", f"""
        SELECT t.request_id, t.similarity, t.rank, {plain_sql(shown, 'm.')}
        FROM ({_top("SELECT * FROM pairs", "top_k")}) t JOIN snapshot m USING (id)""", *_CATALOGUE_REQUESTS))
    def v4_rows(spark, sf):
        shared = Shared.of(spark, sf)
        return plain(search.with_rows(v4(spark, sf), shared.snapshot))

    @r.add("v5_presented_similarity", f"""
        SELECT a.vec_id, CASE WHEN a.vec_id % 17 <> 0 THEN {_shown('s')} END AS similarity
        FROM (SELECT a.vec_id, {_similarity('a.embedding', 'b.embedding')} * 1.5 - 0.25 AS s
          FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 2) b) a""")
    def v5(spark, sf):
        target = rows(spark, sf).filter("vec_id = 2").first()["embedding"]
        other = F.array(*[F.lit(float(x)) for x in target])
        stretched = vector.cosine(F.col("embedding"), other) * 1.5 - 0.25
        return holed(spark, sf).select("vec_id", vector.presented(stretched).alias("similarity"))

    # Cells by the same draw, and the same three quarters of them probed.
    @r.add("v6_approximate_search", f"""
        WITH sized AS (SELECT CAST(ceil(sqrt(count(embedding))) AS INT) AS cells FROM embeddings),
          centres AS (SELECT embedding AS centre, row_number() OVER (ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0
            QUALIFY cell < (SELECT cells FROM sized)),
          near AS (SELECT e.vec_id, e.embedding, c.cell, row_number() OVER (PARTITION BY e.vec_id
            ORDER BY round({_similarity('e.embedding', 'c.centre')}, 9) DESC, c.cell) AS place FROM embeddings e, centres c),
          found AS ({_top(f"""
        SELECT a.vec_id AS request_id, b.vec_id AS id, {_similarity('a.embedding', 'b.embedding')} AS s FROM near a JOIN near b
        ON a.cell = b.cell AND a.place <= ceil((SELECT cells FROM sized) * 3 / 4.0) AND b.place = 1 AND a.vec_id <> b.vec_id""", "10")})
        SELECT * FROM found""")
    def v6(spark, sf):
        index = cells.stored(cells.build(rows(spark, sf), id="vec_id"))
        return cells.search(index, rows(spark, sf), 10, id="vec_id", request_id="vec_id", request_vector="embedding", not_self=True)

    @r.add("v6_signature_search")
    def v6_signature(spark, sf):
        return search.approximate_search(rows(spark, sf), rows(spark, sf), 10, id="vec_id", request_id="vec_id",
                                         request_vector="embedding", not_self=True)

    recall = """
        SELECT count(*) AS requests, true AS nine_of_ten_found FROM embeddings WHERE embedding IS NOT NULL"""

    def found_share(spark, sf, near):
        """The approximate answers held against the exact ones."""
        exact = search.top_k_per_request(rows(spark, sf), rows(spark, sf), 10, id="vec_id", request_id="vec_id", request_vector="embedding",
                                         not_self=True).select("request_id", "id")
        near = near.select("request_id", "id", F.lit(1).alias("hit"))
        return exact.join(near, ["request_id", "id"], "left").agg(
            F.count_distinct("request_id").alias("requests"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_of_ten_found"))

    @r.add("v6_recall", recall)
    def v6_recall(spark, sf):
        return found_share(spark, sf, v6(spark, sf))

    @r.add("v6_signature_recall", recall)
    def v6_signature_recall(spark, sf):
        return found_share(spark, sf, v6_signature(spark, sf))

    # A label's rows fit the candidate budget here, so what is found is exact.
    @r.add("v6_approximate_filtered", _top(f"""
        SELECT a.vec_id AS request_id, b.vec_id AS id, {_similarity('a.embedding', 'b.embedding')} AS s
        FROM embeddings a JOIN embeddings b ON a.label = b.label""", "10"))
    def v6_filtered(spark, sf):
        return search.approximate_search(
            rows(spark, sf), rows(spark, sf), 10, equal={"label": "label"}, id="vec_id",
            request_id="vec_id", request_vector="embedding")

    @r.add("x2_seeded_sample", """
        SELECT vec_id, label FROM embeddings ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 200""")
    def x2(spark, sf):
        return export.seeded_sample(rows(spark, sf).select("vec_id", "label"), 200, 42, "vec_id")

    @r.add("x3_planar_projection")
    def x3(spark, sf):
        return export.planar(rows(spark, sf)).select("vec_id", "label", "x", "y")

    @r.add("x3_projection_properties", """
        SELECT count(*) AS rows, true AS uncorrelated, true AS first_is_widest, true AS within_unit_length FROM embeddings""")
    def x3_properties(spark, sf):
        """What holds of principal components of unit vectors, whatever the order of sums."""
        plane = export.planar(rows(spark, sf))
        return plane.agg(
            F.count("*").alias("rows"), (F.abs(F.corr("x", "y")) < 1e-3).alias("uncorrelated"),
            (F.var_pop("x") >= F.var_pop("y")).alias("first_is_widest"),
            (F.max(F.col("x") * F.col("x") + F.col("y") * F.col("y")) <= 1.000001).alias("within_unit_length"))
