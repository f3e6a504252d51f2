"""Title lookup on the part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import trigram
from cinefold.operators import titles
from cinefold.plans.registry import Registry
from cinefold.plans.registry.base import Shared

COLUMNS = ["id", "title", "release_year"]


def ordered_sql(x: str) -> str:
    return (f"flatten(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: "
            f"list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))")


def set_similarity_sql(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CAST({shared} AS DOUBLE) / (len({a}) + len({b}) - {shared}))"


def best_extent_sql(source: str, keys: str) -> str:
    """Best similarity of ``q`` (a set) to any stretch of ``o`` (ordered trigrams), by trying all."""
    return f"""
      SELECT {keys}, max({set_similarity_sql('q', 'list_distinct(o[lo:hi])')}) AS word_score
      FROM {source} JOIN range(1, 400) a(lo) ON lo <= len(o) JOIN range(1, 400) b(hi) ON hi BETWEEN lo AND len(o)
      GROUP BY {keys}"""


_MOVIES = """
SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 7 <> 0 THEN 1950 + p_size END AS release_year FROM part"""

# Queries from the part names: spelled in another case, with a letter left out, cut to one
# word with an error, and one that matches nothing.
_QUERIES = """
SELECT p_name || '/' || kind AS query_id,
  CASE kind WHEN 'case' THEN '  ' || upper(p_name) || ' ' WHEN 'typo' THEN substr(p_name, 1, 2) || substr(p_name, 4)
    WHEN 'part' THEN substr(p_name, 1, 5) ELSE 'qqqqq wwwww ' || substr(p_name, 1, 1) END AS query
FROM (SELECT DISTINCT p_name FROM part) CROSS JOIN (VALUES ('case'), ('typo'), ('part'), ('none')) k(kind)"""


def movies(spark, sf):
    year = F.when(F.col("p_size") % 7 != 0, F.col("p_size") + 1950)
    return Shared.of(spark, sf).table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), year.alias("release_year"))


def queries(spark, sf):
    name, kind = F.col("p_name"), F.col("kind")
    text = (
        F.when(kind == "case", F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
        .when(kind == "typo", F.concat(F.substring(name, 1, 2), F.expr("substr(p_name, 4)")))
        .when(kind == "part", F.substring(name, 1, 5))
        .otherwise(F.concat(F.lit("qqqqq wwwww "), F.substring(name, 1, 1)))
    )
    names = Shared.of(spark, sf).table("part").select("p_name").distinct()
    kinds = F.explode(F.array(*[F.lit(k) for k in ("case", "typo", "part", "none")]))
    return names.withColumn("kind", kinds).select(
        F.concat_ws("/", name, kind).alias("query_id"), text.alias("query"))


_NEWEST = "ORDER BY release_year DESC NULLS LAST, id"
_EXACT = f"""
SELECT query_id, query, id, title, release_year FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id {_NEWEST}) AS place
  FROM queries JOIN movies ON lower(title) = lower(trim(query))) WHERE place = 1"""

_BASE = [
    ("movies", _MOVIES),
    ("queries", _QUERIES),
    ("pairs", f"""
      SELECT query_id, query, title, list_distinct({ordered_sql('query')}) AS q, {ordered_sql('title')} AS o
      FROM queries CROSS JOIN (SELECT DISTINCT title FROM movies)"""),
    ("words", best_extent_sql("pairs", "query_id, query, title")),
    ("scored", f"""
      SELECT query_id, query, title,
        greatest({set_similarity_sql('q', 'list_distinct(o)')}, coalesce(word_score, 0)) AS score
      FROM pairs LEFT JOIN words USING (query_id, query, title)"""),
    ("fuzzy", f"""
      SELECT query_id, query, id, title, release_year, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id
          ORDER BY score DESC, length(title), release_year DESC NULLS LAST, id) AS place
        FROM scored JOIN movies USING (title) WHERE score >= {S.TITLE_THRESHOLD}) WHERE place = 1"""),
    ("exact", _EXACT),
]


def _with(query: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in _BASE) + "\n" + query


def register(r: Registry) -> None:
    @r.add("p5_exact_titles", _with("SELECT * FROM exact"))
    def p5(spark, sf):
        return titles.exact_titles(queries(spark, sf), movies(spark, sf), COLUMNS)

    @r.add("t1_trigrams", f"""
        SELECT p_partkey, array_to_string({ordered_sql('p_name')}, ',') AS ordered,
          array_to_string(list_sort(list_distinct({ordered_sql('p_name')})), ',') AS trigrams FROM part""")
    def t1(spark, sf):
        name = F.col("p_name")
        return Shared.of(spark, sf).table("part").select(
            "p_partkey", F.array_join(trigram.ordered_trigrams(name), ",").alias("ordered"),
            F.array_join(F.array_sort(trigram.trigrams(name)), ",").alias("trigrams"))

    other = "lower(p_type) || ' ' || substr(p_name, 2)"

    @r.add("t2_set_similarity", f"""
        SELECT p_partkey, {set_similarity_sql('a', 'b')} AS similarity FROM (
          SELECT p_partkey, list_distinct({ordered_sql('p_name')}) AS a, list_distinct({ordered_sql(other)}) AS b
          FROM part)""")
    def t2(spark, sf):
        score = trigram.set_similarity(trigram.trigrams(F.col("p_name")), trigram.trigrams(F.expr(other)))
        return Shared.of(spark, sf).table("part").select("p_partkey", score.alias("similarity"))

    typo, target = "substr(p_name, 1, 3) || substr(p_name, 5)", "p_name || ' ' || p_type || ' ' || p_brand"

    @r.add("t3_word_similarity", f"""
        WITH p AS (SELECT p_partkey, list_distinct({ordered_sql(typo)}) AS q, {ordered_sql(target)} AS o FROM part)
        SELECT p_partkey, word_score AS similarity FROM ({best_extent_sql('p', 'p_partkey')})""")
    def t3(spark, sf):
        score = trigram.word_similarity(F.expr(typo), F.expr(target))
        # Names pack into few splits, so they are spread before the costly step.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = Shared.of(spark, sf).table("part").select("p_partkey", "p_name", "p_type", "p_brand").repartition(parts, "p_partkey")
        return rows.select("p_partkey", score.alias("similarity"))

    @r.add("t4_fuzzy_titles", _with("""
        SELECT query_id, query, id, title, release_year, score AS title_score FROM fuzzy"""))
    def t4(spark, sf):
        return titles.fuzzy_titles(queries(spark, sf), movies(spark, sf), COLUMNS)

    @r.add("t5_title_candidates", _with(f"""
        SELECT query_id, query, title, score FROM scored WHERE score >= {S.TITLE_THRESHOLD}"""))
    def t5(spark, sf):
        return titles.fuzzy_scores(queries(spark, sf), movies(spark, sf).select("title").distinct())

    @r.add("t6_title_lookup", _with("""
        SELECT *, 'exact' AS matched FROM exact UNION ALL
        SELECT query_id, query, id, title, release_year, 'fuzzy' FROM fuzzy
        WHERE query_id NOT IN (SELECT query_id FROM exact)"""))
    def t6(spark, sf):
        return titles.lookup(queries(spark, sf), movies(spark, sf), COLUMNS)
