"""The registered queries opN_..., each over its whole table, and their checks in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm import (contamination, conversations, infilling, licences, mixing, outliers, packing, personal, secret_scan, simhash, streaming_packing,
                          suffixes, warc)
from cinefold.llm.common import n_words, table


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_covariance_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, personal.KINDS), F.sha2(told(F.col("base")), 256).alias("base_sha256"),
                        told(F.concat("base", "discovered")).alias("spans"))


def op4_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", "word", "part", F.sha2("token", 256).alias("token_sha256"), "score", "kept")


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_licence_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in the folder of its source and language."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    return licences.licences(docs.select("doc_id", path.alias("path"), "text"))


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), compression="gzip")


def op9_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    taken = mixing.plan(sized).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infilling.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = lambda text: F.sha2(text, 256)
    return found.select("row.doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
                        F.char_length("middle").cast("long").alias("middle_chars"), hashed("output").alias("output_sha256"),
                        hashed(infilling.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_streaming_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = streaming_packing.segments(streaming_packing.pack(table(spark, sf_dir, "documents")))
    return pieces.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = [op1_token_packing, op2_covariance_outliers, op3_bootstrapped_pii, op4_forest_secrets, op5_suffix_repeats,
           op6_licence_inheritance, op7_simhash_anchors, op8_warc_chains, op9_bm25_decontamination, op10_cube_mixing,
           op11_conversation_repair, op12_infilling, op13_streaming_packing]
def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _repair_sql() -> str:
    """Row by row, the least (cost, audit) that leads to each state of the pattern: 1 nothing yet, 2 behind s, 3 behind u, 4 behind a."""
    far = 1_000_000_000

    def way(state: str, cost: str, letters: str, allowed: str = "true") -> str:
        return f"{{'c': {state}.c + CASE WHEN {allowed} THEN {cost} ELSE {far} END, 'a': {state}.a || '{letters}'}}"

    def inserted(b: str) -> list[str]:
        return [f"{b}1", f"{b}2", _least(f"{b}3", *(way(f"{b}{q}", "2", "I") for q in (1, 2, 4))),
                _least(f"{b}4", way(f"{b}3", "2", "I"), way(f"{b}1", "4", "II"), way(f"{b}2", "4", "II"))]

    free, more = "r.fault NOT IN ('blank', 'duplicate')", "CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END"
    kept = lambda q, initial: way(f"v{q}", more, "K", f"{free} AND r.initial = '{initial}'")
    rerole = lambda q: way(f"v{q}", f"2 + {more}", "R", free)
    gone = lambda q: way(f"v{q}", "3", "D")
    rows = [gone(1), _least(gone(2), kept(1, "s")), _least(gone(3), *(kept(q, "u") for q in (1, 2, 4)), *map(rerole, (1, 2, 4))),
            _least(gone(4), kept(3, "a"), rerole(3))]
    named = lambda values, name: ", ".join(f"{v} AS {name}{q}" for q, v in enumerate(values, 1))
    start = ["{'c': CAST(0 AS BIGINT), 'a': ''}", *[f"{{'c': CAST({far} AS BIGINT), 'a': ''}}"] * 3]
    return rf"""
        WITH RECURSIVE filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
          kinds AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
              lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END)), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM filled),
          damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds),
          placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial FROM damaged),
          flagged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
          ways AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {named(start, "b")} FROM (SELECT DISTINCT conv_id FROM placed)
            UNION ALL SELECT conv_id, i, {named(rows, "b")} FROM (
              SELECT r.conv_id, r.i, r.initial, r.fault, {named(inserted("w.b"), "v")} FROM ways w JOIN flagged r
              ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1) r),
          ends AS (SELECT conv_id, {_least("v1", "v4")} AS best FROM (SELECT conv_id, {named(inserted("w.b"), "v")} FROM ways w
            QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
          letters AS (SELECT conv_id, best.a AS audit, unnest(range(1, length(best.a) + 1)) AS p FROM ends),
          spelled AS (SELECT conv_id, p, audit[p] AS letter, sum(CASE WHEN audit[p] <> 'I' THEN 1 ELSE 0 END) OVER w AS i,
            sum(CASE WHEN audit[p] <> 'D' THEN 1 ELSE 0 END) OVER w AS j,
            sum(CASE WHEN audit[p] <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS m FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
          lines AS (SELECT s.conv_id, s.p, CASE WHEN letter = 'K' THEN f.role WHEN (j + m) % 2 = 1 THEN 'user' ELSE 'assistant' END
              || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
            FROM spelled s LEFT JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i WHERE letter <> 'D'),
          texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY p)) AS digest FROM lines GROUP BY conv_id),
          counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
            count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id)
        SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
          coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
          coalesce(digest, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""


#: The others need hashes, models or draws that SQL does not have; the tests hold them against brute force.
CHECKS: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op12_infilling": r"""
        WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
          cut AS (SELECT *, CAST(len(units) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS d FROM drawn),
          formed AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
            CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM cut),
          parts AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
            array_to_string(units[b + 1:n], '') AS suffix FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM parts""",
    "op8_warc_chains": """
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN again THEN first_id END AS refers_to
        FROM (SELECT *, payload_bytes >= 100 AND page_id <> first_id AS again FROM (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
            min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages))""",
}


def register(registry) -> None:
    for query in QUERIES:
        registry.add(query.__name__, CHECKS.get(query.__name__))(query)
