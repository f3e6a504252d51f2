"""Embedding and incremental merge, on the catalogue as stored and an edited copy as incoming.

The edits go by the hexadecimal digits of the row identifier, which both engines derive
from the key: some keys are new, some are gone, some rows changed only a number, some
their text, some stored rows lack a vector or carry another model or version, and the
embedding service refuses some texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.functions import text
from cinefold.operators import embedding, features, merge
from cinefold.operators.embedding import Rejected, hashed_words
from cinefold.plans import refresh
from cinefold.plans.registry import Registry, sql
from cinefold.plans.registry.base import RUN_TIME, VERSION, Shared, plain, plain_sql
from cinefold.session import scratch_path, step_table
from cinefold.sources import deltas

MODEL = "hashed-words-64"
REFUSED = "Runtime: 99 minutes"
LATER = "2024-02-01 00:00:00"


def _digit(place: int, digits: str) -> Column:
    return F.substring(F.sha2("source_key", 256), place, 1).isin(list(digits))


def refusing_service():
    """The offline embedder, refusing every batch that holds a text with the marked line."""
    service = hashed_words()

    def embed(texts: list[str]):
        if any(REFUSED in t for t in texts):
            raise Rejected("text refused")
        return service(texts)

    return embed


def refusing_embedder(**options) -> embedding.Embedder:
    return embedding.Embedder(MODEL, refusing_service, **options)


def stored_rows(shared: Shared) -> DataFrame:
    bare, older = _digit(2, "0"), _digit(2, "1")
    return shared.snapshot.filter(~_digit(1, "f")).withColumns({
        "embedding": F.when(~bare, F.col("embedding")),
        "embedded_text_hash": F.when(~bare, F.col("embedded_text_hash")),
        "embedding_model": F.when(older, F.lit("older-model")).when(~bare, F.col("embedding_model")),
        "pipeline_version": F.when(_digit(3, "2"), F.lit("0.9.0")).otherwise(F.col("pipeline_version")),
    })


def incoming_rows(shared: Shared) -> DataFrame:
    edited = shared.enriched.drop("ord").filter(~_digit(1, "e")).withColumns({
        "us_gross": F.when(_digit(4, "01"), F.coalesce("us_gross", F.lit(0)) + 1).otherwise(F.col("us_gross")),
        "augmented_text": F.when(_digit(4, "0"), F.concat("augmented_text", F.lit("\nRevised edition")))
        .otherwise(F.col("augmented_text")),
    })
    return features.with_fingerprint(edited)


def merged_rows(shared: Shared) -> merge.Merge:
    """The refused-texts run, made once per session."""
    if "merged_edits" not in shared.__dict__:
        shared.__dict__["merged_edits"] = merge.merge(
            stored_rows(shared), step_table(incoming_rows(shared), "incoming"), refusing_embedder(), VERSION,
            F.lit(LATER).cast("timestamp"))
    return shared.__dict__["merged_edits"]


def vector_digits(vector: Column) -> Column:
    """A vector as text, each entry in millionths."""
    scaled = F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return F.array_join(scaled, ",")


def vector_digits_sql(vector: str) -> str:
    return (f"array_to_string(list_transform({vector}, lambda x: "
            f"CAST(CAST(round(CAST(x AS DOUBLE) * 1e6) AS BIGINT) AS VARCHAR)), ',')")


def _digit_sql(place: int, digits: str) -> str:
    return f"substr(id, {place}, 1) IN ({', '.join(repr(d) for d in digits)})"


_INCOMING_COLUMNS = [c for c in S.STORED_TYPES if not c.startswith(("embedding", "pipeline"))]


def _steps() -> list[tuple[str, str]]:
    kept = ", ".join(c for c in _INCOMING_COLUMNS if c not in ("us_gross", "augmented_text", "content_hash"))
    needs = """i.source_key IS NOT NULL AND (s.source_key IS NULL OR s.embedding IS NULL
      OR s.embedded_text_hash IS DISTINCT FROM sha256(i.augmented_text)
      OR s.embedding_model IS DISTINCT FROM 'hashed-words-64')"""
    return [
        ("stored", f"""
          SELECT * EXCLUDE (embedding, embedded_text_hash, embedding_model, pipeline_version),
            CASE WHEN NOT {_digit_sql(2, '0')} THEN embedding END AS embedding,
            CASE WHEN NOT {_digit_sql(2, '0')} THEN embedded_text_hash END AS embedded_text_hash,
            CASE WHEN {_digit_sql(2, '1')} THEN 'older-model' WHEN NOT {_digit_sql(2, '0')}
              THEN embedding_model END AS embedding_model,
            CASE WHEN {_digit_sql(3, '2')} THEN '0.9.0' ELSE pipeline_version END AS pipeline_version
          FROM snapshot WHERE NOT {_digit_sql(1, 'f')}"""),
        ("edited", f"""
          SELECT id, {kept}, CASE WHEN {_digit_sql(4, '01')} THEN coalesce(us_gross, 0) + 1 ELSE us_gross END AS us_gross,
            CASE WHEN {_digit_sql(4, '0')} THEN augmented_text || chr(10) || 'Revised edition'
              ELSE augmented_text END AS augmented_text
          FROM snapshot WHERE NOT {_digit_sql(1, 'e')}"""),
        ("incoming", f"SELECT *, {sql.fingerprint()} AS content_hash FROM edited"),
        ("fresh", sql.vectors("incoming", "source_key", "augmented_text")),
        ("paired", f"""
          SELECT coalesce(i.source_key, s.source_key) AS source_key, i.source_key IS NOT NULL AS has_i,
            s.source_key IS NOT NULL AS has_s, {needs} AS needed, i AS i, s AS s,
            CASE WHEN {needs} AND NOT contains(i.augmented_text, '{REFUSED}') THEN f.embedding END AS arrived
          FROM incoming i FULL OUTER JOIN stored s ON s.source_key = i.source_key
          LEFT JOIN fresh f ON f.k = i.source_key"""),
        ("judged", f"""
          SELECT *, CASE WHEN arrived IS NOT NULL THEN '{MODEL}' ELSE s.embedding_model END AS model,
            CASE WHEN NOT has_i THEN 'kept' WHEN NOT has_s AND arrived IS NULL THEN 'held_back'
              WHEN NOT has_s THEN 'inserted'
              WHEN s.content_hash IS DISTINCT FROM i.content_hash OR (s.embedding IS NULL AND arrived IS NOT NULL)
                OR s.embedding_model IS DISTINCT FROM CASE WHEN arrived IS NOT NULL THEN '{MODEL}' ELSE s.embedding_model END
                OR s.pipeline_version IS DISTINCT FROM '{VERSION}' THEN 'updated'
              ELSE 'unchanged' END AS action
          FROM paired"""),
    ]


def _merged(query: str) -> str:
    return sql.upto("snapshot", query, *_steps())


def register(r: Registry) -> None:
    @r.add("e1_prefixed_text", """
        SELECT doc_id, 'passage: ' || text AS document, text AS bare FROM documents""")
    def e1(spark, sf):
        return Shared.of(spark, sf).table("documents").select(
            "doc_id", text.with_prefix("  passage: ", F.col("text")).alias("document"),
            text.with_prefix("  ", F.col("text")).alias("bare"))

    @r.add("e2_rows_needing_vectors", _merged("""
        SELECT source_key, needed AS needs_embedding FROM paired WHERE has_i"""))
    def e2(spark, sf):
        shared = Shared.of(spark, sf)
        return merge.needing_vectors(stored_rows(shared), incoming_rows(shared), MODEL)

    @r.add("e3_embedded_documents", f"""
        WITH v AS ({sql.vectors('documents', 'doc_id', 'text')})
        SELECT doc_id, {vector_digits_sql('embedding')} AS vector FROM documents JOIN v ON k = doc_id""")
    def e3(spark, sf):
        # A few large row groups hold all texts, so they are spread before the costly step.
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        texts = Shared.of(spark, sf).table("documents").select("doc_id", "text").repartition(parts, "doc_id")
        vector = embedding.embedded(F.col("text"), embedding.offline_embedder())["vector"]
        rows = texts.select("doc_id", vector.alias("v"))
        return rows.select("doc_id", vector_digits(F.col("v")).alias("vector"))

    @r.add("e4_failure_isolation", sql.upto("enriched", f"""
        SELECT source_key, contains(augmented_text, '{REFUSED}') AS lost,
          CASE WHEN contains(augmented_text, '{REFUSED}') THEN 'Rejected: text refused' END AS error
        FROM enriched"""))
    def e4(spark, sf):
        rows = Shared.of(spark, sf).enriched.select(
            "source_key", embedding.embedded(F.col("augmented_text"), refusing_embedder(batch_size=8)).alias("e"))
        return rows.select("source_key", F.col("e.vector").isNull().alias("lost"), F.col("e.error").alias("error"))

    @r.add("e5_vectors_attached", _merged(f"""
        SELECT source_key, {vector_digits_sql('arrived')} AS arrived FROM paired WHERE has_i"""))
    def e5(spark, sf):
        shared = Shared.of(spark, sf)
        needed = merge.needing_vectors(stored_rows(shared), incoming_rows(shared), MODEL)
        rows = incoming_rows(shared).select("source_key", "augmented_text").join(needed, "source_key")
        sent = F.when(F.col("needs_embedding"), F.col("augmented_text"))
        made = rows.select("source_key", embedding.embedded(sent, refusing_embedder()).alias("e"))
        return made.select("source_key", vector_digits(F.col("e.vector")).alias("arrived"))

    @r.add("e6_embedding_report", _merged("""
        SELECT count_if(needed AND arrived IS NOT NULL)::BIGINT AS embedded,
          count_if(has_i AND NOT needed)::BIGINT AS reused,
          count_if(needed AND arrived IS NULL)::BIGINT AS failures FROM paired"""))
    def e6(spark, sf):
        # The number of batches depends on how the rows are partitioned.
        return merge.embedding_report(merged_rows(Shared.of(spark, sf))).drop("batches")

    @r.add("p8_rows_held_back", _merged("""
        SELECT source_key FROM paired WHERE has_i AND NOT has_s AND arrived IS NULL"""))
    def p8(spark, sf):
        shared = Shared.of(spark, sf)
        made = incoming_rows(shared).select(
            "source_key", embedding.embedded(F.col("augmented_text"), refusing_embedder())["vector"].alias("embedding"))
        return merge.held_back(made, stored_rows(shared)).select("source_key")

    typed = {c: S.STORED_TYPES[c] for c in _INCOMING_COLUMNS if c != "source_key"}
    from_i, from_s = plain_sql(typed, "i."), plain_sql(typed, "s.")
    new = "action IN ('inserted', 'updated')"

    merged_snapshot = _merged(f"""
        SELECT source_key, {from_i}, model AS embedding_model, '{VERSION}' AS pipeline_version
        FROM judged WHERE {new}
        UNION ALL
        SELECT source_key, {from_s}, s.embedding_model, s.pipeline_version
        FROM judged WHERE action IN ('kept', 'unchanged')""")

    @r.add("m1_merged_snapshot", merged_snapshot)
    def m1(spark, sf):
        snapshot = merged_rows(Shared.of(spark, sf)).snapshot
        return plain(snapshot.select("source_key", *typed, "embedding_model", "pipeline_version"))

    def delta_catalogue(spark, sf, share):
        """The stored rows as base of a catalogue, then the run on top of it."""
        shared, path = Shared.of(spark, sf), scratch_path(spark, "delta-catalogue")
        old = stored_rows(shared)
        first = old.withColumns({"action": F.lit("inserted"), "needed": F.lit(False), "embed_error": F.lit(None).cast("string")})
        deltas.commit(spark, path, merge.Merge(old.select("source_key", F.lit("touched").alias("action")), first, old))
        deltas.commit(spark, path, merged_rows(shared), share=share)
        return plain(deltas.read(spark, path).select("source_key", *typed, "embedding_model", "pipeline_version"))

    @r.add("m1_delta_catalogue", merged_snapshot)
    def m1_deltas(spark, sf):
        return delta_catalogue(spark, sf, 1.0)

    @r.add("m1_compacted_catalogue", merged_snapshot)
    def m1_compacted(spark, sf):
        return delta_catalogue(spark, sf, 0.0)

    @r.add("m2_kept_vectors", _merged(f"""
        SELECT source_key, {vector_digits_sql(f"CASE WHEN {new} THEN coalesce(arrived, s.embedding) ELSE s.embedding END")}
          AS embedding,
          CASE WHEN {new} AND arrived IS NOT NULL THEN sha256(i.augmented_text) ELSE s.embedded_text_hash END
          AS embedded_text_hash
        FROM judged WHERE action <> 'held_back'"""))
    def m2(spark, sf):
        snapshot = merged_rows(Shared.of(spark, sf)).snapshot
        return snapshot.select("source_key", vector_digits(F.col("embedding")).alias("embedding"),
                               "embedded_text_hash")

    @r.add("m3_action_counts", _merged("SELECT action, count(*) AS rows FROM judged GROUP BY action"))
    def m3(spark, sf):
        return merge.action_counts(merged_rows(Shared.of(spark, sf)))

    @r.add("m3_load_report", _merged("""
        SELECT count_if(action = 'inserted')::BIGINT AS inserted, count_if(action = 'updated')::BIGINT AS updated,
          count_if(action = 'unchanged')::BIGINT AS unchanged, count_if(action = 'held_back')::BIGINT AS held_back,
          count_if(action <> 'held_back')::BIGINT AS total_rows FROM judged"""))
    def m3_load(spark, sf):
        return merge.load_report(merged_rows(Shared.of(spark, sf)))

    @r.add("m4_audit_times", _merged(f"""
        SELECT source_key, CASE WHEN action = 'inserted' THEN '{LATER}' ELSE '{RUN_TIME}' END AS created_at,
          CASE WHEN {new} THEN '{LATER}' ELSE '{RUN_TIME}' END AS updated_at
        FROM judged WHERE action <> 'held_back'"""))
    def m4(spark, sf):
        snapshot = merged_rows(Shared.of(spark, sf)).snapshot
        return plain(snapshot.select("source_key", "created_at", "updated_at"))

    @r.add("m5_second_run", _merged("""
        SELECT CASE WHEN has_i THEN 'unchanged' ELSE 'kept' END AS action, false AS embedded, count(*) AS rows
        FROM paired GROUP BY ALL"""))
    def m5(spark, sf):
        shared, plan = Shared.of(spark, sf), embedding.offline_embedder()
        incoming = step_table(incoming_rows(shared), "incoming")
        first = merge.merge(stored_rows(shared), incoming, plan, VERSION, F.lit(RUN_TIME).cast("timestamp"))
        stored = step_table(first.snapshot, "first-run")
        second = merge.merge(stored, incoming, plan, VERSION, F.lit(LATER).cast("timestamp"))
        embedded = merge.embedding_report(second).select((F.col("embedded") > 0).alias("embedded")).first()[0]
        return merge.action_counts(second).withColumn("embedded", F.lit(embedded))

    @r.add("m5_unchanged_run", sql.upto("snapshot", """
        SELECT 'first' AS run, 'inserted' AS issue, count(*) AS count FROM snapshot
        UNION ALL SELECT 'second', 'unchanged', count(*) FROM snapshot
        UNION ALL SELECT 'second', 'reused', count(*) FROM snapshot"""))
    def m5_unchanged(spark, sf):
        """Two runs on the same records against a catalogue of deltas."""
        shared, path = Shared.of(spark, sf), scratch_path(spark, "refreshed")
        when = F.lit(RUN_TIME).cast("timestamp")
        reports = [refresh.refresh(shared.raw, path, when).report.withColumn("run", F.lit(run)) for run in ("first", "second")]
        both = reports[0].unionByName(reports[1]).filter("stage IN ('embedding', 'load') AND issue IN ('inserted', 'updated', 'unchanged', 'reused', 'failures')")
        return both.filter("count > 0").select("run", "issue", "count")
