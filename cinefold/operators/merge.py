"""Incremental merge of enriched rows into a stored snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold import schemas as S
from cinefold.operators.embedding import Embedder, embedded, text_hash
from cinefold.session import step_table

# Columns of a snapshot: the stored columns, the hash of the text the vector was made
# from, the identifier and the audit times.
SNAPSHOT_TYPES = {
    "id": "string", **S.STORED_TYPES, "embedded_text_hash": "string",
    "created_at": "timestamp", "updated_at": "timestamp",
}
SNAPSHOT = list(SNAPSHOT_TYPES)


def empty_snapshot(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in SNAPSHOT_TYPES.items()))


def stored_state(snapshot: DataFrame) -> DataFrame:
    """What decides the work of a run, per stored row."""
    return snapshot.select(
        "source_key", "content_hash", "augmented_text", "embedding_model",
        F.col("embedding").isNotNull().alias("has_embedding"),
    )


def _sides(stored: DataFrame, incoming: DataFrame, how: str) -> DataFrame:
    """Stored and incoming rows side by side on the key, as structs ``s`` and ``i``."""
    old = stored.select("source_key", F.struct(*stored.columns).alias("s"))
    new = incoming.select("source_key", F.struct(*incoming.columns).alias("i"))
    return new.join(old, "source_key", how)


def _needs_vector(model: str, force: bool) -> Column:
    reasons = (
        F.col("s").isNull()
        | F.col("s.embedding").isNull()
        | ~F.col("s.embedded_text_hash").eqNullSafe(text_hash(F.col("i.augmented_text")))
        | ~F.col("s.embedding_model").eqNullSafe(F.lit(model))
    )
    return F.col("i").isNotNull() & (F.lit(force) | reasons)


def needing_vectors(
    stored: DataFrame, incoming: DataFrame, model: str, force: bool = False
) -> DataFrame:
    """``source_key, needs_embedding`` for every incoming row."""
    old = stored.select("source_key", "embedding", "embedded_text_hash", "embedding_model")
    new = incoming.select("source_key", "augmented_text")
    return _sides(old, new, "left").select(
        "source_key", _needs_vector(model, force).alias("needs_embedding")
    )


def merge_touched(
    stored: DataFrame, incoming: DataFrame, plan: Embedder, version: str, run_time: Column,
    force: bool = False,
) -> DataFrame:
    """Incoming rows and their stored versions after a run, with what happened to each.

    One join on the (unique) key carries the change test, the embedding, the hold-back and
    the write decision. Rows are marked ``inserted``, ``updated``, ``unchanged`` or
    ``held_back`` (new and without a vector). The model and the hash of the embedded text
    only move together with a vector, so a row whose vector could not be renewed is picked
    up again by the next run.
    """
    if plan.tasks:
        # So many tasks call the embedder at once; the join uses the same shuffle, and keys are unique.
        incoming = incoming.repartition(plan.tasks, "source_key")
    both = _sides(stored.select(*SNAPSHOT), incoming, "left")
    both = both.withColumn("needed", _needs_vector(plan.model, force))
    both = both.withColumn("e", embedded(F.when(F.col("needed"), F.col("i.augmented_text")), plan))

    vector = F.col("e.vector")
    arrived = vector.isNotNull()
    model = F.when(arrived, F.lit(plan.model)).otherwise(F.col("s.embedding_model"))
    changed = (
        ~F.col("s.content_hash").eqNullSafe(F.col("i.content_hash"))
        | (F.col("s.embedding").isNull() & arrived)
        | (arrived & ~F.col("s.embedded_text_hash").eqNullSafe(text_hash(F.col("i.augmented_text"))))
        | ~F.col("s.embedding_model").eqNullSafe(model)
        | ~F.col("s.pipeline_version").eqNullSafe(F.lit(version))
    )
    both = both.withColumn(
        "action",
        F.when(F.col("s").isNull() & ~arrived, "held_back")
        .when(F.col("s").isNull(), "inserted")
        .when(changed, "updated")
        .otherwise("unchanged"),
    )
    written = F.col("action").isin("inserted", "updated", "held_back")

    special = {
        "id": F.coalesce(F.col("s.id"), F.sha2("source_key", 256)),
        "source_key": F.col("source_key"),
        "embedding": F.when(written, F.coalesce(vector, F.col("s.embedding"))).otherwise(
            F.col("s.embedding")
        ),
        "embedding_model": F.when(written, model).otherwise(F.col("s.embedding_model")),
        "pipeline_version": F.when(written, F.lit(version)).otherwise(F.col("s.pipeline_version")),
        "embedded_text_hash": F.when(written & arrived, text_hash(F.col("i.augmented_text")))
        .otherwise(F.col("s.embedded_text_hash")),
        "created_at": F.coalesce(F.col("s.created_at"), run_time),
        "updated_at": F.when(written, run_time).otherwise(F.col("s.updated_at")),
    }
    columns = [
        special.get(n, F.when(written, F.col(f"i.{n}")).otherwise(F.col(f"s.{n}")))
        .cast(SNAPSHOT_TYPES[n]).alias(n)
        for n in SNAPSHOT
    ]
    return both.select(
        *columns, "action", "needed", F.col("e.error").alias("embed_error"),
        F.coalesce(F.col("e.batch_head"), F.lit(False)).alias("batch_head"),
    )


def classify(
    stored: DataFrame, incoming: DataFrame, model: str, version: str, force: bool = False
) -> DataFrame:
    """``source_key, action``: which keys a run has to look at.

    ``touched`` keys are new or differ in content, version, text or model; the others are
    ``unchanged``, or ``kept`` when only stored. Only hashes and names are joined, no text
    and no vector is read; a stored row has a text hash exactly when it has a vector.
    """
    old = stored.select(
        "source_key", "content_hash", "embedded_text_hash", "embedding_model", "pipeline_version"
    )
    new = incoming.select("source_key", "content_hash", text_hash(F.col("augmented_text")).alias("text"))
    differs = (
        ~F.col("s.content_hash").eqNullSafe(F.col("i.content_hash"))
        | ~F.col("s.embedded_text_hash").eqNullSafe(F.col("i.text"))
        | ~F.col("s.embedding_model").eqNullSafe(F.lit(model))
        | ~F.col("s.pipeline_version").eqNullSafe(F.lit(version))
    )
    return _sides(old, new, "full_outer").select(
        "source_key",
        F.when(F.col("i").isNull(), "kept")
        .when(F.col("s").isNull() | differs | F.lit(force), "touched")
        .otherwise("unchanged").alias("action"),
    )


@dataclass
class Merge:
    """Outcome of a run.

    ``keys`` tells the action of every key (``classify``), ``rows`` holds the touched rows
    after the run with what became of them, ``snapshot`` the whole table.
    """

    keys: DataFrame
    rows: DataFrame
    snapshot: DataFrame


def merge(
    stored: DataFrame, incoming: DataFrame, plan: Embedder, version: str, run_time: Column,
    force: bool = False,
) -> Merge:
    """Merge enriched rows into the stored ones.

    The keys are classified first, from hashes alone. Only touched rows are brought
    together, embedded and rewritten; all others go from the stored table into the
    snapshot as they are, without a shuffle while the touched keys are few enough to be
    broadcast.
    """
    keys = step_table(classify(stored, incoming, plan.model, version, force), "merge-keys")
    touched = step_table(keys.filter("action = 'touched'").select("source_key"), "merge-touched")
    rows = step_table(
        merge_touched(
            stored.join(touched, "source_key", "left_semi"),
            incoming.join(touched, "source_key", "left_semi"), plan, version, run_time, force,
        ), "merge-rows",
    )
    written = rows.filter(F.col("action") != "held_back").select(*SNAPSHOT)
    rest = stored.select(*SNAPSHOT).join(touched, "source_key", "left_anti").select(*SNAPSHOT)
    return Merge(keys, rows, rest.unionByName(written))


def bucket(key: Column, buckets: int) -> Column:
    """The bucket folder of a row in a catalogue that is renewed in place."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def changed_buckets(stored: DataFrame, merged: Merge, buckets: int) -> DataFrame:
    """All rows, after the run, of those buckets that a written row falls into, with their ``bucket``.

    ``stored`` is the bucketed table as read; the other buckets' files are not opened, as
    the buckets are few and known before.
    """
    own = bucket(F.col("source_key"), buckets)
    written = merged.rows.filter(F.col("action").isin("inserted", "updated")).select(*SNAPSHOT, own.alias("bucket"))
    hit = [row[0] for row in written.select("bucket").distinct().collect()]
    rest = stored.filter(F.col("bucket").isin(hit)) if hit else stored.filter(F.lit(False))
    rest = rest.select(*SNAPSHOT, "bucket").join(written.select("source_key"), "source_key", "left_anti")
    return rest.select(*SNAPSHOT, "bucket").unionByName(written)


def clustered(snapshot: DataFrame) -> DataFrame:
    """Lay a snapshot out so that decade and genre filters skip files and row groups.

    The key is part of the range, so a decade or genre that holds a third of the rows is
    spread over many files.
    """
    return snapshot.repartitionByRange("decade", "major_genre", "source_key").sortWithinPartitions(
        "decade", "major_genre"
    )


def held_back(
    incoming: DataFrame, stored: DataFrame, vector: str = "embedding", key: str = "source_key"
) -> DataFrame:
    """New rows that got no vector."""
    return incoming.filter(F.col(vector).isNull()).join(stored.select(key), key, "left_anti")


def action_counts(merged: Merge) -> DataFrame:
    """``action, rows`` over all keys."""
    untouched = merged.keys.filter("action <> 'touched'").groupBy("action").agg(F.count("*").alias("rows"))
    touched = merged.rows.groupBy("action").agg(F.count("*").alias("rows"))
    return untouched.unionByName(touched).groupBy("action").agg(F.sum("rows").alias("rows"))


def embedding_report(merged: Merge) -> DataFrame:
    """One row: texts embedded, reused, batches sent and failures."""
    touched = merged.rows.select(
        (F.col("needed") & F.col("embed_error").isNull()).alias("embedded"),
        (~F.col("needed")).alias("reused"), "batch_head", F.col("embed_error").isNotNull().alias("failed"),
    )
    untouched = merged.keys.filter("action = 'unchanged'").select(
        F.lit(False).alias("embedded"), F.lit(True).alias("reused"),
        F.lit(False).alias("batch_head"), F.lit(False).alias("failed"),
    )
    return touched.unionByName(untouched).agg(
        F.count_if("embedded").alias("embedded"), F.count_if("reused").alias("reused"),
        F.count_if("batch_head").alias("batches"), F.count_if("failed").alias("failures"),
    )


def load_report(merged: Merge) -> DataFrame:
    """One row: rows inserted, updated, unchanged, held back, and in the table afterwards."""
    def total(*actions: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("action").isin(*actions), F.col("rows"))), F.lit(0))

    single = ["inserted", "updated", "unchanged", "held_back"]
    return action_counts(merged).agg(
        *[total(n).alias(n) for n in single],
        total("inserted", "updated", "unchanged", "kept").alias("total_rows"),
    )


def as_report(counts: DataFrame, stage: str) -> DataFrame:
    """A one-row count table in the shape of the other stage reports."""
    return counts.select(F.explode(F.array(*[
        F.struct(
            F.lit(stage).alias("stage"), F.lit(n).alias("issue"), F.lit("*").alias("field"),
            F.col(n).cast("bigint").alias("count"), F.lit("counted").alias("action"),
            F.lit("").alias("detail"),
        )
        for n in counts.columns
    ])).alias("r")).select("r.*")
