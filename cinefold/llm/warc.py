r"""WARC archives: written by Spark's text writer, read back by verified boundary chains.

A record is one string; the writer's line separator is the blank line that ends a record. Records whose payload is
equal and has ``LEAST_BYTES`` or more are revisits of that with the smallest id.

Reading splits the files at the record magic, wherever it stands, so any file can be read by many tasks. A task emits for each
piece its place and, if it looks like a record, the place of the successor that its length announces. Within each split the
pointers are first followed to where they leave it; pointers between splits are then doubled from the start of the file until
no new place is reached. Only what is reachable from the file's start is a record; magic inside a payload is never reached,
and its pieces are put back into the payload.

Defined cases: a null page is an empty payload. A null id or url has no header. Line breaks in a url are written as %0D and %0A.
Rows with the smallest id among equal payloads are all responses, also if repeated. A record with a null id is a revisit if others with an id have its payload. An empty table gives no archive rows.
A file that does not start with a record has none. Payload bytes need not be valid UTF-8 when read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinefold.session import scratch_path, step_table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 100
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_PER_FILE = 100_000
LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: *([0-9]{1,18})(?:\r\n|$)", re.IGNORECASE)
PLACE = ["file", "split", "rel"]


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row per page: ``page_id``, ``record_type``, ``refers_to``, and the whole ``record`` without its end."""
    payload = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))
    # Only payloads that come twice take part in the join; their first id is known from counts.
    firsts = (base.filter(F.col("bytes") >= least_bytes).groupBy("digest")
              .agg(F.count("*").alias("times"), F.min("page_id").alias("first_id")).filter("times > 1").drop("times"))
    # The payloads are shuffled at any size: how many come twice has no bound that would allow a broadcast.
    typed = base.join(firsts.hint("merge"), "digest", "left").withColumn("revisit", F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")))
    body = F.concat(F.lit(HTTP), F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    field = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    refers = F.when(F.col("revisit"), F.col("first_id"))
    header = F.concat(
        F.lit(MAGIC), field("WARC-Type", kind), field("WARC-Record-ID", urn(F.col("page_id"))),
        field("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        field("WARC-Refers-To", urn(refers)), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("X-Payload-Length", F.col("bytes").cast("string")), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    return typed.select("page_id", kind.alias("record_type"), refers.alias("refers_to"), F.concat(header, body).alias("record"))


def write_archives(pages: DataFrame, path: str, compression: str = "none", **options) -> None:
    """The pages as WARC files under ``path``; compressed with gzip they are smaller, but each is read by one task."""
    rows = records(pages, **options).select("record")
    rows.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the places of its texts from the start of their split's first, and their sizes. A split's rows come in order."""
    held, at = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column("value")).to_numpy().astype(np.int64)
        keys = list(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()))
        rel = np.empty(len(sizes), np.int64)
        for i, key in enumerate(keys):
            if key != held:
                held, at = key, 0
            rel[i] = at
            at += int(sizes[i]) + len(MAGIC)
        yield batch, rel, sizes


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, size, and the successor's place where the piece begins with a header that tells its length."""
    for batch, rel, sizes in _placed(batches):
        following = []
        for value, place in zip(batch.column("value"), rel.tolist()):
            text = value.as_py()
            end = text.find(b"\r\n\r\n")
            told = LENGTH.search(text, 0, end) if end >= 0 and text[:5].lower() == b"warc-" else None
            # Places are those of texts, each right after its magic.
            following.append(place + end + 4 + int(told[1]) + 4 + len(MAGIC) if told else None)
        yield pa.record_batch([batch.column("file"), batch.column("split"), pa.array(rel), pa.array(sizes), pa.array(following, pa.int64())],
                              names=["file", "split", "rel", "size", "next"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rel, _ in _placed(batches):
        yield pa.record_batch([batch.column("file"), batch.column("split"), pa.array(rel), batch.column("value")], names=[*PLACE, "value"])


def _leave(held: pa.Table) -> pa.Table:
    """Where each candidate of a split leaves it, by doubling the pointers that stay inside."""
    held = held.sort_by("rel")
    rel, following = held["rel"].to_numpy(), held["next"].to_numpy()
    exits, at = following.copy(), np.searchsorted(rel, following)
    inside = (at < len(rel)) & (rel[np.minimum(at, len(rel) - 1)] == following)
    jump = np.where(inside, at, np.arange(len(rel)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    base = held["base"].to_numpy()
    return pa.table([held["file"], pa.array(base + rel), pa.array(base + exits[jump])], names=["file", "place", "exit"])


def _mark(held: pa.Table) -> pa.Table:
    """The candidates of a split that its entry leads to."""
    held = held.sort_by("rel")
    rel, following, real = held["rel"].to_numpy(), held["next"].to_numpy(), held["entry"].to_numpy(zero_copy_only=False).copy()
    at = np.searchsorted(rel, following)
    inside = (at < len(rel)) & (rel[np.minimum(at, len(rel) - 1)] == following)
    for i in range(len(rel)):
        if real[i] and inside[i]:
            real[at[i]] = True
    return held.select(PLACE).append_column("real", pa.array(real))


def boundaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pieces that are no record by themselves: their place and the ``record``'s in the file that they belong to (null: none).

    They are few: parts of payloads with magic inside, and what stands before a file's first record. And the ``base`` of each split.
    """
    schema = "file string, split long, rel long, size long, next long"
    pieces = step_table(_pieces(spark, path).mapInArrow(_candidates, schema), "warc-pieces")
    splits = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = step_table(splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base")), "warc-splits")
    based = pieces.join(bases, ["file", "split"])
    # A file's very first piece stands before any magic, so it is no candidate.
    candidates = based.filter("next IS NOT NULL AND base + rel > 0")
    jumps = step_table(candidates.groupBy("file", "split").applyInArrow(_leave, "file string, place long, exit long"), "warc-jumps")
    first = len(MAGIC)
    starts = pieces.filter("split = 0 AND rel = 0 AND size = 0").select("file", F.lit(first).cast("long").alias("place"))
    reached, known = step_table(starts, "warc-reached"), -1
    while (count := reached.count()) > known:
        known = count
        further = reached.join(jumps, ["file", "place"]).select("file", F.col("exit").alias("place"))
        reached = step_table(reached.union(further).distinct(), "warc-reached")
        ahead = jumps.select("file", F.col("place").alias("exit"), F.col("exit").alias("beyond"))
        jumps = step_table(jumps.join(ahead, ["file", "exit"], "left").select(
            "file", "place", F.coalesce("beyond", "exit").alias("exit")), "warc-jumps")
    entries = reached.withColumn("entry", F.lit(True))
    flagged = candidates.withColumn("place", F.col("base") + F.col("rel")).join(entries, ["file", "place"], "left")
    marks = flagged.select(*PLACE, "next", F.coalesce("entry", F.lit(False)).alias("entry")).groupBy("file", "split").applyInArrow(
        _mark, "file string, split long, rel long, real boolean").filter("real")
    marked = based.join(marks, PLACE, "left").withColumn("place", F.col("base") + F.col("rel"))
    order = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("record", F.last(F.when(F.col("real"), F.col("place")), ignorenulls=True).over(order))
    together = owned.withColumn("pieces", F.count("*").over(Window.partitionBy("file", "record")))
    return step_table(together.filter("record IS NULL OR pieces > 1").select(*PLACE, "place", "record"), "warc-parts"), bases


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``file``, ``place``, its ``header`` and the bytes of its ``payload``."""
    parts, splits = boundaries(spark, path)
    texts = _pieces(spark, path).mapInArrow(_texts, "file string, split long, rel long, value binary")
    whole = texts.join(parts, PLACE, "left_anti").join(splits, ["file", "split"]).select(
        "file", (F.col("base") + F.col("rel")).alias("record"), "value")
    cut = texts.join(parts.filter("record IS NOT NULL"), PLACE).groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("place", F.col("value").cast("string").alias("value")))).alias("parts"))
    joined = cut.select("file", "record", F.array_join(F.col("parts.value"), MAGIC).cast("binary").alias("value"))
    rows = whole.unionByName(joined).withColumn("header", F.substring_index(F.col("value").cast("string"), END, 1))
    block_at = F.octet_length("header") + len(END)
    length = _field("Content-Length").cast("int")
    block = F.expr("substring(value, CAST(at AS INT) + 1, CAST(length AS INT))")
    blocks = rows.withColumn("at", block_at).withColumn("length", length).withColumn("block", block)
    skip = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    return blocks.withColumn("skip", skip).select(
        "file", F.col("record").alias("place"), "header", F.expr("substring(block, CAST(skip AS INT) + 1)").alias("payload"))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"(?:^|\r\n){name}: *([^\r]*)", 1), F.lit(""))


def described(read: DataFrame) -> DataFrame:
    """The records' ids, types and payload figures; a revisit tells those of the payload it leaves out."""
    number = lambda name: F.regexp_extract(F.coalesce(_field(name), F.lit("")), r"<urn:page:(-?[0-9]+)>", 1)
    revisit = _field("WARC-Type") == "revisit"
    return read.select(
        F.nullif(number("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"),
        F.when(revisit, _field("X-Payload-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.replace(_field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit(""))).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"), F.nullif(number("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"))


def round_trip(pages: DataFrame, compression: str = "none") -> DataFrame:
    """Write the pages' archives to the shared folder, then read and describe them."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, compression)
    return described(read_archives(pages.sparkSession, path))
