"""Near copies by fingerprints that differ in few bits, met at the anchors of a covering code.

A text's fingerprint has a bit set where over half of its three-word shingles' hashes have it.
The 64 bits are cut into blocks of odd length. The code's words are those whose blocks are
all zeros or all ones, so any fingerprint's nearest word is the majority of each block
and the code covers everything within the sum of half blocks. Each distinct fingerprint is
stored at its nearest word, its home. It is also sent to every word that is the home of some fingerprint
within the threshold: a block's majority turns over only if its margin allows it, so these are the words
within reach of at most ``threshold`` flipped bits. Two fingerprints within the threshold thus meet at either's
home, and are compared there. The code has more words the more distinct fingerprints there are.

A task keeps a spanning forest of the links it finds, no pairs; stars are then contracted until each
fingerprint points at the least of its component.

Defined cases: null, empty and wordless texts have fingerprint zero, which links like any other. Texts of one
or two words are one shingle. Equal texts share a fingerprint and so a component. A null ``doc_id`` is kept but never
names a component that has another; a component of null ids alone has a null name. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are kept by ``drop_near_copies``
and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import lower_ascii, whole_rows, words
from cinefold.session import step_table

SHINGLE = 3
THRESHOLD = 2
HOMES_PER_ANCHOR = 32  # distinct fingerprints that an anchor holds on average, at most
HOT_HOMES = 4096  # an anchor with more homes is dealt to several tasks
PAIRS_AT_ONCE = 1 << 21


def shingle_hashes(text, shingle: int = SHINGLE):
    """XXH64 with seed 42 of each shingle; of the whole sequence if it is shorter; none without words."""
    every = F.transform(F.sequence(F.lit(1), F.size("words") - shingle + 1),
                        lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, shingle))))
    return (F.when(F.size("words") >= shingle, every)
            .when(F.size("words") > 0, F.array(F.xxhash64(F.concat_ws(" ", "words"))))
            .otherwise(F.array().cast("array<bigint>")))


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = batch.column("hashes")
        ends = hashes.offsets.to_numpy()
        values = hashes.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(ends)
        out = np.zeros((batch.num_rows, 64), bool)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, ends[start] + (1 << 18), "right")) - 1)
            rows = np.arange(start, min(stop, batch.num_rows))
            rows = rows[sizes[rows] > 0]
            if len(rows):
                bits = np.unpackbits(values[ends[start]:ends[rows[-1] + 1]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                out[rows] = 2 * np.add.reduceat(bits, ends[rows] - ends[start], axis=0, dtype=np.int64) > sizes[rows, None]
            start = stop
        prints = np.packbits(out, axis=1, bitorder="little").view(np.int64).ravel()
        yield pa.record_batch([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (64 bits as a long) of each row."""
    split = docs.select("doc_id", words(lower_ascii(F.col("text"))).alias("words"))
    return split.select("doc_id", shingle_hashes(F.col("words"), shingle).alias("hashes")).mapInArrow(
        _majorities, "doc_id long, fingerprint long")


def code_blocks(distinct: int, homes: int = HOMES_PER_ANCHOR) -> list[int]:
    """Odd block lengths that sum to 64, so many that an anchor is the home of ``homes`` at most, were they even."""
    m = 4
    while m < 62 and distinct > homes << m:
        m += 2
    base = 64 // m - (64 // m + 1) % 2
    longer = (64 - base * m) // 2
    return [base + 2] * longer + [base] * (m - longer)


def _anchors(blocks: list[int], threshold: int):
    """For fingerprints: their homes, and all (row, anchor) within reach of ``threshold`` flips."""

    def of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home = np.zeros(len(prints), np.int64)
        costs, at = [], 0
        for k, size in enumerate(blocks):
            mask = np.uint64(((1 << size) - 1) << at)
            ones = np.bitwise_count(prints & mask).astype(np.int64)
            home |= (2 * ones > size).astype(np.int64) << k
            costs.append((np.abs(2 * ones - size) + 1) // 2)  # flips that turn the majority over
            at += size
        # All ways to turn blocks over, in block order, with what they cost.
        rows, anchor, spent = np.arange(len(prints)), home.copy(), np.zeros(len(prints), np.int64)
        for k, cost in enumerate(costs):
            can = spent + cost[rows] <= threshold
            rows, anchor, spent = (np.concatenate([rows, rows[can]]), np.concatenate([anchor, anchor[can] ^ (1 << k)]),
                                   np.concatenate([spent, spent[can] + cost[rows[can]]]))
        return home, rows, anchor

    return of


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) for the components of the links ``a``-``b``."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        for side in (left, right):
            np.minimum.at(label, label[side], low)
        label = np.minimum(label, label[label])
        while (label != (jumped := label[label])).any():
            label = jumped
        if (label == before).all():
            break
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


def links(prints: DataFrame, distinct: int, threshold: int = THRESHOLD, hot_homes: int = HOT_HOMES) -> DataFrame:
    """Links ``member``-``least`` that connect all distinct fingerprints within ``threshold`` bits, directly or by others."""
    reach = _anchors(code_blocks(distinct), threshold)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy()
            yield pa.record_batch([pa.array(own), pa.array(reach(own.view(np.uint64))[0])], names=["fingerprint", "anchor"])

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("fingerprint").to_numpy()
            for part in np.array_split(own, max(1, len(own) >> 11)):
                _, rows, anchor = reach(part.view(np.uint64))
                yield pa.record_batch([pa.array(part[rows]), pa.array(anchor)], names=["fingerprint", "anchor"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by place, homes first. Held: the homes of the place in hand."""
        held_anchor, held_salt, held = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            anchor, salt, away, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "away", "fingerprint"))
            own = own.view(np.uint64)
            cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(own)]])
            n_homes = np.add.reduceat((away == 0).astype(np.int64), starts)
            pool, first_home = own, starts.copy()
            if held_anchor == anchor[0] and held_salt == salt[0]:
                # The first place goes on from the batch before; its homes come from there.
                pool = np.concatenate([held, own])
                starts_in_pool = starts + len(held)
                first_home = starts_in_pool.copy()
                first_home[0], n_homes[0] = 0, len(held) + n_homes[0]
                joined = len(held)
            else:
                joined = 0
                first_home = starts
            visits = np.flatnonzero(away == 1)
            place = np.searchsorted(starts, visits, "right") - 1
            visits = visits[n_homes[place] > 0]
            found_a, found_b, i = [], [], 0
            place = np.searchsorted(starts, visits, "right") - 1
            each = n_homes[place]
            total = np.concatenate([[0], np.cumsum(each)])
            while i < len(visits):
                j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS_AT_ONCE, "right")) - 1)
                size = each[i:j]
                mine = np.repeat(own[visits[i:j]], size)
                where = np.repeat(first_home[place[i:j]] - (total[i:j] - total[i]), size) + np.arange(total[j] - total[i])
                theirs = pool[where]
                near = (np.bitwise_count(mine ^ theirs) <= threshold) & (mine != theirs)
                if near.any():
                    found_a.append(mine[near].view(np.int64))
                    found_b.append(theirs[near].view(np.int64))
                i = j
            if found_a:
                member, least = forest(np.concatenate(found_a), np.concatenate(found_b))
                yield pa.record_batch([pa.array(member), pa.array(least)], names=["member", "least"])
            held_anchor, held_salt = anchor[-1], salt[-1]
            held = pool[first_home[-1]:first_home[-1] + n_homes[-1]].copy()

    schema = "fingerprint long, anchor long"
    at_home, sent = prints.mapInArrow(homes, schema), prints.mapInArrow(replicas, schema)
    hot = step_table(at_home.groupBy("anchor").count().filter(F.col("count") > hot_homes)
                     .select("anchor", F.ceil(F.col("count") / hot_homes).cast("int").alias("salts")), "anchors-hot")
    salts = F.coalesce("salts", F.lit(1))
    at_home = at_home.join(hot, "anchor", "left").select(
        "anchor", F.pmod(F.xxhash64("fingerprint"), salts).cast("int").alias("salt"), F.lit(0).alias("away"), "fingerprint")
    sent = sent.join(hot, "anchor", "left").select(
        "anchor", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(1).alias("away"), "fingerprint")
    met = at_home.unionByName(sent).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "away")
    return met.mapInArrow(compare, "member long, least long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``member`` and the ``least`` of its component, for links ``member``-``least``: large and small stars by turns.

    A node's links are first aggregated to their least end, so a hub's links meet in no task.
    """
    edges = step_table(edges.filter("member <> least").select(
        F.greatest("member", "least").alias("member"), F.least("member", "least").alias("least")).distinct(), "links")
    known = None
    while True:
        both = edges.union(edges.select("least", "member")).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        large = both.join(least, "node").filter("other > node").select(F.col("other").alias("member"), "least").distinct()
        large = step_table(large.filter("member <> least"), "large-star")
        down = large.groupBy("member").agg(F.min("least").alias("to"))
        small = (large.join(down, "member").select(F.col("least").alias("member"), F.col("to").alias("least"))
                 .union(down).filter("member <> least").distinct())
        edges = step_table(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("member", "least").cast("decimal(38,0)"))).first()
        if state == known:
            return edges
        known = state


def near_groups(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` (the least ``doc_id`` of its component) of each row."""
    prints = step_table(fingerprints(docs, shingle), "fingerprints")
    classes = step_table(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_doc")), "fingerprint-classes")
    roots = components(links(classes.select("fingerprint"), classes.count(), threshold))
    rooted = classes.join(roots, classes.fingerprint == roots.member, "left").select(
        "fingerprint", "first_doc", F.coalesce("least", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those in the component of a smaller ``doc_id``.

    Rows that share a ``doc_id`` are copies of one document and stay together; rows without one stay.
    """
    gone = near_groups(docs, **options).filter("component_id < doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = whole_rows(docs)
    return rows.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select("row.*")
