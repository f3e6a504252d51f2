"""Mixing sources to target weights by balanced sampling (the cube method).

A document's size is its number of words. Sources in code point order (null last) weigh 5, 2, 1
and so on again; together they get ``share`` times all words, each by its weight, but at most
``most`` times its own; what is above goes to the others by weight, until none is above.
A source whose target is ``r`` times its words takes each document ``floor(r)`` times, and once
more with probability ``r - floor(r)``. The cube method draws that: within a block, units are taken three at a
time and their probabilities move along the null space of the two balancing totals (words
and documents) until one of them reaches 0 or 1. A block leaves two units open at most;
open units of a source meet in new blocks until one block is left, whose last two units are the
landing: first the document total is given up, then the last unit is drawn.

Blocks and draws follow from a hash of the document, so reruns agree, whatever the partitions.

Defined cases: a null text has size zero. A source of size zero has target zero. Rows that share ``doc_id``, ``source`` and size are
one unit: all are taken or none, and they count in full in the totals. A null ``doc_id`` or ``source``
is a value like any other. An empty table gives no rows. Other columns are kept by ``mix`` and not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinefold.llm.common import n_words, whole_rows
from cinefold.session import step_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096  # units that a task balances at once
SEED = 20
NEAR = 1e-9  # a probability this close to 0 or 1 has arrived

UNIT = "doc_id long, source string, size long, rows long, chance double"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: its words, units and target. Wants ``source``, ``size`` and ``rows``.

    Filling up by weight stops at the cap first where cap / weight is least; in that order the
    level of those not yet full is (all - caps so far) / (weights left).
    """
    totals = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = ((F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    filled = ranked.withColumn("level", level).withColumn("open", F.col("level") < F.col("full_at"))
    # Once a source stays open all after it do, at the level of the first of them.
    final = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, 0))
    return filled.withColumn("target", F.coalesce(F.col("weight") * final, F.col("cap"))).select(
        "source", "source_size", "units", "target")


def flight(chances: list[float], sizes: list[float], rows: list[float], draw: random.Random) -> list[int]:
    """Move ``chances`` until the constraints allow no further move; the units still open."""
    hand: list[int] = []
    waiting = iter([i for i, c in enumerate(chances) if NEAR < c < 1 - NEAR])
    while True:
        while len(hand) < 3 and (unit := next(waiting, None)) is not None:
            hand.append(unit)
        a = hand[0] if hand else 0
        if len(hand) == 3:
            b, c = hand[1], hand[2]
            move = [sizes[b] * rows[c] - sizes[c] * rows[b], sizes[c] * rows[a] - sizes[a] * rows[c],
                    sizes[a] * rows[b] - sizes[b] * rows[a]]
            if not any(move):
                move = [rows[b], -rows[a], 0.0]
        elif len(hand) == 2 and sizes[a] * rows[hand[1]] == sizes[hand[1]] * rows[a]:
            move = [rows[hand[1]], -rows[a]]
        else:
            return hand
        _step(chances, hand, move, draw)
        hand = [i for i in hand if NEAR < chances[i] < 1 - NEAR]


def landing(chances: list[float], sizes: list[float], hand: list[int], draw: random.Random) -> None:
    """The last open units: words alone are balanced, then the last one is drawn."""
    while len(hand) >= 2:
        a, b = hand[0], hand[1]
        _step(chances, hand[:2], [sizes[b], -sizes[a]] if sizes[a] or sizes[b] else [1.0, -1.0], draw)
        hand = [i for i in hand if NEAR < chances[i] < 1 - NEAR]
    for i in hand:
        chances[i] = float(draw.random() < chances[i])


def _step(chances: list[float], hand: list[int], move: list[float], draw: random.Random) -> None:
    """One move along ``move`` or against it, to the nearest side of the cube, so that the mean stays."""
    ahead = min((1 - chances[i] if m > 0 else chances[i]) / abs(m) for i, m in zip(hand, move) if m)
    back = min((chances[i] if m > 0 else 1 - chances[i]) / abs(m) for i, m in zip(hand, move) if m)
    by = ahead if draw.random() * (ahead + back) < back else -back
    for i, m in zip(hand, move):
        moved = chances[i] + by * m
        chances[i] = 0.0 if moved < NEAR else 1.0 if moved > 1 - NEAR else moved


def _fly(units: DataFrame, seed: int, last: bool) -> DataFrame:
    """One round over all blocks; with ``last`` each source is one block and lands."""

    def block(key: tuple, held: pa.Table) -> pa.Table:
        held = held.sort_by([("deal", "ascending"), ("size", "ascending"), ("doc_id", "ascending")])
        chances, rows = held["chance"].to_pylist(), [float(x) for x in held["rows"].to_pylist()]
        sizes = [float(x) * r for x, r in zip(held["size"].to_pylist(), rows)]
        draw = random.Random(f"{seed} {held['deal'][0].as_py()}")
        open_units = flight(chances, sizes, rows, draw)
        if last:
            landing(chances, sizes, open_units, draw)
        at = held.schema.get_field_index("chance")
        return held.set_column(at, "chance", pa.array(chances, pa.float64())).select(["doc_id", "source", "size", "rows", "chance"])

    return units.groupBy("source", "block").applyInArrow(block, UNIT)


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST,
         block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """How often each unit is taken. Wants ``doc_id``, ``source``, ``size``; gives one row per unit with ``rows`` and ``copies``."""
    units = step_table(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-units")
    goals = step_table(targets(units, weights, share, most), "mix-targets")
    times = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    same_source = F.col("u.source").eqNullSafe(F.col("g.source"))
    state = units.alias("u").join(goals.alias("g"), same_source).select(
        "u.*", "source_size", "target", F.floor(times + NEAR).alias("sure"),
        F.greatest(times - F.floor(times + NEAR), F.lit(0.0)).alias("chance"))
    still = (F.col("chance") > NEAR) & (F.col("chance") < 1 - NEAR)
    open_units, settled, last = state.select("doc_id", "source", "size", "rows", "chance").filter(still), [], False
    while not last:
        counts = open_units.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks"))
        last = (counts.agg(F.max("blocks")).first()[0] or 1) == 1
        dealt = open_units.alias("u").join(counts.alias("g"), same_source).select(
            "u.*", F.xxhash64("doc_id", "size", F.lit(seed)).alias("deal"), "blocks")
        dealt = dealt.withColumn("block", F.expr("pmod(deal, blocks)")).drop("blocks")
        flown = step_table(_fly(dealt, seed, last), "mix-flight")
        settled.append(flown.filter(~still))
        open_units = flown.filter(still)
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.unionByName(more)
    keys = [F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}")) for k in ("doc_id", "source", "size")]
    joined = state.alias("s").join(drawn.alias("d"), keys, "left")
    return joined.select("s.doc_id", "s.source", "s.size", "s.rows", "source_size", "target",
                         (F.col("sure") + F.coalesce(F.round("d.chance"), F.lit(0.0))).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Wants ``doc_id``, ``source`` and ``text``."""
    sized = whole_rows(docs).select("row", n_words(F.col("row.text")).alias("size"))
    chosen = plan(sized.select("row.doc_id", "row.source", "size"), **options).filter("copies > 0")
    keys = [F.col("row.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("row.source").eqNullSafe(F.col("c.source")),
            sized["size"] == F.col("c.size")]
    taken = sized.join(chosen.alias("c"), keys).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")
