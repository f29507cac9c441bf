"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. Block i of a source with weight w (weights sum to 1) is released at slot
floor(i / w) and due at slot ceil((i + 1) / w); in every slot the released block with the earliest deadline runs. At
any slot each source is then less than one block away from its share. Weights are exact rationals and are not rounded to
a period; when a source runs dry, the weights of the others are scaled up and a new phase begins. The schedule needs the
number of rows of each source and nothing else.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import dense_number, key_byte, written

#: Slots of a schedule at most, but for one more of each source, and the sources at most.
SLOTS, SOURCES = 1 << 18, 1 << 16
#: Blocks of a source whose slots are one row of the schedule that is sent out.
SENT = 64


def _dealt(shares: list[int]) -> Iterator[int]:
    """The source of slot 0, 1, 2 ... without end; shares: whole numbers in the weights' exact proportion."""
    total = sum(shares)
    waiting = [(0, s, 0) for s, n in enumerate(shares) if n]
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // shares[s]), s, i))
        _, s, i = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, ((i + 1) * total // shares[s], s, i + 1))
        slot += 1


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of weights."""
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact))
    return [int(w * scale) for w in exact]


def schedule(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> list[str | None]:
    """The source of each slot: as many slots as there are blocks, each source as often as it has blocks.

    Of equal deadlines the smaller source comes first, null before all.
    """
    left = {s: n for s, n in sorted(blocks.items(), key=lambda x: (x[0] is not None, x[0])) if n}
    slots: list[str | None] = []
    while left:
        names = list(left)
        for s in _dealt(exact_shares([weights[n] for n in names])):
            slots.append(names[s])
            left[names[s]] -= 1
            if not left[names[s]]:  # a source runs dry
                del left[names[s]]
                break
    return slots


def default_weight(rows: int) -> int:
    """The whole part of the square root: large sources weigh more, but less than in proportion."""
    return math.isqrt(rows)


def rows_of_block(rows: int, least: int = 64, slots: int = SLOTS) -> int:
    """Rows of a block: as few as give at most `slots` blocks, were there one source, and at least `least`."""
    return max(least, -(-rows // slots))


def mixed(
    df: DataFrame, key: str, source: str, weights: Mapping[str | None, float] | None = None, block_rows: int | None = None, order_by: str | None = None, slots: int = SLOTS
) -> DataFrame:
    """Adds source_rank, block, slot and position: the place of every row in the mixture. No row goes or repeats.

    weights: target weight of each source (null is a source like others); by default the whole part of the root of its
    rows. source_rank counts a source's rows from 0 in the order (first byte of the key's MD5, key, order_by); block is
    source_rank // block_rows; slot is the block's place in the schedule and position = slot * block_rows + rank in the
    block, unique, with gaps only after the sources' last blocks. Null keys come first; rows equal in key and order_by
    are interchangeable. An empty table stays empty. Columns of these names are replaced; a key or source of such a name
    is a ValueError.

    block_rows: by default 64, or as many as make at most `slots` blocks, so that the schedule, which the driver makes,
    is bounded whatever the number of rows: slots and one more for each source. More than SOURCES sources are a
    ValueError. The schedule is written as a table, and Spark joins it by what it knows of its size.
    """
    names = ("source_rank", "block", "slot", "position")
    if wrong := {key, source, order_by} & set(names):
        raise ValueError(f"{sorted(wrong)} are columns of the result: rename them first")
    df = df.drop(*names)
    counted = df.groupBy(F.col(f"`{source}`")).agg(F.count(F.lit(1))).limit(SOURCES + 1).collect()
    if len(counted) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources: put the small ones together")
    rows = {r[0]: r[1] for r in counted}
    size = block_rows or rows_of_block(sum(rows.values()), slots=slots)
    target = {s: default_weight(n) for s, n in rows.items()} if weights is None else dict(weights)
    if wrong := [s for s in rows if not target.get(s, 0) > 0]:
        raise ValueError(f"sources without a positive weight: {wrong[:5]}")
    own: dict[str | None, list[int]] = {}
    for slot, s in enumerate(schedule({s: -(-n // size) for s, n in rows.items()}, target)):
        own.setdefault(s, []).append(slot)
    sent = [(s, at // SENT, x[at : at + SENT]) for s, x in own.items() for at in range(0, len(x), SENT)]
    kind = df.schema[source].dataType.simpleString()
    placing = written(df.sparkSession.createDataFrame(sent, f"__name {kind}, __part long, __slots array<long>"), "schedule")
    order = [F.col(f"`{key}`").asc_nulls_first()] + ([F.col(f"`{order_by}`").asc_nulls_first()] if order_by else [])
    ranked = dense_number(df, source, order, "source_rank", key_byte(key))
    placed = ranked.withColumn("block", F.floor(F.col("source_rank") / size))
    placed = placed.join(placing, placed[source].eqNullSafe(placing["__name"]) & (F.floor(placed["block"] / SENT) == placing["__part"]))
    placed = placed.withColumn("slot", F.element_at("__slots", (F.col("block") % SENT + 1).cast("int")))
    placed = placed.withColumn("position", F.col("slot") * size + F.col("source_rank") % size)
    return placed.select(*(F.col(f"`{c}`") for c in df.columns), *names)
