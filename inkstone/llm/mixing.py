r"""Mixing sources to target weights (operator 7): a Pfair schedule of source blocks.

Documents of a source are numbered without gaps (over hash buckets, so a source with a third of all rows is
no hot key) and dealt into blocks of `block_rows`. Block j of a source with weight w is released at
floor(j / w) and due at ceil((j + 1) / w); one block runs in each slot, the released one with the earliest
deadline first. Since the weights add up to 1, every block runs inside its window, so after any number of
slots each source is less than one block away from its target.

Weights are whole parts of `parts` (2^16; each source has one part at least, which can make the whole a
little larger). After `whole` slots every source has had exactly its parts of them, so the schedule repeats:
the driver works out one period (at most 2^16 slots and one for each source), and block j of a source with p
parts runs in slot (j div p) * whole + slot(j mod p). That is a join with a table whose size does not depend on
the documents; blocks have `block_rows` rows at every size of the table.

Weights default to tempered sizes, rows^`temper` normalised. The schedule goes on until every source has
been read once: a source whose weight exceeds its share starts over (`epoch` counts from 0), none is cut
short. The driver holds one row for each source.

A null source is a source. Texts are not looked at. Equal rows are interchangeable. Empty tables give empty
results. Extra columns are carried by `mix`, whatever their names; those called block, epoch, release, deadline or
position are replaced by its own. The query ignores them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import buckets_for, gapless, table

BLOCK_ROWS = 16
PARTS = 1 << 16
TEMPER = 0.8


def pfair(weights: list[Fraction], slots: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(slot, source, block, release, deadline), earliest deadline first among released blocks."""
    waiting = [(0, i, 0) for i, w in enumerate(weights) if w > 0]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((j + 1) / weights[i]), i, j, release))
        deadline, i, j, release = heapq.heappop(ready)
        yield slot, i, j, release, deadline
        heapq.heappush(waiting, (math.floor((j + 1) / weights[i]), i, j + 1))


def target_parts(counts: dict, weights: dict | None = None, temper: float = TEMPER, parts: int = PARTS) -> dict:
    """Whole parts of each source, in proportion to its weight (by default its tempered size)."""
    raw = {s: float(weights[s]) if weights else n**temper for s, n in counts.items()}
    total = sum(raw.values())
    return {s: max(1, round(r / total * parts)) for s, r in raw.items()}


def n_slots(counts: dict, parts: dict, block_rows: int) -> int:
    """Slots until every source has been read once."""
    whole = sum(parts.values())
    return max((-(-(-(-n // block_rows)) * whole // parts[s]) for s, n in counts.items()), default=0)


def period(parts: dict, slots: int) -> list[tuple]:
    """(source, number, slot, release, deadline) of the first `slots` slots of a period, at most all of them."""
    order = sorted(parts, key=lambda s: (s is not None, s or ""))
    whole = sum(parts.values())
    plan = pfair([Fraction(parts[s], whole) for s in order], min(slots, whole))
    return [(order[i], j, slot, release, deadline) for slot, i, j, release, deadline in plan]


def readings(rows: list[tuple], parts: dict, slots: int) -> dict:
    """How many blocks of each source run in the first `slots` slots."""
    whole = sum(parts.values())
    out = {s: slots // whole * p for s, p in parts.items()}
    for source, _, slot, _, _ in rows:
        out[source] += slot < slots % whole
    return out


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, order: list[Column] | None = None) -> DataFrame:
    """docs with block, epoch, release, deadline and position (its block's slot), a row for each reading.

    `order` (by default doc_id) decides which rows share a block; rows equal in it may swap places.
    """
    spark = docs.sparkSession
    own = ("block", "epoch", "release", "deadline", "position")
    carried = [c for c in docs.columns if c not in own]
    counts = {r["s"]: r["n"] for r in docs.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = target_parts(counts, weights)
    whole, slots = sum(parts.values()), n_slots(counts, parts, block_rows)
    rows = period(parts, slots)
    total = readings(rows, parts, slots)
    plan = spark.createDataFrame(rows, "s string, j long, slot long, release long, deadline long")
    sources = spark.createDataFrame(
        [(s, parts[s], -(-n // block_rows), total[s]) for s, n in counts.items()], "s string, parts long, blocks long, readings long"
    )
    # All of docs goes in one struct, so that no name of its columns clashes.
    keys = order or [F.col("doc_id")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("source").alias("source"), *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    numbered = gapless(packed, [f"key{i}" for i in range(len(keys))], "no", within="source", buckets=buckets_for(max(counts.values(), default=0)))
    numbered = numbered.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = ((F.col("no") - F.pmod("no", F.lit(block_rows))) / block_rows).cast("long")
    numbered = numbered.withColumn("block", block)
    # Reading number block + epoch * blocks of its source, as far as the schedule goes.
    last = F.floor((F.col("readings") - 1 - F.col("block")) / F.col("blocks")).cast("long")
    read = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    number = F.col("block") + F.col("epoch") * F.col("blocks")
    read = read.withColumn("j", F.pmod(number, F.col("parts"))).withColumn("before", ((number - F.col("j")) / F.col("parts")).cast("long") * whole)
    plan = plan.select(F.col("s"), F.col("j").alias("k"), "slot", "release", "deadline")
    out = read.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")) & (F.col("j") == F.col("k")))
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in carried], "block", "epoch", *[(F.col("before") + F.col(c)).alias(n) for c, n in (("release", "release"), ("deadline", "deadline"), ("slot", "position"))]
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "epoch", "release", "deadline", "position")
