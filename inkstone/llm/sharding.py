"""Sharding (operator 2): a Feistel permutation of global row numbers.

Row numbers 0..n-1 are permuted by a keyed Feistel network on the mixed-radix domain a x b
(a = ceil(sqrt n), b = ceil(n / a), so a*b - n < a), walking the cycle while an image is not below n.
The image y gives `shard = y mod k` and `slot = y div k`: shard sizes differ by at most one row, slots
have no gaps, and both directions are closed formulas of (n, k, seed) (`place`, `row_of`).

Everything is DataFrame functions. Nulls: a null text has size 16 and CRC 0; a null doc_id is numbered
like any value. Empty texts have size 16 too; very long ones are only measured and never moved. Equal rows
are interchangeable. An empty table gives an empty result. Extra columns are ignored (`place_rows` carries
those asked for, whatever their names but row_no, shard and slot).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import buckets_for, cut, gapless, table

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _mix(seed: int, i: Column, v: Column, radix: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), i.cast("long"), v), F.lit(radix).cast("long"))


def feistel(x: Column, n: int, seed: int, inverse: bool = False) -> Column:
    """One pass of the network over the domain a x b of n; a bijection of 0..a*b-1."""
    a, b = domain(n)
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def step(s: Column, i: Column) -> Column:
        hi, lo = s["hi"], s["lo"]
        sign = -1 if inverse else 1
        return F.when(
            i % 2 == 0, F.struct(F.pmod(hi + sign * _mix(seed, i, lo, a), la).alias("hi"), lo.alias("lo"))
        ).otherwise(F.struct(hi.alias("hi"), F.pmod(lo + sign * _mix(seed, i, hi, b), lb).alias("lo")))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    x = x.cast("long")
    low = F.pmod(x, lb)
    start = F.struct(((x - low) / lb).cast("long").alias("hi"), low.alias("lo"))
    return F.aggregate(rounds, start, step, lambda s: s["hi"] * lb + s["lo"])


def walk(x: Column, n: int, seed: int, extra: int, inverse: bool = False) -> Column:
    """Cycle walking: apply the network, then again (at most `extra` times) while the image is >= n."""
    y = feistel(x, n, seed, inverse)
    if not extra:
        return y
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(extra)), y, lambda s, _: F.when(s < n, s).otherwise(feistel(s, n, seed, inverse))
    )


def extra_steps(spark: SparkSession, n: int, seed: int) -> int:
    """The longest walk that any row can need, found exactly from the fewer than a points beyond n.

    A walk leaves 0..n-1 only through those points, so the longest run among them bounds every row's.
    """
    a, b = domain(n)
    if a * b == n:
        return 0
    steps = 0
    while True:
        steps += 8
        last = spark.range(n, a * b).select(
            F.aggregate(
                F.sequence(F.lit(1), F.lit(steps)),
                F.struct(F.col("id").alias("y"), F.lit(0).alias("d")),
                lambda s, _: F.when(s["y"] < n, s).otherwise(
                    F.struct(feistel(s["y"], n, seed).alias("y"), (s["d"] + 1).alias("d"))
                ),
            ).alias("s")
        ).agg(F.max("s.d").alias("d"), F.max("s.y").alias("y")).first()
        if last["y"] < n:
            return last["d"]


def place(row_no: Column, n: int, shards: int, seed: int, extra: int) -> Column:
    """struct(shard, slot) of a row number."""
    y = walk(row_no, n, seed, extra)
    return F.transform(
        F.array(y),
        lambda v: F.struct(F.pmod(v, F.lit(shards)).cast("int").alias("shard"), ((v - F.pmod(v, F.lit(shards))) / shards).cast("long").alias("slot")),
    )[0]


def row_of(shard: Column, slot: Column, n: int, shards: int, seed: int, extra: int) -> Column:
    """The row number that `place` sends to (shard, slot)."""
    return walk(slot.cast("long") * shards + shard, n, seed, extra, inverse=True)


def place_rows(df: DataFrame, order: list[str], shards: int, seed: int = 17, buckets: int | None = None) -> DataFrame:
    """df (narrow: it is written once to the shared folder) with `row_no`, `shard` and `slot`."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = cut(df)
    n = kept.count()
    extra = extra_steps(df.sparkSession, n, seed) if n else 0
    numbered = gapless(kept, order, "row_no", buckets=buckets or buckets_for(n))
    return numbered.withColumn("_p", place(F.col("row_no"), max(n, 1), shards, seed, extra)).select(
        *df.columns, "row_no", F.col("_p.shard").alias("shard"), F.col("_p.slot").alias("slot")
    )


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = place_rows(narrow, ["doc_id", "text_crc32", "size"], 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )
