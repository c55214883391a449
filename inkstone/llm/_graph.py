"""Connected components and a bounded membership filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm._common import cut, release
from inkstone.llm._words import trim


#: Edges that one task settles (16 MB); more are settled by rounds of joins, with the same result.
LOCAL = 1 << 20


def components(edges: DataFrame, local: int | None = None) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: each is a grouped minimum and a join, the edge set
    never grows beyond twice its size, and hub nodes cost partial aggregation only. Every round is
    cut to the shared folder. Up to `local` edges (counted) need no rounds.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    if e.count() <= (LOCAL if local is None else local):
        return e.coalesce(1).mapInArrow(_joined, "node long, component long")
    e = cut(_small(e))
    while True:
        label = e.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("c"))
        # Done when each node has one edge, to a node that has none.
        further = label.select(F.col("v").alias("w")).join(label.select(F.col("u").alias("w")), "w", "left_semi")
        if not label.where("c > 1").select("u").unionByName(further.toDF("u")).agg(F.count(F.lit(1))).first()[0]:
            break
        e = cut(_small(_large(e)))
        release(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to (node, component), by hooking the larger label to the smaller and halving paths."""
    pairs = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if pairs:
        nodes, at = np.unique(np.concatenate([x for p in zip(*pairs, strict=True) for x in p]), return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        label = np.arange(len(nodes))
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(label, label[label]):
                label = label[label]
        yield pa.record_batch([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def stars(comp: DataFrame) -> DataFrame:
    """The edges (a, b) from each node of components to the smallest one."""
    return comp.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
    out = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return out.where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """For edges with u > v."""
    least = e.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    hop = e.join(least, F.col("u") == F.col("_u")).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return hop.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()


class Sieve:
    """A Bloom filter of 16 bits a key, 32 MB at most, over long keys.

    It only spares work: what passes it is joined exactly afterwards. Beyond 16 million keys it lets more
    rows through.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int | None = None):
        if bits is None:
            bits = min(max((16 * keys.count()).bit_length(), 16), 28)
        self.bits = bits
        mask = (1 << bits) - 1
        bit = F.explode(F.array(F.xxhash64(F.lit(1), column), F.xxhash64(F.lit(2), column)).alias("h"))
        marks = (
            keys.select(bit.alias("h"))
            .select(F.shiftright("h", 8).bitwiseAND(mask).alias("p"))
            .groupBy(F.shiftright("p", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
            .toArrow()
        )
        self.words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        self.words[marks["word"].to_numpy()] = marks["m"].to_numpy().view(np.uint64)

    def hashes(self, key: str) -> list:
        """Columns to append, last, for `before`."""
        return [F.xxhash64(F.lit(1), key).alias("_h1"), F.xxhash64(F.lit(2), key).alias("_h2")]

    def before(self, function=None):
        """`function` over Arrow batches of the rows that may be present, without the hash columns."""
        words, bits = self.words, self.bits

        def has(h: pa.Array) -> np.ndarray:
            p = (h.to_numpy().view(np.uint64) >> np.uint64(8)) & np.uint64((1 << bits) - 1)
            return (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_columns - 2
                mask = has(batch.column(n)) & has(batch.column(n + 1))
                yield batch.select(list(range(n))).filter(pa.array(mask))
            trim()

        return passed if function is None else lambda batches: function(passed(batches))
