"""Training rows for the classifiers: labelled, bounded, chosen by hash, and read in one narrow job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def chosen(ids: DataFrame, most: int, salt: int) -> DataFrame:
    """At most `most` rows of ids(doc_id, ...): those with the smallest hash, the same on every run."""
    return ids.orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id").limit(most)


def with_text(docs: DataFrame, few: DataFrame, bytes_: int, salt: int) -> DataFrame:
    """few (bounded by `chosen`, so broadcast) joined to their texts and `_h`, a hash of the text, in whole texts of `bytes_` in all.

    A first pass sums the lengths in the order of `chosen` and leaves out what comes after the bound. Rows that
    repeat a doc_id all come; `_h` lets the reader take the same one on every run.
    """
    keys = few.columns
    joined = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    order = [F.xxhash64(F.lit(salt), "doc_id"), *keys]
    sized = joined.groupBy(*keys).agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("_b"))
    inside = sized.withColumn("_sum", F.sum("_b").over(Window.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("_sum") <= bytes_)
    out = docs.select("doc_id", "text").join(F.broadcast(inside.select(*keys)), "doc_id")
    return out.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
