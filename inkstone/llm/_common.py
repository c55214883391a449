"""What the operators of this subpackage share: table access, durable cuts and gapless numbering."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six bytes that separate words where a contract says `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors see: the session's `spark.checkpoint.dir`.

    Where none is set, a local session (tests) gets one of its own; on a cluster that is an error, since a
    machine's own temporary folder would lose data with its executor.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="inkstone-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read on from there: a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing reads any more, before the next large shuffle."""
    gc.collect()
    spark._jvm.System.gc()


def buckets_for(rows: int) -> int:
    """Buckets of about a million rows each, 1,024 at least."""
    return max(1024, 1 << max(rows - 1, 0).bit_length() >> 20)


def gapless(df: DataFrame, order: list[str], name: str, within: str | None = None, buckets: int = 1024) -> DataFrame:
    """Number rows 0, 1, 2, ... over the table (or in each value of `within`) without one global sort.

    Rows go to `buckets` hash buckets of the `order` columns, are ranked inside each bucket, and each
    bucket starts at the sum of the buckets before it. The number depends on the rows alone, not on
    the partitioning; only rows equal in all of `order` may swap numbers. A hot value of `within` is
    spread over all buckets. The table of starts has at most buckets x distinct(within) rows; it is broadcast
    only without `within`. A column that has the new name already is replaced.
    """
    keys = ["_k"] if within else []
    rest = [c for c in df.columns if c != name]
    orders = [f"_o{i}" for i in range(len(order))]
    # All of df goes in one struct, so that no name of its columns clashes.
    b = df.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"),
        *[F.col(f"`{c}`").alias(o) for c, o in zip(order, orders, strict=True)],
        # Never null, so that the join below is by the same keys as the window and moves no rows.
        *([F.coalesce(F.concat(F.lit("v"), F.col(f"`{within}`").cast("string")), F.lit("n")).alias("_k")] if within else []),
    ).withColumn("_bucket", F.pmod(F.xxhash64(*orders), F.lit(buckets)).cast("int"))
    starts = (
        b.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(_before(keys)) - F.col("_n"))
        .select(*[F.col(k).alias(f"_s{k}") for k in keys], F.col("_bucket").alias("_b"), "_start")
    )
    ranked = b.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*orders)))
    on: Column = F.col("_bucket") == F.col("_b")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_s{k}"))
    return ranked.join(starts if within else F.broadcast(starts), on).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rest], (F.col("_start") + F.col("_rank") - 1).alias(name)
    )


def _before(keys: list[str]):
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
