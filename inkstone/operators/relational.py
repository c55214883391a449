"""Listing and enrichment queries over the three record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_pending(status: str = "status") -> Column:
    return ~F.col(status).eqNullSafe(F.lit("repaired"))


def parent_counts(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents with damageCount and pendingDamages, zero where there are none."""
    counts = children.groupBy(F.col("rubbingId").alias("_p")).agg(
        F.count(F.lit(1)).alias("damageCount"), F.count_if(is_pending()).alias("pendingDamages")
    )
    return parents.join(counts, F.col("id") == F.col("_p"), "left").drop("_p").na.fill(0, ["damageCount", "pendingDamages"])


def enrich_batches(batches: DataFrame, children: DataFrame) -> DataFrame:
    """Batches with their members in order (duplicates kept, unknown ids left out) and counts."""
    member = F.struct(*[F.col(f"d.{c}").alias(c) for c in children.columns])
    done = F.col("d.status").eqNullSafe(F.lit("repaired"))
    lists = (
        batches.select(F.col("id").alias("_b"), F.posexplode("damageIds").alias("pos", "damageId"))
        .join(children.alias("d"), F.col("damageId") == F.col("d.id"))
        .groupBy("_b")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", member.alias("d")))).alias("l"),
            F.count(F.lit(1)).cast("int").alias("total"),
            F.count_if(done).cast("int").alias("repaired"),
        )
        .select("_b", F.transform("l", lambda x: x["d"]).alias("damages"), "total", "repaired")
    )
    out = batches.join(lists, F.col("id") == F.col("_b"), "left").drop("_b").na.fill(0, ["total", "repaired"])
    return out.withColumn("pending", F.col("total") - F.col("repaired"))


def filter_children(children: DataFrame, status: str | None = None, type_: str | None = None) -> DataFrame:
    out = children.where(F.col("status") == status) if status else children
    return out.where(F.col("type") == type_) if type_ else out


def missing_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    """ids(id, ...) that are not in the table."""
    return ids.join(table.select("id"), "id", "left_anti")


def existing_ids(ids: DataFrame, table: DataFrame) -> DataFrame:
    return ids.join(table.select("id"), "id", "left_semi")


def first_override(rows: DataFrame, overrides: DataFrame, on: str, position: str, values: list[str]) -> DataFrame:
    """rows with each of `values` from the first override of its key (by position) unless that is null or ''."""
    first = overrides.groupBy(F.col(on).alias("_k")).agg(F.min_by(F.struct(*values), position).alias("_v"))
    out = rows.join(first, F.col(on) == F.col("_k"), "left")
    return out.withColumns({v: F.coalesce(F.nullif(F.col(f"_v.{v}"), F.lit("")), F.col(v)) for v in values}).drop("_k", "_v")


def fold(changes: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The last change of each key, without keys whose last change deletes."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.withColumn("_deleted", deleted).groupBy(*keys).agg(F.max_by(F.struct(*rest, "_deleted"), F.struct(*order)).alias("_l"))
    return last.where("NOT _l._deleted").select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def as_of(changes: DataFrame, keys: list[str], seq: str, at: int, deleted: Column) -> DataFrame:
    """State after all changes up to and with `at`."""
    return fold(changes.where(F.col(seq) <= at), keys, [seq], deleted)


def intervals(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Changes with valid_from and valid_to (null: current)."""
    from pyspark.sql import Window

    return changes.withColumns({"valid_from": F.col(seq), "valid_to": F.lead(seq).over(Window.partitionBy(*keys).orderBy(seq))})


def prune(history: DataFrame, floor: int) -> DataFrame:
    """Versions that a reader at `floor` or later can still see (one that ends exactly there stays)."""
    return history.where(F.col("valid_to").isNull() | (F.col("valid_to") >= floor))


def cascade_keys(children: DataFrame, changed_parents: DataFrame) -> DataFrame:
    """Children whose parent changed."""
    return children.join(changed_parents.select(F.col("id").alias("rubbingId")), "rubbingId", "left_semi").select("id").distinct()
