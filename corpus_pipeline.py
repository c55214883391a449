"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents it hands on.

quality rules -> n-gram Jaccard join -> benchmark decontamination -> mixing -> sharding. All but the last
return the columns of documents. Mixing reads sources whose weight exceeds their share more than once, so
a document may stand there more than once, in the order of the schedule; sharding places every such row.

Nulls, empty and very long texts, ties and repeated rows are treated as each operator's docstring says; stages
keep rows with a null doc_id unless their text is rejected. An empty table goes through as one. Extra columns
are handed on by all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import shared_folder, table
from inkstone.llm.decontaminate import CONTAMINATED, find_benchmark
from inkstone.llm.jaccard_join import jaccard_classes
from inkstone.llm.mixing import mix
from inkstone.llm.quality_rules import judge
from inkstone.llm.sharding import place_rows


def _packed(docs: DataFrame) -> DataFrame:
    """docs with all its columns in one struct `row`, so that no extra column clashes, beside those that stages read."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source", "lang")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Rows are judged with their texts' MD5, so rows that repeat a doc_id with other texts stay apart.
    """
    keyed = _packed(docs).withColumn("md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    verdict = judge(keyed, table(spark, sf_dir, "labels"), ["doc_id", "md5"], F.col("lang"))
    gone = verdict.where("NOT kept").select(F.col("doc_id").alias("d"), F.col("md5").alias("m")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("md5") == F.col("m"))
    return _unpacked(keyed.join(gone, on, "left_anti"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that of the smallest doc_id.

    Rows that repeat this doc_id, and rows without one, all stay.
    """
    gone = jaccard_classes(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 5 % of the words or more stand in benchmark windows go."""
    hit = find_benchmark(_packed(docs), table(spark, sf_dir, "benchmark"), ["row"])
    return _unpacked(hit.where(f"NOT ({CONTAMINATED})"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the Pfair schedule; a source that must be read again is."""
    order = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    placed = mix(_packed(docs), order=order)
    return _unpacked(placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id"), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's place in 40 shards."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return place_rows(narrow, ["doc_id", "text_crc32", "n_bytes", "source"], 40)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Signatures, suffix ranges and the schedule are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    The result is written there too and the other stages' tables go once it stands.
    """
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    for name, _ in STAGES[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
