"""Records of three kinds as one table of search documents, and that table's index columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.text import norm, tokens
from inkstone.operators.relational import cascade_keys
from inkstone.schema import FIELDS


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def _joined(*cols: str):
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in cols])


def build_docs(parents: DataFrame, children: DataFrame, batches: DataFrame) -> DataFrame:
    """key, kind, id, code, source, damageType, name, other, createdAt, rubbingId and `parent` (does it exist?)."""
    empty = F.lit("")
    none = F.lit(None).cast("string")
    p = parents.select(
        F.concat(F.lit("rubbing:"), "id").alias("key"), F.lit("rubbing").alias("kind"), "id", _text("code").alias("code"),
        _text("source").alias("source"), empty.alias("damageType"), _text("note").alias("name"), _text("paperSize").alias("other"),
        _text("createdAt").alias("createdAt"), none.alias("rubbingId"), F.lit(False).alias("parent"),
    )
    of = parents.select(F.col("id").alias("_id"), F.col("code").alias("_code"), F.col("source").alias("_source"))
    c = children.join(of, children["rubbingId"] == F.col("_id"), "left").select(
        F.concat(F.lit("damage:"), "id").alias("key"), F.lit("damage").alias("kind"), "id", _text("_code").alias("code"),
        _text("_source").alias("source"), _text("type").alias("damageType"), _text("position").alias("name"),
        _joined("repairNote", "status").alias("other"), _text("createdAt").alias("createdAt"), "rubbingId", F.col("_id").isNotNull().alias("parent"),
    )
    b = batches.select(
        F.concat(F.lit("batch:"), "id").alias("key"), F.lit("batch").alias("kind"), "id", F.col("id").alias("code"), empty.alias("source"),
        empty.alias("damageType"), _text("name").alias("name"), _joined("note", "status").alias("other"), _text("createdAt").alias("createdAt"),
        none.alias("rubbingId"), F.lit(False).alias("parent"),
    )
    return p.unionByName(c).unionByName(b)


def doc_fields(docs: DataFrame) -> DataFrame:
    """One row for each non-empty field: key, ord, field, raw."""
    fields = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f).alias("raw")) for i, f in enumerate(FIELDS)])
    return docs.select("key", F.explode(F.filter(fields, lambda x: x["raw"] != "")).alias("f")).select("key", "f.*")


def affected_keys(changes: DataFrame, children: DataFrame) -> DataFrame:
    """Doc keys that changes touch: their own, and the children of parents that they upsert or delete."""
    own = changes.select(F.concat_ws(":", "kind", "id").alias("key"))
    parents = changes.where("kind = 'rubbing'").select("id").distinct()
    return own.unionByName(cascade_keys(children, parents).select(F.concat(F.lit("damage:"), "id").alias("key"))).distinct()


def field_dictionary(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Distinct values (field, raw) with their normal form and grams, derived once for each raw value of a field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields])
    raw = docs.select(F.explode(F.filter(pairs, lambda x: x["raw"] != "")).alias("f")).select("f.*").distinct()
    raw = raw.withColumn("norm", norm(docs.sparkSession, F.col("raw")))
    return raw.withColumn("grams", tokens(F.col("norm")))


def postings(docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(gram, field, key), each once (docs may repeat a key)."""
    values = field_dictionary(docs) if dictionary is None else dictionary
    joined = doc_fields(docs).join(values.select("field", "raw", "grams"), ["field", "raw"])
    return joined.select(F.explode("grams").alias("gram"), "field", "key").distinct()
