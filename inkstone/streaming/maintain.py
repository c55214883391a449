"""Incremental upkeep of a doc table from the change log, as a Structured Streaming query."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.engine import Engine
from inkstone.plans.docs import affected_keys
from inkstone.schema import CHANGE
from inkstone.sources.files import Folder

#: Parts that a version is cut into by key; a batch writes only those that it touches.
PARTS = 64


def apply_batch(engine: Engine, docs: DataFrame, changes: DataFrame) -> DataFrame:
    """docs with those of affected keys made anew as of the last change; the same when applied twice."""
    seq = changes.agg(F.max("seq")).first()[0]
    if seq is None:
        return docs
    keys = affected_keys(changes, engine.log.table("damage", seq))
    return docs.join(keys, "key", "left_anti").unionByName(engine.docs(seq).join(keys, "key", "left_semi"))


def _part(key: str = "key"):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class Maintained:
    """A doc table kept up under a folder: parts of versions, and `POINTER`, which names the version of each part.

    POINTER is {seq, v, parts: {part: version}}, replaced in one step after the parts are written; what it
    names counts, whatever else stands in the folder after a crash.
    """

    def __init__(self, engine: Engine, out: str):
        self.engine, self.spark = engine, engine.spark
        self.folder = Folder(self.spark, out)
        self.folder.fs.mkdirs(self.folder.path(""))

    def pointer(self) -> dict | None:
        text = self.folder.read("POINTER")
        return json.loads(text) if text else None

    def docs(self, parts: list[int] | None = None) -> DataFrame:
        """The table, or some parts of it."""
        at = self.pointer()
        schema = self.engine.docs().schema
        paths = [f"{self.folder.root}/v={v}/part={p}" for p, v in (at["parts"] if at else {}).items() if parts is None or int(p) in parts]
        paths = [p for p in paths if self.folder.fs.exists(self.folder.path("", p))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _save(self, docs: DataFrame, parts: list[int], seq: int) -> None:
        last = self.pointer() or {"v": -1, "parts": {}, "seq": 0}
        v = last["v"] + 1
        docs.withColumn("part", _part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder.root}/v={v}")
        named = {**last["parts"], **{str(p): v for p in parts}}
        self.folder.replace("POINTER", json.dumps({"v": v, "seq": max(seq, last["seq"]), "parts": named}))
        for name in self.folder.names(""):  # versions that no part names any more, but for the one before
            if name.startswith("v=") and int(name[2:]) not in {*named.values(), v, v - 1}:
                self.folder.remove(name)

    def catch_up(self) -> None:
        """Where the log's snapshot is newer than the table, or there is none, make it from the snapshot."""
        last, base = self.pointer(), self.engine.log.base
        if base > (last["seq"] if last else 0):
            self._save(self.engine.docs(base), list(range(PARTS)), base)

    def step(self, batch: DataFrame, number: int) -> None:
        self.catch_up()
        new = batch.where(F.col("seq") > self.engine.log.base)
        seq = new.agg(F.max("seq")).first()[0]
        if seq is None:
            return
        keys = affected_keys(new, self.engine.log.table("damage", seq))
        parts = [r["p"] for r in keys.select(_part().alias("p")).distinct().collect()]  # at most PARTS
        self._save(apply_batch(self.engine, self.docs(parts), new), parts, seq)


def start(engine: Engine, out: str, checkpoint: str):
    """Stream new change files into the doc table under `out`; a start goes on where POINTER says."""
    table = Maintained(engine, out)
    changes = engine.spark.readStream.schema(CHANGE).option("ignoreMissingFiles", True).json(f"{engine.path}/changes")
    table.catch_up()
    return changes.writeStream.foreachBatch(table.step).option("checkpointLocation", checkpoint).start()
