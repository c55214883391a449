"""The change log: the one source of truth. Append-only, folded on read, compacted to snapshots.

Layout under a folder that every executor sees: `changes/seq=<n>-*.jsonl` (a commit is one file), `snapshot/v=<seq>/`
(a table of live records), `quarantine/` (lines that could not be read), `CURRENT` (the snapshot that
counts, replaced in one step by an overwriting rename).

An upsert sets the top-level fields that its payload holds and leaves the others of the live record as they
are; a delete drops the record, so a later upsert begins anew.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.schema import ARCHIVE, CHANGE, KINDS, LISTS, SNAPSHOT
from inkstone.sources.files import Folder

_ACTIONS = {f"{a}{k.capitalize()}": (k, a) for a in ("upsert", "delete") for k in KINDS}
COMPACT_AT = 2000


def flatten_ops(op: list) -> list[tuple[str, str, str, str | None]]:
    """(kind, action, id, payload) of an operation; bulk operations are taken apart, unknown ones raise ValueError."""
    name, payload = op
    if name == "bulk":
        return [row for sub in payload for row in flatten_ops(sub)]
    if name not in _ACTIONS:
        raise ValueError(f"unknown operation {name}")
    kind, action = _ACTIONS[name]
    if action == "delete":
        return [(kind, action, payload, None)]
    return [(kind, action, payload["id"], json.dumps(payload, ensure_ascii=False))]


def merged(payloads: Column) -> Column:
    """One JSON object from an array of them: each field from the last that holds it, fields in order of name."""
    fields = F.transform(
        payloads, lambda p: F.transform_values(F.coalesce(F.from_json(p, "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    )
    empty = F.create_map().cast("map<string,string>")
    last = F.aggregate(fields, empty, lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(x, k)), x))
    entries = F.array_sort(F.map_entries(last))

    def pair(e: Column) -> Column:
        quoted = F.to_json(F.array(e["key"]))
        return F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), e["value"])

    return F.concat(F.lit("{"), F.array_join(F.transform(entries, pair), ","), F.lit("}"))


def parsed(raw: DataFrame) -> DataFrame:
    """Lines (value) with the columns of a change, and whether the line is one (`good`); torn lines are not."""
    v = F.try_parse_json("value")
    return raw.withColumns(
        {
            "seq": F.try_variant_get(v, "$.seq", "bigint"),
            "sub": F.try_variant_get(v, "$.sub", "int"),
            "kind": F.try_variant_get(v, "$.kind", "string"),
            "action": F.try_variant_get(v, "$.action", "string"),
            "id": F.try_variant_get(v, "$.id", "string"),
            "payload": F.try_variant_get(v, "$.payload", "string"),
        }
    ).withColumn(
        "good",
        F.col("seq").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.col("kind").isin(*KINDS) & F.col("action").isin("upsert", "delete"), F.lit(False)),
    )


def fold_payloads(rows: DataFrame) -> DataFrame:
    """Live records from rows (kind, id, payload, first_seq, first_sub, seq, sub, action): merged payloads since the last delete."""
    at = F.struct("seq", "sub")
    deaths = rows.where("action = 'delete'").groupBy("kind", "id").agg(F.max(at).alias("dead"))
    alive = rows.join(deaths, ["kind", "id"], "left").where("action = 'upsert' AND (dead IS NULL OR struct(seq, sub) > dead)")
    one = alive.groupBy("kind", "id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "sub", "payload"))).alias("l"),
        F.min(F.struct(F.coalesce("first_seq", "seq").alias("s"), F.coalesce("first_sub", "sub").alias("b"))).alias("f"),
    )
    payload = F.when(F.size("l") == 1, F.col("l")[0]["payload"]).otherwise(merged(F.transform("l", lambda x: x["payload"])))
    return one.select("kind", "id", payload.alias("payload"), F.col("f.s").alias("first_seq"), F.col("f.b").alias("first_sub"))


class ChangeLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        self._lock = threading.RLock()
        self.folder.fs.mkdirs(self.folder.path("changes"))
        current = self.folder.read("CURRENT")
        self.base = self.seq = int(current) if current else 0
        # The one count of the log's lines; appends keep it up.
        at = self.lines().agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("good"), F.col("seq"))).alias("seq")).first()
        self.n_lines, self.seq = at["n"], max(self.seq, at["seq"] or 0)

    # --- reading ----------------------------------------------------------------------------------

    def lines(self) -> DataFrame:
        """Every line of the log with what could be read of it."""
        return parsed(self.spark.read.schema("value string").text(f"{self.path}/changes"))

    def changes(self) -> DataFrame:
        """Changes after the current snapshot, each (seq, sub) once; unreadable lines are left out."""
        return self.lines().where("good").where(F.col("seq") > self.base).select(*CHANGE.names).dropDuplicates(["seq", "sub"])

    def _snapshot(self) -> DataFrame:
        if not self.base:
            return self.spark.createDataFrame([], "kind string, id string, payload string, first_seq long, first_sub int")
        return self.spark.read.parquet(f"{self.path}/snapshot/v={self.base}")

    def state(self, seq: int | None = None, kind: str | None = None, ids: list[str] | None = None) -> DataFrame:
        """Live records (kind, id, payload, first_seq, first_sub) as of seq; first_*: where a record entered, its listing order.

        Only those of a kind, or of given ids, if asked for: others are left out before anything is folded. A
        record's changes since the last snapshot are merged in one row; compaction bounds how many there are.
        """
        if seq is not None and seq < self.base:
            raise ValueError(f"history before {self.base} has been compacted")

        def wanted(rows: DataFrame) -> DataFrame:
            rows = rows if kind is None else rows.where(F.col("kind") == kind)
            return rows if ids is None else rows.where(F.col("id").isin(ids))

        changes = self.changes() if seq is None else self.changes().where(F.col("seq") <= seq)
        old = wanted(self._snapshot()).select("kind", "id", "payload", "first_seq", "first_sub", F.col("first_seq").alias("seq"), F.lit(-1).alias("sub"), F.lit("upsert").alias("action"))
        new = wanted(changes).select("kind", "id", "payload", F.lit(None).cast("long").alias("first_seq"), F.lit(None).cast("int").alias("first_sub"), "seq", "sub", "action")
        return fold_payloads(old.unionByName(new))

    def table(self, kind: str, seq: int | None = None) -> DataFrame:
        """Records of a kind in insertion order columns (_seq, _sub last)."""
        rows = self.state(seq, kind)
        return rows.select(F.from_json("payload", KINDS[kind]).alias("r"), F.col("first_seq").alias("_seq"), F.col("first_sub").alias("_sub")).select("r.*", "_seq", "_sub")

    # --- writing ----------------------------------------------------------------------------------

    def append(self, ops: list) -> int:
        """Commit operations (one, or a list of them) at one seq; an empty list changes nothing."""
        with self._lock:
            if ops and isinstance(ops[0], str):
                ops = [ops]
            rows = [row for op in ops for row in flatten_ops(op)]
            if not rows:
                return self.seq
            seq = self.seq + 1
            names = ("kind", "action", "id", "payload")
            lines = [json.dumps({"seq": seq, "sub": i, **dict(zip(names, r, strict=True))}, ensure_ascii=False) for i, r in enumerate(rows)]
            self.folder.replace(f"changes/seq={seq:012d}-{uuid.uuid4().hex}.jsonl", "\n".join(lines) + "\n")
            self.seq, self.n_lines = seq, self.n_lines + len(lines)
            return seq

    def recover(self) -> int:
        """Set unreadable lines aside and compact what is left; returns how many there were."""
        with self._lock:
            bad = self.lines().where("NOT good").select("value")
            n = bad.count()
            if n:
                bad.write.mode("append").text(f"{self.path}/quarantine/{uuid.uuid4().hex}")
                self.compact()
            return n

    def needs_compaction(self) -> bool:
        return self.n_lines >= COMPACT_AT

    def compact(self, upto: int | None = None) -> int:
        """Fold the changes up to a seq (all of them, if none is given) into a new snapshot, make it current, then drop them.

        A snapshot that is current is never written again; the one before it stays for readers that have
        planned with it. Lost halfway, either the old snapshot counts, or changes that the new one holds are
        ignored by their seq.
        """
        with self._lock:
            seq, before = max(self.seq if upto is None else min(upto, self.seq), 1), self.base
            if seq > before:
                self.state(seq).write.mode("overwrite").parquet(f"{self.path}/snapshot/v={seq}")
                self.folder.replace("CURRENT", str(seq))
                self.base, self.seq = seq, max(self.seq, seq)
            for name in self.folder.names("changes"):
                at = re.match(r"seq=(\d+)-", name)
                if upto is None or (at and int(at[1]) <= seq):
                    self.folder.remove(f"changes/{name}")
            self.n_lines = 0 if upto is None else self.lines().count()
            for name in self.folder.names("snapshot"):
                if name not in (f"v={self.base}", f"v={before}"):
                    self.folder.remove(f"snapshot/{name}")
            return self.base

    def load(self, tables: dict[str, DataFrame]) -> int:
        """Tables of records by kind, in listing order, as the first snapshot; only into an empty log."""
        with self._lock:
            if self.seq:
                return self.seq
            parts = []
            for at, (kind, rows) in enumerate(tables.items()):
                row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in KINDS[kind]])
                place = F.monotonically_increasing_id() * len(LISTS) + at
                parts.append(
                    rows.select(
                        F.lit(kind).alias("kind"), "id", F.to_json(row, {"ignoreNullFields": "false"}).alias("payload"), (place + 1).alias("first_seq"), F.lit(0).alias("first_sub")
                    )
                )
            out = reduce(DataFrame.unionByName, parts).withColumn("first_sub", F.col("first_sub").cast("int"))
            # Listing order goes by first_seq; what is loaded stands before every later change.
            out = out.withColumn("first_seq", F.col("first_seq") - F.lit(1 << 62))
            out.write.mode("overwrite").parquet(f"{self.path}/snapshot/v=1")
            self.folder.replace("CURRENT", "1")
            self.base = self.seq = 1
            return 1

    def import_archive(self, file: str) -> int:
        """A snapshot file {version, seq, data} or a legacy {rubbings, damages, batches}; only into an empty log."""
        with self._lock:
            if self.seq:
                return self.seq
            raw = self.spark.read.schema(SNAPSHOT).json(file, multiLine=True)
            legacy = self.spark.read.schema(ARCHIVE).json(file, multiLine=True)
            parts = []
            for at, (kind, name) in enumerate(LISTS.items()):
                for df, col in ((raw, F.col(f"data.{name}")), (legacy, F.col(name))):
                    rows = df.select(F.posexplode(F.coalesce(col, F.array().cast(KINDS_ARRAY[kind]))).alias("pos", "r"))
                    parts.append(
                        rows.select(
                            F.lit(kind).alias("kind"), "r.id", F.to_json("r").alias("payload"), F.lit(1).cast("long").alias("first_seq"),
                            (F.col("pos") * len(LISTS) + at).cast("int").alias("first_sub"),
                        )
                    )
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            seq = max(raw.agg(F.max("seq")).first()[0] or 1, 1)  # a snapshot file says where it stands
            out.write.mode("overwrite").parquet(f"{self.path}/snapshot/v={seq}")
            self.folder.replace("CURRENT", str(seq))
            self.base = self.seq = seq
            return self.seq


KINDS_ARRAY = {k: f"array<{s.simpleString()}>" for k, s in KINDS.items()}
