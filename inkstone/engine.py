"""The archive engine: records, search sessions and index generations over one change log."""

from __future__ import annotations

import json
import logging
import re
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.operators import relational as rel
from inkstone.operators.search import SearchIndex, SearchQuery, clamp_page_size, decode_cursor, encode_cursor, ordered, present
from inkstone.plans.docs import affected_keys, build_docs, field_dictionary, postings
from inkstone.schema import KIND_LABELS, KINDS
from inkstone.sources.log import ChangeLog

SESSION_SECONDS = 600
#: The public routes.
ROUTES = [
    "GET /health", "GET /rubbings", "POST /rubbings", "GET /rubbings/:id/damages", "POST /rubbings/:id/damages", "GET /damages",
    "PATCH /damages/:id", "GET /batches", "POST /batches", "GET /batches/:id", "POST /batches/:id/complete",
]


class ApiError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def parse_body(body: dict | str | bytes | None) -> dict:
    """A JSON body as a dict; an empty one is {}."""
    if body is None or isinstance(body, dict):
        return body or {}
    try:
        out = json.loads(body) if body.strip() else {}
    except ValueError as e:
        raise ApiError(400, "the body is not JSON") from e
    if not isinstance(out, dict):
        raise ApiError(400, "the body is not a JSON object")
    return out


@dataclass
class Session:
    """What a pagination session holds: its size does not depend on the number of hits."""

    id: str
    query: SearchQuery
    seq: int
    expires: float
    total: int | None = None


class Engine:
    """One writer; readers resolve a seq when they plan. `clock` gives epoch seconds."""

    def __init__(self, spark: SparkSession, path: str, clock=time.time):
        self.spark, self.clock = spark, clock
        self.log = ChangeLog(spark, path)
        self.path = self.log.path
        self.sessions: dict[str, Session] = {}
        text = self.log.folder.read("INDEX")
        self.generation = json.loads(text)["generation"] if text else 1
        self._view: tuple[int, SearchIndex] | None = None
        self._rebuilding = threading.Lock()
        self._cancel = threading.Event()

    @classmethod
    def open(cls, spark: SparkSession, path: str, legacy: str | None = None, clock=time.time) -> Engine:
        engine = cls(spark, path, clock)
        if legacy:
            engine.log.import_archive(legacy)
        engine.log.recover()
        if engine.log.needs_compaction():
            engine.log.compact()
        engine.vacuum()
        if engine.published() is None:
            try:
                engine.rebuild()
            except Exception:  # the archive can be read and written without an index
                logging.getLogger(__name__).exception("the first index was not built")
        return engine

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._forget()
        self.sessions.clear()

    def _forget(self) -> None:
        if self._view:
            self._view[1].docs.unpersist()
            self._view[1].dictionary.unpersist()
        self._view = None

    # --- views ------------------------------------------------------------------------------------

    def records(self, kind: str, seq: int | None = None) -> DataFrame:
        """Records in insertion order."""
        return self.log.table(kind, seq).orderBy("_seq", "_sub").drop("_seq", "_sub")

    def docs(self, seq: int | None = None) -> DataFrame:
        tables = [self.log.table(k, seq).drop("_seq", "_sub") for k in KINDS]
        return build_docs(*tables)

    def published(self) -> int | None:
        """The seq of the index generation that counts, if its history is still there."""
        text = self.log.folder.read("INDEX")
        seq = json.loads(text)["seq"] if text else None
        return seq if seq is not None and self.log.base <= seq <= self.log.seq else None

    def _index(self, seq: int) -> SearchIndex:
        """The index as of seq: the published generation with the docs that later changes touch made anew, or all docs."""
        base = self.published()
        if base is None or base > seq:
            docs = self.docs(seq)
            return SearchIndex(docs, field_dictionary(docs))
        path = f"{self.path}/index/seq={base}"
        docs, values = self.spark.read.parquet(f"{path}/docs"), self.spark.read.parquet(f"{path}/dictionary")
        if base < seq:
            fresh = self.docs(seq).join(self.touched(base, seq), "key", "left_semi")
            docs = docs.join(self.touched(base, seq), "key", "left_anti").unionByName(fresh)
            more = field_dictionary(fresh)
            values = values.unionByName(more.join(values, ["field", "raw"], "left_anti"))
        return SearchIndex(docs, values)

    def touched(self, after: int, upto: int) -> DataFrame:
        """Keys of the docs that the changes in (after, upto] touch."""
        changes = self.log.changes().where(F.col("seq").between(after + 1, upto))
        return affected_keys(changes, self.log.table("damage", upto))

    def view(self, seq: int) -> SearchIndex:
        """The index as of seq. The present one is kept in memory; a session's older one is planned from files each time."""
        if seq != self.log.seq:
            return self._index(seq)
        if self._view is None or self._view[0] != seq:
            self._forget()
            index = self._index(seq)
            self._view = seq, SearchIndex(index.docs.cache(), index.dictionary.cache())
        return self._view[1]

    def floor(self) -> int:
        """The oldest seq that an open session or the present reads."""
        return min([self.log.seq, *(s.seq for s in self.sessions.values())])

    def vacuum(self) -> list[str]:
        """Drop index generations that nothing reads any more; returns their names."""
        if self._rebuilding.locked():
            return []
        keep = {f"seq={self.published()}", f"seq={self.log.seq}"}  # one of the present seq may be half built
        gone = [n for n in self.log.folder.names("index") if n not in keep]
        for n in gone:
            self.log.folder.remove(f"index/{n}")
        return gone

    def mutate(self, ops: list) -> int:
        seq = self.log.append(ops)
        if self.log.needs_compaction() and self.floor() > self.log.base:
            # Only history that no open session reads goes.
            self.log.compact(self.floor())
            if self.log.folder.exists("INDEX") and self.published() is None and not self._rebuilding.locked():
                self.rebuild()
                self.vacuum()
        return seq

    # --- search -----------------------------------------------------------------------------------

    def search(self, **params) -> DataFrame:
        """All hits on current data, in order."""
        try:
            return present(ordered(self.view(self.log.seq).search(SearchQuery.from_params(params))))
        except ValueError as e:
            raise ApiError(400, str(e)) from e

    def search_paged(self, params: dict | None = None, pageSize=None, cursor: str | None = None, sessionId: str | None = None) -> dict:
        began, size = time.time(), clamp_page_size(pageSize)
        self.sweep()
        created = not sessionId
        if sessionId:
            session = self.sessions.get(sessionId)
            if session is None:
                raise ApiError(400, "the pagination session is unknown or has expired")
            session.expires = self.clock() + SESSION_SECONDS
        else:
            session = Session(f"s_{uuid.uuid4().hex}", SearchQuery.from_params(params or {}), self.log.seq, self.clock() + SESSION_SECONDS)
            self.sessions[session.id] = session
        try:
            at = decode_cursor(cursor)
            rows, total, start = self.view(session.seq).page(session.query, size, at)
        except ValueError as e:
            raise ApiError(400, str(e)) from e
        session.total = total
        more, rows = len(rows) > size, rows[:size]
        parents = sorted({r["rubbingId"] for r in rows if r["rubbingId"]})
        records = self._records_of([*(r["id"] for r in rows), *parents], session.seq)
        alive = records if session.seq == self.log.seq else self._records_of(parents, self.log.seq)
        data = [{**_shown(r, ("rubbing", r["rubbingId"]) in alive), "record": records.get((r["kind"], r["id"]))} for r in rows]
        return {
            "data": data,
            "total": session.total,
            "tookMs": round((time.time() - began) * 1000),
            "generation": self.generation,
            "page": {
                "sessionId": session.id,
                "pageSize": size,
                "cursor": cursor,
                "nextCursor": encode_cursor(rows[-1]) if more else None,
                "hasMore": more,
                "index": start // size + 1,
            },
            "sessionCreated": created,
        }

    def _records_of(self, ids: list[str], seq: int) -> dict[tuple[str, str], dict]:
        """The records of a page's ids as of seq, folded from their own changes only."""
        if not ids:
            return {}
        found = self.log.state(seq, ids=sorted(set(ids))).select("kind", "id", "payload").collect()
        return {(r["kind"], r["id"]): {f.name: json.loads(r["payload"]).get(f.name) for f in KINDS[r["kind"]]} for r in found}

    def sweep(self) -> None:
        for k in [k for k, s in self.sessions.items() if s.expires <= self.clock()]:
            del self.sessions[k]

    def end_session(self, session_id: str) -> None:
        self.sessions.pop(session_id, None)

    # --- index generations ------------------------------------------------------------------------

    def rebuild(self, progress=None) -> dict:
        """Write docs, dictionary and postings of a new generation, section by section, then make it current.

        A section that is complete (its _SUCCESS stands) is not written again after a cancelled or lost run.
        """
        if not self._rebuilding.acquire(blocking=False):
            raise ApiError(409, "the index is being rebuilt")
        try:
            seq = self.log.seq
            name_ = f"index/seq={seq}"
            base = f"{self.path}/{name_}"
            resumed, done = False, 0
            docs = self.docs(seq)
            read = lambda name: self.spark.read.parquet(f"{base}/{name}")
            sections = {"docs": lambda: docs, "dictionary": lambda: field_dictionary(read("docs")), "postings": lambda: postings(read("docs"), read("dictionary"))}
            for name, make in sections.items():
                if self._cancel.is_set():
                    return {"paused": True, "resumed": resumed, "done": done, "generation": self.generation}
                complete = self.log.folder.exists(f"{name_}/{name}/_SUCCESS")
                resumed = resumed or complete
                if not complete:
                    make().write.mode("overwrite").parquet(f"{base}/{name}")
                done += 1
                if progress:
                    progress({"done": done, "total": len(sections)})
            # Changes written meanwhile have a later seq: a reader applies them to this generation (`_index`).
            self.generation += 1
            self.log.folder.replace("INDEX", json.dumps({"seq": seq, "generation": self.generation}))
            self._forget()
            return {"paused": False, "resumed": resumed, "done": done, "generation": self.generation}
        finally:
            self._cancel.clear()
            self._rebuilding.release()

    def cancel_rebuild(self) -> None:
        self._cancel.set()

    def status(self) -> dict:
        counts = {r["kind"]: r["n"] for r in self.log.state().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        return {
            "generation": self.generation,
            "seq": self.log.seq,
            "rebuilding": self._rebuilding.locked(),
            "sessions": len(self.sessions),
            "rubbings": counts.get("rubbing", 0),
            "damages": counts.get("damage", 0),
            "batches": counts.get("batch", 0),
            "docs": sum(counts.values()),
        }

    # --- records ----------------------------------------------------------------------------------

    def health(self) -> dict:
        return {"ok": True, "routes": ROUTES}

    def _now(self) -> str:
        return datetime.fromtimestamp(self.clock(), UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def _need(self, body: dict, names: list[str]) -> None:
        missing = [n for n in names if n not in body or body[n] == ""]
        if missing:
            raise ApiError(400, f"missing: {', '.join(missing)}")

    def _one(self, kind: str, id_: str) -> dict:
        row = self.log.state(kind=kind, ids=[id_]).select(F.from_json("payload", KINDS[kind]).alias("r")).first()
        if row is None:
            raise ApiError(404, f"no such {kind}: {id_}")
        return row["r"].asDict(recursive=True)

    def list_parents(self) -> DataFrame:
        p, c = self.log.table("rubbing"), self.records("damage")
        return rel.parent_counts(p, c).orderBy("_seq", "_sub").drop("_seq", "_sub")

    def children_of(self, parent_id: str) -> DataFrame:
        self._one("rubbing", parent_id)
        return self.records("damage").where(F.col("rubbingId") == parent_id)

    def list_children(self, status: str | None = None, type: str | None = None) -> DataFrame:  # noqa: A002
        return rel.filter_children(self.records("damage"), status, type)

    def list_batches(self) -> DataFrame:
        return rel.enrich_batches(self.log.table("batch"), self.records("damage")).orderBy("_seq", "_sub").drop("_seq", "_sub")

    def get_batch(self, batch_id: str) -> dict:
        self._one("batch", batch_id)
        row = rel.enrich_batches(self.records("batch").where(F.col("id") == batch_id), self.records("damage")).first()
        out = row.asDict(recursive=True)
        out["damages"] = out["damages"] or []
        return out

    def create_parent(self, body: dict) -> dict:
        self._need(body, ["code", "source", "paperSize"])
        row = {"id": f"rubbing_{uuid.uuid4().hex}", **{k: body[k] for k in ("code", "source", "paperSize")}, "note": body.get("note") or "", "createdAt": self._now()}
        self.mutate(["upsertRubbing", row])
        return row

    def create_child(self, parent_id: str, body: dict) -> dict:
        self._one("rubbing", parent_id)
        self._need(body, ["position", "type", "beforePhotoUrl"])
        row = {
            "id": f"damage_{uuid.uuid4().hex}", "rubbingId": parent_id, **{k: body[k] for k in ("position", "type", "beforePhotoUrl")},
            "afterPhotoUrl": "", "status": "pending", "repairNote": "", "batchId": None, "createdAt": self._now(), "repairedAt": None,
        }
        self.mutate(["upsertDamage", row])
        return row

    def patch_child(self, child_id: str, body: dict) -> dict:
        old = self._one("damage", child_id)
        names = ("position", "type", "beforePhotoUrl", "afterPhotoUrl", "status", "repairNote")
        row = {**old, **{k: body[k] if body.get(k) is not None else old[k] for k in names}}
        row["repairedAt"] = self._now() if row["status"] == "repaired" else old["repairedAt"]
        self.mutate(["upsertDamage", row])
        return row

    def create_batch(self, body: dict) -> dict:
        self._need(body, ["name", "damageIds"])
        ids = body["damageIds"]
        if not isinstance(ids, list) or not ids:
            raise ApiError(400, "damageIds must be a non-empty array")
        children = {r["id"]: r.asDict() for r in self.records("damage").where(F.col("id").isin(ids)).collect()}
        missing = [i for i in ids if i not in children]
        if missing:
            raise ApiError(400, f"no such damage: {', '.join(map(str, missing))}")
        batch = {"id": f"batch_{uuid.uuid4().hex}", "name": body["name"], "status": "open", "damageIds": ids, "note": body.get("note") or "", "createdAt": self._now(), "completedAt": None}
        self.mutate([["upsertBatch", batch], *[["upsertDamage", {**children[i], "batchId": batch["id"], "status": "in_repair"}] for i in ids]])
        return self.get_batch(batch["id"])

    def complete_batch(self, batch_id: str, body: dict | None = None) -> dict:
        body, batch = body or {}, self._one("batch", batch_id)
        now, results = self._now(), body.get("results") if isinstance(body.get("results"), list) else []
        note = body["note"] if body.get("note") is not None else batch["note"]
        children = {r["id"]: r.asDict() for r in self.records("damage").where(F.col("id").isin(batch["damageIds"] or [])).collect()}
        ops = [["upsertBatch", {**batch, "status": "completed", "completedAt": now, "note": note}]]
        for i in batch["damageIds"] or []:
            old = children.get(i)
            if old is None:
                continue
            own = next((r for r in results if r.get("damageId") == i), {})
            photo = own.get("afterPhotoUrl") or body.get("defaultAfterPhotoUrl") or old["afterPhotoUrl"]
            text = own.get("repairNote") or body.get("defaultRepairNote") or old["repairNote"]
            ops.append(["upsertDamage", {**old, "status": "repaired", "afterPhotoUrl": photo, "repairNote": text, "repairedAt": now}])
        self.mutate(ops)
        return self.get_batch(batch_id)

    def handle(self, method: str, target: str, params: dict | None = None, body: dict | str | bytes | None = None):
        """Dispatch a route to its method; unknown ones raise ApiError 404, a body that is not a JSON object 400."""
        body, params = parse_body(body), params or {}
        rows = lambda df: {"data": [r.asDict(recursive=True) for r in df.collect()]}
        table = [
            ("GET", r"/health", lambda: self.health()),
            ("GET", r"/search", lambda: self.search_paged(params, params.get("pageSize"), params.get("cursor"), params.get("sessionId"))),
            ("GET", r"/admin/search/status", lambda: self.status()),
            ("POST", r"/admin/search/reindex", lambda: {"ok": True, **self.rebuild()}),
            ("GET", r"/rubbings", lambda: rows(self.list_parents())),
            ("POST", r"/rubbings", lambda: {"data": self.create_parent(body)}),
            ("GET", r"/rubbings/([^/]+)/damages", lambda i: rows(self.children_of(i))),
            ("POST", r"/rubbings/([^/]+)/damages", lambda i: {"data": self.create_child(i, body)}),
            ("GET", r"/damages", lambda: rows(self.list_children(params.get("status"), params.get("type")))),
            ("PATCH", r"/damages/([^/]+)", lambda i: {"data": self.patch_child(i, body)}),
            ("GET", r"/batches", lambda: rows(self.list_batches())),
            ("POST", r"/batches", lambda: {"data": self.create_batch(body)}),
            ("GET", r"/batches/([^/]+)", lambda i: {"data": self.get_batch(i)}),
            ("POST", r"/batches/([^/]+)/complete", lambda i: {"data": self.complete_batch(i, body)}),
        ]
        for verb, pattern, run in table:
            m = re.fullmatch(pattern, target)
            if m and verb == method:
                return run(*m.groups())
        raise ApiError(404, f"no such route; there are {ROUTES}")


def _shown(hit: dict, parent_lives: bool) -> dict:
    """The columns of a hit as it is shown; the parent only while it lives, with code and source of the doc."""
    names = ("kind", "id", "code", "source", "damageType", "name", "createdAt", "score", "matchedReasons")
    parent = {"id": hit["rubbingId"], "code": hit["code"], "source": hit["source"]} if parent_lives else None
    return {**{n: hit[n] for n in names}, "kindLabel": KIND_LABELS[hit["kind"]], "rubbing": parent}
