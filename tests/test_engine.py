import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from inkstone.engine import ApiError, Engine
from inkstone.operators.search import SearchIndex, SearchQuery, clamp_page_size, parse_kinds, search
from inkstone.plans.docs import build_docs, field_dictionary
from inkstone.sources.generators import closed_form_archive, seeded_archive


def day(n):
    return (datetime(2026, 1, 1, tzinfo=UTC) + timedelta(days=n)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def child(id_, parent, position, type_, status="pending", created=11, repaired=None, note=""):
    return ["upsertDamage", {
        "id": id_, "rubbingId": parent, "position": position, "type": type_, "beforePhotoUrl": "b", "afterPhotoUrl": "", "status": status,
        "repairNote": note, "batchId": None, "createdAt": day(created), "repairedAt": repaired and day(repaired),
    }]


OPS = [
    ["upsertRubbing", dict(id="r1", code="TP-清-014", source="地方碑刻残页", paperSize="42x68cm", note="边缘旧折痕", createdAt=day(10))],
    ["upsertRubbing", dict(id="r2", code="TP-明-201", source="馆藏拓片征集", paperSize="38x60cm", note="保存完好", createdAt=day(40))],
    ["upsertRubbing", dict(id="r3", code="TB-宋-007", source="考古发掘出土", paperSize="50x90cm", note="大幅摩崖", createdAt=day(100))],
    child("d1", "r1", "左上角第3列题字旁", "虫蛀孔"),
    child("d2", "r1", "下边缘中央", "撕裂", created=12),
    child("d3", "r2", "右上角", "霉变", "repaired", 41, 60, "已除菌"),
    ["upsertBatch", dict(id="b1", name="六月小批修补", status="completed", damageIds=["d3"], note="首批", createdAt=day(55), completedAt=day(60))],
]


@pytest.fixture
def engine(spark, tmp_path):
    with Engine(spark, str(tmp_path / "a")) as e:
        e.mutate(OPS)
        yield e


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("code", ["TP-清-014", "ＴＰ－清－０１４", "tp 清 014", "tp-清-014"])
def test_spellings_of_a_code(engine, code):
    assert ids(engine.search(code=code)).count("r1") == 1


def test_searches(engine):
    assert ids(engine.search(source="碑刻")) == ["r1", "d1", "d2"]
    assert ids(engine.search(damageType="虫蛀孔")) == ["d1"]
    got = ids(engine.search(dateFrom="2026-02-01", dateTo="2026-02-28"))
    assert {"r2", "d3"} <= set(got) and "r1" not in got
    assert ids(engine.search(code="014", source="碑刻", damageType="虫蛀", dateFrom="2026-01-01", dateTo="2026-12-31")) == ["d1"]
    assert ids(engine.search(q="根本不存在的词条xyz")) == []
    hits = engine.search(q="014", kind="damage").collect()
    assert {h.kind for h in hits} == {"damage"} and "d1" in [h.id for h in hits]


def test_one_typo_is_explained(engine):
    hit = engine.search(q="蟲柱孔").first()
    assert hit.id == "d1" and hit.score == 70
    reason = hit.matchedReasons[0]
    assert (reason.match, reason.distance) == ("fuzzy", 1) and "虫蛀孔" in reason.detail
    assert hit.rubbing.id == "r1"


def test_bad_date_and_cursor(engine):
    with pytest.raises(ApiError) as e:
        engine.search(dateFrom="not-a-date")
    assert e.value.status == 400
    with pytest.raises(ApiError):
        engine.search_paged({}, cursor="%%%")


def test_only_created_time_counts(engine):
    engine.mutate([child("dJ", "r1", "x", "水渍", "repaired", 160, 262)])
    assert "dJ" not in ids(engine.search(dateFrom="2026-09-01", dateTo="2026-09-30"))
    assert "dJ" in ids(engine.search(dateFrom="2026-06-01", dateTo="2026-06-30"))


def test_sessions_are_snapshots(engine):
    one = engine.search_paged({}, pageSize=3)
    assert one["total"] == 7 and one["sessionCreated"] and one["page"]["index"] == 1
    engine.mutate([["deleteDamage", "d2"], child("d9", "r1", "新", "撕裂")])
    seen, page = [d["id"] for d in one["data"]], one
    while page["page"]["hasMore"]:
        page = engine.search_paged(pageSize=3, sessionId=one["page"]["sessionId"], cursor=page["page"]["nextCursor"])
        seen += [d["id"] for d in page["data"]]
    assert sorted(seen) == ["b1", "d1", "d2", "d3", "r1", "r2", "r3"] and page["page"]["index"] == 3
    fresh = ids(engine.search())
    assert "d2" not in fresh and "d9" in fresh


def test_sessions_expire(spark, tmp_path):
    now = [0.0]
    e = Engine(spark, str(tmp_path / "a"), clock=lambda: now[0])
    e.mutate(OPS)
    s = e.search_paged({})["page"]["sessionId"]
    now[0] = 601
    with pytest.raises(ApiError):
        e.search_paged(sessionId=s)


def test_records(engine):
    counts = {r.id: (r.damageCount, r.pendingDamages) for r in engine.list_parents().collect()}
    assert counts == {"r1": (2, 2), "r2": (1, 0), "r3": (0, 0)}
    assert ids(engine.children_of("r1")) == ["d1", "d2"]
    assert ids(engine.list_children("repaired")) == ["d3"]
    with pytest.raises(ApiError) as e:
        engine.children_of("nope")
    assert e.value.status == 404
    batch = engine.create_batch({"name": "n", "damageIds": ["d2", "d1", "d2"]})
    assert [d["id"] for d in batch["damages"]] == ["d2", "d1", "d2"] and (batch["total"], batch["pending"]) == (3, 3)
    assert {d["status"] for d in batch["damages"]} == {"in_repair"}
    with pytest.raises(ApiError):
        engine.create_batch({"name": "n", "damageIds": ["zz"]})
    done = engine.complete_batch(batch["id"], {"results": [{"damageId": "d1", "afterPhotoUrl": "", "repairNote": "own"}], "defaultAfterPhotoUrl": "p"})
    by = {d["id"]: d for d in done["damages"]}
    assert by["d1"]["repairNote"] == "own" and by["d1"]["afterPhotoUrl"] == "p" and done["repaired"] == 3
    patched = engine.patch_child("d1", {"status": "pending"})
    assert patched["repairedAt"] == by["d1"]["repairedAt"]
    assert engine.handle("GET", "/health")["routes"] and engine.handle("GET", "/batches/b1")["data"]["repaired"] == 1
    with pytest.raises(ApiError):
        engine.handle("GET", "/nothing")


def test_log_recovers_and_compacts(spark, engine, tmp_path):
    broken = tmp_path / "a" / "changes" / "seq=000000000099-x.jsonl"
    broken.write_text('{"seq": 2, "sub": 0, "kind": "rubbing", "action": "upsert", "id": "r4", "payload": "{\\"id\\": \\"r4\\"}"}\n{"seq": 3, "op": ["ups', encoding="utf-8")
    again = Engine.open(spark, str(tmp_path / "a"))
    assert again.log.lines().where("NOT good").count() == 0
    assert sorted(ids(again.records("rubbing"))) == ["r1", "r2", "r3", "r4"]
    assert again.mutate([]) == again.log.seq
    with pytest.raises(ValueError):
        again.mutate([["explode", {}]])


def test_legacy_import(spark, tmp_path):
    file = tmp_path / "db.json"
    file.write_text(json.dumps({"rubbings": [{"id": "x", "code": "c"}], "damages": []}), encoding="utf-8")
    e = Engine.open(spark, str(tmp_path / "a"), legacy=str(file))
    assert ids(e.records("rubbing")) == ["x"]


def test_rebuild_is_idempotent_and_resumes(engine):
    engine.cancel_rebuild()
    assert engine.rebuild()["paused"]
    first = engine.rebuild()
    again = engine.rebuild()
    assert not first["paused"] and again["resumed"] and again["generation"] == first["generation"] + 1
    assert engine.status()["docs"] == 7 and len(ids(engine.search())) == 7


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_streamed_upkeep_equals_rebuild(engine, tmp_path):
    from inkstone.streaming.maintain import Maintained, start

    engine.mutate([["upsertRubbing", {**OPS[0][1], "code": "TP-元-999"}], ["deleteDamage", "d2"]])
    q = start(engine, str(tmp_path / "ix"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert same(Maintained(engine, str(tmp_path / "ix")).docs(), engine.docs())


def test_streamed_upkeep_after_restart_compaction_and_a_parents_delete(engine, tmp_path):
    from inkstone.streaming.maintain import Maintained, start

    def upkeep(name):
        q = start(engine, str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        q.processAllAvailable()
        q.stop()
        assert same(Maintained(engine, str(tmp_path / name)).docs(), engine.docs())

    upkeep("ix")
    engine.mutate([["upsertRubbing", {**OPS[0][1], "code": "TP-元-999"}]])
    upkeep("ix")  # a restart
    engine.mutate([["deleteDamage", "d2"]])
    engine.log.compact()
    upkeep("ix")  # the last change stands in the snapshot alone
    upkeep("new")
    engine.mutate([["deleteRubbing", "r1"]])
    upkeep("ix")
    upkeep("new")


# --- the log --------------------------------------------------------------------------------------


def test_upserts_merge(engine):
    engine.mutate([["upsertRubbing", {"id": "r1", "code": "new"}]])
    row = engine.records("rubbing").where("id = 'r1'").first()
    assert (row.code, row.source, row.note) == ("new", "地方碑刻残页", "边缘旧折痕")
    engine.mutate([["upsertDamage", {"id": "d3", "repairedAt": None}]])
    engine.mutate([["deleteRubbing", "r1"], ["upsertRubbing", {"id": "r1", "code": "again"}]])
    row = engine.records("rubbing").where("id = 'r1'").first()
    assert (row.code, row.source) == ("again", None)
    before = sorted(map(str, engine.log.state().select("kind", "id", "payload").collect()))
    engine.log.compact()
    assert sorted(map(str, engine.log.state().select("kind", "id", "payload").collect())) == before
    assert engine.records("damage").where("id = 'd3'").first().repairedAt is None


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    from inkstone.sources.files import Folder

    folder = Folder(spark, str(tmp_path / "f"))
    folder.replace("CURRENT", "1")
    inode = [p.name for p in (tmp_path / "f").iterdir() if not p.name.startswith(".")]
    folder.replace("CURRENT", "2")
    assert folder.read("CURRENT") == "2" and inode == ["CURRENT"]
    # A crash after writing beside and before the rename: the old file counts.
    (tmp_path / "f" / ".CURRENT.dead").write_text("3")
    assert folder.read("CURRENT") == "2"


def test_compaction_is_triggered_by_lines(spark, tmp_path, monkeypatch):
    from inkstone.sources import log

    monkeypatch.setattr(log, "COMPACT_AT", 8)
    with Engine(spark, str(tmp_path / "a")) as e:
        e.mutate(OPS)
        assert e.log.base == 0 and e.log.n_lines == 7
        e.mutate([["deleteDamage", "d2"]])
        assert e.log.base == 2 and e.log.n_lines == 0
        session = e.search_paged({}, pageSize=2)["page"]["sessionId"]
        for i in range(9):
            e.mutate([child(f"x{i}", "r1", "p", "霉变")])
        assert e.log.base == 2  # the session still reads seq 2
        assert e.search_paged(sessionId=session)["total"] == 6
        e.end_session(session)
        e.mutate([["deleteDamage", "x0"]])
        assert e.log.base == e.log.seq and e.status()["damages"] == 10
    (tmp_path / "b").mkdir()
    with Engine(spark, str(tmp_path / "b")) as e:
        monkeypatch.setattr(log, "COMPACT_AT", 2000)
        e.mutate(OPS)
    monkeypatch.setattr(log, "COMPACT_AT", 5)
    with Engine.open(spark, str(tmp_path / "b")) as e:
        assert e.log.base == e.log.seq == 1 and e.status()["docs"] == 7


def test_compacted_history_keeps_later_changes(engine):
    engine.mutate([["deleteDamage", "d1"]])
    engine.mutate([["deleteDamage", "d2"]])
    engine.log.compact(2)
    assert engine.log.base == 2 and engine.log.seq == 3 and ids(engine.records("damage")) == ["d3"]
    assert sorted(ids(engine.records("damage", 2))) == ["d2", "d3"]
    with pytest.raises(ValueError):
        engine.records("damage", 1)


def test_snapshot_file_keeps_its_seq(spark, tmp_path):
    file = tmp_path / "snapshot.json"
    file.write_text(json.dumps({"version": 1, "seq": 41, "data": {"rubbings": [{"id": "x", "code": "c"}], "damages": None}}), encoding="utf-8")
    e = Engine.open(spark, str(tmp_path / "a"), legacy=str(file))
    assert e.log.seq == 41 and e.mutate([["deleteRubbing", "x"]]) == 42 and ids(e.records("rubbing")) == []


# --- index generations ----------------------------------------------------------------------------


def test_index_is_read_on_open_and_follows_changes(spark, engine, tmp_path):
    engine.rebuild()
    engine.mutate([["upsertRubbing", {"id": "r1", "code": "TP-元-999"}], ["deleteDamage", "d3"], child("d9", "r3", "新", "墨迹脱落")])
    again = Engine.open(spark, str(tmp_path / "a"))
    assert again.published() == 1 and again.generation == engine.generation
    index = again.view(again.log.seq)
    assert same(index.docs, again.docs())
    want = field_dictionary(again.docs())
    assert want.join(index.dictionary, ["field", "raw", "norm", "grams"], "left_anti").isEmpty()
    assert sorted(ids(again.search(q="元999"))) == ["d1", "d2", "r1"] and ids(again.search(damageType="墨迹脱落")) == ["d9"]


def test_changes_during_a_rebuild_are_found(engine):
    done = []

    def write(progress):
        if not done:
            done.append(engine.mutate([child("d9", "r3", "新", "墨迹脱落"), ["deleteDamage", "d1"]]))

    engine.rebuild(progress=write)
    assert ids(engine.search(damageType="墨迹脱落")) == ["d9"] and ids(engine.search(damageType="虫蛀孔")) == []


def test_vacuum_drops_old_generations(engine):
    engine.rebuild()
    engine.mutate([["deleteDamage", "d1"]])
    engine.rebuild()
    engine.mutate([["deleteDamage", "d2"]])
    assert engine.vacuum() == ["seq=1"] and len(ids(engine.search())) == 5


def test_seed(spark, tmp_path):
    from inkstone.sources import seed

    to = str(tmp_path / "seeded")
    got = seed.seed(spark, seed.arguments(["--dir", to, "--count", "1200", "--no-index"]))
    assert got["docs"] == 0 and Engine(spark, to).status()["docs"] == 1200
    got = seed.seed(spark, seed.arguments(["--dir", to, "--count", "600", "--wipe"]))
    assert got["docs"] == 600 and got["probes"]["虫蛀孔"][0] > 0
    with Engine(spark, to) as e:
        assert ids(e.records("rubbing").limit(2)) == ["rub_seed_0000000", "rub_seed_0000001"]
        e.mutate([["upsertRubbing", {"id": "rub_seed_0000000", "note": "later"}], ["upsertRubbing", {"id": "new"}]])
        assert ids(e.records("rubbing"))[-1] == "new" and e.records("rubbing").first().code.startswith("TP-")


def test_a_session_shows_only_living_parents(engine):
    one = engine.search_paged({"q": "虫蛀孔"})
    assert one["data"][0]["rubbing"]["code"] == "TP-清-014" and one["data"][0]["record"]["type"] == "虫蛀孔"
    engine.mutate([["deleteRubbing", "r1"]])
    again = engine.search_paged(sessionId=one["page"]["sessionId"])
    assert again["data"][0]["rubbing"] is None and again["data"][0]["record"]["type"] == "虫蛀孔"


def test_bodies(engine):
    assert engine.handle("POST", "/rubbings", body='{"code": "c", "source": "s", "paperSize": "1"}')["data"]["code"] == "c"
    for body, status in (("{", 400), ("[1]", 400), ("", 400)):  # an empty body is {}, which lacks the fields
        with pytest.raises(ApiError) as e:
            engine.handle("POST", "/rubbings", body=body)
        assert e.value.status == status


@pytest.mark.parametrize("params", [{"q": "虫蛀孔"}, {"q": "清014"}, {"q": "TP-清"}, {"q": "蟲柱孔", "kind": "damage"}, {"code": "014", "source": "碑刻"}, {"type": "撕裂"}, {}, {"q": "！"}])
def test_pages_agree_with_the_whole_search(engine, params):
    query = SearchQuery.from_params(params)
    index = engine.view(engine.log.seq)
    rows, total, before = index.page(query, 100)
    want = {(r.kind, r.id): r.asDict(recursive=True) for r in index.search(query).collect()}
    assert total == len(rows) == len(want) and before == 0
    for r in rows:
        w = want[r["kind"], r["id"]]
        assert (r["score"], r["matchedReasons"]) == (w["score"], w["matchedReasons"])
    import inkstone.operators.search as search_module

    few, search_module.FEW_VALUES = search_module.FEW_VALUES, 0
    try:
        assert [(r["kind"], r["id"], r["score"]) for r in index.page(query, 100)[0]] == [(r["kind"], r["id"], r["score"]) for r in rows]
    finally:
        search_module.FEW_VALUES = few


def test_small_parsers():
    assert parse_kinds("Rubbings, 批次, what") == ["batch", "rubbing"] and parse_kinds("what") is None
    assert [clamp_page_size(x) for x in (None, "x", 0, -1, 0.5, 7.9, 1000)] == [20, 20, 20, 20, 20, 7, 100]


@pytest.mark.parametrize(
    "make,params,total",
    [(seeded_archive, {"q": "虫蛀孔"}, 7447), (seeded_archive, {"q": "TP-清"}, 12821), (seeded_archive, {"q": "蟲柱孔"}, 7447), (closed_form_archive, {"type": "撕裂"}, 14584)],
)
def test_published_hit_counts(spark, make, params, total, cache={}):  # noqa: B006
    if make not in cache:
        docs = build_docs(*make(spark)).cache()
        cache[make] = SearchIndex(docs, field_dictionary(docs).cache())
    query = SearchQuery.from_params(params)
    assert cache[make].page(query, 20)[1] == total
    assert search(cache[make].docs, query).count() == total
