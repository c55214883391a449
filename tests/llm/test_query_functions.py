"""The registered queries over a small corpus with every kind of case, against brute force; and over empty tables."""

import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from inkstone import llm
from inkstone.llm import jaccard_join, mixing, quality_rules
from tests.llm import corpus

QUERIES = llm.queries()
DOCUMENTS, LABELS, BENCHMARK, CONVERSATIONS = corpus.make_corpus()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    corpus.write(spark, path, DOCUMENTS, LABELS, BENCHMARK, CONVERSATIONS)
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    corpus.write(spark, path, [], [], [], [])
    return path


def rows(query, spark, path, *names):
    return Counter(tuple(r[n] for n in names) for r in QUERIES[query](spark, path).collect())


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op5_chat"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_op5_of_an_empty_table(spark, empty):
    got = QUERIES["op5_chat"](spark, empty).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(-7, 2)]


def test_op1(spark, sf):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows("op1_quality_rules", spark, sf, *names) == Counter((d, *corpus.rule_counts(t)) for d, t, *_ in DOCUMENTS)
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    rel = c.sql(llm.oracle_sql()["op1_quality_rules"])
    unique = {d for d, n in Counter(d for d, *_ in DOCUMENTS).items() if n == 1 and d is not None}
    got = {tuple(r[n] for n in rel.columns) for r in QUERIES["op1_quality_rules"](spark, sf).collect() if r.doc_id in unique}
    assert got == {r for r in rel.fetchall() if r[rel.columns.index("doc_id")] in unique}


def test_copies_are_one_draw(spark):
    """A thousand copies of one good text are no evidence."""
    table = [(i, "plain words " * 30, "en") for i in range(1000)] + [(2000 + i, f"bad### {i} " + "wo###rd " * 60, "en") for i in range(50)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, int(d < 2000), 0) for d, *_ in table], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels, ["doc_id"], F.col("lang"))
    assert out.where("failed_rules <> ''").count() == 0


def test_op2(spark, sf):
    got = QUERIES["op2_feistel_sharding"](spark, sf).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in DOCUMENTS)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    sizes = [len(slots.get(i, [])) for i in range(40)]
    assert max(sizes) - min(sizes) <= 1 and {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op3(spark, sf):
    want = corpus.classes([(d, t) for d, t, *_ in DOCUMENTS if d is not None])
    got = rows("op3_jaccard_join", spark, sf, "doc_id", "n_shingles", "component_id")
    assert got == Counter((d, *(want[d] if d is not None else (0, None))) for d, *_ in DOCUMENTS)


def test_op3_large_groups(spark):
    """A family of near copies whose members link only by way of others, and many copies, with hot signatures."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(200):
        own = list(words)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(150)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(own))
    table = list(enumerate(texts)) + [(1000 + i, "the very same text of some seven words " * 4) for i in range(3000)]
    want = corpus.classes(table[:201])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in range(200)} == {d: want[d] for d in range(200)}
    assert len({got[1000 + i] for i in range(3000)}) == 1 and got[2000][1] == 1000


def test_words_that_a_polynomial_cannot_tell_apart(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate({97: 98, 98: 97})
    other = thue.translate({97: 98, 98: 97})
    d = spark.createDataFrame([(1, f"{thue} x"), (2, f"{other} x")], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_classes(d).collect()} == {1, 2}
    from inkstone.llm.decontaminate import find_benchmark

    bench = spark.createDataFrame([("i", thue)], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in find_benchmark(d, bench, ["doc_id"]).collect()} == {1: 1, 2: 0}


def test_op4(spark, sf):
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows("op4_licenses", spark, sf, *names) == Counter((d, *corpus.license_places(t)) for d, t, *_ in DOCUMENTS)
    for r in QUERIES["op4_licenses"](spark, sf).collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = Counter(r.labels for r in QUERIES["op4_licenses"](spark, sf).collect())
    assert labels["gpl"] == 1


def test_op5(spark, sf):
    turns = {}
    for conv, turn, role, text in CONVERSATIONS:
        turns.setdefault(conv, []).append((turn, role, text))
    want = {c: corpus.chat_digests([(r, t) for _, r, t in sorted(x, key=lambda y: y[0])]) for c, x in turns.items()}
    said = r"\### Assistant: </turn> ok"
    want[-7] = corpus.chat_digests([("user", said), ("assistant", said)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op5_chat"](spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("name,modulus,held,column,least", [("op6_quality_model", 3, 1, 1, 0.9), ("op8_toxicity", 5, 0, 2, 0.9)])
def test_classifiers(spark, sf, name, modulus, held, column, least):
    got = QUERIES[name](spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in DOCUMENTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and corpus.crc(r.doc_id) % modulus == held) for r in got)
    truth = {r[0]: r[column] for r in LABELS}
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(a == b for a, b in out) >= least * len(out)
    again = QUERIES[name](spark, sf).collect()
    assert Counter((r.doc_id, r.score) for r in got) == Counter((r.doc_id, r.score) for r in again)


def test_op7(spark, sf):
    got = QUERIES["op7_mixing"](spark, sf).collect()
    first = Counter((r.doc_id, r.source) for r in got if r.epoch == 0)
    assert first == Counter((d, s) for d, _, _, s, _ in DOCUMENTS)
    counts = Counter(s for _, _, _, s, _ in DOCUMENTS)
    check_schedule(got, counts, mixing.target_parts(counts), 16)


def check_schedule(got, counts, parts, block_rows):
    """Every slot holds one block; windows hold; no source is a block or more away from its target."""
    whole = sum(parts.values())
    slot = {}
    for r in got:
        assert slot.setdefault(r.position, (r.source, r.block, r.epoch)) == (r.source, r.block, r.epoch)
        assert r.release <= r.position < r.deadline
    assert sorted(slot) == list(range(len(slot))) and len(slot) == mixing.n_slots(counts, parts, block_rows)
    done = Counter()
    for t in sorted(slot):
        source, block, epoch = slot[t]
        assert done[source] == block + epoch * -(-counts[source] // block_rows)
        done[source] += 1
        assert all(abs(done[s] * whole - parts[s] * (t + 1)) < whole for s in parts)
    sizes = Counter((r.source, r.block) for r in got if r.epoch == 0)
    assert max(sizes.values()) <= block_rows


def test_schedules_over_many_periods(spark, monkeypatch):
    """With few parts the period is short and the schedule goes through many of them."""
    monkeypatch.setattr(mixing.target_parts, "__defaults__", (None, 0.8, 16))
    table = [(i, "abc"[min(i % 7, 2)], i) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(table, "doc_id long, source string, block long"), block_rows=2).collect()
    counts = Counter(s for _, s, _ in table)
    check_schedule(got, counts, mixing.target_parts(counts), 2)


def test_mix_keeps_clashing_columns(spark):
    names = ["doc_id", "source", "_bucket", "_row", "row", "s", "j", "parts", "no", "key0", "slot"]
    d = spark.createDataFrame([(i, "s", *range(9)) for i in range(5)], ", ".join(f"{n} {'string' if n == 'source' else 'long'}" for n in names))
    out = mixing.mix(d)
    assert out.columns[: len(names)] == names
    assert {tuple(r[n] for n in names[2:]) for r in out.collect()} == {tuple(range(9))}


def test_op9(spark, sf):
    got = rows("op9_repeats", spark, sf, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == Counter((d, *x) for (d, *_), x in zip(DOCUMENTS, corpus.repeats([t for _, t, *_ in DOCUMENTS]), strict=True))
    assert all(r.has_repeat == (r.n_removed > 0) for r in QUERIES["op9_repeats"](spark, sf).collect())


def test_op10(spark, sf):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows("op10_decontaminate", spark, sf, *names)
    assert got == Counter((d, *corpus.contamination(t, BENCHMARK)) for d, t, *_ in DOCUMENTS)


EXTRA = ["n_words", "n_hit", "items", "spans", "_text", "score", "predicted", "_bucket", "label", "labels", "h", "key", "pos", "id", "n", "f1", "window", "kept"]


def test_extra_columns_are_ignored(spark, sf, tmp_path):
    """With extra columns of clashing names every query gives the same rows."""
    path = str(tmp_path)
    for name in ("documents", "labels", "benchmark", "conversations"):
        t = spark.read.parquet(f"{sf}/{name}.parquet")
        for c in EXTRA:
            t = t.withColumn(c, F.lit("clash"))
        t.write.parquet(f"{path}/{name}.parquet")
    for name in ("op1_quality_rules", "op3_jaccard_join", "op4_licenses", "op5_chat", "op6_quality_model", "op8_toxicity", "op9_repeats", "op10_decontaminate"):
        one, two = (QUERIES[name](spark, p) for p in (sf, path))
        assert one.columns == two.columns and Counter(map(str, one.collect())) == Counter(map(str, two.collect())), name
