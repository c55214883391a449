"""Each stage of the corpus pipeline against brute force, on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkstone.llm import mixing
from tests.llm import corpus

DOCUMENTS, LABELS, BENCHMARK, CONVERSATIONS = corpus.make_corpus(11)
STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ["row", "n_words", "n_hit", "items", "spans", "_text", "_bucket", "block", "epoch", "position", "slot", "no", "md5", "m", "d", "component_id"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    corpus.write(spark, path, DOCUMENTS, LABELS, BENCHMARK, CONVERSATIONS)
    return path


@pytest.fixture(scope="module")
def docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for i, c in enumerate(CLASHES):
        d = d.withColumn(c, F.lit(i))
    return d


def out(stage, spark, docs, sf):
    got = STAGES[stage](spark, docs, sf)
    assert stage == "sharding" or got.columns == docs.columns
    got = got.collect()
    assert stage == "sharding" or {tuple(r[c] for c in CLASHES) for r in got} <= {tuple(range(len(CLASHES)))}
    return got


def test_stages_are_those_of_the_contract():
    assert list(STAGES) == ["quality_rules", "jaccard_join", "decontamination", "mixing", "sharding"]


def test_quality(spark, docs, sf):
    kept = Counter((r.doc_id, r.text) for r in out("quality_rules", spark, docs, sf))
    every = Counter((d, t) for d, t, *_ in DOCUMENTS)
    assert not kept - every
    bad = {x for x in every if corpus.rule_counts(x[1])[-1]}
    assert not bad & set(kept)
    rules = set(every) - bad - set(kept)  # turned away by a certified cutoff
    assert all("###" in t for _, t in rules) and all(kept[x] == every[x] for x in kept)


def test_near_duplicates(spark, docs, sf):
    want = corpus.classes([(d, t) for d, t, *_ in DOCUMENTS if d is not None])
    kept = Counter((r.doc_id, r.text) for r in out("jaccard_join", spark, docs, sf))
    assert kept == Counter((d, t) for d, t, *_ in DOCUMENTS if d is None or want[d][1] == d)


def test_decontamination(spark, docs, sf):
    kept = Counter((r.doc_id, r.text) for r in out("decontamination", spark, docs, sf))
    assert kept == Counter((d, t) for d, t, *_ in DOCUMENTS if not corpus.contamination(t, BENCHMARK)[-1])


def test_mixing(spark, docs, sf):
    got = out("mixing", spark, docs, sf)
    counts = Counter(r[3] for r in DOCUMENTS)
    parts = mixing.target_parts(counts)
    once = Counter((r.doc_id, r.text) for r in got)
    every = Counter((d, t) for d, t, *_ in DOCUMENTS)
    assert not every - once
    slots = mixing.n_slots(counts, parts, 16)
    shares = Counter(r.source for r in got)
    for s, p in parts.items():  # readings of blocks of at most 16 rows, less than one block from the target
        assert shares[s] <= 16 * (slots * p / sum(parts.values()) + 1)


def test_sharding(spark, docs, sf):
    got = out("sharding", spark, docs, sf)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((d, __import__("zlib").crc32((t or "").encode())) for d, t, *_ in DOCUMENTS)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.get(i, 0) for i in range(40)) <= 1


def test_whole_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda d: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in d.collect())
    assert key(got) == key(docs) and got.count() > 50


def test_empty_tables_run(spark, tmp_path):
    corpus.write(spark, str(tmp_path), [], [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
