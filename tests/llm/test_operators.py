"""The corpus operators against brute force, on small tables with nulls, ties, copies, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkstone.llm import chat, decontaminate, jaccard_join, licenses, mixing, quality_model, quality_rules, repeats, sharding, toxicity
from inkstone.llm._common import gapless
from inkstone.llm._graph import Sieve, components

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _bucket int"


def make_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgäöé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = say(300)
    texts = [None, "", " \n\t", "one", "One", "a b c d", "a b c d e", "x " * 2000, say(3000), base, base]
    for edits in range(1, 12):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    passage = say(110)
    texts += [f"{say(rng.randint(0, 80))} {passage} {say(rng.randint(0, 80))}" for _ in range(12)]
    texts += [f"{say(60)}\nrepeated line here\n{say(9)}\nrepeated line here\n" for _ in range(3)]
    texts += [say(rng.randint(1, 12)) for _ in range(20)]
    return texts


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "s", "s", "t"][i % 4], 0, 0.5, 7) for i, t in enumerate(TEXTS)]
    rows += [(None, "null id text", "en", "s", 0, 0.5, 7), (9, TEXTS[9], "en", "s", 0, 0.5, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# --- quality rules --------------------------------------------------------------------------------------


def test_rule_counts(docs):
    got = Counter(tuple(r) for r in quality_rules.features(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for d, t in rows_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[(d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))] += 1
    assert got == want


def test_binomial_tail(spark):
    from math import comb

    for n, k, p in ((10, 0, 0.1), (50, 3, 0.05), (400, 12, 0.02)):
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_certified_cutoffs_keep_good_documents(spark):
    rng = random.Random(1)
    rows = [("en", True, rng.random() * 0.05, 0.0, 0.0, rng.random()) for _ in range(5000)] + [("en", False, 0.5, 0.0, 0.0, rng.random()) for _ in range(300)]
    rows += [("de", True, 0.01, 0.0, 0.0, 0.1)] * 20 + [("de", False, 0.9, 0.0, 0.0, 0.1)] * 5
    table = spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{r} double" for r in quality_rules.RULES))
    got = {(r.stratum, r.rule): r.cutoff for r in quality_rules.certify(table).collect()}
    assert set(got) == {("en", "symbols")} and 0.05 <= got["en", "symbols"] < 0.5


def test_judging_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels, ["doc_id"], F.col("lang"))
    assert out.count() == docs.count() and out.where("kept = base_failed").count() == 0


# --- sharding -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    extra = sharding.extra_steps(spark, n, 3)
    x = spark.range(n).select("id", sharding.place(F.col("id"), n, 7, 3, extra).alias("p"))
    back = x.select("id", "p.*", sharding.row_of(F.col("p.shard"), F.col("p.slot"), n, 7, 3, extra).alias("back")).collect()
    assert all(r.id == r.back for r in back)
    slots = {}
    for r in back:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_does_not_depend_on_partitions(docs):
    one, two = (
        sorted(map(str, sharding.place_rows(d.select("doc_id", "text"), ["doc_id", "text"], 5).select("doc_id", "shard", "slot").collect()))
        for d in (docs.coalesce(1), docs.repartition(7))
    )
    assert one == two and len(one) == docs.count()


def test_gapless_numbers(spark, docs):
    nums = [r.no for r in gapless(docs.select("doc_id", "text"), ["doc_id", "text"], "no", buckets=4).collect()]
    assert sorted(nums) == list(range(docs.count()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert sharding.place_rows(none.select("doc_id"), ["doc_id"], 4).count() == 0
    assert jaccard_join.jaccard_classes(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert decontaminate.find_benchmark(none, spark.createDataFrame([], "item_id long, text string"), ["doc_id"]).count() == 0


# --- Jaccard join ---------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("hot", [24, 2])
def test_jaccard_components(docs, hot):
    want = brute_components([(d, t) for d, t in rows_of(docs) if d is not None])
    for r in jaccard_join.jaccard_classes(docs, hot=hot).collect():
        assert r.doc_id is None or want[r.doc_id] == (r.n_shingles, r.component_id)


@pytest.mark.parametrize("size", [4, 7, 12, 25, 60, 200])
def test_signatures_meet(size):
    """Sets at the very edge of the threshold share a signature, or spend what they can spare."""
    rng = np.random.default_rng(size)
    for _ in range(40):
        larger = int(rng.integers(size, size * 4 // 3 + 1))
        common = -(-3 * (size + larger) // 7)
        if common > size:
            continue
        pool = rng.integers(0, 1 << 63, size + larger, dtype=np.uint64)
        r, s = np.sort(pool[:size]), np.sort(np.concatenate([pool[:common], pool[size : size + larger - common]]))
        b = jaccard_join.bands(1 << 20)
        met = []
        for j in range(len(b) - 2):
            both = [x for x in (r, s) if j - 1 <= np.searchsorted(b, len(x), side="right") - 1 <= j]
            if len(both) == 2:
                (x, p), (y, q) = (jaccard_join.signatures(v, len(v), j) for v in both)
                met.append(bool(np.intersect1d(x, y).size) or jaccard_join.scheme(j)[0] == 0)
        assert any(met)


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components(spark, local):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7), (5, 5)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {(r.node, r.component) for r in components(e, local).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 1), (9, 8), (8, 8), (100, 100)} | {(i, 100) for i in range(101, 140)}


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components_of_a_path_and_a_random_graph(spark, local):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in rng.sample(range(60), 60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(70)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long"), local).collect()}
    assert got == {(x, find(x)) for x in list(up)}


def test_sieve_lets_every_key_through(spark):
    keys = spark.range(0, 1000, 7)
    s = Sieve(keys, "id")
    out = spark.range(1000).select("id", *s.hashes("id")).mapInArrow(s.before(), "id long")
    passed = {r.id for r in out.collect()}
    assert {r.id for r in keys.collect()} <= passed and len(passed) < 200


# --- licenses -------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = [t for label, t in licenses.TEMPLATES if label == "mit"][1].split("[[")[0]
    texts = [
        "Released Under the MIT License. under the mit license", "Licensed under CC BY-NC 4.0.", "under the GNU General Public License, version 3.",
        "under the GNU General Private License version 3", None, "", "Permission is hereby granted nothing",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (the \"Software\") to deal in the Software without restriction",
        "Licensed under the Apache License, Version 2.0", mit,
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d, ["doc_id"]).collect()}
    assert got[0].labels == ["mit"] and (got[0].n_base, got[0].first_word, got[0].last_word) == (2, 1, 5)
    assert got[1].labels == ["cc-by-nc"] and got[2].labels == ["gpl"] and got[2].base_labels == []
    assert got[3].labels == [] and got[4].n_words == got[5].n_words == 0 and got[6].labels == []
    assert got[7].labels == ["mit"] and got[8].base_labels == ["apache-2"] and got[9].labels == []


def test_automaton_marks():
    a = licenses.Automaton("one two three [[four five]] {{2}} end")
    for words, ok in (("one two three end", 4), ("one two three four five end", 6), ("one two three x y end", 6), ("one two three four end", 5), ("one two three x y z end", -1)):
        assert a.accept(words.split(), 0, len(words.split())) == ok
    with pytest.raises(ValueError):
        licenses.Automaton("one {{1}} two three")


# --- chat -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "\\", "\\\\### <turn </turn> \\<turn", "####", "a\n</turn>\nb", r"\### Assistant: </turn> ok"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    head, body, tail = chat.render('us"er\n', text)
    assert [(r, t) for r, t, _, _ in chat.parse((head + body + tail) * 2)] == [('us"er\n', text)] * 2


def test_windows(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(6):
        for turn in range(rng.randint(1, 40)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", None])
            rows.append((conv, turn, role, None if rng.random() < 0.1 else "word " * rng.randint(0, 60), 1))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra int").repartition(4)
    windows = sorted(chat.format_conversations(d, budget=120, history=40).collect(), key=lambda r: (r.conv_id, r.window))
    for conv in range(6):
        mine = [w for w in windows if w.conv_id == conv]
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        said, loss = [], []
        for w in mine:
            turns = chat.parse(w.formatted)
            said += [(r, t) for r, t, _, _ in turns[w.n_repeated :]]
            loss += [chat.unescape(w.formatted[m.lo : m.hi]) for m in w.loss]
            assert w.n_tokens <= 120 or len(turns) - w.n_repeated == 1
            if w.window and own[0][0] == "system":
                assert turns[0][:2] == own[0]
        assert said == own and loss == [t for r, t in own if r == "assistant"]


# --- classifiers ----------------------------------------------------------------------------------------


def test_models_learn_and_ignore_held_out_labels(spark, tmp_path):
    rng = random.Random(2)
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "tempor", "labore"]
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 3 == 0, i % 4 == 0
        words = [rng.choice(plain) for _ in range(60)]
        if bad:
            words = [w + "###" for w in words]
        if toxic:
            words[rng.randrange(60)] = words[rng.randrange(60)] = "vile"
        rows.append((i, " ".join(words)))
        held = zlib.crc32(str(i).encode()) % 3 == 1
        labels.append((i, int(not bad) if not held else int(bad), int(toxic)))  # held-out labels are wrong on purpose
    rows += [(None, None), (10_000, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality_model.op6_quality_model(spark, str(tmp_path)).collect()}
    assert sum(got[i].predicted == int(i % 3 != 0) for i in range(600)) > 590
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(600)) and 0 <= got[None].score <= 1
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()}
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(600)) > 590 and got[10_000].predicted == 0


# --- mixing ---------------------------------------------------------------------------------------------


def test_pfair_windows_and_lag():
    weights = [Fraction(1, 2), Fraction(1, 3), Fraction(1, 12), Fraction(1, 12)]
    done = [0] * 4
    for slot, source, block, release, deadline in mixing.pfair(weights, 600):
        assert release <= slot < deadline and block == done[source]
        done[source] += 1
        assert all(abs(n - w * (slot + 1)) < 1 for n, w in zip(done, weights, strict=True))


def test_mix_reads_every_row(docs):
    out = mixing.mix(docs.select("doc_id", "source", "text"), block_rows=3).collect()
    first = Counter((r.doc_id, r.source) for r in out if r.epoch == 0)
    assert first == Counter((r.doc_id, r.source) for r in docs.collect())


# --- repeats --------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        out.append((sum(cover), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,hot", [(400, 50, 4000), (60, 12, 4000), (60, 12, 8)])
def test_repeats(docs, length, gram, hot):
    got = repeats.remove_repeats(docs, length, gram, hot)
    got = Counter((r.doc_id, sum(s.hi - s.lo for s in r.spans), len(r.spans), r.kept_sha256) for r in got.collect())
    rows = rows_of(docs)
    want = Counter((d, *w) for (d, _), w in zip(rows, brute_repeats([t.encode() for _, t in rows], length), strict=True))
    assert got == want


@pytest.mark.parametrize("levels,alts,n,hot", [(6, 3, 300, 4), (10, 2, 400, 4)])
def test_repeats_around_one_gram(spark, levels, alts, n, hot):
    """Members of one hot gram that vary in blocks on both sides reach the same side by several ways."""
    length, gram = 40, 10
    rng = random.Random(1)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def gram_hash(w):
        s = repeats.prefix_hash(np.frombuffer(w.encode(), dtype=np.uint8))
        return int(repeats.mix(s[gram:] - s[:-gram])[0])

    middle = min((word(gram) for _ in range(4000)), key=gram_hash)  # the anchor of nearly all windows
    sides = [[[word((length - gram) // levels) for _ in range(alts)] for _ in range(levels)] for _ in range(2)]
    texts = ["".join(rng.choice(b) for b in sides[0]) + middle + "".join(rng.choice(b) for b in sides[1]) for _ in range(n)]
    texts = sorted(set(texts))
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, gram, hot)
    got = {r.doc_id: (sum(s.hi - s.lo for s in r.spans), len(r.spans), r.kept_sha256) for r in got.collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], length)))


def test_repeats_of_colliding_bytes(spark):
    """Two strings that one polynomial hash modulo 2^64 takes for the same, at the end of texts whose last windows stand twice each."""
    length, gram = 60, 12
    pair = "mllomlllnlllnmnlmllnnmmmnm", "mnnlmnonmnnnmmlnnoommmmmln"
    s = [repeats.prefix_hash(np.frombuffer(w.encode(), dtype=np.uint8))[-1] for w in pair]
    assert s[0] == s[1]
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    texts = []
    for _ in range(24):
        passage = word(length - len(pair[0]))
        texts += [word(30) + passage + pair[i % 2] for i in range(4)]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length, gram)
    got = {r.doc_id: (sum(s.hi - s.lo for s in r.spans), len(r.spans), r.kept_sha256) for r in got.collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts], length)))


@pytest.mark.parametrize("members,alts,hashes", [(60, [40] + [1] * 11, False), (700, [2] * 12, True)])
def test_repeats_sorts_without_hashes(monkeypatch, members, alts, hashes):
    """Groups are sorted by bytes; windows are hashed only where open members are many."""
    length, gram = 60, 12
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    middle = word(gram)
    sides = [[word(8) for _ in range(k)] for k in alts]
    texts = sorted({"".join(map(rng.choice, sides[:6])) + middle + "".join(map(rng.choice, sides[6:])) for _ in range(members)})
    left = 48
    table = pa.table(
        {
            "h": np.zeros(len(texts), np.int64),
            "key": pa.array([str(i).encode() for i in range(len(texts))], pa.binary()),
            "pos": np.full(len(texts), left),
            "left": pa.array([left] * len(texts), pa.int32()),
            "ctx": pa.array([t.encode() for t in texts], pa.binary()),
        }
    )
    calls = []
    monkeypatch.setattr(repeats, "prefix_hash", lambda data, real=repeats.prefix_hash: calls.append(len(data)) or real(data))
    got = {int(r["key"]): [] for r in table.to_pylist()}
    for r in repeats._sort_bucket(length, gram)(table).to_pylist():
        got[int(r["key"])].append((r["lo"], r["hi"]))
    assert bool(calls) == hashes
    for (i, spans), (n, k, _) in zip(sorted(got.items()), brute_repeats([t.encode() for t in texts], length), strict=True):
        assert (sum(hi - lo for lo, hi in spans), len(spans)) == (n, k)


def test_suffix_sort():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    ext = repeats.Extensions(data)
    start = rng.permutation(500)[:200]
    group = np.sort(rng.integers(0, 9, 200))
    size = np.minimum(90, len(data) - start)
    order = repeats.suffix_sort(ext, start, size, group)
    raw = data.tobytes()
    for g in range(9):
        at = [i for i in order if group[i] == g]
        texts = [raw[start[i] : start[i] + size[i]] for i in at]
        assert texts == sorted(texts)


# --- decontamination ------------------------------------------------------------------------------------


def test_fm_index():
    rng = np.random.default_rng(6)
    t = rng.integers(0, 5, 900).astype(np.int32)
    t[-1] = 0
    index = decontaminate.FMIndex(t, 4)
    for m in (1, 2, 5):
        patterns = rng.integers(1, 6, (40, m)).astype(np.int32)
        lo, hi = index.search(patterns[:, ::-1], np.full(40, m))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(t) - m + 1) if (t[i : i + m] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_decontamination(spark, docs):
    items = [(1, " ".join((TEXTS[9] or "").split()[20:60])), (2, "One"), (3, None), (4, "!!"), (None, "a b c"), (1, "edit")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for item, t in items:
        w = word.findall((t or "").translate(LOWER))
        for i in range(max(len(w) - 13, 0) + 1) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    for block in (1 << 20, 1):
        for r in decontaminate.find_benchmark(docs, bench, ["doc_id", "text"], block).collect():
            w = word.findall((r.text or "").translate(LOWER))
            hit, found = set(), set()
            for p, own in windows.items():
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hit |= set(range(i, i + len(p)))
                        found |= {str(x) for x in own if x is not None}
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(found))
            left = decontaminate.remove_spans(r.text or "", [(s.lo, s.hi) for s in r.spans])
            assert len(word.findall(left.translate(LOWER))) <= len(w) - len(hit) + len(r.spans)


def test_shards_are_cut_inside_batches(spark):
    assert list(decontaminate.slices(pa.array(["a" * 10] * 5), 20)) == [(0, 2), (2, 4), (4, 5)]
