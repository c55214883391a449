"""A small corpus with every kind of case, and brute-force versions of what the operators return."""

import hashlib
import random
import re
import zlib
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return (text or "").translate(LOWER)


def make_corpus(seed=7):
    """(documents, labels, benchmark, conversations) as lists of rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuäö") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"b{i}", say(rng.randint(14, 60))) for i in range(12)] + [("short", "only these four words"), ("none", "!!"), ("null", None)]
    texts = [None, "", " \n\t ", "one", "One two", "a b c d e", say(4000), "x y " * 300]
    base = say(160)
    texts += [base] * 4
    for edits in range(1, 14):
        words = base.split()
        for _ in range(edits):
            words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    passage = say(90)
    texts += [f"{say(rng.randint(20, 90))} {passage} {say(rng.randint(20, 90))}" for _ in range(10)]
    texts += [f"{say(60)}\nthe same line\n{say(20)}\nthe same line\n" for _ in range(4)]
    texts += [f"{say(70)}. Released UNDER the MIT license. {say(5)}. Apache License, Version 2.0. under the mit license", f"{say(55)} CC BY-NC 4.0"]
    texts += [f"{say(60)} under the GNU General Public License version 3 {say(9)}"]
    texts += [f"{say(30)} {items[i][1]} {say(200)}" for i in range(6)] + [items[7][1], f"{say(900)} {items[8][1]}"]
    texts += [" ".join(w + "###" for w in say(80).split()) for _ in range(30)]
    texts += [f"{say(40)} vileword {say(40)} vileword" for _ in range(30)]
    texts += [say(rng.randint(55, 120)) for _ in range(150)]
    documents, labels = [], []
    for i, t in enumerate(texts):
        documents.append((i * 3 + 1, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None, "s2"][i % 5], len(t or "")))
        labels.append((i * 3 + 1, int("###" not in (t or "")), int("vileword" in (t or ""))))
    documents += [(None, "a text without an id " + say(60), "en", "s0", 0), documents[9], (documents[10][0], say(70), "en", "s1", 0)]
    conversations = []
    for conv in range(9):
        for turn in range(rng.randint(1, 25)):
            role = "system" if (turn == 0 and conv % 2) or (turn == 9 and conv == 4) else rng.choice(["user", "assistant", "assistant", None])
            text = rng.choice([None, "", "\\", "a </turn> b", '<turn "user">', "### x", say(rng.randint(0, 120))])
            conversations.append((conv, turn, role, text))
    return documents, labels, items, conversations


def write(spark, path, documents, labels, benchmark, conversations):
    tables = {
        "documents": (documents, DOCUMENTS),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (benchmark, "item_id string, text string"),
        "conversations": (conversations, "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def rule_counts(text):
    t = text or ""
    w = SPACED.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def shingles(text):
    w = SPACED.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows):
    """{doc_id: (size, component)} of (doc_id, text) rows; an id that repeats has its largest set and all its links."""
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(d, shingles(t)) for d, t in rows]
    for i, (a, r) in enumerate(sets):
        for b, s in sets[:i]:
            if r and s and 100 * len(r & s) >= 75 * len(r | s):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    size = {}
    for d, s in sets:
        size[d] = max(size.get(d, 0), len(s))
    return {d: (size[d], find(d)) for d in size}


def license_places(text):
    w = ALNUM.findall(lowered(text))
    found = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((len(b), sum(cover), sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def contamination(text, benchmark):
    """(n_words, n_hit, n_items, items_sha256, contaminated)."""
    w = ALNUM.findall(lowered(text))
    hit, items = set(), set()
    for item, t in benchmark:
        v = ALNUM.findall(lowered(t))
        for j in range(max(len(v) - 13, 0) + 1) if v else ():
            p = v[j : j + 13]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    items.add(item)
    names = ",".join(sorted(map(str, items)))
    return len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def chat_digests(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) rows in order."""
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def crc(x):
    return zlib.crc32(str(x).encode())
