r"""N-gram Jaccard join (operator 3): all links of similarity 3/4 and more, by PartEnum signatures.

A document's set holds its distinct 5-word shingles (a shorter text is one shingle). Sets r, s link when
100 |r & s| >= 75 |r | s|, which bounds their Hamming distance by |r| + |s| - 2 ceil(3 (|r| + |s|) / 7).
Equal-size bands [l, l / 0.75] turn that into one bound k for each band; a set takes part in its own band
and the next. In a band the feature domain is hashed into n1 partitions:

* small bands: each partition is divided into n2 = k2 + 3 and every choice of n2 - k2 of them is a
  signature, with n1 (k2 + 1) > k, so linked sets share a signature;
* large bands: n1 > k partitions, each one signature, so linked sets agree on n1 - k or more.

1. Equal sets (128-bit fingerprint and size) collapse by a partial aggregation to the one of the smallest
   doc_id, so copies send no signatures. Each remaining set has its signatures packed in one value.
2. Signatures are dealt to buckets in packed blocks (some six bytes each, at any number of buckets), where
   sets with equal signatures meet; only pairs with a set that is in its own band count. A signature of at
   most `hot` sets yields its pairs. A hotter one (a common passage, a large family of near copies) yields
   stars to two leaders, and costs each member one of the agreements that it can spare: a pair can be
   lost only if both members spend more than they can spare, and only such rows of hot signatures go to
   `_rest`, which compares them block by block. Empty partitions are never sent (they count as spent),
   unless a set cannot spare them.
3. Pairs that share fewer signatures than a link must are dropped, and so are those whose parity sketches
   (one bit for each of 8 k or more hashed bins: how many features fall there, modulo 2) differ in more than
   k bits: each feature that only one set has changes one bit, so no link is lost.
4. Each set is first verified against the smaller one with the nearest sketch; every other pair after
   that, unless its ends are in one component by then, which its link could not change. Verification
   compares the sets of the texts' words themselves, not of hashes. No link is capped or dropped.

Nulls and texts without words: empty set, linked with nothing, component = own doc_id. A null doc_id is
reported with a null component and links nothing. Rows that repeat a doc_id are each reported with the
id's largest set and smallest component. Very long texts are read whole; a text's set and signatures must
fit in a task. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm._common import cut, gapless, release, table
from inkstone.llm._graph import Sieve, components, stars
from inkstone.llm._words import SPACED, Words, mix, slices, trim

GRAM = 5
#: Different sets that may share a signature before it counts as hot: at most hot^2 / 2 pairs each.
HOT = 12
#: Sets in a block of those that are compared all with all.
BLOCK = 2048
#: Up to this size (of a band's end) partitions are divided and subsets enumerated.
SMALL = 40
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_COUNT = np.uint64(0x2545F4914F6CDD1D)


# --- sets ---------------------------------------------------------------------------------------


def shingle_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, first): the sorted distinct shingles of text d are fingerprints[first[d]:first[d + 1]]."""
    w = Words(texts, SPACED)
    h, n = w.hash, w.counts
    m = max(len(h) - GRAM + 1, 0)
    grams = np.zeros(m, dtype=np.uint64)
    for j in range(GRAM):
        grams += mix(h[j : j + m]) * _K[j]
    text = w.text_of()
    whole = np.flatnonzero(text[:m] == text[GRAM - 1 :]) if m else np.zeros(0, np.int64)
    values, rows = [mix(grams[whole])], [text[whole]]
    short = np.flatnonzero((n > 0) & (n < GRAM))
    for d in short:
        lo, c = w.first[d], int(n[d])
        values.append(mix(np.sum(mix(h[lo : lo + c]) * _K[:c], dtype=np.uint64, keepdims=True) + _COUNT * _K[c : c + 1]))
        rows.append(np.array([d]))
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    value, row = value[order], row[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(len(n) + 1))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text."""
    value, first = shingle_rows(texts)
    return [value[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


# --- the signature scheme -------------------------------------------------------------------------


@lru_cache(None)
def bands(limit: int) -> tuple[int, ...]:
    """First sizes of the bands, up to beyond `limit`."""
    out = [1]
    while out[-1] <= limit:
        out.append(out[-1] * 4 // 3 + 1)
    return tuple(out)


def distance(total: np.ndarray | int) -> np.ndarray:
    """The largest Hamming distance of linked sets whose sizes add up to `total` or less."""
    t = np.asarray(total)[..., None] - np.arange(8)
    return np.max(t - 2 * -(-3 * t // 7), axis=-1)


@lru_cache(None)
def scheme(j: int) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of band j."""
    b = bands(1 << 40)
    k = int(distance(2 * (b[j + 1] - 1)))
    if b[j + 1] - 1 <= SMALL:
        k2 = min(k, 3)
        return k, -(-(k + 1) // (k2 + 1)), k2 + 3, k2
    return k, math.ceil(1.2 * (k + 1)) + 3, 1, 0


def _salt(j: int) -> int:
    return j * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)


def signatures(s: np.ndarray, size: int, j: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in band j, and how many of its agreements it can spare."""
    out, row, spare = _signatures(s, np.array([0, len(s)]), np.array([j]))
    return out, int(spare[0])


def _signatures(value: np.ndarray, first: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set, spare): those of each set in its given band, sets ascending."""
    sizes = np.diff(first)
    plan = {int(j): scheme(int(j)) for j in np.unique(band)}
    n1 = np.array([plan[int(j)][1] for j in band], dtype=np.int64)
    k = np.array([plan[int(j)][0] for j in band], dtype=np.int64)
    n2 = np.array([plan[int(j)][2] for j in band], dtype=np.int64)
    parts = np.where(k > 0, n1 * n2, 0)  # k = 0: only equal sets link here, and those are collapsed
    base = np.concatenate([[0], np.cumsum(parts)])
    salt = np.array([_salt(int(j)) for j in band], dtype=np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    some = parts[row] > 0
    row, v = row[some], value[some]
    with np.errstate(over="ignore"):
        at = base[row] + ((mix(v ^ salt[row]) >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(base[-1]), dtype=np.uint64)
        np.add.at(sums, at, mix(v + salt[row]))
        counts = np.bincount(at, minlength=len(sums)).astype(np.uint64)
        code = mix(sums + counts * _COUNT)
        # Large bands: a signature for each partition.
        owner = np.repeat(np.arange(len(sizes)), parts)
        number = (np.arange(len(sums)) - base[owner]).astype(np.uint64)
        full = counts > 0
        filled = np.bincount(owner[full], minlength=len(sizes))
        b = np.array(bands(1 << 40), dtype=np.int64)
        most = sizes + np.minimum(b[band + 1] - 1, sizes * 4 // 3)
        spare = np.where(n2 == 1, n1 - np.minimum(distance(most), k) - 1 - (n1 - filled), 0)
        spare = np.where(k > 0, spare, 32000)
        send = (n2[owner] == 1) & (full | (spare[owner] < 0))
        out, who = [mix(code[send] + number[send] * _K[1] + salt[owner[send]])], [owner[send]]
        # Small bands: a signature for each choice of a partition's divisions.
        for d in np.flatnonzero((n2 > 1) & (k > 0)):
            _, p, q, k2 = plan[int(band[d])]
            own = code[base[d] : base[d + 1]].reshape(p, q)
            for choice, chosen in enumerate(combinations(range(q), q - k2)):
                h = np.zeros(p, dtype=np.uint64)
                for c in chosen:
                    h = mix(h + own[:, c])
                out.append(mix(h + np.arange(p, dtype=np.uint64) * _K[1] + np.uint64(choice) * _K[2] + salt[d]))
                who.append(np.full(p, d))
    sig, of = np.concatenate(out), np.concatenate(who)
    order = np.argsort(of, kind="stable")
    return sig[order], of[order], np.clip(spare, -32000, 32000)


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Bins of a set's parity sketch: a power of two, 8 to 16 times its distance bound, 64 at least."""
    return 1 << np.ceil(np.log2(np.maximum(8 * distance(sizes * 7 // 3), 64))).astype(np.int64)


def _sketches(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    sizes = np.diff(first)
    bits = sketch_bits(sizes)
    base = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = base[row] + ((value >> np.uint64(8)).astype(np.int64) & (bits[row] - 1))
    odd = (np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _prints(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set's members; 0 for empty sets."""
    sizes = np.diff(first)
    f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        with np.errstate(over="ignore"):
            f1[some] = np.add.reduceat(mix(value + _K[3]), first[some])
            f2[some] = np.add.reduceat(mix(mix(value ^ _K[4]) + _K[2]), first[some])
    return f1.view(np.int64), f2.view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (id, f1, f2, n, sketch) of its set, n = 0 for none."""
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            value, first = shingle_rows(batch.column(1).slice(lo, hi - lo))
            f1, f2 = _prints(value, first)
            sketch = pa.array(_sketches(value, first), pa.binary())
            columns = [pa.array(f1), pa.array(f2), pa.array(np.diff(first).astype(np.int32)), sketch]
            yield pa.record_batch([batch.column(0).slice(lo, hi - lo), *columns], names=["id", "f1", "f2", "n", "sketch"])
    trim()


def _signed(width: int):
    """(doc_id, text) to (id, f1, f2, n, spare, own, sigs) of its set, if any.

    `sigs` holds `width` bytes for each signature: `own` of them in the set's own band, then those in the next.
    """
    names = ["id", "f1", "f2", "n", "spare", "own", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                value, first = shingle_rows(batch.column(1).slice(lo, hi - lo))
                some = np.flatnonzero(np.diff(first))
                sizes = np.diff(first)[some]
                first = np.concatenate([[0], np.cumsum(sizes)])
                if not len(some):
                    continue
                f1, f2 = _prints(value, first)
                own = np.searchsorted(np.array(bands(1 << 40)), sizes, side="right") - 1
                parts, spares, counts = [], [], []
                for step in (0, 1):
                    sig, of, spare = _signatures(value, first, own + step)
                    raw = np.ascontiguousarray(sig.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 8 - width :]
                    cuts = np.searchsorted(of, np.arange(len(sizes) + 1)) * width
                    raw = np.ascontiguousarray(raw).tobytes()
                    parts.append([raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
                    counts.append(np.diff(cuts) // width)
                    spares.append(spare)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(some)),
                        pa.array(f1),
                        pa.array(f2),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(np.minimum(*spares).astype(np.int32)),
                        pa.array(counts[0].astype(np.int32)),
                        pa.array([x + y for x, y in zip(*parts, strict=True)], pa.binary()),
                    ],
                    names=names,
                )
        trim()

    return run


# --- meeting --------------------------------------------------------------------------------------

_BLOCK = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary())])
#: Widths of the steps between the ids of a block.
_STEPS = ("<u1", "<u2", "<u4", "<u8")
_SPARE = 255


def _blocks(buckets: int, width: int):
    """Rows (id, own, spare, sigs) to packed entries by bucket: ids as steps of the narrowest width, keys of four bytes.

    A key is 31 bits of the signature and whether the set is there from the band below. What sets can spare
    goes along, to any bucket.
    """

    def flush(ids: list, owns: list, spares: list, blobs: list) -> pa.RecordBatch:
        who = np.array(ids, dtype=np.int64)
        order = np.argsort(who, kind="stable")
        raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :width] = raw
        sig = wide.view("<u8").ravel()
        n = np.array([len(b) // width for b in blobs], dtype=np.int64)
        row = np.repeat(np.arange(len(who)), n)
        begin = np.concatenate([[0], np.cumsum(n)])
        following = (np.arange(len(sig)) - begin[row]) >= np.array(owns, dtype=np.int64)[row]
        rank = np.empty(len(who), dtype=np.int64)
        rank[order] = np.arange(len(who))
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        key = ((sig // np.uint64(buckets)) << np.uint64(1) & np.uint64(0xFFFFFFFF) | following.astype(np.uint64)).astype("<u4")
        by = np.lexsort((rank[row], bucket))
        bucket, key, entry = bucket[by], key[by], who[row[by]]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        out: dict[str, list] = {"bucket": [], "ids": [], "keys": []}
        for b in np.flatnonzero(np.diff(edges)):
            lo, hi = edges[b], edges[b + 1]
            step = np.diff(entry[lo:hi])
            most = int(step.max()) if len(step) else 0
            code = next(i for i in range(4) if most < 1 << (8 << i) or i == 3) if not len(step) or step.min() >= 0 else 3
            out["bucket"].append(int(b))
            out["ids"].append(bytes([code]) + entry[lo : lo + 1].tobytes() + step.astype(_STEPS[code]).tobytes())
            out["keys"].append(key[lo:hi].tobytes())
        out["bucket"].append(int(who[0] % buckets))
        out["ids"].append(bytes([_SPARE]) + who.tobytes())
        out["keys"].append(np.array(spares, dtype="<i4").tobytes())
        return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), _BLOCK.types, strict=True)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], []]
        held = 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for column, v in zip(rows, row, strict=True):
                    column.append(v.as_py())
                held += len(rows[3][-1]) // width + 1
                if held > 1 << 20:
                    yield flush(*rows)
                    rows, held = [[], [], [], []], 0
        if rows[0]:
            yield flush(*rows)
        trim()

    return run


_MET = "kind int, a long, b long, c long"


def _meet(hot: int):
    """All blocks of a bucket to rows: 0 (doc: what it can spare), 1 (pair: signatures shared), 2 (doc: hot signatures met), 3 (doc, hot signature)."""

    def run(t: pa.Table) -> pa.Table:
        keys, docs = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        t = t.combine_chunks()
        bucket = t.column("bucket")[0].as_py()
        for ids, key in zip(t.column("ids"), t.column("keys"), strict=True):
            raw = ids.as_py()
            if raw[0] == _SPARE:
                who = np.frombuffer(raw, dtype="<i8", offset=1)
                out.append((0, who, np.zeros(len(who), np.int64), np.frombuffer(key.as_py(), dtype="<i4")))
                continue
            steps = np.frombuffer(raw, dtype=_STEPS[raw[0]], offset=9).astype(np.int64)
            docs.append(np.cumsum(np.concatenate([np.frombuffer(raw, dtype="<i8", count=1, offset=1), steps])))
            keys.append(np.frombuffer(key.as_py(), dtype="<u4"))
        key, doc = np.concatenate(keys), np.concatenate(docs)
        del keys, docs
        # Signatures met once go first; what is left is small.
        order = np.argsort(key >> np.uint32(1))
        key, doc = key[order], doc[order]
        same = np.zeros(len(key) + 1, dtype=bool)
        np.equal(key[1:] >> np.uint32(1), key[:-1] >> np.uint32(1), out=same[1:-1])
        keep = same[1:] | same[:-1]
        key, doc = key[keep], doc[keep]
        sig, above = (key >> np.uint32(1)).astype(np.int64), (key & np.uint32(1)).astype(bool)
        order = np.lexsort((doc, above, sig))
        sig, above, doc = sig[order], above[order], doc[order]
        begins = np.ones(len(sig), dtype=bool)
        begins[1:] = sig[1:] != sig[:-1]
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(sig)))
        group = np.repeat(np.arange(len(starts)), sizes)
        # A group in which no set is in its own band pairs nothing.
        alive = (~above[starts])[group] if len(group) else above
        place = np.arange(len(sig)) - starts[group] if len(sig) else np.zeros(0, int)
        first, second = [], []
        for gap in range(1, hot):
            i = np.flatnonzero(alive & (place >= gap) & (sizes[group] <= hot)) if len(sig) else np.zeros(0, int)
            i = i[~above[i - gap]] if len(i) else i
            if not len(i):
                break
            first.append(doc[i - gap])
            second.append(doc[i])
        big = np.flatnonzero((sizes > hot) & ~above[starts]) if len(sig) else np.zeros(0, int)
        if len(big):
            inside = alive & (sizes[group] > hot)
            g, d = group[inside], doc[inside]
            for how in (d.view(np.uint64), mix(d.view(np.uint64))):
                lead = np.lexsort((how, g))
                head_of = lead[np.searchsorted(g[lead], big)]
                leader = np.zeros(len(starts), dtype=np.int64)
                leader[big] = d[head_of]
                first.append(leader[g])
                second.append(d)
            met, times = np.unique(d, return_counts=True)
            out.append((2, met, np.zeros(len(met), np.int64), times))
            out.append((3, d, sig[inside] * 65536 + bucket % 65536 + (bucket // 65536 << 48), np.ones(len(d), np.int64)))
        if first:
            x, y = np.concatenate(first), np.concatenate(second)
            x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            new = np.ones(len(x), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(new)
            out.append((1, x[at], y[at], np.diff(np.append(at, len(x)))))
        kinds = np.concatenate([np.full(len(a), k, np.int32) for k, a, _, _ in out]) if out else np.zeros(0, np.int32)
        cols = [np.concatenate([o[i] for o in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in (1, 2, 3)]
        del key, doc, sig
        trim()
        return pa.table({"kind": kinds, "a": cols[0], "b": cols[1], "c": cols[2]})

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, sa, sb) to (a, b, apart): pairs whose sketches differ in no more bits than a link may."""
    for batch in batches:
        a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
        apart = np.full(len(a), 1 << 30, dtype=np.int64)
        sides = [batch.column(i) for i in (4, 5)]
        sizes = [np.array([len(x.as_py()) for x in side], dtype=np.int64) if len(a) else np.zeros(0, np.int64) for side in sides]
        for p, q in {(int(x), int(y)) for x, y in zip(*sizes, strict=True)}:
            i = np.flatnonzero((sizes[0] == p) & (sizes[1] == q))
            both = []
            for side, wide in zip(sides, (p, q), strict=True):
                x = np.frombuffer(b"".join(v.as_py() for v in side.take(pa.array(i))), dtype=np.uint8).reshape(len(i), wide)
                both.append(np.bitwise_xor.reduce(x.reshape(len(i), -1, min(p, q)), axis=1))
            apart[i] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
        n, m = na.astype(np.int64), nb.astype(np.int64)
        may = (apart <= n + m - 2 * -(-3 * (n + m) // 7)) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))
        yield pa.record_batch([pa.array(a[may]), pa.array(b[may]), pa.array(apart[may])], names=["a", "b", "apart"])


# --- verification -----------------------------------------------------------------------------------


def word_set(text: bytes) -> set:
    """The set of a text as tuples of its words."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(GRAM)))) if len(w) >= GRAM else {tuple(w)} if w else set()  # noqa: B905


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, set())
    for batch in batches:
        keep = np.zeros(len(batch), dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
            x = x.as_py()
            if x != last[0]:
                last = (x, word_set(x))
            r, s = last[1], word_set(y.as_py())
            if not r or 4 * min(len(r), len(s)) < 3 * max(len(r), len(s)):
                continue
            common = len(r & s)
            keep[i] = 100 * common >= 75 * (len(r) + len(s) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))
    trim()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, t) of the documents in ids(id), and some more."""
    sieve = Sieve(ids, "id")
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).where("doc_id IS NOT NULL AND t IS NOT NULL")
    return made.select("doc_id", "t", *sieve.hashes("doc_id")).mapInArrow(sieve.before(), "id long, t binary")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets link, by the words of their whole texts."""
    made = _texts(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    x, y, p = made.alias("x"), made.alias("y"), pairs.alias("p")
    one = p.join(x, F.col("p.a") == F.col("x.id")).select("p.a", "p.b", F.col("x.t").alias("ta")).alias("o")
    two = one.join(y, F.col("o.b") == F.col("y.id")).select("o.a", "o.b", "o.ta", F.col("y.t").alias("tb"))
    return two.mapInArrow(_linked, "a long, b long").distinct()


def _candidates(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, apart) that share as many signatures as a link must and whose sketches are near enough.

    Linked sets agree on at least spare + 1 full partitions; those that were hot need not show up in c.
    """
    hot = met.where("kind = 2").groupBy(F.col("a").alias("h")).agg(F.sum("c").alias("hot"))
    spare = met.where("kind = 0").groupBy(F.col("a").alias("s")).agg(F.min("c").alias("spare"))
    known = sets.join(spare, F.col("id") == F.col("s")).join(hot, F.col("id") == F.col("h"), "left")
    known = known.select("id", "n", "sketch", (F.col("spare") + 1 - F.coalesce("hot", F.lit(0))).alias("need"))
    x, y, p = known.alias("x"), known.alias("y"), met.where("kind = 1").alias("p")
    one = p.join(x, (F.col("p.a") == F.col("x.id")) & (F.col("p.c") >= F.col("x.need")))
    one = one.select("p.a", "p.b", "p.c", F.col("x.n").alias("na"), F.col("x.sketch").alias("sa")).alias("o")
    two = one.join(y, (F.col("o.b") == F.col("y.id")) & (F.col("o.c") >= F.col("y.need")))
    return two.select("o.a", "o.b", "o.na", F.col("y.n").alias("nb"), "o.sa", F.col("y.sketch").alias("sb")).mapInArrow(_near, "a long, b long, apart long")


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component."""
    c = comp.groupBy("node").agg(F.min("component").alias("c"))
    return (
        pairs.join(c.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left")
        .join(c.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
        .where("ca IS NULL OR cb IS NULL OR ca <> cb")
        .select("a", "b")
    )


def _block_links(t: pa.Table) -> pa.Table:
    """Links inside a pair of blocks, as many as connect what they connect.

    Overlaps of all its sets come from matrix products over slices of the features that occur twice; a link
    counts if the sets of words confirm it.
    """
    side = np.array(t.column("side").to_pylist(), dtype=np.int64)
    ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
    texts = t.column("t").combine_chunks()
    value, first = shingle_rows(texts)
    size = np.diff(first)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: both
    row = np.repeat(np.arange(len(size)), size)
    _, feature, times = np.unique(value, return_inverse=True, return_counts=True)
    twice = times[feature] > 1
    row, feature = row[twice], feature[twice]
    number = np.cumsum(times > 1) - 1
    feature = number[feature]
    order = np.argsort(feature, kind="stable")
    row, feature = row[order], feature[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 2048
    for lo in range(0, int(feature[-1]) + 1 if len(feature) else 0, width):
        i, j = np.searchsorted(feature, [lo, lo + width])
        m = np.zeros((len(size), width), dtype=np.float32)
        m[row[i:j], feature[i:j] - lo] = 1
        common += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - common
    x, y = np.nonzero((100 * common >= 75 * union) & (union > 0))
    x, y = left[x], right[y]
    up = {c: c for c in comp.tolist()}
    words: dict[int, set] = {}

    def find(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    def of(i):
        if i not in words:
            words[i] = word_set(texts[i].as_py())
        return words[i]

    a, b = [], []
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        p, q = find(int(comp[i])), find(int(comp[j]))
        if p != q and 100 * len(of(i) & of(j)) >= 75 * len(of(i) | of(j)):
            up[max(p, q)] = min(p, q)
            a.append(int(ids[i]))
            b.append(int(ids[j]))
    trim()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rest(docs: DataFrame, met: DataFrame, sets: DataFrame, comp: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """Links between sets that spent more agreements than they can spare, across the components so far; None for no such sets.

    Only such sets that share a hot signature with another component come here. Those that hot signatures
    connect form a family; families are cut into size classes (links stay in a class or reach the next) and
    blocks of `block` sets, and each pair of blocks is compared in one task. No pairs are written.
    """
    hot = met.where("kind = 2").groupBy(F.col("a").alias("id")).agg(F.sum("c").alias("hot"))
    spare = met.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("spare"))
    unsafe = hot.join(spare, "id").where("hot > spare").select("id")
    rows = (
        met.where("kind = 3")
        .select(F.col("a").alias("id"), F.col("b").alias("sig"))
        .join(unsafe, "id")
        .join(comp.groupBy(F.col("node").alias("id")).agg(F.min("component").alias("component")), "id", "left")
        .select("id", "sig", F.coalesce("component", "id").alias("comp"))
    )
    mixed = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("lead")).where("lo < hi")
    open_ = cut(rows.join(mixed.select("sig", "lead"), "sig").select("id", "comp", "lead").distinct())
    if not open_.count():
        return None
    family = components(open_.select(F.col("lead").alias("a"), F.col("id").alias("b")))
    size = sets.groupBy("id").agg(F.max("n").alias("n"))
    placed = (
        open_.select("id", "comp")
        .distinct()
        .join(family.groupBy(F.col("node").alias("id")).agg(F.min("component").alias("family")), "id")
        .join(size, "id")
        .withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(4 / 3) + 1e-9).cast("int"))
    )
    placed = cut(
        gapless(placed.withColumn("group", F.concat_ws(":", "family", "class")), ["id"], "no", within="group", buckets=64)
        .withColumn("block", (F.col("no") / block).cast("int"))
        .select("id", "comp", "family", "class", "block")
    )
    blocks = placed.groupBy("family", F.col("class").alias("of")).agg((F.max("block") + 1).alias("blocks"))
    # A set goes to each pair of its block with one of its own class, of the next, and of the one before.
    near = placed.withColumn("of", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1))).join(blocks, ["family", "of"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    task = near.withColumn("other", other).withColumns(
        {
            "low": F.least(F.struct(F.col("class").alias("c"), F.col("block").alias("b")), F.struct(F.col("of").alias("c"), F.col("other").alias("b"))),
            "high": F.greatest(F.struct(F.col("class").alias("c"), F.col("block").alias("b")), F.struct(F.col("of").alias("c"), F.col("other").alias("b"))),
        }
    )
    own = F.struct(F.col("class").alias("c"), F.col("block").alias("b"))
    task = task.select(
        "id", "comp", F.concat_ws(":", "family", "low.c", "low.b", "high.c", "high.b").alias("task"),
        F.when(F.col("low") == F.col("high"), 2).when(own == F.col("low"), 0).otherwise(1).alias("side"),
    )
    made = _texts(docs, placed.select("id"))
    return task.join(made, "id").groupBy("task").applyInArrow(_block_links, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    # A bucket should hold some 15 MB of signatures; the input's size is the planner's estimate.
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(min(max(size // (8 << 20), partitions), 1 << 20))
    # Bytes of a signature: few unlike signatures may be equal by chance at any size of the input.
    width = min(max(-(-(size.bit_length() + 5) // 8), 5), 8)
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    sets = cut(narrow.mapInArrow(_fingerprints, "id long, f1 long, f2 long, n int, sketch binary").where("n > 0"))
    met = cut(
        narrow.mapInArrow(_signed(width), "id long, f1 long, f2 long, n int, spare int, own int, sigs binary")
        .groupBy("f1", "f2", "n")
        .agg(F.min("id").alias("id"), F.first("own").alias("own"), F.first("spare").alias("spare"), F.first("sigs").alias("sigs"))
        .select("id", "own", "spare", "sigs")
        .mapInArrow(_blocks(buckets, width), "bucket int, ids binary, keys binary")
        .groupBy("bucket")
        .applyInArrow(_meet(hot), _MET)
        .groupBy("kind", "a", "b")
        .agg(F.when(F.col("kind") == 0, F.min("c")).otherwise(F.sum("c")).alias("c"))
    )
    release(spark)
    near = cut(_candidates(met, sets))
    # First each set with the smaller one that looks nearest.
    first = near.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a")).select("a", "b")
    comp = cut(components(verify(docs, first)))
    release(spark)
    open_ = cut(_across(near.select("a", "b"), comp).join(first, ["a", "b"], "left_anti"))
    comp = cut(components(stars(comp).unionByName(verify(docs, open_))))
    release(spark)
    rest = _rest(docs, met, sets, comp)
    if rest is not None:
        comp = cut(components(stars(comp).unionByName(rest)))
        release(spark)
    comp = comp.groupBy(F.col("node").alias("rep")).agg(F.min("component").alias("component"))
    found = sets.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep")).join(comp, "rep", "left")
    classes = (
        sets.select("id", "f1", "f2", "n")
        .join(found, ["f1", "f2", "n"])
        .groupBy(F.col("id").alias("doc_id"))
        .agg(F.max("n").cast("long").alias("n_shingles"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    return docs.select(F.col("doc_id").cast("long")).join(classes, "doc_id", "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
